"""The refresh of a digest by batches: what is linked before stays, empty batches keep it, and a batch that is run again makes the same."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from gristmill.plans.digest import merged
from gristmill.streaming import jobs

T0 = dt.datetime(2026, 1, 5)
SCHEMA = "id string, doc_id long, source_id string, source string, source_type string, title_original string, title_cn string, summary string, why_it_matters string, url string, published_at timestamp, importance_score int, content_extraction_method string, content_original string"
BODY = "The company described faster inference lower latency and broader access for enterprise customers worldwide"


def row(i, title, hours=1.0, body="", kind="official", url=None, importance=70):
    return (i, 1, "s", "S", kind, title, "", body, "", url or f"https://x.org/{i}", T0 + dt.timedelta(hours=hours), importance, "web", "")


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("s", "S", 1)], "source_id string, name string, priority int")


def fed(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{number}")
    for name in os.listdir(f"{folder}/in/{number}"):
        os.utime(f"{folder}/in/{number}/{name}", (time.time() - 1000 + number * 10,) * 2)


def refresh(spark, folder, sources, plan=None, projects=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    start, end = F.lit(T0).cast("timestamp"), F.lit(T0 + dt.timedelta(hours=24)).cast("timestamp")
    jobs.refreshed(stream, f"file://{folder}/digest", plan or (lambda linked, batch: merged(linked, batch, sources, start, end)), projects)


def links(spark, folder):
    return [r.id for r in jobs.linked(spark, f"file://{folder}/digest").orderBy("rank").collect()]


def test_batches_are_merged_with_what_is_linked(spark, tmp_path, sources):
    """Equal URLs, titles and events fold into what is linked; rows out of the window are archived only; media are capped."""
    fed(spark, tmp_path, 0, [row("b", "OpenAI unveils GPT-6 model", body=BODY, importance=90), row("c", "Chips cost more", body="Nobody knows what chips will cost")])
    fed(spark, tmp_path, 1, [row("a", "GPT-6 model unveiled by OpenAI", 2, BODY + " soon", importance=80), row("d", "Robots learn to walk", 3, "They walk over stones and stairs"), row("e", "Too late", 30), row("f", "Low media", 4, kind="media", importance=10)])
    refresh(spark, tmp_path, sources)
    assert sorted(links(spark, tmp_path)) == ["b", "c", "d"] and links(spark, tmp_path)[0] == "b"
    sizes = {r.id: r.cluster_size for r in jobs.linked(spark, f"file://{tmp_path}/digest").collect()}
    assert sizes == {"b": 2, "c": 1, "d": 1}
    assert spark.read.parquet(f"file://{tmp_path}/digest/archive").count() == 6


def test_empty_batches_keep_links_and_projects(spark, tmp_path, sources):
    fed(spark, tmp_path, 0, [row("a", "One story here")])
    fed(spark, tmp_path, 1, [row("z", "Out of the window", 50)])
    refresh(spark, tmp_path, sources, projects=lambda batch: batch.where("id = 'a'").select(F.lit("repo").alias("repo")))
    assert links(spark, tmp_path) == ["a"] and [r.repo for r in jobs.linked_projects(spark, f"file://{tmp_path}/digest").collect()] == ["repo"]
    state = jobs.committed(spark, f"file://{tmp_path}/digest")
    assert state["projects"] == 0


def test_a_batch_that_fails_in_the_middle_is_run_again_from_the_commit_before(spark, tmp_path, sources):
    """The second batch fails once its links are written, but before its commit: readers see the first; after the restart all is as without the failure."""
    fed(spark, tmp_path, 0, [row("a", "One story here")])
    refresh(spark, tmp_path, sources)
    fed(spark, tmp_path, 1, [row("b", "Another story there", 2)])

    def broken(batch):
        assert batch.where("id = 'b'").isEmpty(), "broken"
        return batch.limit(0).select("id")

    with pytest.raises(Exception, match="broken"):
        refresh(spark, tmp_path, sources, projects=broken)
    assert links(spark, tmp_path) == ["a"] and sorted(jobs.numbers_in(spark, f"file://{tmp_path}/digest/commits")) == [0]
    refresh(spark, tmp_path, sources)
    assert sorted(links(spark, tmp_path)) == ["a", "b"]
    assert spark.read.parquet(f"file://{tmp_path}/digest/archive").count() == 2
