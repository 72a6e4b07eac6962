"""Keyed state of titles against the batch form, with late rows and expiry."""

import os
import random
import time
from datetime import datetime, timedelta

import pyarrow as pa

from gristmill.operators import dedup
from gristmill.streaming import jobs

START = datetime(2026, 1, 1)
SCHEMA = "title string, source_type string, priority int, published_at timestamp, canonical_url string, url string"


def row(title, hours, url, source_type="media", priority=5):
    return (title, source_type, priority, START + timedelta(hours=hours), url, url)


def streamed(spark, folder, batches):
    """One file a batch, read in turn."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
        for name in os.listdir(f"{folder}/in/{i}"):
            os.utime(f"{folder}/in/{i}/{name}", (time.time() - 1000 + i * 10,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = jobs.finished(jobs.title_clusters(stream), f"file://{folder}")
    return sorted((r.title_key, r.cluster.split("\n")[1], r.url, r.rows) for r in found.collect() if r.title_key != "the end")


END = [row("the end", 10_000, "z")]


def test_one_batch_gives_the_clusters_of_the_batch_form(spark, tmp_path):
    """A chain over 48 hours whose order by URL is not that of time, an official row that wins, titles that differ in marks only."""
    rows = [row("A story!", h, u) for h, u in ((80, "a"), (0, "b"), (40, "c"), (47, "d"), (200, "e"), (230, "f"))] + [row("a STORY", 41, "g", "official"), row("other", 0, "h"), row("", 0, "i")]
    batch = dedup.by_title(spark.createDataFrame(rows, SCHEMA))
    winners = {r.cluster: r.url for r in dedup.title_winners(batch).where("title <> ''").collect()}
    sizes = {r.cluster: r["count"] for r in batch.where("title <> ''").groupBy("cluster").count().collect()}
    got = streamed(spark, tmp_path, [rows + END])
    assert [(c, u, n) for _, c, u, n in got] == sorted(((c.split("\n")[1], winners[c], n) for c, n in sizes.items()), key=lambda x: ([k for k, c, *_ in got if c == x[0]], x[0]))
    assert {n for *_, n in got} >= {1, 2} and ("a story", "a", "g", 4) in got


def test_rows_join_clusters_of_earlier_batches(spark, tmp_path):
    """In order, clusters go on over batches; after the horizon a title begins anew; a better row of a later batch wins."""
    batches = [[row("t", 0, "b")], [row("t", 40, "a", "official")], [row("t", 88, "c")], [row("t", 200, "d")], END]
    assert streamed(spark, tmp_path, batches) == [("t", "b", "a", 3), ("t", "d", "d", 1)]


def test_late_rows_are_dropped_and_told_clusters_are_gone(spark, tmp_path):
    """A row behind the watermark joins nothing; a title told before has a cluster of its own later."""
    batches = [[row("t", 0, "a")], [row("u", 100, "b")], [row("t", 10, "c"), row("t", 101, "d")], END]
    assert streamed(spark, tmp_path, batches) == [("t", "a", "a", 1), ("t", "d", "d", 1), ("u", "b", "b", 1)]


def _scan(times):
    """Names of dedup._clustered for times (hours) of one chain in scan order."""
    us = [int(t * 3_600_000_000) for t in times]
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(len(us))], "title_key": ["t"] * len(us), "_chain": [1] * len(us), "us": us})
    return next(dedup._clustered([batch])).column("cluster").to_pylist()


def test_scan_against_a_plain_version():
    r = random.Random(3)
    for _ in range(300):
        times, clusters, names = [r.choice([r.randrange(900), r.randrange(900) / 7, 48 * r.randrange(-9, 12)]) for _ in range(r.randrange(120))], [], []
        for i, t in enumerate(times):
            found = next((c for c in clusters if any(abs(t - x) <= 48 for x in c[1])), None)
            if found is None:
                clusters.append(found := (str(i), []))
            found[1].append(t)
            names.append(found[0])
        times = [round(t * 3_600_000_000) / 3_600_000_000 for t in times]
        assert _scan(times) == names


def test_a_scan_of_many_clusters_stays_linear():
    times = [100 * i for i in range(20_000)]
    random.Random(4).shuffle(times)
    begun = time.process_time()
    assert len(set(_scan(times))) == 20_000 and time.process_time() - begun < 5
