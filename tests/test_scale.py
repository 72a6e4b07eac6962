"""What keeps a step's work and its tasks in proportion to the input."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from gristmill import queries_text
from gristmill.operators import dedup, ranges, ranking, repos, search
from gristmill.sources import pages


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_keywords_are_found_by_words(spark):
    texts = ["LLM-server_for/RAGs", "brag rag2 ai's x", "stable  diffusion", "Stable-Diffusion models", "", None, "games", "µrag é rag", "a mcps mcp", "modelss"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    every = repos.CORE + repos.TOOLING + repos.WEAK + repos.AGAINST

    def plain(text: str) -> list[str]:
        low = re.sub("[-_/]+", " ", text.lower())
        return sorted(k for k in every if (k in low if " " in k else re.search(rf"(?<![a-z0-9]){re.escape(k)}s?(?![a-z0-9])", low)))

    got = frame.select("t", F.array_sort(repos.found(F.coalesce("t", F.lit("")), every)).alias("k")).collect()
    assert {r.t: r.k for r in got} == {t: plain(t or "") for t in texts}
    # one look at a text for all words, not one a keyword
    columns = "rank int, repo string, name string, description string, more string, topics array<string>, strict boolean"
    assert "RLIKE(" not in _plan(repos.judged(spark.createDataFrame([], columns)))


def test_repositories_of_one_small_file_are_dealt_out(spark):
    parts = [(i, f"o/r{i}", "llm server", "An AI agent", 1) for i in range(40)]
    views = {
        "repos": spark.createDataFrame(parts, "rank long, repo string, name string, description string, stars int").coalesce(1),
        "repo_metadata": spark.createDataFrame([(1, "More", 1)], "part long, description string, forks int"),
    }
    got = queries_text.flt_repo_relevance(views.__getitem__)
    assert "REPARTITION_BY_COL" in _plan(got) and got.count() == 40


def test_ranges_of_long_rows_are_small(spark, tmp_path):
    rows = spark.range(64).selectExpr("lpad(string(id), 4, '0') AS k", "repeat('x', 1000) AS body")
    table = ranges.RangeTable.created(rows, "k", f"file://{tmp_path}/t", range_bytes=4000)
    assert len(table.files) >= 12
    changed = table.patched(rows.select("k", F.lit("new").alias("body")))
    assert changed.rows().where("body = 'new'").count() == 64 and ranges.RangeTable.opened(spark, table.path) == changed
    # a range that grows by long rows is split, be they few
    grown = changed.upserted(spark.range(20).selectExpr("concat('0007-', lpad(string(id), 3, '0')) AS k", "repeat('y', 1000) AS body"))
    assert len(grown.files) > len(changed.files) and grown.rows().count() == 84
    # ranges meet in no task: as many files as ranges, each written by its own
    spread = ranges.RangeTable.created(rows, "k", f"file://{tmp_path}/u", range_rows=4)
    tasks = spread.patched(rows.select("k", F.lit("new").alias("body"))).rows().select(F.regexp_extract(F.input_file_name(), "part-([0-9]+)-", 1).alias("task")).distinct().count()
    assert tasks == len(spread.files)


def test_pages_are_sent_in_small_batches():
    n, html = 3000, "<p>" + "some words " * 200 + "</p>"
    batch = pa.RecordBatch.from_pydict({"page_id": [*range(n - 1), None], "html": [html] * (n - 1) + [None], "source_id": [""] * (n - 1) + [None]})
    got = list(pages._walked(iter([batch])))
    assert max(b.nbytes for b in got) < 2_500_000 and max(b.num_rows for b in got) <= 500
    ids, blocks = ([x for b in got for x in b.column(c).to_pylist()] for c in ("page_id", "blocks"))
    assert ids == [*range(n - 1), None] and blocks == [[" ".join(["some words"] * 200)]] * (n - 1) + [[]]


def test_a_batch_searched_once_writes_no_index(spark, monkeypatch):
    rows = [(f"a{i}", f"GPT robot {i % 3}", "x aa aaa" if i % 2 else "robots AI") for i in range(30)]
    frame = spark.createDataFrame(rows, "id string, title_original string, summary string").select("*", *[F.lit("").alias(c) for c in search.WEIGHTS if c not in ("title_original", "summary")])
    queries = spark.createDataFrame([(1, "gpt Robot"), (2, "aaa gpt"), (3, "ai robots"), (4, "none")], "query_id long, query string")
    found = [sorted(map(tuple, search.held_once(frame, queries, few).collect())) for few in (0, search.FEW_TERMS)]
    assert found[0] == found[1] and len(found[0]) == 30 + 30 + 15 + 15 + 15
    monkeypatch.setattr(search, "written", None)
    docs = frame.select("*", F.lit(None).cast("timestamp").alias("published_at"))
    got = {r["query"]: r.hits for r in queries_text.search_batch(lambda name: docs).collect()}
    assert got == {"gpt robot": 30}


def test_classes_of_events_have_short_names(spark):
    rows = [("a", "GPT-6 is out", "x"), ("b", "GPT-6 is out", "x"), ("c", "Other news", "x")]
    items = spark.createDataFrame(rows, "id string, title_original string, summary string").selectExpr("*", "'' AS title_cn", "'' AS why_it_matters", "TIMESTAMP '2024-01-01 00:00:00' AS published_at")
    got = {r.id: bytes(r["class"]) for r in dedup.event_features(items).collect()}
    assert got["a"] == got["b"] != got["c"] and {len(c) for c in got.values()} == {16}


def test_days_are_dealt_out_after_the_join_with_the_nth_scores(spark):
    """A deal by day itself is left out where the join before it is planned by day; if that turns into a broadcast while it runs, a day is read in several tasks."""
    items = spark.sql("SELECT string(id % 9) AS digest_date, string(id) AS id, double(id) AS base_score, timestamp'2026-01-01 00:00:00' AS published_at, 'c' AS company, 'other' AS topic, 's' AS source FROM range(90)")
    bound = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(bound, "-1")
    try:
        plan = ranking.diverse_top(items, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(bound)
    assert "Exchange" in plan[plan.index("MapInArrow") : plan.index("SortMergeJoin")]
