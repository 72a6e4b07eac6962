"""Search by one pass over the texts and by a written index."""

import datetime as dt
import math

from gristmill.operators import search

T0 = dt.datetime(2026, 1, 5)
ROWS = [
    ("a", "GPT-6 robot", "robots walk", 0),
    ("b", "other", "a robot walks, a robot talks", 1),
    ("c", "nothing", "at all", 2),
    ("d", "it's \"quoted\" 100% \\Q odd \\E (x)", "aaaa banana", 3),
    ("e", "", None, 4),
    ("f", "GPT-6 robot", "robots walk", 5),
]


def frame(spark):
    rows = spark.createDataFrame([(i, t, s, T0 + dt.timedelta(hours=h)) for i, t, s, h in ROWS], "id string, title_original string, summary string, published_at timestamp")
    from pyspark.sql import functions as F

    return rows.select("*", *[F.lit("").alias(c) for c in search.WEIGHTS if c not in ("title_original", "summary")])


QUERIES = [(1, "Robot"), (2, "robot gpt-6"), (3, "it's \"quoted\" 100%"), (4, "aa ana"), (5, "\\Q odd"), (6, "at"), (7, "aaa"), (8, "nowhere robot"), (9, "")]


def times(text, term):
    return sum(text.startswith(term, i) for i in range(len(text)))


def plain():
    items = [(i, {"title_original": t.lower(), "summary": (s or "").lower()}, h) for i, t, s, h in ROWS]
    size = {i: sum(max(len(c) - 2, 0) for c in cols.values()) for i, cols, _ in items}
    mean, out = sum(size.values()) / len(size), []
    for q, text in QUERIES:
        terms = list(dict.fromkeys(text.lower().split()))
        if not any(len(t) >= 3 for t in terms):
            continue
        found = []
        for i, cols, h in items:
            if all(any(t in c for c in cols.values()) for t in terms):
                score = 0
                for t in (t for t in terms if len(t) >= 3):
                    df = sum(any(t in c for c in cols.values()) for _, cols, _ in items)
                    tf = sum(search.WEIGHTS[c] * times(v, t) for c, v in cols.items())
                    score += max(math.log((len(items) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
                found.append((-round(score, 9), -h, i))
        out += [(q, i, k + 1, len(found), -s) for k, (s, _, i) in enumerate(sorted(found))]
    return out


def test_ranked_with_and_without_an_index(spark, tmp_path):
    items, queries = frame(spark).cache(), spark.createDataFrame(QUERIES, "query_id int, query string")
    written = search.written(items, f"file://{tmp_path}/index", 8)
    for index in (None, search.postings(items)):
        got = search.ranked(items, queries, index=index).collect()
        assert sorted((r.query_id, r.id, r.place, r.total, round(r.score, 9)) for r in got) == sorted(plain())
    near = search.near(queries, written, 8)
    assert {(r.term, r.id) for r in near.collect()} == {(r.term, r.id) for r in search.near(queries, search.postings(items)).collect()}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [" in plan and "dynamicpruning" in plan.lower()


def test_pages_of_hits(spark):
    items, queries = frame(spark), spark.createDataFrame([(1, "robot")], "query_id int, query string")
    first = search.hits(items, queries, limit=2).orderBy("place").collect()
    second = search.hits(items, queries, limit=2, offset=2).collect()
    assert [(r.id, r.place, r.total) for r in first] == [("f", 1, 3), ("a", 2, 3)] and [(r.id, r.place) for r in second] == [("b", 3)]
    assert first[0].snippet == "robots walk" and second[0].snippet == "a robot walks, a robot talks"
    assert search.hits(items, queries, limit=2, offset=10).count() == 0
    assert [search.page_size(x) for x in (None, 0, -3, 7, 51)] == [20, 20, 20, 7, 50]


def test_no_items_and_no_queries(spark):
    items, queries = frame(spark), spark.createDataFrame([(1, "robot")], "query_id int, query string")
    assert search.ranked(items.limit(0), queries).count() == 0 and search.ranked(items, queries.limit(0)).count() == 0


def test_words_are_text(spark):
    assert [r.id for r in search.short_terms(frame(spark), ["it's"]).collect()] == ["d"]
    assert search.short_terms(frame(spark), ["') OR true --"]).count() == 0
