"""Event classes, links and clusters against plain forms."""

import datetime as dt
import random

import pytest

from gristmill.operators import dedup, graph

T0 = dt.datetime(2026, 1, 5)
SCHEMA = "id string, title_original string, title_cn string, summary string, why_it_matters string, published_at timestamp"
BODY = "The company described faster inference lower latency and broader access for enterprise customers worldwide"


def plain_below(edges):
    """Greedy clusters in id order: each joins the first cluster that holds one of its neighbours before it."""
    before, place = {}, {}
    for u, v in edges:
        before.setdefault(u, set()).add(v)
    for x in sorted({x for e in edges for x in e}):
        place[x] = min((place[m] for m in before.get(x, ())), default=x)
    return place


@pytest.mark.parametrize("kind", ["random", "chain", "clique", "star"])
def test_least_below(spark, kind):
    r = random.Random(2)
    edges = {
        "random": [(max(a, b), min(a, b)) for a, b in ((r.randrange(120), r.randrange(120)) for _ in range(130)) if a != b],
        "chain": [(i + 1, i) for i in range(150)],
        "clique": [(i, j) for i in range(30) for j in range(i)],
        "star": [(i, 50) for i in range(51, 90)] + [(50, 3), (89, 1)],
    }[kind]
    got = {x.node: x.least for x in graph.least_below(spark.createDataFrame(edges, "u long, v long"), most=14).collect()}
    assert got == plain_below(edges)


def test_no_edges(spark):
    assert graph.least_below(spark.createDataFrame([], "u long, v long")).count() == 0


def stories():
    """Few texts, told again and again over some days; ids are not in the order of time."""
    r = random.Random(5)
    texts = [("OpenAI unveils GPT-6 model", BODY), ("GPT-6 model unveiled by OpenAI", BODY + " soon"), ("OpenAI unveils GPT-5 model", BODY), ("Mecka raises v500m", ""), ("Plan passes and fails", BODY + " again"), ("Something else entirely", "Nobody knows what this says about gardens and their many keepers")]
    ids = r.sample(range(1000, 9999), 90)
    return [(str(i), t, "", b, "", T0 + dt.timedelta(hours=r.randrange(150))) for i, (t, b) in zip(ids, (r.choice(texts) for _ in ids), strict=True)]


def test_links_give_the_clusters_of_all_matches(spark):
    items = spark.createDataFrame(stories(), SCHEMA).repartition(4)
    events = dedup.event_classes(items)
    matches = [(m.b, m.a) for m in dedup.matches_of(events).collect()]
    links = [(e.u, e.v) for e in dedup.event_links(events).collect()]
    assert set(links) <= set(matches) and len(links) < len(matches)
    expected = plain_below(matches)
    got = {c.id: c.cluster for c in dedup.event_clusters(items, dedup.event_links(events)).collect()}
    assert got == {i: expected.get(i, i) for i, *_ in stories()}


def test_one_story_of_many_rows_stays_linear(spark):
    """20 000 equal rows within two days: one pair of classes, as many links as rows, one cluster."""
    items = spark.range(20_000).selectExpr("lpad(string(id), 6, '0') AS id", "'OpenAI unveils GPT-6 model' AS title_original", "'' AS title_cn", f"'{BODY}' AS summary", "'' AS why_it_matters", "timestamp'2026-01-05 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 1440) AS published_at")
    events = dedup.event_classes(items)
    links = dedup.event_links(events)
    assert events.pairs.count() == 1 and events.members.count() == 20_000 and links.count() == 19_999
    assert [c.cluster for c in dedup.event_clusters(items, links).select("cluster").distinct().collect()] == ["000000"]


def test_previous(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("b", 1, None), ("b", 2, "y"), ("a", 5, "z"), ("a", 6, None)]
    got = dedup.previous(spark.createDataFrame(rows, "k string, at int, member string").repartition(3), ["k"], "at", "member")
    assert sorted((r.k, r.at, r.before) for r in got.collect()) == [("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, "x"), ("a", 5, "x"), ("a", 6, "z"), ("b", 1, None), ("b", 2, None)]


@pytest.mark.parametrize("kind", ["dead ends", "random"])
def test_least_below_takes_few_rounds(spark, kind):
    """A way down of 150 steps, each with an end of its own that is smaller than the steps below it; and edges at random, over many small batches."""
    r = random.Random(7)
    edges = {
        "dead ends": [(f"{1000 + i}", f"{1000 + i - 1}" if i else "0000") for i in range(150)] + [(f"{1000 + i}", f"{900 - i:04}") for i in range(150)],
        "random": [(f"{max(a, b):04}", f"{min(a, b):04}") for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(700)) if a != b],
    }[kind]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "3")
    try:
        got = {x.node: x.least for x in graph.least_below(spark.createDataFrame(edges, "u string, v string"), most=14).collect()}
    finally:
        spark.conf.unset(name)
    assert got == plain_below(edges)
