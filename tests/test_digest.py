"""The digest operators on small golden rows, and against plain versions of the sequential ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import quality, rules, text, times, urls
from gristmill.operators import dedup, graph, ranking, repos, search, tables
from gristmill.sources import feeds, pages
from gristmill.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def one(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://Example.COM/a/?utm_source=x&b=2#top", "https://example.com/a?b=2"),
        ("http://u:p@h.org:8080/", "http://h.org:8080/"),
        ("http://h.org/?a=&b", "http://h.org/?a=&b="),
        ("http://h.org/x?q=a b*~", "http://h.org/x?q=a+b%2A~"),
        ("not a url#frag", "not a url"),
        ("HTTP://münchen.de/ü", "http://münchen.de/ü"),
        ("http://h.org?UTM_Medium=1", "http://h.org"),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, [url], urls.canonical_url) == [expected]


def test_windows(spark):
    rows = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h) if h is not None else None) for k, h in enumerate([0, 1, 24, 25, None])], "k int, t timestamp")
    start, end = F.lit(T0), F.lit(T0 + dt.timedelta(hours=24))
    assert [r.x for r in rows.orderBy("k").select(times.in_window(F.col("t"), start, end).alias("x")).collect()] == [False, True, True, False, False]
    assert [r.x for r in rows.orderBy("k").select(times.within_hours(F.col("t"), end, 24).alias("x")).collect()] == [True, True, True, False, False]
    assert [r.x for r in rows.orderBy("k").select(times.within_hours(F.col("t"), end, 24, closed=False).alias("x")).collect()] == [False, True, True, False, False]


def test_times(spark):
    assert one(spark, ["Mon, 01 Jan 2024 10:00:00 +0000", "2024-01-01T10:00:00Z", "x", None], times.published) == [T0.replace(hour=10)] * 2 + [None] * 2
    assert one(spark, ["Jan 1, 2024", "January 1, 2024", "Jan. 1, 2024", "2024-01-01", "soon"], times.english_date) == [T0] * 4 + [None]
    got = one(spark, ["1704067200", "1704067200000", "2024-01-01", "2024年1月1日", "3 hours ago"], times.page_time)
    # a date alone is a day of the app's zone, eight hours ahead
    day = T0 - dt.timedelta(hours=8)
    assert [g.at for g in got] == [T0, T0, day, day, None] and [g.has_time for g in got] == [True, True, False, False, False]


def test_labels(spark):
    assert one(spark, ["chip export ban", "NVIDIA launches a chip", "metadata only", "GPT-6 pricing", "发布 混元"], lambda c: rules.topic(c)) == ["policy", "hardware", "other", "business", "model_release"]
    assert one(spark, ["metadata", "Meta ships", "google and meta", "阿里云"], lambda c: rules.company(c)) == ["", "Meta", "Google DeepMind", "Alibaba Qwen"]
    assert one(spark, ["robot and robotics", "robot and cloud", "AI cloud", "said email", "Hunyuan3D", "just AI"], lambda c: rules.topical(c, F.lit(""))) == [False, True, True, False, True, False]


def test_tokens(spark):
    assert [set(x) for x in one(spark, ["The GPT-6 v4.1 a 5 2026 released.", "发布模型 x", "", None], text.tokens)] == [{"gpt-6", "v4.1", "5", "2026"}, {"发布", "布模", "模型"}, set(), set()]
    assert one(spark, ["a fails", "it passes"], lambda c: text.opposed(text.stances(text.tokens(c)), F.lit(1 << 1))) == [True, False]
    assert one(spark, ["  x" + "y" * 300 + " needle " + "z" * 100], lambda c: text.snippet(c, F.array(F.lit("needle"))))[0].startswith("…")


def test_quality(spark):
    prose = "\n\n".join(f"Sentence number {i} goes on and on about many different things of note." for i in range(9))
    got = one(spark, ["", "short", prose, "Share\n\nSubscribe\n\n" * 40 + prose[:30], "\n\n".join([prose[:60]] * 12), "label " * 90], lambda c: quality.quality(c, F.lit("web")))
    assert [g.reason for g in got] == ["empty", "too_short", "", "noisy", "repetitive", "menu_like"]


def articles(spark, rows):
    return spark.createDataFrame(rows, "source_id string, source_type string, title string, url string, published_at timestamp")


def sources(spark):
    return spark.createDataFrame([("a", "A", 10), ("b", "B", 20)], "source_id string, name string, priority int")


def test_url_winner(spark):
    rows = [("b", "media", "t", "http://x/1", T0), ("z", "media", "t", "http://x/1#f", T0), ("a", "media", "t", "http://x/1/", None), ("b", "official", "t", "http://x/2", T0)]
    got = dedup.by_url(articles(spark, rows), sources(spark)).select("source_id", "canonical_url").collect()
    assert sorted((r.source_id, r.canonical_url) for r in got) == [("a", "http://x/1"), ("b", "http://x/2")]


@pytest.mark.parametrize("seed", range(3))
def test_title_clusters(spark, seed):
    r = random.Random(seed)
    rows = [("a", "media", r.choice(["One!", "one", "Two", ""]), f"http://x/{i:03}", T0 + dt.timedelta(hours=r.randrange(400)) if r.random() < 0.9 else None) for i in range(60)]
    r.shuffle(rows)
    clusters = []
    for row in sorted(rows, key=lambda x: (x[2].lower().strip("!"), x[3])):
        key = row[2].lower().strip("!")
        fits = next((c for c in clusters if key and row[4] and any(m[2].lower().strip("!") == key and m[4] and abs(m[4] - row[4]) <= dt.timedelta(hours=48) for m in c)), None)
        fits.append(row) if fits else clusters.append([row])
    got = {}
    for x in dedup.by_title(dedup.by_url(articles(spark, rows), sources(spark))).collect():
        got.setdefault(x.cluster, set()).add(x.url)
    assert sorted(map(sorted, got.values())) == sorted(sorted(m[3] for m in c) for c in clusters)


def items(spark, rows):
    return spark.createDataFrame(rows, "id string, title_original string, title_cn string, summary string, why_it_matters string, published_at timestamp, source string, source_type string, importance_score int")


def test_events(spark):
    body = "The company described faster inference lower latency and broader access for enterprise customers worldwide"
    rows = [
        ("1", "OpenAI unveils GPT-6 model", "", body, "", T0, "A", "official", 70),
        ("2", "GPT-6 model unveiled by OpenAI", "", body + " soon", "", T0 + dt.timedelta(hours=48), "B", "media", 90),
        ("3", "OpenAI unveils GPT-5 model", "", body, "", T0, "B", "media", 90),
        ("4", "OpenAI unveils GPT-6 model", "", body, "", T0 + dt.timedelta(hours=48, seconds=1), "B", "media", 90),
        ("5", "OpenAI unveils GPT-6 model", "", body, "", None, "B", "media", 90),
        ("6", "Mecka raises 500m", "", "", "", T0, "B", "media", 90),
        ("7", "Mecka raises v500m", "", "", "", T0, "B", "media", 90),
    ]
    frame = items(spark, rows)
    matches = dedup.match_events(frame)
    assert {(r.a, r.b) for r in matches.collect()} == {("1", "2"), ("2", "4")}
    clusters = {r.id: r.cluster for r in dedup.event_clusters(frame, matches).collect()}
    assert clusters == {"1": "1", "2": "1", "3": "3", "4": "1", "5": "5", "6": "6", "7": "7"}
    winners = dedup.event_winners(frame, dedup.event_clusters(frame, matches), sources(spark)).where("cluster = '1'").first()
    assert (winners.id, winners.cluster_size) == ("1", 3)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    to = list(range(80))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        to[b] = a
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if e[0] != e[1] or n in got}


@pytest.mark.parametrize("seed", range(2))
def test_media_caps(spark, seed):
    r = random.Random(seed)
    rows = [(f"i{k:02}", "t", "", "", "", T0 + dt.timedelta(hours=r.randrange(9)) if r.random() < 0.9 else None, r.choice("PQRS"), r.choice(["media", "media", "official"]), r.choice([None, 50, 60, 70, 90])) for k in range(40)]
    order = sorted((x for x in rows if x[7] == "media" and (x[8] or 0) >= 60), key=lambda x: (-x[8], -(x[5] or dt.datetime(1, 1, 1)).timestamp() if x[5] else float("inf"), x[0]))
    kept, each, reasons = 0, {}, {}
    for x in order:
        if each.get(x[6], 0) >= 2:
            reasons[x[0]] = "per_source_cap"
        elif kept >= 5:
            reasons[x[0]] = "total_cap"
        else:
            kept, each[x[6]], reasons[x[0]] = kept + 1, each.get(x[6], 0) + 1, "kept"
    got = {x.id: x.reason for x in ranking.media_decisions(items(spark, rows)).collect()}
    assert all(got[k] == v for k, v in reasons.items())


def plain_diverse(rows):
    """Each pick looks at all rows that are left."""
    left, seen, out = list(rows), {}, []
    while left:
        def key(r):
            i, score, us, company, topic, source = r
            cost = 3.0 * (seen.get(("c", company), 0) if company else 0) + 2.0 * (seen.get(("t", topic), 0) if topic != "other" else 0) + (seen.get(("s", source), 0) if source else 0)
            return -(score - min(cost, 8.0)), -(us if us is not None else float("-inf")), i

        best = min(left, key=key)
        left.remove(best)
        out.append((best[0], -key(best)[0]))
        for k in zip("cts", best[3:], strict=True):
            seen[k] = seen.get(k, 0) + 1
    return out


def test_diverse_against_a_plain_version(spark):
    """Ties in score and time, rows without time, company or source, and the topic that costs nothing."""
    r = random.Random(4)
    rows = [(f"i{k:03}", r.choice([50.0, 51.0, 60.5, r.random() * 100]), r.choice([None, 5, r.randrange(100)]), r.choice(["", "A", "B", None]), r.choice(["other", "chips", "law"]), r.choice(["", "s1", "s2", "s3"])) for k in range(240)]
    days = [("2026-01-01", *x) for x in rows[:200]] + [("2026-01-02", *x) for x in rows[200:]]
    frame = spark.createDataFrame(days, "digest_date string, id string, base_score double, at int, company string, topic string, source string").withColumn("published_at", F.timestamp_micros("at"))
    got = sorted(ranking.diverse(frame).collect(), key=lambda x: (x.digest_date, x["rank"]))
    for day, part in (("2026-01-01", rows[:200]), ("2026-01-02", rows[200:])):
        assert [(x.id, x.final_score) for x in got if x.digest_date == day] == plain_diverse(part)
        assert [x["rank"] for x in got if x.digest_date == day] == list(range(1, len(part) + 1))


def test_a_digest_of_many_rows(spark):
    rows = spark.range(100_000).selectExpr("'d' AS digest_date", "string(id) AS id", "double(hash(id) % 1000) / 10 AS base_score", "timestamp_micros(id) AS published_at", "concat('c', id % 30) AS company", "concat('t', id % 9) AS topic", "concat('s', id % 20) AS source")
    got = ranking.diverse(rows).agg(F.count_distinct("id").alias("n"), F.max("rank").alias("last")).first()
    assert (got.n, got["last"]) == (100_000, 100_000)


def test_diverse_order_and_its_top(spark):
    r = random.Random(3)
    rows = [(f"d{k % 2}", f"i{k:02}", r.random() * 30, T0 + dt.timedelta(hours=r.randrange(5)), r.choice(["", "X", "Y"]), r.choice(["other", "agent"]), r.choice("AB")) for k in range(60)]
    frame = spark.createDataFrame(rows, "digest_date string, id string, base_score double, published_at timestamp, company string, topic string, source string")
    whole = {(x.digest_date, x.id): x["rank"] for x in ranking.diverse(frame).collect()}
    top = {(x.digest_date, x.id): x["rank"] for x in ranking.diverse_top(frame, 5).collect()}
    assert top == {k: v for k, v in whole.items() if v <= 5} and len(top) == 10


def test_reciprocal_ranks(spark):
    hits = spark.createDataFrame([("u", "q", 3, "d", T0), ("u", "q", 1, "d", T0), ("u", "p", 2, "d", T0)], "url string, query string, rank int, domain string, published_at timestamp")
    row = ranking.reciprocal_ranks(hits).first()
    assert row.n_queries == 2 and row.rrf_score == pytest.approx(1 / 61 + 1 / 62)


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", "body"), (2, "b", "")], "id int, title string, body string")
    new = spark.createDataFrame([(1, "A", ""), (3, "c", "x")], "id int, title string, body string")
    got = {r.id: (r.title, r.body) for r in tables.upserted(old, new, "id", ("body",), "body").collect()}
    assert got == {1: ("A", "body"), 2: ("b", ""), 3: ("c", "x")}
    again = tables.upserted(tables.upserted(old, new, "id", ("body",), "body"), new, "id", ("body",), "body")
    assert {r.id: (r.title, r.body) for r in again.collect()} == got
    assert {r.id: r.created for r in tables.inserted(old.select("id"), new.select("id"), ["id"]).collect()} == {1: False, 2: False, 3: True}
    assert [r.id for r in tables.orphans(new, old, "id", "id").collect()] == [3]


def test_repositories(spark):
    rows = [
        (1, "o/llm-server", "llm-server", "serves", None, [], True),
        (2, "o/x", "x", "An agent model", "a chat tool", ["agents"], False),
        (3, "o/x", "x", "MCP tools", "", ["llm"], False),
        (4, "o/crm", "crm", "AI agent", "", ["llm"], False),
        (5, "o/y", "y", "Machine learning game", "", [], False),
    ]
    frame = spark.createDataFrame(rows, "rank int, repo string, name string, description string, more string, topics array<string>, strict boolean")
    assert {r["rank"]: r.route for r in repos.judged(frame).collect()} == {1: "explicit-name", 2: "none", 3: "core", 4: "none", 5: "core"}


def test_search(spark):
    columns = list(search.WEIGHTS)
    rows = [("a", "GPT-6 robot", "robots walk"), ("b", "other", "a robot walks"), ("c", "nothing", "at all")]
    frame = spark.createDataFrame([(i, t, s, T0) for i, t, s in rows], "id string, title_original string, summary string, published_at timestamp")
    frame = frame.select("*", *[F.lit("").alias(c) for c in columns if c not in ("title_original", "summary")])
    queries = spark.createDataFrame([(1, "Robot"), (2, "robot gpt-6"), (3, 'it\'s "quoted" %')], "query_id long, query string")
    got = search.ranked(frame, queries).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "a"), (1, "b"), (2, "a")]
    assert [r.id for r in search.short_terms(frame, ["at"]).collect()] == ["c"]


def test_pages(spark):
    html = "<html><head><title>T one</title><script>x</script></head><body><nav>menu</nav><h1>T one</h1><p>First <b>bold</b> text</p><ul><li>item</li></ul><div class='ad-slot big'>buy</div><div id='nav_main'>nav</div><div class='shadow header'>kept header</div><div role='dialog'>d</div><div aria-hidden='true'>h</div><blockquote>said</blockquote><footer>f</footer></body>"
    row = pages.bodies(spark.createDataFrame([(1, html), (2, None), (3, "<p>open <div>never")], "page_id long, html string")).orderBy("page_id").collect()
    assert (row[0].title, row[0].body) == ("T one", "First bold text\n\n- item\n\nkept header\n\n> said") and row[1].body == "" and "never" in row[2].body


def test_feeds(spark):
    xml = "<channel><item><title>A</title><link>http://x</link><description>d</description><pubDate>Mon, 1 Jan 2024 00:00:00 +0000</pubDate></item><item><title></title><guid>http://y</guid></item></channel>"
    got = feeds.feed_items(spark.createDataFrame([("s", xml)], "source_id string, xml string")).collect()
    assert [(r.url, r.published_at, r.valid) for r in got] == [("http://x", T0, True), ("http://y", None, False)]


def test_streams(spark, tmp_path):
    rows = [("http://x", T0), ("http://x", T0 + dt.timedelta(hours=1)), ("http://y", T0)]
    spark.createDataFrame(rows, "url string, published_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, published_at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.url for r in jobs.finished(jobs.first_urls(stream).select("url"), f"file://{tmp_path}").collect()) == ["http://x", "http://y"]
