"""Bodies, listings, feeds, search by words and links of titles: golden rows."""

import datetime as dt

from pyspark.sql import functions as F

from gristmill.functions import quality, text
from gristmill.operators import bodies, dedup, ranking, search, tables
from gristmill.plans.digest import digest_windows, rebuild_changes, rebuilt
from gristmill.sources import feeds, listings, pages


def test_body_is_chosen_in_order(spark):
    rows = [
        (1, ("kept", "web", "good"), "f" * 700, "good", "p" * 300, "text/html", "good", "", None, "s"),
        (2, None, "f" * 600, "good", "p" * 300, "text/html", "good", "", None, "s"),
        (3, None, "f" * 600, "fallback", "p" * 200, "TEXT/HTML; charset=x", "good", "", None, "s"),
        (4, None, "f" * 599, "good", "p" * 199, "text/html", "good", "", None, "s"),
        (5, None, "f", "low", "p" * 300, "application/pdf", "good", "", None, "summary"),
        (6, None, None, None, "p" * 300, "text/html", "low", "noisy", None, "summary"),
        (7, None, "ab", None, None, None, None, None, "HTTP 403", "cd"),
        (8, None, "", None, " ", "text/html", None, None, None, None),
        (9, None, "", None, "p" * 300, None, "good", "", None, None),
    ]
    schema = "id int, cached struct<text: string, method: string, quality: string>, feed string, feed_verdict string, page string, page_type string, page_verdict string, page_reason string, page_error string, summary string"
    names = ("cached", "feed", "feed_verdict", "page", "page_type", "page_verdict", "page_reason", "page_error", "summary")
    got = spark.createDataFrame(rows, schema).select("id", bodies.selected(*[F.col(c) for c in names]).alias("b")).select("id", "b.*")
    found = {r.id: (r.method, len(r.text), r.error, r.from_cache) for r in got.collect()}
    assert found == {
        1: ("web", 4, None, True),
        2: ("rss_full", 600, None, False),
        3: ("web", 200, None, False),
        4: ("rss_summary", 599, "page too short (199 chars)", False),
        5: ("rss_summary", 7, "not HTML (application/pdf)", False),
        6: ("rss_summary", 7, "low quality page (noisy)", False),
        7: ("rss_summary", 2, "HTTP 403", False),
        8: ("none", 0, "empty body", False),
        9: ("web", 300, None, False),
    }
    assert bodies.stats(got).first().asDict() == {"candidates": 9, "rss_full": 1, "web": 3, "fallback": 5, "failed": 5, "rejected_low_quality": 1, "cache_hits": 1}


def test_batch_of_bodies(spark):
    long = " ".join(f"Sentence number {i} of a real article with its own words." for i in range(40))
    articles = spark.createDataFrame([("a", "u1", "sum", ""), ("b", "u2", "sum", f"<p>{long}</p>"), ("c", "u3", "", ""), ("d", "u4", "sum", None)], "id string, url string, summary string, feed_body string")
    fetched = spark.createDataFrame([("u1", f"<article><p>{long}</p><p>{long} More.</p></article>", "text/html", None), ("u2", "<p>x</p>", "text/html", None), ("u3", "", None, "timeout")], "url string, html string, content_type string, error string")
    cache = spark.createDataFrame([("u4", "kept", "web", "good")], "url string, text string, method string, quality string")
    got = {r.id: (r.method, r.error, r.from_cache) for r in pages.extracted(articles, fetched, cache).collect()}
    assert got == {"a": ("web", None, False), "b": ("rss_full", None, False), "c": ("none", "timeout", False), "d": ("web", None, True)}


def test_leading_title(spark):
    title = "A headline of some length here"
    cases = [(["# " + title.upper(), "x"], 1), (["A headline of some length", "x"], 1), (["A headline of so", "x"], 2), ([title + " and much more that makes it another headline", "x"], 2), ([title], 0), ([], 0), (["# ", "x"], 2)]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b array<string>").orderBy("i")
    assert [r.n for r in rows.select(F.size(text.without_title(F.col("b"), F.lit(title))).alias("n")).collect()] == [n for _, n in cases]
    assert rows.where("i = 0").select(F.size(text.without_title(F.col("b"), F.lit(None).cast("string"))).alias("n")).first().n == 2


def test_listings(spark):
    answers = [
        '{"results":[{"title":"t","url":"u1","score":0.5},{"link":"u2","publishedDate":"2024"},{"title":"no url"},5]}',
        '{"results":[]}',
        '{"other":[]}',
        '{"data":{"items":[{"url":"x","title":true}]}}',
        "not json",
        '{"results":"x","data":{"documents":{"results":[{"url":" y "}]}}}',
        None,
        '{"results":[1,2],"items":[{"url":"z"}]}',
    ]
    got = listings.results(spark.createDataFrame(list(enumerate(answers)), "id int, json string")).orderBy("id").collect()
    assert [(r.found, r.list_key, r.skipped_no_url, [(h["rank"], h.title, h.url, h.published, h.score) for h in r.hits]) for r in got] == [
        (True, "results", 2, [(1, "t", "u1", "", "0.5"), (2, "", "u2", "2024", "")]),
        (True, "results", 0, []),
        (False, "", 0, []),
        (True, "data.items", 0, [(1, "", "x", "", "")]),
        (False, "", 0, []),
        (True, "data.documents.results", 0, [(1, "", "y", "", "")]),
        (False, "", 0, []),
        (True, "items", 0, [(1, "", "z", "", "")]),
    ]


def test_link_cards(spark):
    html = """<html><body><div>
      <div class="card"><a href="/blog/a"><img alt="pic"></a><a href="/blog/a"><h3>Title A</h3><p>standfirst</p></a><p class="date x">Jan 3, 2024</p></div>
      <div class="card"><a href="/blog/b"><span>Head B Jan. 4, 2024 5 min read</span></a><time>Jan 4, 2024</time></div>
      <div><a href="/blog/tag/z">tag</a><time>Jan 5, 2024</time></div>
      <div><a href="/blog/c">C</a><time>soon</time></div>
      <div><a href="/blog/d"><img alt="Only a picture"></a><time>2024-01-06</time></div></div></body></html>"""
    rows = [(1, html), (2, "<p>nothing</p>"), (3, None), (4, "<a href='/blog/e'>E</a><p>undated</p>")]
    got = listings.link_cards(spark.createDataFrame(rows, "page_id long, html string"), "/blog/", "https://q.org").collect()
    day = lambda n: dt.datetime(2024, 1, n)
    assert {(r.page_id, r.url, r.title, r.published_at, r.found) for r in got} == {
        (1, "https://q.org/blog/a", "Title A", day(3), True),
        (1, "https://q.org/blog/b", "Head B", day(4), True),
        (1, "https://q.org/blog/d", "Only a picture", day(6), True),
        (2, None, None, None, False),
        (3, None, None, None, False),
    }


def test_feeds(spark):
    rss = "<rss><channel><title>x</title><item><title> A </title><link>/blog/a/</link><guid>g</guid><description>short</description><content:encoded>much longer body</content:encoded><pubDate>Wed, 3 Jan 2024 10:00:00 +0000</pubDate></item><item><title>B</title><link></link><guid>https://x.org/b</guid><pubDate>soon</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">C</title><link rel="self" href="/self"/><link href="https://y.org/c"/><id>urn:1</id><summary>sum</summary><content type="html">longer</content><updated>2024-01-05T01:02:03Z</updated></entry><entry><title>D</title><link href="/d"/><updated>2024-01-05T01:02:03Z</updated></entry></feed>'
    rows = [("rss", rss, "https://x.org/en"), ("atom", atom, None), ("bad", "<rss><channel><item>", None), ("empty", "<rss><channel></channel></rss>", None), ("text", "nonsense", None), ("null", None, None)]
    docs = spark.createDataFrame(rows, "source_id string, xml string, base_url string")
    assert {r.source_id: (r.failed, len(r["items"])) for r in feeds.parsed(docs).collect()} == {"rss": (False, 2), "atom": (False, 2), "bad": (True, 0), "empty": (False, 0), "text": (True, 0), "null": (True, 0)}
    assert {(r.title, r.url, r.body, r.valid) for r in feeds.feed_items(docs).collect()} == {("A", "https://x.org/blog/a/", "much longer body", True), ("B", "https://x.org/b", "", False), ("C", "https://y.org/c", "longer", True), ("D", None, "", False)}


def test_search_by_words(spark):
    columns = list(search.WEIGHTS)
    rows = [("a", "AI chips"), ("b", "airline chips"), ("c", "芯片 and AI"), ("d", None)]
    items = spark.createDataFrame([(i, *[t if c == "title_cn" else "" for c in columns]) for i, t in rows], "id string, " + ", ".join(f"{c} string" for c in columns))
    queries = spark.createDataFrame([(1, "ai"), (2, "AI 芯片"), (3, "chips airline"), (4, "chip")], "query_id long, query string")
    assert {(r.query_id, r.id) for r in search.by_words(items, queries).collect()} == {(1, "a"), (1, "c"), (2, "c"), (3, "b")}
    assert {(r.query_id, r.id) for r in search.matches(items, queries).collect()} == {(3, "b"), (4, "a"), (4, "b")}
    assert search.matches(items, queries.limit(0)).count() == 0


def test_title_links_hold_all_pairs(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [0, 1, 47, 48, 96, 97, 200, 248, 248, 297]
    rows = [(i, "Same: title", start + dt.timedelta(hours=h)) for i, h in enumerate(hours)] + [(50, "other", start), (51, "", start), (52, "same title", None)]
    links = {(r.a, r.b) for r in dedup.title_links(spark.createDataFrame(rows, "doc_id long, title string, published_at timestamp")).collect()}
    assert links == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 7), (7, 8)}


def test_merge_evidence(spark):
    matches = spark.createDataFrame([("a", "b", "r1", 0.5), ("b", "c", "r2", 0.6), ("a", "d", "r3", 0.7)], "a string, b string, reason string, score double")
    clusters = spark.createDataFrame([(x, "a") for x in "abcde"], "id string, cluster string")
    winners = spark.createDataFrame([("a", "d")], "cluster string, id string")
    got = {r.id: (r.winner, r.reason, r.score) for r in dedup.merge_evidence(matches, clusters, winners).collect()}
    assert got == {"a": ("d", "r3", 0.7), "b": ("d", "r1", 0.5), "c": ("d", "r2", 0.6), "e": ("d", "transitive_cluster", 0.0)}


def test_selection_counts(spark):
    rows = [(f"u{i}", d, 1.0 - i / 100) for i, d in enumerate("aaabbcccd")]
    docs = spark.createDataFrame(rows, "url string, domain string, rrf_score double").withColumn("published_at", F.lit(None).cast("timestamp"))
    assert tuple(ranking.selection_counts(docs, 2, 5).first()) == (5, 1, 3)
    assert tuple(ranking.selection_counts(docs.limit(0), 2, 5).first()) == (0, 0, 0)


def test_rebuild(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("a", at(1, 5), 90), ("b", at(1, 23), 10), ("c", at(2, 1), 50), ("d", at(2, 23), 60), ("late", at(1, 6), 99)]
    items = spark.createDataFrame(rows, "id string, published_at timestamp, importance_score int").withColumns({"source_type": F.lit("media"), "source": F.col("id"), "company": F.lit(""), "topic": F.lit("other"), "content_extraction_method": F.lit(""), "content_original": F.lit("")})
    links = spark.createDataFrame([("2024-01-01", "a", 0), ("2024-01-01", "b", 1), ("2024-01-02", "c", 0), ("2024-01-02", "d", 1)], "digest_date string, news_id string, position int")
    windows = digest_windows(links, items)
    assert {(r.digest_date, r.window_start, r.window_end) for r in windows.collect()} == {("2024-01-01", at(1, 23) - dt.timedelta(days=1), at(1, 23)), ("2024-01-02", at(1, 23), at(2, 23))}
    new = rebuilt(items, windows, 2)
    assert {(r.digest_date, r.news_id, r.position) for r in new.collect()} == {("2024-01-01", "late", 0), ("2024-01-01", "a", 1), ("2024-01-02", "d", 0), ("2024-01-02", "c", 1)}
    assert {tuple(r) for r in rebuild_changes(links, new).collect()} == {("added", "2024-01-01", "late"), ("removed", "2024-01-01", "b")}
    stored = tables.replaced(links, new.select(*links.columns), "digest_date")
    assert rebuild_changes(stored, new).count() == 0


def test_bound_quality(spark):
    noisy = "\n\n".join(["Share this article", "Related posts", "Read more"] + ["A long enough paragraph of an article, with words that are not furniture. " * 8])
    rows = spark.createDataFrame([(1, noisy), (2, ""), (3, None), (4, "short")], "i int, t string")
    got = {r.i: (r.verdict, r.reason) for r in rows.select("i", quality.quality(F.col("t"), F.lit("web")).alias("q")).select("i", "q.*").collect()}
    assert got == {1: ("low", "noisy"), 2: ("fallback", "empty"), 3: ("fallback", "empty"), 4: ("fallback", "too_short")}
