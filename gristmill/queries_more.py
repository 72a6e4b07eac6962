"""Queries of table maintenance, lookups, orders, digest windows and the remaining statistics."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import quality, rules, text, times, urls
from gristmill.operators import bodies, dedup, ranking, search, tables
from gristmill.plans.digest import digest_windows, merged, rebuild_changes, rebuilt, steps
from gristmill.queries import HOST_SQL, _CANON, _CON, _FOUND_AT, _LABELS, _MEDIA, _NORMAL, _OUTCOMES, _REC, _SCORE, _SUMMARY, FROM, TO, View, _diverse_sql, _tokens_sql, at, event_view, kind_sql, labelled, outcomes, query, ranged, result_host, source_of_domain
from gristmill.queries_text import snippet_sql
from gristmill.sources import listings, pages
from gristmill.streaming import jobs

# Pairs that tell one event, by comparing all within 48 hours


def _any(column: str, words: tuple[str, ...]) -> str:
    return f"list_has_any({column}, [{', '.join(repr(w) for w in words)}])"


_OPPOSED = " OR ".join(f"({_any('a.bo', x)} AND {_any('b.bo', y)}) OR ({_any('a.bo', y)} AND {_any('b.bo', x)})" for x, y in text.OPPOSITES)
_DICE = "CASE WHEN len(a.{0}) = 0 OR len(b.{0}) = 0 THEN 0.0 ELSE 2.0 * CAST(len(list_intersect(a.{0}, b.{0})) AS DOUBLE) / (len(a.{0}) + len(b.{0})) END"
def matches_sql(items: str) -> str:
    """The pairs that tell one event, of a select of id, title_original, title_cn, summary, why_it_matters and published_at."""
    return rf"""WITH items AS ({items}),
texts AS (SELECT id, epoch_us(published_at) AS us, concat(coalesce(title_original, ''), ' ', coalesce(title_cn, '')) AS ttl, concat(coalesce(summary, ''), ' ', coalesce(why_it_matters, '')) AS bod FROM items WHERE published_at IS NOT NULL),
sets AS (SELECT *, {_tokens_sql('ttl')} AS tt, {_tokens_sql('bod')} AS bt, trim(bod) = '' AS bare, list_distinct(regexp_extract_all(lower(ttl), '[a-z]+[a-z0-9]*[.\-]?[0-9][a-z0-9._\-]*')) AS terms FROM texts),
boths AS (SELECT *, list_distinct(list_concat(tt, bt)) AS bo FROM sets),
f AS (SELECT *, list_filter(bo, lambda x: regexp_matches(x, '[0-9]')) AS ve, list_filter(bo, lambda x: regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^(19|20)[0-9][0-9]$') AND regexp_matches(x, '[a-z]')) AS fi FROM boths),
p AS (SELECT a.id AS a, b.id AS b, CAST(abs(a.us - b.us) AS DOUBLE) / 3600000000 AS hours_apart, {_DICE.format('tt')} AS title_similarity, {_DICE.format('bt')} AS body, a.bare OR b.bare AS bare, list_has_any(a.terms, b.terms) AS shared, list_has_any(a.fi, b.fi) AS figure
  FROM f AS a JOIN f AS b ON a.id < b.id AND abs(a.us - b.us) <= 172800000000 WHERE (len(a.ve) = 0 OR len(b.ve) = 0 OR list_has_any(a.ve, b.ve)) AND NOT ({_OPPOSED})),
r AS (SELECT *, CASE WHEN bare THEN CASE WHEN title_similarity >= 0.9 AND shared THEN 'title_similarity' END WHEN body < 0.62 THEN CASE WHEN body >= 0.45 AND title_similarity >= 0.7 AND figure THEN 'same_headline_and_figure' END
  WHEN title_similarity >= CASE WHEN shared THEN 0.3 ELSE 0.45 END THEN CASE WHEN shared THEN 'shared_term_text_similarity' ELSE 'text_similarity' END END AS reason FROM p)
SELECT a, b, reason, CASE WHEN bare THEN title_similarity ELSE (title_similarity + body) / 2 END AS score, title_similarity, hours_apart FROM r WHERE reason IS NOT NULL"""


MATCHES = matches_sql("SELECT id, title_original, title_cn, summary, '' AS why_it_matters, published_at FROM articles UNION ALL SELECT concat('b', id), title_original, title_cn, summary, '' AS why_it_matters, published_at + INTERVAL 5 HOUR FROM articles WHERE doc_id % 4 = 0")

# Sources and tables


@query("src_epoch_json", ["articles"], "SELECT id, CASE doc_id % 3 WHEN 0 THEN published_at WHEN 1 THEN published_at + INTERVAL 1 HOUR ELSE published_at + INTERVAL 2 HOUR END AS published_at, CASE WHEN doc_id % 2 = 0 THEN concat('slug-', doc_id) ELSE CAST(doc_id AS VARCHAR) END AS slug FROM articles WHERE published_at IS NOT NULL")
def src_epoch_json(v: View) -> DataFrame:
    """Listings written as JSON with a display, a publish and a create time, of which some lack the first ones, and read again."""
    n, s = F.col("doc_id"), F.unix_seconds("published_at")
    row = F.struct(
        n.alias("id"),
        F.when(n % 2 == 0, F.concat(F.lit("slug-"), n)).alias("customUrl"),
        F.when(n % 3 == 0, s).alias("displayPublishTime"),
        F.when(n % 3 <= 1, s + 3600).alias("publishedAt"),
        (s + 7200).alias("createdAt"),
    )
    text = v("articles").where("published_at IS NOT NULL").select("id", F.to_json(F.struct(F.struct(F.array(row).alias("list")).alias("data"))).alias("json"))
    read = text.select("id", F.from_json("json", "data struct<list: array<struct<id: bigint, customUrl: string, displayPublishTime: bigint, publishedAt: bigint, createdAt: bigint>>>").alias("j"))
    one = read.select("id", F.explode("j.data.list").alias("e"))
    return one.select("id", F.timestamp_seconds(F.coalesce("e.displayPublishTime", "e.publishedAt", "e.createdAt")).alias("published_at"), F.coalesce("e.customUrl", F.col("e.id").cast("string")).alias("slug"))


@query("sink_upsert_projects", ["repos"], "SELECT rank, repo, CASE WHEN rank % 4 = 0 THEN stars + 1000 ELSE stars END AS stars FROM repos")
def sink_upsert_projects(v: View) -> DataFrame:
    old = v("repos").select("rank", "repo", "stars")
    return ranged(old, "rank").upserted(old.where("rank % 4 = 0").withColumn("stars", F.col("stars") + 1000)).rows()


@query("sink_run_log", ["run_log"], r"SELECT run_id, CASE WHEN success THEN 'success' WHEN run_id % 2 = 0 THEN 'failed' ELSE 'running' END AS status, CASE WHEN success OR run_id % 2 = 0 THEN fetched END AS fetched, CASE WHEN success OR run_id % 2 = 0 THEN valid END AS valid, CASE WHEN run_id % 2 = 0 THEN nullif(substring(trim(regexp_replace(error, '\s+', ' ', 'g')), 1, 300), '') END AS error FROM run_log")
def sink_run_log(v: View) -> DataFrame:
    """An append-only log: a row at the start of a run, another with counts and a short error at its end; the latest counts."""
    runs = v("run_log").withColumn("success", F.coalesce("success", F.lit(False)))
    ended = runs.where("success OR run_id % 2 = 0")
    log = tables.run_started(runs.select("run_id", "started_at")).unionByName(tables.run_ended(ended.select("run_id", "started_at", "success", "fetched", "valid", "error")))
    return tables.latest_runs(log).select("run_id", "status", "fetched", "valid", "error")


@query("sink_add_columns", ["repos", "repo_metadata"], "SELECT repo, stars, NULL AS forks FROM repos UNION ALL SELECT repo, NULL, forks FROM repo_metadata")
def sink_add_columns(v: View) -> DataFrame:
    return v("repos").select("repo", "stars").unionByName(v("repo_metadata").select("repo", "forks"), allowMissingColumns=True)


@query("join_digest_projects", ["project_links", "repo_metadata"], "SELECT l.digest_date, r.repo, r.rank, coalesce(m.license, '') AS license FROM project_links AS l JOIN repos AS r ON l.rank = r.rank LEFT JOIN repo_metadata AS m ON r.rank = m.part")
def join_digest_projects(v: View) -> DataFrame:
    rows = v("project_links").join(v("repos").select("rank", "repo"), "rank").join(v("repo_metadata").select(F.col("part").alias("rank"), "license"), "rank", "left")
    return rows.select("digest_date", "repo", "rank", F.coalesce("license", F.lit("")).alias("license"))


@query("join_body_cache", ["articles"], "SELECT a.id, b.body IS NOT NULL AS cached, CASE WHEN b.body IS NULL THEN a.content_original ELSE b.body END AS body, CASE WHEN b.body IS NULL THEN a.content_extraction_method ELSE 'web' END AS method FROM articles AS a LEFT JOIN (SELECT url, min(content_original) AS body FROM articles WHERE content_extraction_method = 'web' AND length(content_original) >= 200 GROUP BY url) AS b ON a.url = b.url")
def join_body_cache(v: View) -> DataFrame:
    """Bodies fetched before, by URL and one a URL, are used again where they are long enough; else the row's own stays."""
    known = v("articles").where("content_extraction_method = 'web' AND length(content_original) >= 200").groupBy("url").agg(F.min("content_original").alias("cached_body"))
    rows, has = v("articles").join(known, "url", "left"), F.col("cached_body").isNotNull()
    return rows.select("id", has.alias("cached"), F.coalesce("cached_body", "content_original").alias("body"), F.when(has, "web").otherwise(F.col("content_extraction_method")).alias("method"))


@query("join_favorites", ["articles", "repos"], "SELECT 'news' AS item_type, id AS item_id, title_original AS title FROM articles WHERE doc_id % 50 = 0 UNION ALL SELECT 'project', CAST(rank AS VARCHAR), repo FROM repos WHERE rank % 50 = 0")
def join_favorites(v: View) -> DataFrame:
    """Favourites point into articles or projects by type; each type is joined with its own table."""
    articles, repos = v("articles"), v("repos")
    saved = articles.where("doc_id % 50 = 0").select(F.lit("news").alias("item_type"), F.col("id").alias("item_id")).unionByName(repos.where("rank % 50 = 0").select(F.lit("project").alias("item_type"), F.col("rank").cast("string").alias("item_id")))
    news = saved.where("item_type = 'news'").join(articles.select(F.col("id").alias("item_id"), F.col("title_original").alias("title")), "item_id")
    projects = saved.where("item_type = 'project'").join(repos.select(F.col("rank").cast("string").alias("item_id"), F.col("repo").alias("title")), "item_id")
    return news.unionByName(projects).select("item_type", "item_id", "title")


@query("join_existing_news", ["articles", "links"], "SELECT news_id, row_number() OVER (ORDER BY part, position, news_id) - 1 AS position FROM (SELECT news_id, min(part) AS part, min_by(position, part) AS position FROM (SELECT news_id, 0 AS part, position FROM links WHERE digest_date = '2024-01-03' UNION ALL SELECT id, 1, doc_id FROM articles WHERE published_at > TIMESTAMP '2024-01-03' AND published_at <= TIMESTAMP '2024-01-04') AS u GROUP BY news_id) AS w")
def join_existing_news(v: View) -> DataFrame:
    """The links of a date first, then the rows of its window, each id once: one day's rows, so one task numbers them."""
    old = v("links").where("digest_date = '2024-01-03'").select("news_id", F.lit(0).alias("part"), F.col("position").cast("long").alias("position"))
    new = v("articles").where(times.in_window(F.col("published_at"), at("2024-01-03 00:00:00"), at("2024-01-04 00:00:00"))).select(F.col("id").alias("news_id"), F.lit(1).alias("part"), F.col("doc_id").alias("position"))
    rows = dedup.first_by_key(old.unionByName(new), ["news_id"], F.col("part"), F.col("position"))
    return rows.select("news_id", (F.row_number().over(Window.orderBy("part", "position", "news_id")) - 1).alias("position"))


# Duplicates by event


def _clustered(v: View) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = event_view(v)
    events = dedup.event_classes(items)
    return items, dedup.matches_of(events), tables.stored(dedup.event_clusters(items, dedup.event_links(events)), "clusters")


#: Items in order of their ids: each takes the number of the first cluster that holds one of its matches, else its own.
def clusters_sql(items: str, matches: str) -> str:
    return f"""all_items AS ({items}),
matches AS ({matches}),
nodes AS (SELECT id, list(e) FILTER (WHERE e IS NOT NULL) AS earlier FROM (SELECT b AS id, a AS e FROM matches UNION ALL SELECT a, NULL FROM matches) AS n0 GROUP BY id),
steps AS (SELECT list([{{'id': id, 'earlier': coalesce(earlier, CAST([] AS VARCHAR[])), 'c': CAST(1 AS BIGINT)}}] ORDER BY id) AS rows FROM nodes),
reduced AS (SELECT list_reduce(rows, lambda acc, x: list_concat(acc, [{{'id': x[1].id, 'earlier': x[1].earlier, 'c': coalesce(list_min(list_transform(list_filter(acc, lambda p: list_contains(x[1].earlier, p.id)), lambda p: p.c)), len(acc) + 1)}}])) AS rows FROM steps WHERE len(rows) > 0),
named AS (SELECT rows[i].id AS id, rows[rows[i].c].id AS cluster FROM (SELECT rows, unnest(range(1, len(rows) + 1)) AS i FROM reduced) AS r1),
clusters AS (SELECT t.id, coalesce(n.cluster, t.id) AS cluster FROM all_items AS t LEFT JOIN named AS n ON t.id = n.id),
placed AS (SELECT t.*, c.cluster, count(*) OVER (PARTITION BY c.cluster) AS cluster_size, row_number() OVER (PARTITION BY c.cluster ORDER BY CASE source_type WHEN 'official' THEN 0 WHEN 'research' THEN 1 WHEN 'media' THEN 2 ELSE 3 END, coalesce(s.priority, 1000), coalesce(importance_score, -1) DESC, length(coalesce(summary, '')) + length(coalesce(why_it_matters, '')) DESC, published_at NULLS LAST, t.id) AS k
  FROM all_items AS t JOIN clusters AS c ON t.id = c.id LEFT JOIN (SELECT name, priority FROM sources) AS s ON t.source = s.name),
winners AS (SELECT * FROM placed WHERE k = 1)"""


_CLUSTERS = clusters_sql("SELECT id, doc_id, source_id, source, source_type, published_at, importance_score, summary, '' AS why_it_matters FROM articles UNION ALL SELECT concat('b', id), doc_id, 'src3', 'Source 3', source_type, published_at + INTERVAL 5 HOUR, importance_score, summary, '' AS why_it_matters FROM articles WHERE doc_id % 4 = 0", MATCHES)


@query("dedup_event", ["articles", "sources"], f"WITH {_CLUSTERS} SELECT id, cluster FROM clusters")
def dedup_event(v: View) -> DataFrame:
    return _clustered(v)[2]


@query("dedup_event_winner", ["articles", "sources"], f"WITH {_CLUSTERS} SELECT cluster, id, cluster_size FROM winners")
def dedup_event_winner(v: View) -> DataFrame:
    items, _, clusters = _clustered(v)
    return dedup.event_winners(items, clusters, v("sources")).select("cluster", "id", "cluster_size")


@query("dedup_event_sizes", ["articles", "sources"], f"WITH {_CLUSTERS} SELECT cluster, count(*) AS size FROM clusters GROUP BY cluster")
def dedup_event_sizes(v: View) -> DataFrame:
    return _clustered(v)[2].groupBy("cluster").agg(F.count("*").alias("size"))


@query("dedup_event_reason", ["articles", "sources"], f"""WITH {_CLUSTERS}, inside AS (SELECT m.a, m.b, m.reason, m.score FROM matches AS m JOIN clusters AS x ON m.a = x.id JOIN clusters AS y ON m.b = y.id AND x.cluster = y.cluster),
admitted AS (SELECT b AS id, arg_min(reason, a) AS reason, arg_min(score, a) AS score FROM inside GROUP BY b)
SELECT c.id, w.id AS winner, coalesce(m.reason, d.reason, 'transitive_cluster') AS reason, coalesce(m.score, d.score, 0.0) AS score FROM clusters AS c JOIN winners AS w ON c.cluster = w.cluster AND c.id <> w.id LEFT JOIN admitted AS m ON m.id = c.id
LEFT JOIN inside AS d ON (d.a = c.id AND d.b = w.id) OR (d.b = c.id AND d.a = w.id)""")
def dedup_event_reason(v: View) -> DataFrame:
    """Why each folded item is where it is."""
    items, matches, clusters = _clustered(v)
    return dedup.merge_evidence(matches, clusters, dedup.event_winners(items, clusters, v("sources")))


@query("dedup_keep_order", ["articles", "sources"], f"WITH {_CLUSTERS} SELECT w.id, f.place FROM winners AS w JOIN (SELECT cluster, min(doc_id) AS place FROM placed GROUP BY cluster) AS f ON w.cluster = f.cluster ORDER BY place, w.id")
def dedup_keep_order(v: View) -> DataFrame:
    """Winners at the place of their cluster's first member."""
    items, _, clusters = _clustered(v)
    place = items.join(clusters, "id").groupBy("cluster").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    return dedup.event_winners(items, clusters, v("sources")).select("cluster", "id").join(place, "cluster").select("id", F.col("first.doc_id").alias("place")).orderBy("place", "id")


@query("agg_event_stats", ["articles", "sources"], f"WITH {_CLUSTERS}, sizes AS (SELECT count(*) AS n FROM clusters GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS candidates, count(*) AS clusters, CAST(sum(n) - count(*) AS BIGINT) AS merged, count(*) FILTER (WHERE n > 1) AS several, max(n) AS largest FROM sizes")
def agg_event_stats(v: View) -> DataFrame:
    """Candidates, clusters, what they merge, clusters of several items, and the largest."""
    sizes = _clustered(v)[2].groupBy("cluster").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(total.alias("candidates"), F.count("*").alias("clusters"), (total - F.count("*")).alias("merged"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("largest"))


# Statistics


_RESULTS = f"SELECT event_id, {HOST_SQL} AS domain, user_id % 2 = 0 AS ugc FROM hits"
_KIND_SQL = f"""SELECT r.*, CASE WHEN domain IN (SELECT DISTINCT r2.domain FROM ({_RESULTS}) AS r2 JOIN sources AS s ON r2.domain = s.domain OR ends_with(r2.domain, concat('.', s.domain)) OR ends_with(s.domain, concat('.', r2.domain))) THEN 'official' ELSE {kind_sql('domain', 'ugc')} END AS bucket FROM ({_RESULTS}) AS r"""


def _kinds(v: View) -> DataFrame:
    """Results with the kind of their source; hosts of known sources are found by equality of suffixes."""
    rows = v("hits").select("event_id", result_host().alias("domain"), (F.col("user_id") % 2 == 0).alias("ugc"))
    known = urls.with_source(rows, v("sources").select("source_id", "source_type", "priority", F.col("domain").alias("host")))
    return known.withColumn("bucket", rules.source_kind(F.col("domain"), F.col("source_id").isNotNull(), F.col("ugc")))


@query("fn_source_quality", ["hits", "sources"], f"SELECT DISTINCT domain, ugc, bucket FROM ({_KIND_SQL}) AS k")
def fn_source_quality(v: View) -> DataFrame:
    return _kinds(v).select("domain", "ugc", "bucket").distinct()


@query("agg_quality_buckets", ["hits", "sources"], f"SELECT bucket, count(*) AS n FROM ({_KIND_SQL}) AS k GROUP BY bucket")
def agg_quality_buckets(v: View) -> DataFrame:
    return _kinds(v).groupBy("bucket").agg(F.count("*").alias("n"))


@query("fn_watched_domain", ["hits"], "SELECT DISTINCT domain, CASE WHEN domain IN ('s1.example.com', 's2.example.com') THEN domain END AS watched FROM hits")
def fn_watched_domain(v: View) -> DataFrame:
    watched = F.array(F.lit("s1.example.com"), F.lit("s2.example.com"))
    return v("hits").select("domain").distinct().select("domain", F.get(F.array_intersect(urls.suffixes(F.col("domain")), watched), F.lit(0)).alias("watched"))


@query("agg_source_class_map", ["hits", "sources"], "SELECT h.domain, s.source_id IS NOT NULL AS known, count(*) AS n FROM hits AS h LEFT JOIN (SELECT source_id, concat('s', n, '.example.com') AS domain FROM sources) AS s ON h.domain = s.domain GROUP BY 1, 2")
def agg_source_class_map(v: View) -> DataFrame:
    hits = v("hits")
    sources = v("sources").withColumn("domain", F.concat(F.lit("s"), F.col("n"), F.lit(".example.com")))
    known = source_of_domain(hits.select("domain").distinct(), sources)
    return hits.join(known, "domain", "left").groupBy("domain", F.col("source_id").isNotNull().alias("known")).agg(F.count("*").alias("n"))


@query("agg_enrichment_stats", ["articles"], "SELECT count(*) AS candidates, count(*) FILTER (WHERE hit) AS cache_hits, count(*) FILTER (WHERE NOT hit AND answered AND valid) AS success, count(*) FILTER (WHERE NOT hit AND NOT (answered AND valid)) AS fallback, count(*) FILTER (WHERE NOT hit AND NOT answered) AS failed, CAST(sum(CASE WHEN NOT hit AND answered THEN 50 + doc_id % 700 ELSE 0 END) AS BIGINT) AS tokens FROM (SELECT doc_id, title_cn <> '' AS hit, doc_id % 8 <> 6 AS answered, why_it_matters <> '' AS valid FROM articles) AS x")
def agg_enrichment_stats(v: View) -> DataFrame:
    """Rows from the cache, answered as asked, or left as they were; of these some had no answer at all. Tokens are those of answers."""
    rows = v("articles").select((F.col("title_cn") != "").alias("hit"), (F.col("doc_id") % 8 != 6).alias("answered"), (F.col("why_it_matters") != "").alias("valid"), (50 + F.col("doc_id") % 700).alias("tokens"))
    return tables.enrichment_stats(rows)


_IN = "published_at > TIMESTAMP '{FROM}' AND published_at <= TIMESTAMP '{TO}'"


@query("agg_run_status", ["run_log"], "SELECT source_id, CASE WHEN sum(valid) FILTER (WHERE success) > 0 THEN 'success' WHEN count(*) FILTER (WHERE success) > 0 THEN 'failed: empty' ELSE 'failed: no digest' END AS status FROM run_log GROUP BY source_id")
def agg_run_status(v: View) -> DataFrame:
    rows = v("run_log").groupBy("source_id").agg(F.sum(F.when(F.col("success"), F.col("valid"))).alias("landed"), F.count_if("success").alias("ok"))
    return rows.select("source_id", F.when(F.col("landed") > 0, "success").when(F.col("ok") > 0, "failed: empty").otherwise("failed: no digest").alias("status"))


# Orders and sections


_REASON = """concat_ws(' + ', CASE WHEN importance_score >= 80 THEN 'high importance' WHEN importance_score >= 50 THEN 'notable importance' END,
 CASE source_type WHEN 'official' THEN 'official source' WHEN 'research' THEN 'research source' ELSE 'media source' END,
 CASE WHEN content_extraction_method IN ('web', 'rss_full') AND (CASE content_extraction_method WHEN 'web' THEN 1.0 ELSE 0.9 END) * (1 + least(length(coalesce(content_original, '')) / 4000.0, 1.0)) / 2 >= 0.6 THEN 'full text' END,
 replace(topic, '_', ' '), nullif(company, ''))"""


@query("rank_reason", ["articles"], f"SELECT id, {_REASON} AS reason FROM ({_LABELS}) AS l")
def rank_reason(v: View) -> DataFrame:
    score, kind = F.col("importance_score"), F.col("source_type")
    parts = [
        F.when(score >= 80, "high importance").when(score >= 50, "notable importance"),
        F.when(kind == "official", "official source").when(kind == "research", "research source").otherwise("media source"),
        F.when(ranking.content() >= 0.6, "full text"),
        F.replace("topic", F.lit("_"), F.lit(" ")),
        F.nullif("company", F.lit("")),
    ]
    return labelled(v("articles")).select("id", F.concat_ws(" + ", *parts).alias("reason"))


@query("sort_by_rank", ["articles", "links"], "SELECT a.id, l.position FROM articles AS a LEFT JOIN links AS l ON a.id = l.news_id ORDER BY l.position NULLS LAST, a.id")
def sort_by_rank(v: View) -> DataFrame:
    return v("articles").select("id").join(v("links").select(F.col("news_id").alias("id"), "position"), "id", "left").orderBy(F.asc_nulls_last("position"), "id")


@query("sort_discovery", ["hits"], "SELECT event_id, published_at, provider_score FROM hits ORDER BY published_at IS NULL, published_at DESC, provider_score DESC, event_id")
def sort_discovery(v: View) -> DataFrame:
    return v("hits").select("event_id", "published_at", "provider_score").orderBy(F.col("published_at").isNull(), F.desc("published_at"), F.desc("provider_score"), "event_id")


@query("sort_status", ["run_log"], f"SELECT source_id, status FROM ({_OUTCOMES}) AS o ORDER BY CASE status WHEN 'OK' THEN 0 WHEN 'EMPTY' THEN 1 ELSE 2 END, source_id")
def sort_status(v: View) -> DataFrame:
    order = F.when(F.col("status") == "OK", 0).when(F.col("status") == "EMPTY", 1).otherwise(2)
    return outcomes(v("run_log")).select("source_id", "status").orderBy(order, "source_id")


@query("split_sections", ["articles", "links"], "SELECT digest_date, news_id, CASE WHEN position < 10 THEN 'top' ELSE 'more' END AS section FROM links")
def split_sections(v: View) -> DataFrame:
    return v("links").select("digest_date", "news_id", F.when(F.col("position") < 10, "top").otherwise("more").alias("section"))


@query("set_union_reports", ["run_log", "hits"], f"SELECT source_id, fetched, valid, false AS discovery FROM ({_OUTCOMES}) AS o UNION ALL SELECT query, count(*), count(published_at), true FROM hits GROUP BY query")
def set_union_reports(v: View) -> DataFrame:
    found = v("hits").groupBy(F.col("query").alias("source_id")).agg(F.count("*").alias("fetched"), F.count("published_at").alias("valid")).withColumn("discovery", F.lit(True))
    return outcomes(v("run_log")).select("source_id", "fetched", "valid", F.lit(False).alias("discovery")).unionByName(found)


# Expressions


@query("fn_plain_text", ["documents"], r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), concat(chr(10), chr(10))) AS plain FROM documents")
def fn_plain_text(v: View) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return v("documents").select("doc_id", F.array_join(lines, "\n\n").alias("plain"))


@query("fn_drop_dup_blocks", ["documents"], r"SELECT doc_id, CAST(sum(CASE WHEN length(x) < 30 OR k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) AS l) AS m GROUP BY doc_id")
def fn_drop_dup_blocks(v: View) -> DataFrame:
    rows = v("documents").select("doc_id", F.split("text", "\n").alias("blocks")).withColumn("keys", F.transform("blocks", lambda b: quality.folded(b)))
    turn = lambda b, i: (F.length(b) < 30) | (F.array_position("keys", F.element_at("keys", i + 1)) == i + 1)
    return rows.select("doc_id", F.size(F.filter("blocks", turn)).cast("long").alias("kept"))


@query("fn_tags_map", ["hits"], "SELECT event_id, user_id % 2 = 0 AS is_ugc, concat('v', user_id % 5) AS kind FROM hits")
def fn_tags_map(v: View) -> DataFrame:
    """Tags as a map of text, read back by key; several spellings mean yes."""
    yes = F.when(F.col("user_id") % 2 == 0, F.lit("True")).otherwise("no")
    rows = v("hits").select("event_id", F.create_map(F.lit("is_ugc"), yes, F.lit("kind"), F.concat(F.lit("v"), F.col("user_id") % 5)).alias("tags"))
    return rows.select("event_id", F.lower(F.element_at("tags", "is_ugc")).isin("1", "true", "yes").alias("is_ugc"), F.element_at("tags", "kind").alias("kind"))


@query("fn_parse_ts", ["articles"], "SELECT id, date_trunc('second', published_at) AS parsed FROM articles")
def fn_parse_ts(v: View) -> DataFrame:
    """Times written as RFC 2822 or ISO, by turns, and read again."""
    moment = F.col("published_at")
    written = F.when(F.col("doc_id") % 2 == 0, F.date_format(moment, "d MMM yyyy HH:mm:ss Z")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return v("articles").select("id", times.published(written).alias("parsed"))


@query("fn_english_date", ["articles"], "SELECT id, date_trunc('day', published_at) AS day FROM articles")
def fn_english_date(v: View) -> DataFrame:
    moment, n = F.col("published_at"), F.col("doc_id") % 3
    written = F.when(n == 0, F.date_format(moment, "MMM d, yyyy")).when(n == 1, F.date_format(moment, "MMMM d, yyyy")).otherwise(F.date_format(moment, "yyyy-MM-dd"))
    return v("articles").select("id", times.english_date(written).alias("day"))


@query("fn_parse_ts_multi", ["articles"], "SELECT id, CASE WHEN doc_id % 8 IN (2, 4) THEN date_trunc('day', published_at + INTERVAL 8 HOUR) - INTERVAL 8 HOUR WHEN doc_id % 8 < 8 THEN published_at END AS parsed, doc_id % 8 NOT IN (2, 4) AND published_at IS NOT NULL AS has_time FROM articles")
def fn_parse_ts_multi(v: View) -> DataFrame:
    """Times in all forms of pages: epochs and a named zone tell the instant, all others the clock of the app's zone, eight hours ahead."""
    moment, n = F.col("published_at"), F.col("doc_id") % 8
    local = F.from_utc_timestamp(moment, times.ZONE)
    forms = ("yyyy-MM-dd", "yyyy年MM月dd日 HH:mm", "yyyy年M月d日", None, "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm")
    written = F.when(n == 0, F.unix_seconds(moment).cast("string")).when(n == 1, F.unix_millis(moment).cast("string")).when(n == 5, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    for k, form in enumerate(forms, 2):
        written = written.when(n == k, F.date_format(local, form)) if form else written
    read = v("articles").select("id", times.page_time(written).alias("t"))
    return read.select("id", F.col("t.at").alias("parsed"), F.coalesce("t.has_time", F.lit(False)).alias("has_time"))


#: Hosts of the sources; some are read from a host above their own, some from one below.
_HOSTS = "SELECT source_id, source_type, priority, CASE n % 3 WHEN 0 THEN concat('s', n, '.example.com') WHEN 1 THEN concat('www.s', n, '.example.com') ELSE concat('blog.s', n, '.example.com') END AS host FROM sources"


@query("proj_candidate", ["hits", "sources"], f"SELECT h.event_id, coalesce(s.source_id, concat('web:', h.domain)) AS source_id, coalesce(s.source_type, 'media') AS source_type FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('news.', domain) ELSE domain END AS domain FROM hits) AS h LEFT JOIN (SELECT domain, arg_min(source_id, (priority, source_id)) AS source_id, arg_min(source_type, (priority, source_id)) AS source_type FROM (SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN concat('news.', domain) ELSE domain END AS domain FROM hits) AS d JOIN ({_HOSTS}) AS k ON domain = regexp_replace(host, '^www[.]', '') OR ends_with(domain, concat('.', regexp_replace(host, '^www[.]', ''))) OR ends_with(regexp_replace(host, '^www[.]', ''), concat('.', domain)) GROUP BY domain) AS s ON h.domain = s.domain")
def proj_candidate(v: View) -> DataFrame:
    """Hits as candidates: of a known source where their host is that of a source, above or below it; of several by priority."""
    n = F.col("n")
    host = F.when(n % 3 == 0, F.concat(F.lit("s"), n, F.lit(".example.com"))).when(n % 3 == 1, F.concat(F.lit("www.s"), n, F.lit(".example.com"))).otherwise(F.concat(F.lit("blog.s"), n, F.lit(".example.com")))
    rows = v("hits").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("news."), "domain")).otherwise(F.col("domain")).alias("domain"))
    return urls.with_source(rows, v("sources").select("source_id", "source_type", "priority", F.regexp_replace(host, r"^www\.", "").alias("host"))).select("event_id", F.coalesce("source_id", F.concat(F.lit("web:"), "domain")).alias("source_id"), F.coalesce("source_type", F.lit("media")).alias("source_type"))


# Bodies and windows


def _given(v: View) -> DataFrame:
    """Articles with what a batch has for each: some cached bodies, feed bodies, pages of several lengths, kinds and verdicts, and failed requests."""
    n, text = F.col("doc_id"), F.coalesce("content_original", F.lit(""))
    cached = F.when((n % 13 == 0) & (text != ""), F.struct(text.alias("text"), F.lit("web").alias("method"), F.lit("good").alias("quality")))
    page = F.when(n % 19 != 0, F.when(n % 3 == 0, F.substring(text, 1, 150)).otherwise(text))
    return v("articles").select(
        "id",
        cached.alias("cached"),
        F.when(n % 2 == 0, F.substring(text, 1, 900)).otherwise("").alias("feed"),
        F.when(n % 6 == 0, "fallback").otherwise("good").alias("feed_verdict"),
        page.alias("page"),
        F.when(n % 9 == 0, "application/pdf").otherwise("text/html").alias("page_type"),
        F.when(n % 4 == 1, "low").otherwise("good").alias("page_verdict"),
        F.when(n % 4 == 1, "noisy").otherwise("").alias("page_reason"),
        F.when(n % 17 == 0, "HTTP 403").alias("page_error"),
        "summary",
    )


_SELECTED = """SELECT id, CASE WHEN hit THEN length(body) WHEN use_feed THEN length(feed) WHEN error IS NULL THEN length(page) ELSE greatest(length(feed), length(summary)) END AS chars,
  CASE WHEN hit THEN 'web' WHEN use_feed THEN 'rss_full' WHEN error IS NULL THEN 'web' WHEN feed <> '' OR summary <> '' THEN 'rss_summary' ELSE 'none' END AS method,
  CASE WHEN hit OR use_feed THEN NULL WHEN error IS NULL THEN NULL ELSE error END AS error, hit AS from_cache
FROM (SELECT *, doc_id % 13 = 0 AND body <> '' AS hit, length(feed) >= 600 AND doc_id % 6 <> 0 AS use_feed,
  CASE WHEN doc_id % 17 = 0 THEN 'HTTP 403' WHEN doc_id % 9 = 0 THEN 'not HTML (application/pdf)' WHEN trim(page) = '' THEN 'empty body' WHEN length(page) < 200 THEN concat('page too short (', length(page), ' chars)') WHEN doc_id % 4 = 1 THEN 'low quality page (noisy)' END AS error
  FROM (SELECT id, doc_id, coalesce(content_original, '') AS body, coalesce(summary, '') AS summary, CASE WHEN doc_id % 2 = 0 THEN substring(coalesce(content_original, ''), 1, 900) ELSE '' END AS feed,
    CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 3 = 0 THEN substring(coalesce(content_original, ''), 1, 150) ELSE coalesce(content_original, '') END AS page FROM articles) AS s0) AS s1"""


def _bodies(v: View) -> DataFrame:
    columns = ("cached", "feed", "feed_verdict", "page", "page_type", "page_verdict", "page_reason", "page_error", "summary")
    return _given(v).select("id", bodies.selected(*[F.col(c) for c in columns]).alias("b")).select("id", "b.*")


@query("body_select", ["articles"], _SELECTED)
def body_select(v: View) -> DataFrame:
    return _bodies(v).select("id", F.length("text").alias("chars"), "method", "error", "from_cache")


@query("agg_extraction_stats", ["articles"], f"SELECT count(*) AS candidates, count(*) FILTER (WHERE method = 'rss_full') AS rss_full, count(*) FILTER (WHERE method = 'web') AS web, count(*) FILTER (WHERE method NOT IN ('rss_full', 'web')) AS fallback, count(error) AS failed, count(*) FILTER (WHERE starts_with(error, 'low quality page')) AS rejected_low_quality, count(*) FILTER (WHERE from_cache) AS cache_hits FROM ({_SELECTED}) AS b")
def agg_extraction_stats(v: View) -> DataFrame:
    return bodies.stats(_bodies(v))


@query("body_batch", ["raw_articles", "pages"])
def body_batch(v: View) -> DataFrame:
    """Every article with the page of its number, where there is one: feed bodies and pages are cleaned and judged, and the best is taken."""
    rows = v("raw_articles").select(F.concat(F.lit("a"), "doc_id").alias("id"), F.concat(F.lit("u"), "doc_id").alias("url"), "summary", F.when(F.col("doc_id") % 3 == 0, F.col("feed_body")).otherwise("").alias("feed_body"), "doc_id")
    fetched = v("pages").select(F.concat(F.lit("u"), "page_id").alias("url"), "html", F.when(F.col("page_id") % 9 == 0, "application/pdf").otherwise("text/html").alias("content_type"), F.when(F.col("page_id") % 17 == 0, "HTTP 403").alias("error"))
    cache = rows.where("doc_id % 13 = 0").select("url", F.lit("kept before").alias("text"), F.lit("web").alias("method"), F.lit("good").alias("quality"))
    return pages.extracted(rows, fetched, cache).select("id", F.length("text").alias("chars"), "method", "quality", "error", "from_cache")


_WINDOWS = "SELECT digest_date, coalesce(lag(e) OVER (ORDER BY digest_date), e - INTERVAL 24 HOUR) AS window_start, e AS window_end FROM (SELECT digest_date, max(published_at) AS e FROM links AS l JOIN articles AS a ON l.news_id = a.id GROUP BY digest_date) AS d"


@query("inc_resolve_window", ["articles", "links"], _WINDOWS)
def inc_resolve_window(v: View) -> DataFrame:
    return digest_windows(v("links"), v("articles"))


@query("inc_historical_window", ["articles"], "SELECT DISTINCT CAST(d AS VARCHAR) AS digest_date, CAST(d AS TIMESTAMP) - INTERVAL 24 HOUR AS window_start, CAST(d AS TIMESTAMP) AS window_end FROM (SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS d FROM articles WHERE published_at IS NOT NULL) AS x")
def inc_historical_window(v: View) -> DataFrame:
    """A past digest's window: from the cutoff of the day before to its own, at 08:00 of the app's zone."""
    days = v("articles").where("published_at IS NOT NULL").select(times.digest_date(F.col("published_at")).alias("digest_date")).distinct()
    end = F.to_utc_timestamp(F.to_timestamp("digest_date") + F.expr("INTERVAL 8 HOURS"), times.ZONE)
    return days.select("digest_date", (end - F.expr("INTERVAL 24 HOURS")).alias("window_start"), end.alias("window_end"))


_IN_WINDOW = f"SELECT digest_date, id, floor({_SCORE.replace('{rec}', 'coalesce(greatest(0.0, least((epoch_us(published_at) - epoch_us(window_start)) / CAST(epoch_us(window_end) - epoch_us(window_start) AS DOUBLE), 1.0)), 0.0)').replace('{con}', _CON)} * 10000 + 0.500001) / 10000 AS base_score, CAST(epoch_us(published_at) AS DOUBLE) AS us, company, topic, source FROM ({_LABELS}) AS l JOIN ({_WINDOWS}) AS w ON published_at > window_start AND published_at <= window_end"


@query("maint_rebuild_digest", ["articles", "links"], f"WITH new AS ({_diverse_sql(_IN_WINDOW, 'n')}) SELECT 'added' AS change, digest_date, id AS news_id FROM new WHERE (digest_date, id) NOT IN (SELECT (digest_date, news_id) FROM links) UNION ALL SELECT 'removed', digest_date, news_id FROM links WHERE (digest_date, news_id) NOT IN (SELECT (digest_date, id) FROM new)")
def maint_rebuild_digest(v: View) -> DataFrame:
    """Dry run: all links of each date derived anew from the archive in the window of that date, against those stored."""
    articles, links = v("articles"), tables.stored(v("links"), "links")
    return rebuild_changes(links, tables.stored(rebuilt(labelled(articles), digest_windows(links, articles)), "rebuilt"))


@query("search_hits", ["articles", "links"], f"SELECT l.id, topic, company, f.digest_date AS first_digest_date, {snippet_sql('gpt')} AS snippet, place, total FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS place, count(*) OVER () AS total FROM (SELECT * FROM ({_LABELS}) AS l0 WHERE contains(lower(title_original), 'gpt')) AS l1) AS l LEFT JOIN (SELECT news_id, min(digest_date) AS digest_date FROM links GROUP BY news_id) AS f ON l.id = f.news_id WHERE place <= 50")
def search_hits(v: View) -> DataFrame:
    """The first page of the newest titles with a word, as many as a page holds at most, and how many there are."""
    first = v("links").groupBy(F.col("news_id").alias("id")).agg(F.min("digest_date").alias("first_digest_date"))
    found = tables.stored(v("articles").where(F.contains(F.lower("title_original"), F.lit("gpt"))), "found")
    page = found.orderBy(F.desc_nulls_last("published_at"), "id").limit(search.page_size(80))
    page = page.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("published_at"), "id"))).withColumn("total", found.agg(F.count("*")).scalar())
    snippet = text.chosen_snippet([F.col("summary"), F.col("content_original"), F.col("title_original")], F.array(F.lit("gpt")))
    return labelled(page).join(first, "id", "left").select("id", "topic", "company", "first_digest_date", snippet.alias("snippet"), "place", "total")


@query("join_search_articles", ["articles"], f"SELECT id, title_original FROM ({_LABELS}) AS l WHERE contains(lower(concat_ws(chr(10), title_cn, title_original, summary, why_it_matters, content_original, source, company, topic)), 'gpt')")
def join_search_articles(v: View) -> DataFrame:
    items = labelled(v("articles"))
    wanted = items.sparkSession.createDataFrame([(1, "GPT")], "query_id long, query string")
    return search.matches(items, wanted).join(items, "id").select("id", "title_original")


@query("join_repo_enrichment", ["repos", "repo_metadata"], "SELECT r.rank, r.repo, m.part IS NULL AS needs_work FROM repos AS r LEFT JOIN (SELECT DISTINCT part, sha256(concat(repo, chr(10), substring(description, 7))) AS key FROM repo_metadata) AS m ON sha256(concat(r.repo, chr(10), r.description)) = m.key AND r.rank = m.part")
def join_repo_enrichment(v: View) -> DataFrame:
    known = v("repo_metadata").select(F.col("part").alias("rank"), urls.hash_key(F.col("repo"), F.expr("substring(description, 7)")).alias("key"), F.lit(True).alias("has")).distinct()
    rows = v("repos").withColumn("key", urls.hash_key(F.col("repo"), F.col("description"))).join(known, ["rank", "key"], "left")
    return rows.select("rank", "repo", F.col("has").isNull().alias("needs_work"))


@query("fn_match_event", ["articles"], f"SELECT a, b, reason, score, title_similarity FROM ({MATCHES}) AS m")
def fn_match_event(v: View) -> DataFrame:
    return dedup.match_events(event_view(v)).select("a", "b", "reason", "score", "title_similarity")


@query("join_event_pairs", ["articles"], MATCHES)
def join_event_pairs(v: View) -> DataFrame:
    return dedup.match_events(event_view(v))


@query("set_union_coverage", ["run_log", "sources"], f"SELECT organization, channel, o.status, s.name, valid, '' AS note FROM ({_OUTCOMES}) AS o JOIN sources AS s ON o.source_id = s.source_id UNION ALL SELECT 'org1', 'video', 'UNSUPPORTED', NULL, NULL, 'no stable public source' UNION ALL SELECT 'org9', 'video', 'UNSUPPORTED', NULL, NULL, 'no stable public source' ORDER BY 1, CASE status WHEN 'OK' THEN 0 WHEN 'EMPTY' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END, 2")
def set_union_coverage(v: View) -> DataFrame:
    """Outcomes by organization and channel, with the channels that have no source."""
    rows = outcomes(v("run_log")).join(v("sources"), "source_id").select("organization", "channel", "status", "name", "valid", F.lit("").alias("note"))
    unsupported = rows.sparkSession.createDataFrame([("org1", "video"), ("org9", "video")], "organization string, channel string")
    more = unsupported.select("organization", "channel", F.lit("UNSUPPORTED").alias("status"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("valid"), F.lit("no stable public source").alias("note"))
    place = F.when(F.col("status") == "OK", 0).when(F.col("status") == "EMPTY", 1).when(F.col("status") == "FAIL", 2).otherwise(3)
    return rows.unionByName(more).orderBy("organization", place, "channel")


@query("agg_search_summary", ["hits", "sources"], _SUMMARY)
def agg_search_summary(v: View) -> DataFrame:
    """What a round of searches found: a URL counts once, with its first hit."""
    hits = v("hits")
    first = dedup.first_by_key(hits, ["url"], F.col("query"), F.col("day"), F.col("rank"))
    domains = first.select("domain").distinct()
    known = source_of_domain(domains, v("sources").withColumn("domain", F.concat(F.lit("s"), F.col("n"), F.lit(".example.com"))))
    watched = F.array(F.lit("s1.example.com"), F.lit("s2.example.com"))
    rows = first.join(known, "domain", "left").withColumn("seen", F.col("source_id").isNotNull())
    # pages of the sources themselves are told by seen
    rows = rows.withColumn("bucket", rules.source_kind(result_host(), F.lit(False), F.col("user_id") % 2 == 0))
    when, now, n = F.col("published_at"), at(_FOUND_AT), F.count("*")
    inside = times.within_hours(when, now, 24)
    one = rows.agg(
        n.alias("uniq"),
        F.count_distinct(F.coalesce(F.nullif("domain", F.lit("")), F.lit("(no host)"))).alias("domains"),
        F.count_if("seen").alias("known"),
        F.count_if(~F.col("seen")).alias("discovered"),
        F.count(when).alias("published"),
        F.count_if(inside).alias("inside_24h"),
        F.count_if(when.isNotNull() & ~inside).alias("outside_24h"),
        F.count_if(when.isNull()).alias("unknown_time"),
        F.count_if(~rules.topical(F.col("title"), F.col("summary"))).alias("irrelevant"),
        *[F.count_if(F.col("bucket") == b).alias(b if b != "unknown" else "unknown_quality") for b in ("portal", "ugc_blog", "research", "professional_media", "unknown")],
        F.count_if(F.arrays_overlap(urls.suffixes(F.col("domain")), watched)).alias("second_hand"),
        F.count_if(F.col("user_id") % 2 == 0).alias("tagged"),
        F.count_distinct(F.col("user_id") % 5).alias("genres"),
    )
    # two tables of one row
    return hits.agg(n.alias("raw")).join(one).withColumn("duplicates", F.col("raw") - F.col("uniq"))


_TITLE30 = "lower(trim(regexp_replace(coalesce(substring(text, 1, 30), ''), '\\s+', ' ', 'g')))"


@query("fn_drop_leading_title", ["documents"], rf"""SELECT doc_id, CAST(len(blocks) - CASE WHEN wanted <> '' AND head <> '' AND (head = wanted OR (least(length(head), length(wanted)) >= 20 AND least(length(head), length(wanted)) >= 0.6 * greatest(length(head), length(wanted)) AND (starts_with(head, wanted) OR starts_with(wanted, head)))) THEN 1 ELSE 0 END AS INT) AS n_blocks
FROM (SELECT doc_id, blocks, wanted, lower(trim(regexp_replace(blocks[1], '^[# ]+', ''))) AS head FROM (SELECT doc_id, string_split(text, chr(10)) AS blocks, {_TITLE30} AS wanted FROM documents) AS d0) AS d1""".replace("\\\\s", "\\s"))
def fn_drop_leading_title(v: View) -> DataFrame:
    """Lines as blocks; the first 30 characters as title."""
    blocks = F.split("text", "\n")
    return v("documents").select("doc_id", F.size(text.without_title(blocks, F.substring("text", 1, 30))).alias("n_blocks"))


@query("src_link_cards", ["raw_articles"], r"SELECT doc_id // 50 AS page_id, concat('https://q.example.com/blog/', doc_id) AS url, trim(regexp_replace(replace(replace(title, '<', ''), '&', ''), '\s+', ' ', 'g'), ' ·|—–-') AS title, date_trunc('day', published_at) AS published_at FROM raw_articles WHERE published_at IS NOT NULL")
def src_link_cards(v: View) -> DataFrame:
    """Listing pages written from the articles, fifty cards a page, some with a cover link, a reading time or a tag link beside; and read again."""
    n, day = F.col("doc_id"), F.coalesce(F.date_format("published_at", "MMM d, yyyy"), F.lit("soon"))
    link = F.concat(F.lit('<a href="/blog/'), n, F.lit('">'))
    title = F.replace(F.replace("title", F.lit("<"), F.lit("")), F.lit("&"), F.lit(""))
    card = F.when(n % 2 == 0, F.concat(F.lit("<div>"), link, F.lit('<img alt="cover"></a>'), link, F.lit("<h3>"), title, F.lit('</h3></a><p class="meta date">'), day, F.lit(" · 5 min read</p></div>"))).otherwise(
        F.concat(F.lit("<section>"), link, title, F.lit(" "), day, F.lit('</a><span><time>'), day, F.lit('</time></span><a href="/blog/tag/x">a much longer tag text than any title could ever be, to be sure that it is not taken for the headline of this card</a></section>'))
    )
    html = F.concat(F.lit("<html><body><main>"), F.array_join(F.collect_list(card), ""), F.lit("</main></body></html>"))
    listing = v("raw_articles").groupBy(F.floor(n / 50).alias("page_id")).agg(html.alias("html"))
    return listings.link_cards(listing, "/blog/", "https://q.example.com").select("page_id", "url", "title", "published_at")


@query("src_embedded_json", ["articles"], "SELECT doc_id AS page_id, id, title_original AS title FROM articles")
def src_embedded_json(v: View) -> DataFrame:
    """Pages that carry an article as JSON in a script, written from the articles and read again."""
    row = F.to_json(F.array(F.struct("id", F.col("title_original").alias("title"), F.lit('a ] and " inside').alias("odd"))))
    html = F.concat(F.lit("<html><body><script>window.items = "), row, F.lit("; done([])</script></body></html>"))
    return pages.embedded_rows(v("articles").select(F.col("doc_id").alias("page_id"), html.alias("html")), "window.items", "id: string, title: string")


@query("maint_backfill_body", ["articles", "pages"])
def maint_backfill_body(v: View) -> DataFrame:
    """Bodies for articles that lack one, from the page of the same number, written into the stored table: filled, skipped (body unusable) or failed (no page); chars: what the table's next version holds of each."""
    articles = v("articles").select("id", "doc_id", "content_original", "content_extraction_method")
    table = ranged(articles, "id")
    missing = table.rows().where("coalesce(content_original, '') = ''").select("id", F.col("doc_id").alias("page_id"))
    state = F.when(F.col("quality").isNull(), "failed").when(F.col("quality.verdict") == "good", "filled").otherwise("skipped")
    rows = tables.stored(missing.join(pages.bodies(v("pages")), "page_id", "left").select("id", "body", state.alias("state")), "backfill")
    after = table.patched(rows.where("state = 'filled'").select("id", F.col("body").alias("content_original"), F.lit("web").alias("content_extraction_method")))
    held = after.rows().select("id", F.length(F.coalesce("content_original", F.lit(""))).alias("chars"))
    return rows.join(held, "id").groupBy("state").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


_WON = """concat(canonical_url, chr(10), url) AS key, epoch_us(published_at) AS us, """ + _NORMAL.replace("trim(title)", "trim(title_original)")
_BONUS = " + 0.06 * least(greatest(cluster_size - 1, 0) * 0.5, 2.0))"
_LINKED = f"""SELECT '2024-01-06' AS digest_date, id, floor({_SCORE.replace('0.05 * {con})', '0.05 * {con}' + _BONUS).replace('{rec}', _REC).replace('{con}', _CON)} * 10000 + 0.500001) / 10000 AS base_score, CAST(epoch_us(published_at) AS DOUBLE) AS us, company, topic, source FROM l"""
_STEPS = f"""WITH w AS (SELECT *, {_CANON} AS canonical_url FROM articles WHERE {_IN.format(FROM=FROM, TO=TO)}),
p AS (SELECT w.*, coalesce(s.priority, 1000) AS priority FROM w LEFT JOIN (SELECT source_id AS sid, priority FROM sources) AS s ON w.source_id = s.sid),
u AS (SELECT *, {_WON} AS title_key FROM (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY source_type <> 'official', priority, published_at NULLS LAST, url) AS k FROM p) AS k1 WHERE k = 1) AS k2),
g AS (SELECT title_key, list({{'key': key, 'us': us, 'c': CAST(1 AS BIGINT)}} ORDER BY canonical_url, url) AS rows FROM u WHERE title_key <> '' AND us IS NOT NULL GROUP BY title_key),
r AS (SELECT list_reduce(list_transform(rows, lambda y: [y]), lambda acc, x: list_concat(acc, [{{'key': x[1].key, 'us': x[1].us, 'c': coalesce(list_min(list_transform(list_filter(acc, lambda p: abs(p.us - x[1].us) <= 172800000000), lambda p: p.c)), len(acc) + 1)}}])) AS rows FROM g),
c AS (SELECT rows[i].key AS key, rows[rows[i].c].key AS title_cluster FROM (SELECT rows, unnest(range(1, len(rows) + 1)) AS i FROM r) AS r1),
t AS (SELECT * EXCLUDE (k, priority, key, us, title_key) FROM (SELECT u.*, row_number() OVER (PARTITION BY coalesce(c.title_cluster, u.key) ORDER BY source_type <> 'official', priority, published_at NULLS LAST, canonical_url, url) AS k FROM u LEFT JOIN c ON u.key = c.key) AS k3 WHERE k = 1),
{clusters_sql('SELECT * FROM t', matches_sql('SELECT id, title_original, title_cn, summary, why_it_matters, published_at FROM t'))},
v AS (SELECT * EXCLUDE (k) FROM winners),
m AS ({_MEDIA.replace("FROM articles", "FROM v")}),
l AS ({_LABELS.replace("FROM articles", "FROM (SELECT * FROM m WHERE coalesce(reason = 'kept', true)) AS kept")}),
d AS ({_diverse_sql(_LINKED, "n")})
"""
_REFRESHED = f"""{_STEPS}SELECT d.rank, l.id, title_original, topic, company, round(d.final_score, 4) AS score, cluster_size FROM d JOIN l ON d.id = l.id"""


@query("inc_refresh", ["articles", "sources"], _REFRESHED)
def inc_refresh(v: View) -> DataFrame:
    """The articles as a stream of batches into one digest's window: what it links in the end."""
    articles, sources = v("articles"), tables.stored(v("sources"), "sources")
    spark = articles.sparkSession
    path = f"{tables.folder(spark)}/refresh-{tables.unique()}"
    articles.write.parquet(f"{path}/input")
    stream = spark.readStream.schema(articles.schema).parquet(f"{path}/input")
    jobs.refreshed(stream, path, lambda linked, batch: merged(linked, batch, sources, at(FROM), at(TO)))
    return jobs.linked(spark, path).select("rank", "id", "title_original", "topic", "company", F.round("score", 4).alias("score"), "cluster_size")


@query("agg_funnel", ["articles", "sources"], f"""{_STEPS}
SELECT 'fetched' AS stage, count(*) AS n FROM articles UNION ALL SELECT 'in_window', count(*) FROM w UNION ALL SELECT 'distinct_urls', count(*) FROM u UNION ALL SELECT 'distinct_titles', count(*) FROM t
UNION ALL SELECT 'distinct_events', count(*) FROM v UNION ALL SELECT 'selected', count(*) FROM l UNION ALL SELECT 'linked', count(*) FROM d""")
def agg_funnel(v: View) -> DataFrame:
    """Rows after each step of a refresh."""
    articles = v("articles")
    found = steps(articles.limit(0), articles, tables.stored(v("sources"), "sources"), at(FROM), at(TO)).funnel()
    return articles.agg(F.count("*").alias("n")).select(F.lit("fetched").alias("stage"), "n").union(found)
