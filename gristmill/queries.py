"""Queries of the digest operators over the given tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill import views
from gristmill.functions import rules, text, times, urls
from gristmill.operators import dedup, ranking, search, tables
from gristmill.operators.ranges import RangeTable, in_windows
from gristmill.plans.digest import digest, labelled
from gristmill.sources import listings

View = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FROM, TO, NOW = "2024-01-04 00:00:00", "2024-01-06 00:00:00", "2024-01-07 12:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def query(name: str, reads: list[str], sql: str | None = None):
    """Register a query: a function of a view reader, and its SQL over the views it reads. Names of given tables read those."""

    def registered(make: Callable[[View], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def view(v: str) -> DataFrame:
                return views.view(spark, sf_dir, v) if v in views.VIEWS else spark.read.parquet(f"{sf_dir}/{v}.parquet")

            return make(view)

        QUERIES[name] = run
        if sql:
            SQL[name] = views.duckdb([r for r in reads if r in views.VIEWS], sql.format(FROM=FROM, TO=TO, NOW=NOW) if "{FROM}" in sql or "{NOW}" in sql else sql) if any(r in views.VIEWS for r in reads) else sql
        return make

    return registered


# Filters


@query("flt_window", ["articles"], "SELECT id, published_at FROM articles WHERE published_at > TIMESTAMP '{FROM}' AND published_at <= TIMESTAMP '{TO}'")
def flt_window(v: View) -> DataFrame:
    return v("articles").where(times.in_window(F.col("published_at"), at(FROM), at(TO))).select("id", "published_at")


@query("flt_future", ["articles"], "SELECT id FROM articles WHERE published_at > TIMESTAMP '{NOW}'")
def flt_future(v: View) -> DataFrame:
    return v("articles").where(times.in_future(F.col("published_at"), at(NOW))).select("id")


@query("flt_24h_open", ["articles"], "SELECT id FROM articles WHERE published_at <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' - published_at < INTERVAL 24 HOUR")
def flt_24h_open(v: View) -> DataFrame:
    return v("articles").where(times.within_hours(F.col("published_at"), at(NOW), 24, closed=False)).select("id")


@query("flt_24h_closed", ["articles"], "SELECT id FROM articles WHERE published_at <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' - published_at <= INTERVAL 24 HOUR")
def flt_24h_closed(v: View) -> DataFrame:
    return v("articles").where(times.within_hours(F.col("published_at"), at(NOW), 24)).select("id")


@query("flt_hours_closed", ["articles"], "SELECT id FROM articles WHERE published_at <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' - published_at <= INTERVAL 60 HOUR")
def flt_hours_closed(v: View) -> DataFrame:
    return v("articles").where(times.within_hours(F.col("published_at"), at(NOW), 60)).select("id")


@query("flt_required", ["raw_articles"], "SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE title = '' OR url = '' OR published_at IS NULL) AS skipped FROM raw_articles GROUP BY source_id")
def flt_required(v: View) -> DataFrame:
    lacks = (F.col("title") == "") | (F.col("url") == "") | F.col("published_at").isNull()
    return v("raw_articles").groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_if(lacks).alias("skipped"))


@query("flt_domain_block", ["hits"], "SELECT event_id, domain FROM hits WHERE NOT (domain = 's7.example.com' OR domain LIKE '%.s7.example.com' OR domain = 's12.example.com')")
def flt_domain_block(v: View) -> DataFrame:
    blocked = F.array(F.lit("s7.example.com"), F.lit("s12.example.com"))
    return v("hits").where(~F.arrays_overlap(urls.suffixes(F.col("domain")), blocked)).select("event_id", "domain")


def _re2(terms: tuple[str, ...], after: str) -> str:
    """The same test for an engine without look-around."""
    words = [w.replace(".", "\\.") for w in terms]
    return f"(^|[^a-z0-9])({'|'.join(words)})($|{after})".replace("'", "''")


_TOPICAL = "regexp_replace(lower(concat(coalesce(title, ''), ' ', coalesce(summary, ''))), '\\s+', ' ', 'g')"
_OTHERS = " + ".join(f"CASE WHEN regexp_matches(t, '{_re2(terms, '[^a-z]')}') THEN 1 ELSE 0 END" for _, terms in rules.FAMILIES[1:])
_CANON = r"""regexp_replace(CASE WHEN doc_id % 5 = 1 THEN concat('https://', source_id, '.example.com/a/', doc_id % 700, '?b=2') ELSE concat('https://', source_id, '.example.com/a/', doc_id % 700) END, '/$', '')"""
_IS_TOPICAL = f"""SELECT doc_id, source_id, regexp_matches(t, '{_re2(rules.STRONG, "[^a-z]")}') OR (o >= 1 AND regexp_matches(t, '{_re2(rules.FAMILIES[0][1], "[^a-z]")}')) OR o >= 2 AS topical
FROM (SELECT doc_id, source_id, t, {_OTHERS} AS o FROM (SELECT doc_id, source_id, {_TOPICAL} AS t FROM raw_articles) AS x) AS y"""


@query("flt_topical", ["raw_articles"], f"SELECT doc_id, topical FROM ({_IS_TOPICAL}) AS z")
def flt_topical(v: View) -> DataFrame:
    return v("raw_articles").select("doc_id", rules.topical(F.col("title"), F.col("summary")).alias("topical"))


@query("src_entries_to_articles", ["raw_articles", "sources"], f"SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE gated AND k = 1) AS valid, count(*) FILTER (WHERE gated AND k > 1) AS repeated, count(*) FILTER (WHERE NOT gated) AS off_topic FROM (SELECT *, row_number() OVER (PARTITION BY source_id, gated, c ORDER BY doc_id) AS k FROM (SELECT r.doc_id, r.source_id, {_CANON} AS c, NOT s.gate OR z.topical AS gated FROM raw_articles AS r JOIN (SELECT source_id AS sid, requires_ai_filter AS gate FROM sources) AS s ON r.source_id = s.sid JOIN (SELECT doc_id AS doc, topical FROM ({_IS_TOPICAL}) AS z0) AS z ON r.doc_id = z.doc) AS x) AS y GROUP BY source_id")
def src_entries_to_articles(v: View) -> DataFrame:
    """Entries of listings as articles: of sources that tell of more than the topic only topical ones, a URL once; what is skipped is counted by reason."""
    gates = v("sources").select("source_id", F.col("requires_ai_filter").alias("gate"))
    rows = v("raw_articles").join(gates, "source_id").withColumn("gated", ~F.col("gate") | rules.topical(F.col("title"), F.col("summary")))
    turn = F.row_number().over(Window.partitionBy("source_id", "gated", "canonical_url").orderBy("doc_id"))
    rows = rows.withColumn("canonical_url", urls.canonical_url(F.col("url"))).withColumn("turn", turn)
    first = F.col("turn") == 1
    return rows.groupBy("source_id").agg(F.count("*").alias("fetched"), F.count_if(F.col("gated") & first).alias("valid"), F.count_if(F.col("gated") & ~first).alias("repeated"), F.count_if(~F.col("gated")).alias("off_topic"))


@query("flt_topical_if_wide", ["raw_articles", "sources"], f"SELECT s.source_id, count(*) FILTER (WHERE NOT requires_ai_filter OR topical) AS kept, count(*) FILTER (WHERE requires_ai_filter AND NOT topical) AS skipped FROM ({_IS_TOPICAL}) AS z JOIN sources AS s ON z.source_id = s.source_id GROUP BY s.source_id")
def flt_topical_if_wide(v: View) -> DataFrame:
    rows = v("raw_articles").join(v("sources").select("source_id", "requires_ai_filter"), "source_id")
    keeps = ~F.col("requires_ai_filter") | rules.topical(F.col("title"), F.col("summary"))
    return rows.groupBy("source_id").agg(F.count_if(keeps).alias("kept"), F.count_if(~keeps).alias("skipped"))


@query("flt_media_floor", ["articles"], "SELECT id, CASE WHEN importance_score IS NULL THEN 'missing_importance' WHEN importance_score < 60 THEN 'below_threshold' ELSE 'eligible' END AS reason FROM articles WHERE source_type = 'media'")
def flt_media_floor(v: View) -> DataFrame:
    score = F.col("importance_score")
    reason = F.when(score.isNull(), "missing_importance").when(score < ranking.MEDIA_FLOOR, "below_threshold").otherwise("eligible")
    return v("articles").where("source_type = 'media'").select("id", reason.alias("reason"))


@query("flt_like_all", ["articles"], "SELECT id FROM articles WHERE (contains(lower(title_original), 'ai') OR contains(lower(summary), 'ai')) AND (contains(lower(title_original), 'on') OR contains(lower(summary), 'on'))")
def flt_like_all(v: View) -> DataFrame:
    rows = v("articles")
    for word in ("ai", "on"):
        rows = rows.where(F.contains(F.lower("title_original"), F.lit(word)) | F.contains(F.lower("summary"), F.lit(word)))
    return rows.select("id")


# Sources and lookups


@query("src_dimension", ["sources"], "SELECT source_id, name, priority FROM sources WHERE enabled")
def src_dimension(v: View) -> DataFrame:
    return v("sources").where("enabled").select("source_id", "name", "priority")


@query("src_archive_scan", ["articles"], "SELECT id, published_at FROM articles ORDER BY published_at, id")
def src_archive_scan(v: View) -> DataFrame:
    return v("articles").select("id", "published_at").orderBy("published_at", "id")


@query("src_point_lookup", ["articles"], "SELECT id, title_original, content_original IS NOT NULL AND content_original <> '' AS has_content FROM articles WHERE id = 'a000000042'")
def src_point_lookup(v: View) -> DataFrame:
    return v("articles").where("id = 'a000000042'").select("id", "title_original", F.coalesce(F.col("content_original") != "", F.lit(False)).alias("has_content"))


@query("src_missing_body", ["articles"], "SELECT id, published_at FROM articles WHERE coalesce(content_original, '') = '' AND published_at > TIMESTAMP '{FROM}' AND published_at <= TIMESTAMP '{TO}' ORDER BY published_at, id")
def src_missing_body(v: View) -> DataFrame:
    rows = v("articles").where("coalesce(content_original, '') = ''").where(times.in_window(F.col("published_at"), at(FROM), at(TO)))
    return rows.select("id", "published_at").orderBy("published_at", "id")


@query("src_json_listing", ["hits"], "SELECT day, query, n % 7 <> 3 AS found, CASE n % 7 WHEN 3 THEN '' WHEN 1 THEN 'data.items' WHEN 2 THEN 'documents' ELSE 'results' END AS list_key, CASE WHEN n % 7 = 3 THEN 0 ELSE CAST(skipped AS INT) END AS skipped_no_url, CASE WHEN n % 7 = 3 THEN 0 ELSE CAST(rows - skipped AS INT) END AS hits, CASE WHEN n % 7 = 3 THEN 0 ELSE CAST(chars AS BIGINT) END AS title_chars FROM (SELECT day, query, min(event_id) AS n, count(*) AS rows, count(*) FILTER (WHERE event_id % 10 = 0) AS skipped, coalesce(sum(length(title)) FILTER (WHERE event_id % 10 <> 0), 0) AS chars FROM hits GROUP BY day, query) AS a")
def src_json_listing(v: View) -> DataFrame:
    """Answers written as JSON from the hits of a day and query, with the names that several providers use, some without a list; and read again."""
    n, url = F.col("event_id"), F.when(F.col("event_id") % 10 != 0, F.col("url"))
    row = F.struct("title", F.when(n % 2 == 0, url).alias("url"), F.when(n % 2 == 1, url).alias("link"), F.col("published_at").cast("string").alias("publishedDate"), F.col("provider_score").alias("score"))
    answers = v("hits").groupBy("day", "query").agg(F.min("event_id").alias("n"), F.collect_list(row).alias("rows"))
    kind = F.col("n") % 7
    none = F.lit(None).cast(answers.schema["rows"].dataType)
    answer = F.struct(
        F.when(kind.isin(1, 2, 3), none).otherwise(F.col("rows")).alias("results"),
        F.struct(F.when(kind == 1, F.col("rows")).alias("items")).alias("data"),
        F.when(kind == 2, F.col("rows")).alias("documents"),
        F.when(kind == 3, F.col("rows")).alias("entries"),
    )
    read = listings.results(answers.select("day", "query", F.to_json(answer).alias("json")))
    chars = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + F.length(h["title"]))
    return read.select("day", "query", "found", "list_key", "skipped_no_url", F.size("hits").alias("hits"), chars.alias("title_chars"))


# Expressions


@query("fn_canonical_url", ["raw_articles"], f"SELECT doc_id, {_CANON} AS canonical_url FROM raw_articles")
def fn_canonical_url(v: View) -> DataFrame:
    return v("raw_articles").select("doc_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query("fn_domain", ["pages"], r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\.', '') AS domain FROM pages")
def fn_domain(v: View) -> DataFrame:
    return v("pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("fn_stable_id", ["raw_articles"], "SELECT doc_id, concat('rss-', substring(sha256(url), 1, 16)) AS id FROM raw_articles")
def fn_stable_id(v: View) -> DataFrame:
    return v("raw_articles").select("doc_id", urls.stable_id("rss-", F.col("url")).alias("id"))


@query("fn_hash_key", ["articles"], "SELECT id, sha256(concat(coalesce(url, ''), chr(10), coalesce(title_original, ''), chr(10), coalesce(content_original, ''))) AS key FROM articles")
def fn_hash_key(v: View) -> DataFrame:
    return v("articles").select("id", urls.hash_key(F.col("url"), F.col("title_original"), F.col("content_original")).alias("key"))


_NORMAL = r"""trim(regexp_replace(regexp_replace(lower(trim(title)), '[.,;:!?"''`()\[\]{}]+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("fn_norm_title", ["raw_articles"], f"SELECT doc_id, {_NORMAL} AS title_key FROM raw_articles")
def fn_norm_title(v: View) -> DataFrame:
    return v("raw_articles").select("doc_id", text.normal_title(F.col("title")).alias("title_key"))


@query("fn_digest_date", ["articles"], "SELECT id, strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS digest_date FROM articles")
def fn_digest_date(v: View) -> DataFrame:
    return v("articles").select("id", times.digest_date(F.col("published_at")).alias("digest_date"))


@query("fn_date_range", ["articles"], "SELECT id, strftime(published_at - INTERVAL 16 HOUR, '%Y-%m-%d') AS first_day, strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS last_day FROM articles")
def fn_date_range(v: View) -> DataFrame:
    day = times.digest_date(F.col("published_at"))
    return v("articles").select("id", F.date_format(F.date_sub(day.cast("date"), 1), "yyyy-MM-dd").alias("first_day"), day.alias("last_day"))


@query("fn_iso_ts", ["articles"], "SELECT id, strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM articles")
def fn_iso_ts(v: View) -> DataFrame:
    return v("articles").select("id", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"))


@query("fn_as_utc", ["articles"], "SELECT id, CASE WHEN doc_id % 5 = 4 THEN 'no time' ELSE concat(strftime(CASE WHEN doc_id % 5 = 1 THEN published_at - INTERVAL 8 HOUR ELSE published_at END, '%Y-%m-%dT%H:%M:%S'), CASE WHEN doc_id % 5 = 3 THEN '.250000' ELSE '' END, '+00:00') END AS iso FROM articles WHERE published_at IS NOT NULL")
def fn_as_utc(v: View) -> DataFrame:
    """Times written without a zone, with one, with a Z, with a fraction, and text that is none."""
    n, day, clock = F.col("doc_id") % 5, F.date_format("published_at", "yyyy-MM-dd"), F.date_format("published_at", "HH:mm:ss")
    written = F.when(n == 0, F.concat_ws(" ", day, clock)).when(n == 1, F.concat(day, F.lit("T"), clock, F.lit("+08:00"))).when(n == 2, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(n == 3, F.concat(day, F.lit(" "), clock, F.lit(".25"))).otherwise("no time")
    return v("articles").where("published_at IS NOT NULL").select("id", times.iso_text(written).alias("iso"))


_WIDE = f"len(regexp_extract_all(title, '{text.WIDE}'))"


@query("fn_effective_length", ["raw_articles"], f"SELECT doc_id, CAST(floor(length(title) - {_WIDE} + 2.5 * {_WIDE}) AS INT) AS chars FROM raw_articles")
def fn_effective_length(v: View) -> DataFrame:
    return v("raw_articles").select("doc_id", text.effective_length(F.col("title")).alias("chars"))


@query("fn_paragraphs", ["documents"], r"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS INT) AS n_paragraphs FROM documents")
def fn_paragraphs(v: View) -> DataFrame:
    return v("documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).alias("n_paragraphs"))


@query("fn_truncate", ["documents"], r"SELECT doc_id, regexp_replace(substring(text, 1, 100), '\s+$', '') AS head FROM documents")
def fn_truncate(v: View) -> DataFrame:
    return v("documents").select("doc_id", text.truncated(F.col("text"), 100).alias("head"))


@query("fn_short_error", ["run_log"], r"SELECT run_id, nullif(substring(trim(regexp_replace(error, '\s+', ' ', 'g')), 1, 300), '') AS error FROM run_log")
def fn_short_error(v: View) -> DataFrame:
    return v("run_log").select("run_id", text.short_error(F.col("error")).alias("error"))


ERRORS = (("timeout", "timeout"), ("HTTP 403", "forbidden"), ("HTTP 5", "server"), ("no links", "parse"), ("refused", "connection"))
_ERROR_SQL = "CASE WHEN error IS NULL THEN NULL " + " ".join(f"WHEN contains(lower(error), lower('{p}')) THEN '{c}'" for p, c in ERRORS) + " ELSE 'other' END"


def error_class(error: Column) -> Column:
    """The class of the first pattern that an error holds."""
    out = F.when(error.isNull(), F.lit(None))
    for pattern, name in ERRORS:
        out = out.when(F.contains(F.lower(error), F.lit(pattern.lower())), name)
    return out.otherwise("other")


@query("fn_error_class", ["run_log"], f"SELECT run_id, {_ERROR_SQL} AS error_class FROM run_log")
def fn_error_class(v: View) -> DataFrame:
    return v("run_log").select("run_id", error_class(F.col("error")).alias("error_class"))


@query("fn_count_text", ["repos"], "SELECT repo, rank, CAST(regexp_extract(stars_text, '([0-9]+) stars', 1) AS INT) AS stars_today FROM repos")
def fn_count_text(v: View) -> DataFrame:
    n = F.regexp_extract("stars_text", r"([0-9][0-9,]*)\s+stars", 1)
    return v("repos").select("repo", "rank", F.replace(n, F.lit(","), F.lit("")).try_cast("int").alias("stars_today"))


@query("fn_safe_float", ["repos"], "SELECT rank, coalesce(try_cast(stars_text AS DOUBLE), 0.0) AS value FROM repos")
def fn_safe_float(v: View) -> DataFrame:
    return v("repos").select("rank", F.coalesce(F.col("stars_text").try_cast("double"), F.lit(0.0)).alias("value"))


@query("fn_result_date", ["articles", "links"], "SELECT a.id, coalesce(min(l.digest_date), strftime(any_value(a.published_at), '%Y-%m-%d')) AS day FROM articles AS a LEFT JOIN links AS l ON a.id = l.news_id GROUP BY a.id")
def fn_result_date(v: View) -> DataFrame:
    rows = v("articles").join(v("links").withColumnRenamed("news_id", "id"), "id", "left").groupBy("id").agg(F.min("digest_date").alias("d"), F.any_value("published_at").alias("p"))
    return rows.select("id", F.coalesce("d", F.date_format("p", "yyyy-MM-dd")).alias("day"))


@query("fn_importance", ["articles"], "SELECT id, greatest(0.0, least(coalesce(CAST(importance_score AS DOUBLE), 35.0), 100.0)) / 100 AS importance FROM articles")
def fn_importance(v: View) -> DataFrame:
    return v("articles").select("id", ranking.importance().alias("importance"))


@query("proj_body_flags", ["articles"], "SELECT id, content_original IS NOT NULL AND length(trim(content_original)) > 0 AS has_content, content_extraction_method AS method FROM articles")
def proj_body_flags(v: View) -> DataFrame:
    has = F.coalesce(F.length(F.trim("content_original")) > 0, F.lit(False))
    return v("articles").select("id", has.alias("has_content"), F.col("content_extraction_method").alias("method"))


@query("proj_article", ["raw_articles"], "SELECT concat('rss-', substring(sha256(url), 1, 16)) AS id, coalesce(nullif(trim(CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE title END), ''), 'Untitled') AS title_original, coalesce(nullif(summary, ''), '') AS summary, source, coalesce(source_type, 'media') AS source_type, published_at, CASE source_type WHEN 'official' THEN 'official,rss' WHEN 'research' THEN 'research,rss' ELSE 'rss' END AS tags FROM raw_articles")
def proj_article(v: View) -> DataFrame:
    """Entries as articles, with defaults for what an entry lacks and the tags of its source's class."""
    written = v("raw_articles").withColumn("title", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("title")))
    kind = F.coalesce("source_type", F.lit("media"))
    tags = F.array_compact(F.array(F.when(kind.isin("official", "research"), kind), F.lit("rss")))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    return written.select(urls.stable_id("rss-", F.col("url")).alias("id"), title.alias("title_original"), F.coalesce("summary", F.lit("")).alias("summary"), "source", kind.alias("source_type"), "published_at", F.array_join(tags, ",").alias("tags"))


@query("proj_repo", ["repos", "repo_metadata"], "SELECT r.rank, r.repo, coalesce(nullif(m.description, ''), r.description) AS description, coalesce(m.license, '') AS license, m.forks FROM repos AS r LEFT JOIN repo_metadata AS m ON r.rank = m.part")
def proj_repo(v: View) -> DataFrame:
    m = v("repo_metadata").select(F.col("part").alias("rank"), F.col("description").alias("more"), "license", "forks")
    return v("repos").join(m, "rank", "left").select("rank", "repo", F.coalesce(F.nullif("more", F.lit("")), "description").alias("description"), F.coalesce("license", F.lit("")).alias("license"), "forks")


def _rules_sql(column: str, found, default: str) -> str:
    cases = []
    for name, terms in found:
        latin = [w.replace(".", "\\.") for w in terms if all(ord(c) <= 0x2E00 for c in w)]
        cjk = [w for w in terms if any(ord(c) > 0x2E00 for c in w)]
        pattern = "|".join([f"(^|[^a-z0-9])({'|'.join(latin)})($|[^a-z0-9])"] * bool(latin) + cjk)
        cases.append(f"WHEN regexp_matches({column}, '{pattern}') THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


_LABEL = "lower(concat_ws(' ', nullif(title_cn, ''), nullif(title_original, ''), nullif(summary, ''), nullif(why_it_matters, ''), nullif(source, '')))"
_LABELS = f"SELECT *, {_rules_sql('t', rules.TOPICS, 'other')} AS topic, {_rules_sql('t', rules.COMPANIES, '')} AS company FROM (SELECT *, {_LABEL} AS t FROM articles) AS l0"
@query("fn_topic", ["articles"], f"SELECT id, topic FROM ({_LABELS}) AS l")
def fn_topic(v: View) -> DataFrame:
    return labelled(v("articles")).select("id", "topic")


@query("fn_company", ["articles"], f"SELECT id, company FROM ({_LABELS}) AS l")
def fn_company(v: View) -> DataFrame:
    return labelled(v("articles")).select("id", "company")


@query("fn_label", ["articles"], f"SELECT id, topic, company FROM ({_LABELS}) AS l")
def fn_label(v: View) -> DataFrame:
    return labelled(v("articles")).select("id", "topic", "company")


_LATIN = r"[a-z0-9][a-z0-9._\-]*"


def _tokens_sql(column: str) -> str:
    """Tokens of a column: words, and pairs of CJK characters."""
    words = f"list_filter(list_transform(regexp_extract_all(lower({column}), '{_LATIN}'), lambda x: regexp_replace(x, '^[._\\-]+|[._\\-]+$', '', 'g')), lambda x: regexp_matches(x, '^[0-9]+$') OR (length(x) >= 2 AND NOT list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], x)))"
    pairs = f"flatten(list_transform(regexp_extract_all({column}, '{text.CJK}'), lambda run: CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substring(run, CAST(i AS INT), 2)) END))"
    return f"list_distinct(list_concat({words}, {pairs}))"


_TOKENS = _tokens_sql("title_original")


@query("fn_tokens", ["articles"], f"SELECT id, CAST(len({_TOKENS}) AS INT) AS n_tokens, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM articles")
def fn_tokens(v: View) -> DataFrame:
    found = text.tokens(F.col("title_original"))
    return v("articles").select("id", F.size(found).alias("n_tokens"), F.array_join(F.array_sort(found), " ").alias("tokens"))


@query("fn_version_tokens", ["articles"], f"SELECT id, array_to_string(list_sort(list_filter({_TOKENS}, lambda x: regexp_matches(x, '[0-9]'))), ' ') AS versions FROM articles")
def fn_version_tokens(v: View) -> DataFrame:
    return v("articles").select("id", F.array_join(F.array_sort(text.versions(text.tokens(F.col("title_original")))), " ").alias("versions"))


@query("fn_figures", ["articles"], f"SELECT id, array_to_string(list_sort(list_filter({_TOKENS}, lambda x: regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^(19|20)[0-9][0-9]$'))), ' ') AS figures FROM articles")
def fn_figures(v: View) -> DataFrame:
    return v("articles").select("id", F.array_join(F.array_sort(text.figures(text.tokens(F.col("title_original")))), " ").alias("figures"))


@query("fn_distinctive_terms", ["articles"], r"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title_original), '[a-z]+[a-z0-9]*[.\-]?[0-9][a-z0-9._\-]*'))), ' ') AS terms FROM articles")
def fn_distinctive_terms(v: View) -> DataFrame:
    return v("articles").select("id", F.array_join(F.array_sort(text.distinctive(F.col("title_original"))), " ").alias("terms"))


# Joins


@query("join_digest_news", ["articles", "links"], "SELECT digest_date, id, position, position + 1 AS rank, position < 10 AS is_top_story FROM links AS l JOIN articles AS a ON l.news_id = a.id WHERE digest_date = '2024-01-03'")
def join_digest_news(v: View) -> DataFrame:
    rows = v("links").where("digest_date = '2024-01-03'").join(v("articles").withColumnRenamed("id", "news_id"), "news_id")
    return rows.select("digest_date", F.col("news_id").alias("id"), "position", (F.col("position") + 1).alias("rank"), (F.col("position") < 10).alias("is_top_story"))


@query("join_first_digest_date", ["articles", "links"], "SELECT a.id, (SELECT min(digest_date) FROM links AS l WHERE l.news_id = a.id) AS first_digest_date FROM articles AS a")
def join_first_digest_date(v: View) -> DataFrame:
    first = v("links").groupBy(F.col("news_id").alias("id")).agg(F.min("digest_date").alias("first_digest_date"))
    return v("articles").select("id").join(first, "id", "left")


@query("join_source_priority", ["articles", "sources"], "SELECT a.id, coalesce(s.priority, 1000) AS priority FROM articles AS a LEFT JOIN (SELECT * FROM sources WHERE enabled) AS s ON a.source_id = s.source_id")
def join_source_priority(v: View) -> DataFrame:
    return dedup.with_priority(v("articles"), v("sources").where("enabled")).select("id", "priority")


_MATCHED = "SELECT h.domain, s.source_id, row_number() OVER (PARTITION BY h.domain ORDER BY s.priority, s.source_id) AS k FROM (SELECT DISTINCT domain FROM hits) AS h JOIN (SELECT source_id, priority, concat('s', n * 3, '.example.com') AS d FROM sources) AS s ON h.domain = s.d OR ends_with(h.domain, concat('.', s.d)) OR ends_with(s.d, concat('.', h.domain))"


def source_of_domain(domains: DataFrame, sources: DataFrame) -> DataFrame:
    """domain and source_id of the best source whose domain is it, holds it or lies under it: two equality joins on suffixes."""
    own = sources.select("source_id", "priority", F.col("domain").alias("d"))
    under = domains.select("domain", F.explode(urls.suffixes(F.col("domain"))).alias("d")).join(own, "d").select("domain", "source_id", "priority")
    over = domains.join(own.select("source_id", "priority", F.explode(urls.suffixes(F.col("d"))).alias("domain")), "domain").select("domain", "source_id", "priority")
    return dedup.first_by_key(under.union(over), ["domain"], F.col("priority"), F.col("source_id")).select("domain", "source_id")


def _spread(sources: DataFrame) -> DataFrame:
    return sources.withColumn("domain", F.concat(F.lit("s"), F.col("n") * 3, F.lit(".example.com")))


@query("join_domain_source", ["hits", "sources"], f"SELECT domain, source_id FROM ({_MATCHED}) AS m WHERE k = 1")
def join_domain_source(v: View) -> DataFrame:
    return source_of_domain(v("hits").select("domain").distinct(), _spread(v("sources")))


@query("join_known_flag", ["hits", "sources"], f"SELECT d.domain, m.domain IS NOT NULL AS known FROM (SELECT DISTINCT domain FROM hits) AS d LEFT JOIN ({_MATCHED}) AS m ON d.domain = m.domain AND k = 1")
def join_known_flag(v: View) -> DataFrame:
    domains = v("hits").select("domain").distinct()
    return domains.join(source_of_domain(domains, _spread(v("sources"))), "domain", "left").select("domain", F.col("source_id").isNotNull().alias("known"))


@query("join_repo_metadata", ["repos", "repo_metadata"], "SELECT r.rank, r.repo, m.part IS NULL AS strict FROM repos AS r LEFT JOIN repo_metadata AS m ON r.rank = m.part")
def join_repo_metadata(v: View) -> DataFrame:
    m = v("repo_metadata").select(F.col("part").alias("rank"), F.lit(True).alias("has"))
    return v("repos").join(m, "rank", "left").select("rank", "repo", F.col("has").isNull().alias("strict"))


@query("join_title_48h", ["raw_articles"], f"SELECT a, b FROM (SELECT doc_id AS b, p, lag(doc_id) OVER w AS a, lag(p) OVER w AS before FROM (SELECT doc_id, published_at AS p, {_NORMAL} AS k FROM raw_articles WHERE published_at IS NOT NULL) AS x WHERE k <> '' WINDOW w AS (PARTITION BY k ORDER BY p, doc_id)) AS y WHERE p - before <= INTERVAL 48 HOUR")
def join_title_48h(v: View) -> DataFrame:
    return dedup.title_links(v("raw_articles"))


@query("join_enrichment", ["articles"], "SELECT id, coalesce(e.title_cn, nullif(a.title_cn, ''), a.title_original) AS title, e.key IS NULL AS needs_work FROM articles AS a LEFT JOIN (SELECT sha256(concat(url, chr(10), title_original)) AS key, min(title_cn) AS title_cn FROM articles WHERE title_cn <> '' AND doc_id % 7 <> 0 AND importance_score BETWEEN 0 AND 100 GROUP BY 1) AS e ON sha256(concat(a.url, chr(10), a.title_original)) = e.key")
def join_enrichment(v: View) -> DataFrame:
    """Titles from the cache, one row a key and only answers that are valid; else what the row has, else the original."""
    key = urls.hash_key(F.col("url"), F.col("title_original"))
    cache = v("articles").where("doc_id % 7 <> 0").select(key.alias("key"), "title_cn", "importance_score")
    known = cache.where("title_cn <> '' AND importance_score BETWEEN 0 AND 100").groupBy("key").agg(F.min("title_cn").alias("t"))
    rows = v("articles").withColumn("key", key).join(known, "key", "left")
    return rows.select("id", F.coalesce("t", F.nullif("title_cn", F.lit("")), "title_original").alias("title"), F.col("t").isNull().alias("needs_work"))


# Duplicates

_KEYED = f"SELECT r.*, s.priority FROM (SELECT *, {_CANON} AS canonical_url FROM raw_articles) AS r JOIN sources AS s ON r.source_id = s.source_id"
_BY_URL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY source_type <> 'official', priority, published_at NULLS LAST, url) AS k FROM ({_KEYED}) AS k0) AS k1 WHERE k = 1"


@query("dedup_url", ["raw_articles", "sources"], f"SELECT doc_id, canonical_url FROM ({_BY_URL}) AS u")
def dedup_url(v: View) -> DataFrame:
    return dedup.by_url(v("raw_articles"), v("sources")).select("doc_id", "canonical_url")


#: Rows of a title in scan order: each takes the number of the first cluster with a member within 48 hours, else its own.
_TITLED = f"""WITH u AS (SELECT doc_id, canonical_url, url, source_type, priority, published_at, concat(canonical_url, chr(10), url) AS key, epoch_us(published_at) AS us, {_NORMAL} AS title_key FROM ({_BY_URL}) AS u0),
g AS (SELECT title_key, list([{{{{'key': key, 'us': us, 'c': CAST(1 AS BIGINT)}}}}] ORDER BY canonical_url, url) AS rows FROM u WHERE title_key <> '' AND us IS NOT NULL GROUP BY title_key),
r AS (SELECT list_reduce(rows, lambda acc, x: list_concat(acc, [{{{{'key': x[1].key, 'us': x[1].us, 'c': coalesce(list_min(list_transform(list_filter(acc, lambda p: abs(p.us - x[1].us) <= 172800000000), lambda p: p.c)), len(acc) + 1)}}}}])) AS rows FROM g),
c AS (SELECT rows[i].key AS key, rows[rows[i].c].key AS cluster FROM (SELECT rows, unnest(range(1, len(rows) + 1)) AS i FROM r) AS r1),
n AS (SELECT u.*, coalesce(c.cluster, u.key) AS cluster FROM u LEFT JOIN c ON u.key = c.key)
SELECT doc_id, canonical_url, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY source_type <> 'official', priority, published_at NULLS LAST, canonical_url, url) AS k FROM n) AS w WHERE k = 1""".replace("{{", "{").replace("}}", "}")


@query("dedup_title", ["raw_articles", "sources"], _TITLED)
def dedup_title(v: View) -> DataFrame:
    return dedup.title_winners(dedup.by_title(dedup.by_url(v("raw_articles"), v("sources")))).select("doc_id", "canonical_url", "cluster")


@query("dedup_first_by_key", ["hits"], "SELECT query, url, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY event_id) AS k FROM hits) AS h WHERE k = 1 GROUP BY query, url")
def dedup_first_by_key(v: View) -> DataFrame:
    return dedup.first_by_key(v("hits"), ["query", "url"], F.col("event_id")).select("query", "url", "event_id")


def event_view(v: View) -> DataFrame:
    """Articles with copies that other sources tell five hours later."""
    rows = v("articles").withColumn("why_it_matters", F.lit(""))
    more = rows.where("doc_id % 4 = 0").withColumns({"id": F.concat(F.lit("b"), "id"), "source_id": F.lit("src3"), "source": F.lit("Source 3"), "published_at": F.col("published_at") + F.expr("INTERVAL 5 HOURS")})
    return rows.unionByName(more)


# Aggregates


@query("agg_rrf", ["hits"], "SELECT url, min(domain) AS domain, sum(1.0 / (60 + rank)) AS rrf_score, count(*) AS n_queries FROM (SELECT url, query, min(domain) AS domain, min(rank) AS rank FROM hits GROUP BY url, query) AS b GROUP BY url")
def agg_rrf(v: View) -> DataFrame:
    return ranking.reciprocal_ranks(v("hits")).select("url", "domain", "rrf_score", "n_queries")


_FOUND_AT = "2024-01-15 00:00:00"
_HIT_TOPICAL = _IS_TOPICAL.replace("doc_id, source_id, t, ", "*, ").replace("doc_id, source_id, ", "*, ").replace("FROM raw_articles", "FROM hits")
_GATES = f"""SELECT *, CASE WHEN domain = 's7.example.com' THEN 'social' WHEN published_at IS NULL THEN 'missing_time' WHEN published_at > TIMESTAMP '{_FOUND_AT}' OR TIMESTAMP '{_FOUND_AT}' - published_at >= INTERVAL 24 HOUR THEN 'outside_24h' WHEN NOT topical THEN 'not_ai' ELSE 'kept' END AS gate FROM ({_HIT_TOPICAL}) AS t0"""
_FUNNEL = f"""WITH g AS ({_GATES}),
r AS (SELECT url, min(domain) AS domain, max(published_at) AS published_at, sum(1.0 / (60 + rank)) AS s, count(*) AS n FROM (SELECT url, query, min(domain) AS domain, min(rank) AS rank, max(published_at) AS published_at FROM g WHERE gate = 'kept' GROUP BY url, query) AS b GROUP BY url),
c AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY s DESC, coalesce(epoch_us(published_at), 0) DESC, url) AS k FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY s DESC, coalesce(epoch_us(published_at), 0) DESC, url) AS position FROM c WHERE k <= 2),
d AS (SELECT domain, count(*) AS n, (SELECT count(*) FROM p WHERE p.domain = r.domain AND position <= 24) AS taken FROM r GROUP BY domain)
SELECT (SELECT count(*) FROM g) AS raw, (SELECT count(*) FROM g WHERE gate = 'social') AS social, (SELECT count(*) FROM g WHERE gate = 'missing_time') AS missing_time, (SELECT count(*) FROM g WHERE gate = 'outside_24h') AS outside_24h,
  (SELECT count(*) FROM g WHERE gate IN ('not_ai', 'kept')) AS inside_24h, (SELECT count(*) FROM g WHERE gate = 'not_ai') AS not_ai, (SELECT count(*) FROM r) AS unique_urls, (SELECT count(*) FROM r WHERE n > 1) AS several_queries,
  (SELECT CAST(coalesce(sum(taken), 0) AS BIGINT) FROM d) AS selected, (SELECT CAST(coalesce(sum(n - taken) FILTER (WHERE taken >= 2), 0) AS BIGINT) FROM d) AS dropped_domain_cap, (SELECT CAST(coalesce(sum(n - taken) FILTER (WHERE taken < 2), 0) AS BIGINT) FROM d) AS dropped_candidate_cap"""


@query("agg_discovery_funnel", ["hits"], _FUNNEL)
def agg_discovery_funnel(v: View) -> DataFrame:
    """Hits by the first gate that stops them, then what merging by URL and the caps leave."""
    inside = times.within_hours(F.col("published_at"), at(_FOUND_AT), 24, closed=False)
    gate = F.when(F.col("domain") == "s7.example.com", "social").when(F.col("published_at").isNull(), "missing_time").when(~inside, "outside_24h").when(~rules.topical(F.col("title"), F.col("summary")), "not_ai").otherwise("kept")
    hits = v("hits").withColumn("gate", gate)
    gates = hits.agg(
        F.count("*").alias("raw"),
        *[F.count_if(F.col("gate") == g).alias(g) for g in ("social", "missing_time", "outside_24h")],
        F.count_if(F.col("gate").isin("not_ai", "kept")).alias("inside_24h"),
        F.count_if(F.col("gate") == "not_ai").alias("not_ai"),
    )
    merged = ranking.reciprocal_ranks(hits.where("gate = 'kept'"))
    urls_found = merged.agg(F.count("*").alias("unique_urls"), F.count_if(F.col("n_queries") > 1).alias("several_queries"))
    # three tables of one row
    return gates.join(urls_found).join(ranking.selection_counts(merged))


#: Hosts of results: of sources and below them, of all kinds, in two lists at once, and look-alikes.
RESULT_HOSTS = ("src1.example.com", "news.src2.example.com", "163.com", "m.toutiao.com", "mp.weixin.qq.com", "arxiv.org", "spectrum.ieee.org", "eu.techcrunch.com", "evil-arxiv.org", "example.org", "csdn.net")
HOST_SQL = f"[{', '.join(repr(h) for h in RESULT_HOSTS)}][CAST(user_id % {len(RESULT_HOSTS)} + 1 AS INT)]"


def result_host() -> Column:
    return F.element_at(F.lit(list(RESULT_HOSTS)), (F.col("user_id") % len(RESULT_HOSTS) + 1).cast("int"))


def kind_sql(host: str, ugc: str) -> str:
    """The kind of a host that no known source has: the first whose list holds it or a host above it."""
    lists = " ".join(f"WHEN len(list_filter([{', '.join(repr(h) for h in hosts)}], lambda h: {host} = h OR ends_with({host}, concat('.', h)))) > 0 THEN '{name}'" for name, hosts in rules.HOSTS)
    return f"CASE {lists} WHEN {ugc} THEN 'ugc_blog' ELSE 'unknown' END"


_SUMMARY = f"""WITH t AS ({_HIT_TOPICAL}), u AS (SELECT *, {kind_sql(HOST_SQL, 'user_id % 2 = 0')} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query, day, rank) AS k FROM t) AS x WHERE k = 1)
SELECT (SELECT count(*) FROM t) AS raw, (SELECT count(*) FROM t) - count(*) AS duplicates, count(*) AS uniq, count(DISTINCT coalesce(nullif(domain, ''), '(no host)')) AS domains, count(*) FILTER (WHERE s.domain2 IS NOT NULL) AS known, count(*) FILTER (WHERE s.domain2 IS NULL) AS discovered,
  count(published_at) AS published, count(*) FILTER (WHERE published_at <= TIMESTAMP '{_FOUND_AT}' AND TIMESTAMP '{_FOUND_AT}' - published_at <= INTERVAL 24 HOUR) AS inside_24h,
  count(*) FILTER (WHERE published_at > TIMESTAMP '{_FOUND_AT}' OR TIMESTAMP '{_FOUND_AT}' - published_at > INTERVAL 24 HOUR) AS outside_24h, count(*) FILTER (WHERE published_at IS NULL) AS unknown_time, count(*) FILTER (WHERE NOT topical) AS irrelevant,
  {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k if k != 'unknown' else 'unknown_quality'}" for k in ('portal', 'ugc_blog', 'research', 'professional_media', 'unknown'))},
  count(*) FILTER (WHERE domain IN ('s1.example.com', 's2.example.com')) AS second_hand, count(*) FILTER (WHERE user_id % 2 = 0) AS tagged, count(DISTINCT concat('v', user_id % 5)) AS genres
FROM u LEFT JOIN (SELECT concat('s', n, '.example.com') AS domain2 FROM sources) AS s ON u.domain = s.domain2"""


@query("agg_domain_histogram", ["hits"], "SELECT coalesce(nullif(domain, ''), '(no host)') AS domain, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, 1")
def agg_domain_histogram(v: View) -> DataFrame:
    return v("hits").groupBy(F.coalesce(F.nullif("domain", F.lit("")), F.lit("(no host)")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")


def outcomes(runs: DataFrame) -> DataFrame:
    """Per source: fetched, valid, skipped, failures and status."""
    rows = runs.groupBy("source_id").agg(F.sum("fetched").alias("fetched"), F.sum("valid").alias("valid"), F.sum(F.col("fetched") - F.col("valid")).alias("skipped"), F.count_if(~F.col("success")).alias("failures"), F.count("*").alias("runs"))
    return rows.withColumn("status", F.when(F.col("failures") == F.col("runs"), "FAIL").when(F.col("valid") == 0, "EMPTY").otherwise("OK"))


_OUTCOMES = "SELECT source_id, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(fetched - valid) AS BIGINT) AS skipped, count(*) FILTER (WHERE NOT success) AS failures, count(*) AS runs, CASE WHEN count(*) FILTER (WHERE NOT success) = count(*) THEN 'FAIL' WHEN sum(valid) = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM run_log GROUP BY source_id"


@query("agg_source_outcome", ["run_log"], _OUTCOMES)
def agg_source_outcome(v: View) -> DataFrame:
    return outcomes(v("run_log"))


@query("agg_health_summary", ["run_log"], f"SELECT count(*) FILTER (WHERE status = 'OK') AS ok, count(*) AS total, bool_and(status = 'FAIL') AS all_failed FROM ({_OUTCOMES}) AS o")
def agg_health_summary(v: View) -> DataFrame:
    return outcomes(v("run_log")).agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count("*").alias("total"), F.bool_and(F.col("status") == "FAIL").alias("all_failed"))


@query("agg_coverage", ["run_log", "sources"], f"SELECT organization, channel, s.name, o.status, count(*) OVER (PARTITION BY organization, channel) > 1 AS repeats FROM ({_OUTCOMES}) AS o JOIN sources AS s ON o.source_id = s.source_id UNION ALL SELECT 'org9', 'video', NULL, 'UNSUPPORTED', false")
def agg_coverage(v: View) -> DataFrame:
    rows = outcomes(v("run_log")).join(v("sources"), "source_id")
    rows = rows.select("organization", "channel", "name", "status", (F.count("*").over(Window.partitionBy("organization", "channel")) > 1).alias("repeats"))
    unsupported = rows.sparkSession.createDataFrame([("org9", "video", None, "UNSUPPORTED", False)], rows.schema)
    return rows.unionByName(unsupported)


@query("agg_org_sources", ["sources"], "SELECT organization, string_agg(name, ', ' ORDER BY name) AS names, count(*) AS n FROM sources GROUP BY organization")
def agg_org_sources(v: View) -> DataFrame:
    return v("sources").groupBy("organization").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"), F.count("*").alias("n"))


@query("agg_digest_summaries", ["links", "project_links"], "SELECT digest_date, news_count, coalesce(project_count, 0) AS project_count, least(news_count, 10) AS top_count FROM (SELECT digest_date, count(*) AS news_count FROM links GROUP BY digest_date) AS n LEFT JOIN (SELECT digest_date AS d, count(*) AS project_count FROM project_links GROUP BY digest_date) AS p ON n.digest_date = p.d ORDER BY digest_date DESC")
def agg_digest_summaries(v: View) -> DataFrame:
    news = v("links").groupBy("digest_date").agg(F.count("*").alias("news_count"))
    rows = news.join(v("project_links").groupBy("digest_date").agg(F.count("*").alias("p")), "digest_date", "left")
    return rows.select("digest_date", "news_count", F.coalesce("p", F.lit(0)).alias("project_count"), F.least("news_count", F.lit(10)).alias("top_count")).orderBy(F.desc("digest_date"))


@query("agg_store_stats", ["articles", "links", "repos"], "SELECT (SELECT count(DISTINCT digest_date) FROM links) AS digests, (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM repos) AS projects")
def agg_store_stats(v: View) -> DataFrame:
    counts = tables.report({"articles": v("articles"), "digests": v("links").select("digest_date").distinct(), "projects": v("repos")})
    return counts.agg(*[F.sum(F.when(F.col("table") == t, F.col("n"))).alias(t) for t in ("digests", "articles", "projects")])


@query("agg_digest_overview", ["articles", "links"], f"SELECT digest_date, count(*) AS total, count(*) FILTER (WHERE position < 10) AS top_stories, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN topic <> 'other' THEN topic END) AS topics FROM links AS k JOIN ({_LABELS}) AS l ON k.news_id = l.id GROUP BY digest_date")
def agg_digest_overview(v: View) -> DataFrame:
    rows = v("links").join(labelled(v("articles")).withColumnRenamed("id", "news_id"), "news_id")
    return rows.groupBy("digest_date").agg(F.count("*").alias("total"), F.count_if(F.col("position") < 10).alias("top_stories"), F.count_distinct("source").alias("sources"), F.count_distinct(F.when(F.col("topic") != "other", F.col("topic"))).alias("topics"))


@query("agg_digest_description", ["articles", "links"], "SELECT digest_date, concat(string_agg(DISTINCT source, '、' ORDER BY source), ' ', count(*)) AS description FROM links AS k JOIN articles AS a ON k.news_id = a.id GROUP BY digest_date")
def agg_digest_description(v: View) -> DataFrame:
    rows = v("links").join(v("articles").withColumnRenamed("id", "news_id"), "news_id")
    return rows.groupBy("digest_date").agg(F.concat(F.array_join(F.array_sort(F.collect_set("source")), "、"), F.lit(" "), F.count("*")).alias("description"))


@query("agg_ranking_stats", ["articles"], f"SELECT count(*) AS candidates, least(count(*), 10) AS top_stories, count(DISTINCT topic) AS topics, count(DISTINCT nullif(company, '')) AS companies FROM ({_LABELS}) AS l")
def agg_ranking_stats(v: View) -> DataFrame:
    return labelled(v("articles")).agg(F.count("*").alias("candidates"), F.least(F.count("*"), F.lit(10)).alias("top_stories"), F.count_distinct("topic").alias("topics"), F.count_distinct(F.nullif("company", F.lit(""))).alias("companies"))


_MEDIA = """SELECT a.*, CASE WHEN source_type <> 'media' THEN NULL WHEN importance_score IS NULL THEN 'missing_importance' WHEN importance_score < 60 THEN 'below_threshold'
 WHEN g <= 5 THEN 'kept' WHEN n_kept >= 2 THEN 'per_source_cap' ELSE 'total_cap' END AS reason FROM articles AS a
 LEFT JOIN (SELECT *, count(*) FILTER (WHERE g <= 5) OVER (PARTITION BY src) AS n_kept FROM (SELECT id AS id1, source AS src, CASE WHEN k <= 2 THEN row_number() OVER (PARTITION BY k <= 2 ORDER BY importance_score DESC, published_at DESC NULLS LAST, id) END AS g FROM
 (SELECT *, row_number() OVER (PARTITION BY source ORDER BY importance_score DESC, published_at DESC NULLS LAST, id) AS k FROM articles WHERE source_type = 'media' AND importance_score >= 60) AS m0) AS m1) AS m ON a.id = m.id1"""


@query("rank_media_caps", ["articles"], f"SELECT id, reason, coalesce(reason = 'kept', true) AS kept FROM ({_MEDIA}) AS m")
def rank_media_caps(v: View) -> DataFrame:
    return ranking.media_decisions(v("articles")).select("id", "reason", "kept")


@query("agg_media_stats", ["articles"], f"SELECT reason, count(*) AS n FROM ({_MEDIA}) AS m WHERE reason IS NOT NULL GROUP BY reason")
def agg_media_stats(v: View) -> DataFrame:
    return ranking.media_decisions(v("articles")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("agg_type_counts", ["articles"], "SELECT t.source_type, count(a.id) AS n FROM (VALUES ('official'), ('research'), ('media'), ('community')) AS t(source_type) LEFT JOIN articles AS a ON a.source_type = t.source_type GROUP BY t.source_type")
def agg_type_counts(v: View) -> DataFrame:
    rows = v("articles")
    kinds = rows.sparkSession.createDataFrame([("official",), ("research",), ("media",), ("community",)], "source_type string")
    return kinds.join(rows.groupBy("source_type").agg(F.count("*").alias("c")), "source_type", "left").select("source_type", F.coalesce("c", F.lit(0)).alias("n"))


@query("agg_latest", ["articles", "links"], "SELECT max(digest_date) AS latest, max(digest_date) FILTER (WHERE digest_date < '2024-01-06') AS before FROM links")
def agg_latest(v: View) -> DataFrame:
    return v("links").agg(F.max("digest_date").alias("latest"), F.max(F.when(F.col("digest_date") < "2024-01-06", F.col("digest_date"))).alias("before"))


@query("agg_days_without_success", ["run_log", "sources"], "SELECT source_id, day FROM (SELECT source_id FROM sources) AS s, (SELECT DISTINCT CAST(started_at AS DATE) AS day FROM run_log WHERE started_at >= TIMESTAMP '2024-01-02') AS d WHERE NOT EXISTS (SELECT 1 FROM run_log AS r WHERE CAST(r.started_at AS DATE) = d.day AND success AND r.source_id = s.source_id AND valid >= 4)")
def agg_days_without_success(v: View) -> DataFrame:
    """Days since a cutoff on which any source ran, and the sources of which no run landed at least four rows then."""
    rows = v("run_log").where(F.col("started_at") >= at("2024-01-02 00:00:00")).withColumn("day", F.to_date("started_at"))
    # as many days as the log has, in one array
    days = rows.agg(F.coalesce(F.collect_set("day"), F.array().cast("array<date>")).alias("days")).scalar()
    return v("sources").select("source_id", F.explode(days).alias("day")).join(rows.where("success AND valid >= 4").select("source_id", "day").distinct(), ["source_id", "day"], "left_anti")


# Ranks, orders, sets


_SCORE = "100 * (0.60 * (greatest(0.0, least(coalesce(CAST(importance_score AS DOUBLE), 35.0), 100.0)) / 100) + 0.20 * CASE source_type WHEN 'official' THEN 1.0 WHEN 'research' THEN 0.55 WHEN 'media' THEN 0.15 ELSE 0.10 END + 0.08 * {rec} + 0.05 * {con})"
_REC = "coalesce(greatest(0.0, least((epoch_us(published_at) - epoch_us(TIMESTAMP '2024-01-04')) / CAST(epoch_us(TIMESTAMP '2024-01-06') - epoch_us(TIMESTAMP '2024-01-04') AS DOUBLE), 1.0)), 0.0)"
_CON = "(CASE content_extraction_method WHEN 'web' THEN 1.0 WHEN 'rss_full' THEN 0.9 WHEN 'rss_summary' THEN 0.3 ELSE 0.2 END * (1 + least(length(coalesce(content_original, '')) / 4000.0, 1.0)) / 2)"
_BASE = _SCORE.replace("{rec}", _REC).replace("{con}", _CON)


@query("rank_recency", ["articles"], f"SELECT id, {_REC} AS recency FROM articles")
def rank_recency(v: View) -> DataFrame:
    return v("articles").select("id", ranking.recency(at(FROM), at(TO)).alias("recency"))


@query("rank_content", ["articles"], f"SELECT id, {_CON} AS content FROM articles")
def rank_content(v: View) -> DataFrame:
    return v("articles").select("id", ranking.content().alias("content"))


@query("rank_base_score", ["articles"], f"SELECT id, {_BASE} AS base_score FROM articles")
def rank_base_score(v: View) -> DataFrame:
    return v("articles").select("id", ranking.base_score(at(FROM), at(TO), F.lit(1)).alias("base_score"))


def scored(v: View) -> DataFrame:
    rows = labelled(v("articles")).where("published_at IS NOT NULL").withColumn("digest_date", times.digest_date(F.col("published_at"), "UTC"))
    return rows.withColumn("base_score", ranking.rounded(ranking.base_score(at(FROM), at(TO), F.lit(1))))


def _diverse_sql(scored: str, most: str) -> str:
    """digest_date, id, penalty, final_score, rank of the first picks (`most` of n) of each digest of some rows of digest_date, id, base_score, us, company, topic, source."""
    row = "STRUCT(id VARCHAR, score DOUBLE, us DOUBLE, company VARCHAR, topic VARCHAR, source VARCHAR)"
    pick = "STRUCT(id VARCHAR, cost DOUBLE, final DOUBLE, company VARCHAR, topic VARCHAR, source VARCHAR)"

    def before(field: str, none: str) -> str:
        return f"CASE WHEN p.{field} = '{none}' THEN 0 ELSE len(list_filter(acc.picks, lambda o: o.{field} = p.{field})) END"

    cost = f"least(3.0 * {before('company', '')} + 2.0 * {before('topic', 'other')} + {before('source', '')}, 8.0)"
    costed = f"list_transform(acc.lft, lambda p: {{'p': p, 'cost': CAST({cost} AS DOUBLE)}})"
    best = f"list_min(list_transform({costed}, lambda c: {{'f': c.cost - c.p.score, 'u': -c.p.us, 'i': c.p.id, 'cost': c.cost, 'p': c.p}}))"
    taken = "{'id': b.i, 'cost': b.cost, 'final': -b.f, 'company': b.p.company, 'topic': b.p.topic, 'source': b.p.source}"
    step = f"lambda acc, x: list_transform([{best}], lambda b: {{'lft': list_filter(acc.lft, lambda p: p.id <> b.i), 'picks': list_append(acc.picks, {taken})}})[1]"
    start = f"{{'lft': items, 'picks': CAST([] AS {pick}[])}}"
    blank = f"{{'lft': CAST([] AS {row}[]), 'picks': CAST([] AS {pick}[])}}"
    return f"""SELECT digest_date, picks[i].id AS id, picks[i].cost AS penalty, picks[i].final AS final_score, CAST(i AS INT) AS rank FROM (SELECT digest_date, picks, unnest(range(1, len(picks) + 1)) AS i
FROM (SELECT digest_date, list_reduce(list_concat([{start}], list_transform(range({most}), lambda k: {blank})), {step}).picks AS picks
  FROM (SELECT digest_date, count(*) AS n, list({{'id': id, 'score': base_score, 'us': us, 'company': company, 'topic': topic, 'source': source}}) AS items FROM ({scored}) AS d0 GROUP BY digest_date) AS d1) AS d2) AS d3"""


_SCORED = f"SELECT strftime(published_at, '%Y-%m-%d') AS digest_date, id, floor({_BASE} * 10000 + 0.500001) / 10000 AS base_score, CAST(epoch_us(published_at) AS DOUBLE) AS us, company, topic, source FROM ({_LABELS}) AS l WHERE published_at IS NOT NULL"


@query("rank_diversity", ["articles"], _diverse_sql(_SCORED, "n"))
def rank_diversity(v: View) -> DataFrame:
    return ranking.diverse(scored(v))


@query("rank_diversity_topn", ["articles"], _diverse_sql(_SCORED, "least(n, 10)"))
def rank_diversity_topn(v: View) -> DataFrame:
    return ranking.diverse_top(scored(v), 10)


@query("rank_domain_caps", ["hits"], "WITH r AS (SELECT url, min(domain) AS domain, max(published_at) AS published_at, sum(1.0 / (60 + rank)) AS s FROM (SELECT url, query, min(domain) AS domain, min(rank) AS rank, max(published_at) AS published_at FROM hits GROUP BY url, query) AS b GROUP BY url), c AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY s DESC, coalesce(epoch_us(published_at), 0) DESC, url) AS k FROM r) SELECT url, domain, row_number() OVER (ORDER BY s DESC, coalesce(epoch_us(published_at), 0) DESC, url) AS position FROM c WHERE k <= 2 ORDER BY position LIMIT 24")
def rank_domain_caps(v: View) -> DataFrame:
    return ranking.domain_caps(ranking.reciprocal_ranks(v("hits"))).select("url", "domain", "position")


@query("rank_positions", ["articles", "links"], "SELECT digest_date, news_id, position + 1 AS rank, position < 10 AS is_top_story FROM links")
def rank_positions(v: View) -> DataFrame:
    return v("links").select("digest_date", "news_id", (F.col("position") + 1).alias("rank"), (F.col("position") < 10).alias("is_top_story"))


@query("rank_query_position", ["hits"], "SELECT event_id, row_number() OVER (PARTITION BY query ORDER BY published_at NULLS LAST, event_id) AS place FROM hits")
def rank_query_position(v: View) -> DataFrame:
    return v("hits").select("event_id", F.row_number().over(Window.partitionBy("query").orderBy(F.col("published_at").asc_nulls_last(), "event_id")).alias("place"))


@query("win_neighbours", ["articles", "links"], "SELECT digest_date, lag(digest_date) OVER (ORDER BY digest_date) AS previous, lead(digest_date) OVER (ORDER BY digest_date) AS following FROM (SELECT DISTINCT digest_date FROM links) AS d")
def win_neighbours(v: View) -> DataFrame:
    order = Window.orderBy("digest_date")  # one row a day
    return v("links").select("digest_date").distinct().select("digest_date", F.lag("digest_date").over(order).alias("previous"), F.lead("digest_date").over(order).alias("following"))


@query("win_latest_run", ["run_log"], "SELECT source_id, max_by(run_id, (started_at, run_id)) AS run_id FROM run_log GROUP BY source_id")
def win_latest_run(v: View) -> DataFrame:
    return v("run_log").groupBy("source_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


@query("win_consecutive_failures", ["run_log"], "SELECT run_id, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM run_log")
def win_consecutive_failures(v: View) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    return v("run_log").select("run_id", F.sum(F.when(F.col("success"), 0).otherwise(1)).over(order).alias("failures"))


@query("sort_enriched", ["articles"], "SELECT id, importance_score, published_at FROM articles ORDER BY importance_score DESC NULLS LAST, published_at DESC NULLS LAST")
def sort_enriched(v: View) -> DataFrame:
    return v("articles").select("id", "importance_score", "published_at").orderBy(F.desc_nulls_last("importance_score"), F.desc_nulls_last("published_at"))


@query("topk_repos", ["repos"], "SELECT rank, repo FROM repos ORDER BY rank, repo LIMIT 10")
def topk_repos(v: View) -> DataFrame:
    return v("repos").select("rank", "repo").orderBy("rank", "repo").limit(10)


@query("page_limit_offset", ["articles"], "SELECT id, published_at, 50 AS page_limit, total FROM (SELECT id, published_at, count(*) OVER () AS total FROM articles) AS x ORDER BY published_at DESC NULLS LAST, id LIMIT 50 OFFSET 40")
def page_limit_offset(v: View) -> DataFrame:
    """A page of the archive: more rows are asked for than a page may hold, so it holds as many as it may; and how many rows there are."""
    rows, size = v("articles").select("id", "published_at"), search.page_size(500)
    page = rows.orderBy(F.desc_nulls_last("published_at"), "id").offset(40).limit(size)
    return page.withColumn("page_limit", F.lit(size)).withColumn("total", rows.agg(F.count("*")).scalar())


@query("list_recent_runs", ["run_log"], "SELECT run_id, started_at FROM run_log ORDER BY started_at DESC, run_id DESC LIMIT 20")
def list_recent_runs(v: View) -> DataFrame:
    return v("run_log").select("run_id", "started_at").orderBy(F.desc("started_at"), F.desc("run_id")).limit(20)


@query("set_digest_diff", ["articles", "links"], "SELECT 'removed' AS change, news_id FROM links WHERE digest_date = '2024-01-03' AND position >= 20 UNION ALL SELECT 'added', news_id FROM links WHERE digest_date = '2024-01-04'")
def set_digest_diff(v: View) -> DataFrame:
    links = v("links")
    before = links.where("digest_date = '2024-01-03'").select("news_id")
    after = links.where("digest_date = '2024-01-03' AND position < 20 OR digest_date = '2024-01-04'").select("news_id")
    removed = before.join(after, "news_id", "left_anti").select(F.lit("removed").alias("change"), "news_id")
    return removed.unionByName(after.join(before, "news_id", "left_anti").select(F.lit("added").alias("change"), "news_id"))


# Table maintenance


def ranged(rows: DataFrame, key: str) -> RangeTable:
    """rows stored by ranges of a key."""
    return RangeTable.created(rows, key, f"{tables.folder(rows.sparkSession)}/ranges-{tables.unique()}")


@query("sink_upsert_articles", ["articles"], "SELECT a.id, CASE WHEN doc_id % 3 = 0 THEN concat('new ', title_original) ELSE title_original END AS title_original, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'fresh' ELSE content_original END AS content_original FROM articles AS a")
def sink_upsert_articles(v: View) -> DataFrame:
    old = v("articles").select("id", "doc_id", "title_original", "content_original")
    new = old.where("doc_id % 3 = 0").select("id", F.concat(F.lit("new "), "title_original").alias("title_original"), F.when(F.col("doc_id") % 2 == 0, "fresh").otherwise("").alias("content_original"))
    return ranged(old.drop("doc_id"), "id").upserted(new, keep_if_empty=("content_original",), body="content_original").rows()


@query("sink_set_body", ["articles"], "SELECT id, CASE WHEN doc_id % 10 = 0 THEN 'patched' ELSE content_original END AS content_original FROM articles")
def sink_set_body(v: View) -> DataFrame:
    rows = v("articles")
    return ranged(rows.select("id", "content_original"), "id").patched(rows.where("doc_id % 10 = 0").select("id", F.lit("patched").alias("content_original"))).rows()


@query("sink_insert_ignore", ["articles"], "SELECT id, doc_id % 2 <> 0 AS created FROM articles WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def sink_insert_ignore(v: View) -> DataFrame:
    rows = v("articles")
    return tables.inserted(rows.where("doc_id % 2 = 0").select("id"), rows.where("doc_id % 3 = 0").select("id"), ["id"])


@query("sink_delete", ["articles"], "SELECT id FROM articles WHERE doc_id % 4 <> 0")
def sink_delete(v: View) -> DataFrame:
    rows = v("articles")
    return tables.deleted(rows.select("id"), rows.where("doc_id % 4 = 0").select("id"), ["id"])


@query("sink_digest_replace", ["articles", "links"], "SELECT digest_date, news_id, position FROM links WHERE digest_date <> '2024-01-03' UNION ALL SELECT digest_date, news_id, position FROM links WHERE digest_date = '2024-01-03' AND position < 10")
def sink_digest_replace(v: View) -> DataFrame:
    links = v("links")
    return ranged(links, "digest_date").replaced(links.where("digest_date = '2024-01-03' AND position < 10")).rows()


@query("maint_table_report", ["articles", "links", "repos", "run_log"], "SELECT 'articles' AS \"table\", (SELECT count(*) FROM articles) AS n UNION ALL SELECT 'links', (SELECT count(*) FROM links) UNION ALL SELECT 'repos', (SELECT count(*) FROM repos) UNION ALL SELECT 'run_log', (SELECT count(*) FROM run_log)")
def maint_table_report(v: View) -> DataFrame:
    return tables.report({t: v(t) for t in ("articles", "links", "repos", "run_log")})


@query("maint_fk_violations", ["articles", "links"], "SELECT news_id, digest_date, position FROM links WHERE news_id NOT IN (SELECT id FROM articles WHERE doc_id % 5 <> 0)")
def maint_fk_violations(v: View) -> DataFrame:
    return tables.orphans(v("links"), v("articles").where("doc_id % 5 <> 0"), "news_id", "id")


# Windows of digests


_UNLIKE = "SELECT strftime(published_at, '%Y-%m-%d') AS digest_date, max(published_at) AS e, min(published_at) + INTERVAL 90 MINUTE AS s FROM articles WHERE doc_id % 3 <> 1 AND published_at IS NOT NULL GROUP BY 1"


@query("inc_assign_window", ["articles"], f"SELECT id, digest_date AS digest_window FROM articles AS a LEFT JOIN ({_UNLIKE}) AS w ON a.published_at > w.s AND a.published_at <= w.e WHERE published_at IS NOT NULL")
def inc_assign_window(v: View) -> DataFrame:
    """Windows of unlike lengths with gaps between them: from an hour and a half past a day's first article to its last."""
    rows = v("articles").where("published_at IS NOT NULL")
    windows = rows.where("doc_id % 3 <> 1").groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("digest_date")).agg((F.min("published_at") + F.expr("INTERVAL 90 MINUTES")).alias("start"), F.max("published_at").alias("end"))
    return in_windows(rows.select("id", "published_at"), windows, "digest_date").select("id", F.col("digest_date").alias("digest_window"))


@query("inc_late_rows", ["articles"], "SELECT id, published_at IS NOT NULL AND published_at > TIMESTAMP '{FROM}' AND published_at <= TIMESTAMP '{TO}' AS linked FROM articles")
def inc_late_rows(v: View) -> DataFrame:
    return v("articles").select("id", times.in_window(F.col("published_at"), at(FROM), at(TO)).alias("linked"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the archive's first day."""
    return digest(views.view(spark, sf_dir, "articles"), views.view(spark, sf_dir, "sources"), at("2024-01-01 00:00:00"), at("2024-01-02 00:00:00"))
