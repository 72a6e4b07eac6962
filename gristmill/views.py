"""Article tables derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START = "TIMESTAMP '2024-01-01 00:00:00'"

VIEWS = {
    "sources": """
SELECT source AS source_id, concat('Source ', n) AS name, concat(source, '.example.com') AS domain, n,
  CASE WHEN n < 5 THEN 'official' WHEN n < 10 THEN 'research' ELSE 'media' END AS source_type,
  CASE WHEN n < 5 THEN 10 + n WHEN n < 10 THEN 60 + n ELSE 120 + n END AS priority,
  concat('org', n % 7) AS organization, CASE n % 3 WHEN 0 THEN 'blog' WHEN 1 THEN 'news' ELSE 'docs' END AS channel,
  n % 4 = 0 AS requires_ai_filter, n % 10 <> 9 AS enabled
FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS INT) AS n FROM documents) AS s""",
    "raw_articles": f"""
SELECT doc_id, source AS source_id, concat('Source ', substring(source, 4)) AS source,
  CASE WHEN CAST(substring(source, 4) AS INT) < 5 THEN 'official' WHEN CAST(substring(source, 4) AS INT) < 10 THEN 'research' ELSE 'media' END AS source_type,
  concat(CASE doc_id % 11 WHEN 0 THEN 'OpenAI launches GPT-6' WHEN 1 THEN 'New chip export ban' WHEN 2 THEN 'A robot and robotics review'
    WHEN 3 THEN 'Mistral raises 500m funding' WHEN 4 THEN '发布 混元3D 模型' WHEN 5 THEN 'Weekly gardening notes' WHEN 6 THEN 'Agents and inference at scale'
    WHEN 7 THEN 'AI policy: a study' WHEN 8 THEN 'Qwen 3.5 open weights' WHEN 9 THEN 'Cloud pricing drops' ELSE 'Claude 5 fails a safety benchmark' END,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat(' ', replace(substring(text, 1, 40), chr(10), ' ')) END) AS title,
  concat(CASE WHEN doc_id % 5 = 4 THEN 'HTTPS://' ELSE 'https://' END, CASE WHEN doc_id % 5 = 4 THEN upper(source) ELSE source END, '.example.com/a/', doc_id % 700,
    CASE doc_id % 5 WHEN 1 THEN '?utm_source=x&b=2' WHEN 2 THEN '/' WHEN 3 THEN '#top' ELSE '' END) AS url,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE {START} + INTERVAL '13' MINUTE * doc_id END AS published_at,
  substring(text, 1, 200) AS summary, text AS feed_body
FROM documents""",
    "articles": f"""
SELECT concat('a', lpad(CAST(r.doc_id AS STRING), 9, '0')) AS id, r.doc_id, r.source_id, r.source, r.source_type, r.title AS title_original,
  CASE WHEN r.doc_id % 3 = 0 THEN '' ELSE concat('标题 ', r.doc_id % 50) END AS title_cn, substring(r.feed_body, 1, 120) AS summary,
  CASE WHEN r.doc_id % 4 = 1 THEN '' ELSE concat('Matters for plan ', r.doc_id % 9) END AS why_it_matters, r.url, r.published_at,
  CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(l.quality * 50 + (r.doc_id * 37) % 50 AS INT) END AS importance_score,
  CASE r.doc_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'rss_full' WHEN 2 THEN 'rss_summary' ELSE '' END AS content_extraction_method,
  CASE WHEN r.doc_id % 7 = 0 THEN '' WHEN r.doc_id % 7 = 1 THEN NULL ELSE r.feed_body END AS content_original
FROM raw_articles AS r LEFT JOIN labels AS l ON r.doc_id = l.doc_id""",
    "links": """
SELECT date_format(published_at, '%Y-%m-%d') AS digest_date, id AS news_id,
  row_number() OVER (PARTITION BY date_format(published_at, '%Y-%m-%d') ORDER BY coalesce(importance_score, 35) DESC, id) - 1 AS position
FROM articles WHERE published_at IS NOT NULL AND doc_id % 3 <> 2""",
    "hits": """
SELECT event_type AS query, event_id, concat('https://s', user_id % 60, '.example.com/p/', user_id) AS url, concat('s', user_id % 60, '.example.com') AS domain,
  CASE event_id % 5 WHEN 0 THEN 'OpenAI launches GPT-6' WHEN 1 THEN 'Weekly gardening notes' WHEN 2 THEN 'Agents and inference at scale' WHEN 3 THEN 'Cloud pricing drops' ELSE 'A robot and robotics review' END AS title,
  CASE WHEN event_id % 7 = 0 THEN 'About machine learning' ELSE '' END AS summary,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS published_at, value AS provider_score, user_id, CAST(ts AS DATE) AS day,
  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rank
FROM events""",
    "run_log": """
SELECT event_id AS run_id, concat('src', user_id % 20) AS source_id, CAST(ts AS TIMESTAMP) AS started_at, event_type <> 'error' AS success, CAST(floor(value) AS INT) % 5 AS valid,
  CAST(floor(value) AS INT) % 5 + CAST(event_id % 3 AS INT) AS fetched,
  CASE WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'read timeout' WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'no links on the page' WHEN 4 THEN 'connection refused' ELSE ' odd   thing ' END END AS error
FROM events""",
    "repos": """
SELECT p_partkey AS rank, concat('o', p_size, '/', replace(p_name, ' ', '-')) AS repo, p_name AS name,
  concat(CASE p_partkey % 8 WHEN 0 THEN 'LLM inference server' WHEN 1 THEN 'A CSS library' WHEN 2 THEN 'AI agent framework' WHEN 3 THEN 'Dotfiles' WHEN 4 THEN 'RAG toolkit'
    WHEN 5 THEN 'Machine learning models' WHEN 6 THEN 'Awesome list' ELSE 'Prompt tools' END, ' ', p_brand) AS description, p_size AS stars, concat(p_partkey * 7 % 3000, ' stars today') AS stars_text
FROM part""",
    "project_links": """
SELECT concat('2024-01-', lpad(CAST(rank % 31 + 1 AS STRING), 2, '0')) AS digest_date, rank FROM repos WHERE rank % 3 <> 1""",
    "repo_metadata": """
SELECT rank AS part, repo, concat('About ', description) AS description, CASE WHEN rank % 2 = 0 THEN 'MIT' ELSE '' END AS license, CAST(rank % 900 AS INT) AS forks
FROM repos WHERE rank % 5 <> 0""",
}
#: Views that each view reads.
NEEDS = {"articles": ["raw_articles"], "links": ["raw_articles", "articles"], "repo_metadata": ["repos"], "project_links": ["repos"]}


def needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [v for v in [*NEEDS.get(name, []), name] if v not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "events", "part") if t in VIEWS[name] or any(t in VIEWS[v] for v in NEEDS.get(name, []))}
    for v in needed([name]):
        sql = VIEWS[v].replace("'%Y-%m-%d'", "'yyyy-MM-dd'")
        for t in sorted(tables, key=len, reverse=True):
            sql = _from(sql, t, "{" + t + "}")
        tables[v] = spark.sql(sql, **{t: d for t, d in tables.items() if "{" + t + "}" in sql})
    return tables[name]


def _from(sql: str, table: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {table} ", f"{word} {name} ").replace(f"{word} {table})", f"{word} {name})")
        if sql.endswith(f"{word} {table}"):
            sql = sql[: -len(table)] + name
    return sql


def duckdb(names: list[str], select: str) -> str:
    """select with the views it names in front."""
    parts = [f"{v} AS ({VIEWS[v].replace('date_format(', 'strftime(').replace('AS STRING', 'AS VARCHAR')})" for v in needed(names)]
    body = select.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
