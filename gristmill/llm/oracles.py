"""DuckDB SQL for the operators that SQL can express, over whole tables."""

OP2 = r"""
WITH w AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS text,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT rn, unnest(range(len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT rn, i, array_to_string(ws[i + 1:i + 5], ' ') AS k FROM win),
hit AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT rn, count(DISTINCT i + j) AS n FROM hit, (VALUES (0), (1), (2), (3), (4)) AS s(j) GROUP BY rn),
ln AS (SELECT rn, count(*) - count(DISTINCT l) AS n FROM (SELECT rn, unnest(string_split(text, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rn),
base AS (SELECT w.rn, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN cov ON w.rn = cov.rn LEFT JOIN ln ON w.rn = ln.rn),
flagged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source AS host, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM flagged GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1e6) ELSE 1e6 END AS s FROM prior),
verdict AS (SELECT host, (f + m * s) / (n + s) > 0.5 AS host_rejected FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM flagged JOIN verdict ON source IS NOT DISTINCT FROM host
"""

OP3 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:12] AS BIGINT) AS place FROM documents),
srcs AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS k, (SELECT CAST(sum(source_size) AS BIGINT) FROM srcs) AS r, (SELECT CAST(sum(w) AS BIGINT) FROM srcs) AS ws
  UNION ALL
  SELECT k + 1,
    CAST((SELECT sum(source_size) FROM srcs) - (SELECT coalesce(sum(3 * source_size), 0) FROM srcs WHERE CAST(w AS DOUBLE) * CAST(r AS DOUBLE) / CAST(ws AS DOUBLE) > 3 * source_size) AS BIGINT),
    CAST((SELECT coalesce(sum(w), 0) FROM srcs WHERE NOT (CAST(w AS DOUBLE) * CAST(r AS DOUBLE) / CAST(ws AS DOUBLE) > 3 * source_size)) AS BIGINT)
  FROM rounds WHERE k < 30 AND ws > 0),
last AS (SELECT r, ws FROM rounds WHERE ws > 0 ORDER BY k DESC LIMIT 1),
goals AS (SELECT source, source_size,
                 CASE WHEN CAST(w AS DOUBLE) * CAST(r AS DOUBLE) / CAST(ws AS DOUBLE) > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
                      ELSE CAST(w AS DOUBLE) * CAST(r AS DOUBLE) / CAST(ws AS DOUBLE) END AS target FROM srcs, last),
ordered AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS passes,
                   sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up
            FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (SELECT *, passes + CASE WHEN up <= target - passes * source_size THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM copies
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id,
                  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item, size, array_to_string(ws[i + 1:i + size], ' ') AS k FROM (
         SELECT item, ws, least(10, len(ws)) AS size, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rn, size, i, array_to_string(ws[i + 1:i + size], ' ') AS k FROM (
         SELECT rn, ws, size, unnest(range(len(ws) - size + 1)) AS i FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT DISTINCT rn, dw.size, i, item FROM dw JOIN bw ON dw.size = bw.size AND dw.k = bw.k),
words AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rn, item FROM hit) GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.rn = words.rn LEFT JOIN items ON d.rn = items.rn
"""

OP10 = r"""
WITH cap AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * ((page_id * 37) % 527040) AS fetched_at,
    nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') AS host FROM pages),
caps AS (SELECT row_number() OVER () AS rn, * FROM cap),
hosts AS (SELECT host, CAST('0x' || md5(host)[1:8] AS BIGINT) AS h FROM (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL)),
pat AS (SELECT CASE h % 3 WHEN 0 THEN 'malware' WHEN 1 THEN 'adult' ELSE 'piracy' END AS lst,
               CASE WHEN h % 5 = 0 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS pattern, h,
               TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (h % 250) AS start FROM hosts),
ev AS (SELECT lst, pattern, true AS added, start AS moment FROM pat
       UNION ALL SELECT lst, pattern, false, start + INTERVAL 1 DAY * (h % 45 + 1) FROM pat
       UNION ALL SELECT lst, pattern, true, start + INTERVAL 1 DAY * (h % 45 + 31) FROM pat WHERE h % 2 = 0),
one AS (SELECT lst, pattern, moment, bool_and(added) AS added FROM ev GROUP BY lst, pattern, moment),
iv AS (SELECT *, lead(moment) OVER (PARTITION BY lst, pattern ORDER BY moment) AS until FROM one),
met AS (SELECT rn, lst, pattern FROM caps c JOIN iv ON (host = pattern OR ends_with(host, '.' || pattern))
        AND added AND fetched_at >= moment AND (until IS NULL OR fetched_at < until)),
agg AS (SELECT rn, string_agg(DISTINCT lst, ',' ORDER BY lst) AS lists, count(DISTINCT lst) AS n_lists,
               arg_min(pattern, (-length(pattern), pattern)) AS pattern FROM met GROUP BY rn)
SELECT c.page_id, fetched_at, host, coalesce(n_lists, 0) > 0 AS blocked, coalesce(lists, '') AS lists, pattern, CAST(coalesce(n_lists, 0) AS BIGINT) AS n_lists
FROM caps c LEFT JOIN agg ON c.rn = agg.rn
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM placed, range(1, 5) AS sizes(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2 AND f >= 30),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i:i + k - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, unnest(range(1, len(g) + 1)) AS i FROM candidates), range(2, 4) AS sizes(k)
  WHERE i + k - 1 <= len(g) AND k < len(g) GROUP BY ALL
), held AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * b.a::HUGEINT),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, score FROM held)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SQL = {
    "op2_host_quality_rules": OP2,
    "op3_hash_threshold_mix": OP3,
    "op5_benchmark_decontamination": OP5,
    "op10_temporal_url_filter": OP10,
    "op11_phrase_collocations": OP11,
}
