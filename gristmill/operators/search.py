"""Full-text search by trigram postings, exact substring checks and BM25 over weighted columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.quality import bound
from gristmill.functions.text import chosen_snippet, query_tokens
from gristmill.operators.tables import stored

# Weight of each indexed column.
WEIGHTS = {"title_cn": 10.0, "title_original": 10.0, "summary": 5.0, "why_it_matters": 2.0, "content_original": 1.0, "source": 3.0, "company": 4.0, "topic": 4.0}
K1, B = 1.2, 0.75


def _low(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _grams(text: Column) -> Column:
    """Distinct trigrams, found in one pass; none for shorter text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def postings(items: DataFrame) -> DataFrame:
    """gram, id: the trigrams that any indexed column of an item holds."""
    return items.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(_low(c)) for c in WEIGHTS])))).alias("gram"))


def refreshed(index: DataFrame, changed: DataFrame) -> DataFrame:
    """index with the rows of changed items replaced."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").select("gram", "id").unionByName(postings(changed).select("gram", "id"))


def _terms(queries: DataFrame) -> DataFrame:
    """query_id, term (lower case) of queries (query_id, query)."""
    return queries.select("query_id", F.explode(query_tokens(F.lower("query"))).alias("term"))


def _whole() -> Column:
    """All indexed columns as one lower-case text; no term spans two, as terms hold no line end."""
    return F.concat_ws("\n", *[_low(c) for c in WEIGHTS])


def written(items: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """The index of items as a table at path, in files by bucket of the gram, so that a search opens those of its grams only. See opened()."""
    rows = postings(items).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return opened(items.sparkSession, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, id string, bucket int").parquet(path)


def near(queries: DataFrame, index: DataFrame, buckets: int = 64) -> DataFrame:
    """term, id: the items that have all trigrams of a term of three letters or more. A written index is read in the terms' buckets only."""
    terms = _terms(queries).where(F.length("term") >= 3).select("term").distinct()
    grams = terms.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    keys = ["gram"]
    if "bucket" in index.columns:
        grams, keys = grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")), ["gram", "bucket"]
    need = grams.groupBy("term").agg(F.count("*").alias("n"))
    return index.join(grams, keys).groupBy("term", "id").agg(F.count("*").alias("m")).join(need, "term").where("m = n").select("term", "id")


def held(items: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """term, id, tf, size, published_at: which items hold each term in some column, how often by the columns' weights (overlapping ones too), and the trigrams of the item.

    Texts are read once. Without an index each item is looked through for all terms of the batch, which stand in one row; with one (of postings() or written()) only the items near() a term of
    three letters or more, for the terms they are near to, so a batch may be large.
    """
    # only a term that ends as it begins can overlap itself
    overlaps = F.exists(F.sequence(F.lit(1), F.greatest(F.length("term") - 1, F.lit(1))), lambda i: (F.length("term") > 1) & (F.col("term").substr(F.lit(1), i) == F.col("term").substr(F.length("term") - i + 1, i)))
    terms = _terms(queries).select("term").distinct().withColumn("overlaps", overlaps)
    every = F.coalesce(F.collect_list(F.struct("term", "overlaps")), F.array())
    if index is None:
        rows = items.withColumn("asked", terms.agg(every.alias("asked")).scalar())
    else:
        asked = near(queries, index).join(terms, "term").groupBy("id").agg(F.collect_list(F.struct("term", "overlaps")).alias("asked"))
        short = terms.where(F.length("term") < 3).agg(every.alias("asked")).scalar()
        rows = items.join(asked, "id").withColumn("asked", F.concat("asked", short))

    def times(text: Column, t: Column) -> Column:
        plain = (F.length(text) - F.length(F.replace(text, t["term"], F.lit("")))) / F.length(t["term"])
        return F.when(t["overlaps"], F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), F.replace(t["term"], F.lit(r"\E"), F.lit("")), F.lit(r"\E)")))).otherwise(plain)

    def counted(columns: Column) -> Column:
        inside = F.filter(F.col("asked"), lambda t: F.exists(columns, lambda c: F.contains(c, t["term"])))
        weights = list(WEIGHTS.values())
        return F.transform(inside, lambda t: F.struct(t["term"].alias("term"), sum((w * times(F.get(columns, F.lit(i)), t) for i, w in enumerate(weights)), F.lit(0.0)).alias("tf")))

    found = bound(F.array(*[_low(c) for c in WEIGHTS]), counted)
    at = F.col("published_at") if "published_at" in items.columns else F.lit(None).cast("timestamp").alias("published_at")
    return rows.select("id", at, _size().alias("size"), F.explode(found).alias("found")).select("found.term", "id", "found.tf", "size", "published_at")


#: Terms of a batch up to which looking each text through for all of them costs less than finding its trigrams.
FEW_TERMS = 200


def held_once(items: DataFrame, queries: DataFrame, few: int = FEW_TERMS) -> DataFrame:
    """held() of a batch that is searched once: a written index pays for many searches only. Of many terms the postings go by, of which those of the batch's grams are kept."""
    many = _terms(queries).select("term").distinct().count() > few
    return held(items, queries, postings(items) if many else None)


def _size() -> Column:
    return sum((F.greatest(F.length(_low(c)) - 2, F.lit(0)) for c in WEIGHTS), F.lit(0))


def matches(items: DataFrame, queries: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """query_id, id of the items that hold every term of a query with a term of three letters or more. found: of held()."""
    found = held(items, queries) if found is None else found
    terms = _terms(queries).distinct()
    need = terms.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.length("term")).alias("longest")).where("longest >= 3")
    return found.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("m")).join(need, "query_id").where("m = n").select("query_id", "id")


def ranked(items: DataFrame, queries: DataFrame, most: int = 20, index: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, place, total: per query the best items by BM25, then newest, and how many match. All terms must occur, as substrings of some column; those of three letters or more count."""
    n, mean = items.agg(F.count("*"), F.avg(_size())).first()
    found = stored(held(items, queries, index), "held")
    long = found.where(F.length("term") >= 3)
    met = matches(items, queries, found)
    rows = met.join(_terms(queries).distinct(), "query_id").join(long, ["term", "id"]).join(long.groupBy("term").agg(F.count("*").alias("df")), "term")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / (mean or 1.0)))
    best = rows.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.max("published_at").alias("published_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc_nulls_last("published_at"), "id")
    first = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return first.join(met.groupBy("query_id").agg(F.count("*").alias("total")), "query_id").select("query_id", "id", "score", "place", "total")


#: Hits a page, unless asked otherwise, and at most.
PAGE, PAGE_MOST = 20, 50


def page_size(limit: int | None) -> int:
    return PAGE if limit is None or limit < 1 else min(limit, PAGE_MOST)


def hits(items: DataFrame, queries: DataFrame, limit: int | None = None, offset: int = 0, index: DataFrame | None = None) -> DataFrame:
    """One page of ranked() with the items' columns, and a snippet around the query's terms."""
    size, offset = page_size(limit), max(offset, 0)
    page = ranked(items, queries, offset + size, index).where(F.col("place") > offset)
    terms = _terms(queries).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    rows = page.join(terms, "query_id").join(items, "id")
    return rows.withColumn("snippet", chosen_snippet([F.col("summary"), F.col("content_original"), F.col("title_original")], F.col("terms"))).drop("terms")


def by_words(items: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id of the items that hold all terms of queries with an ASCII term: ASCII terms as a word of some column, others as a substring of one of the items that the words leave."""
    terms = _terms(queries).distinct().withColumn("word", F.col("term").rlike("^[\\x00-\\x7F]+$"))
    words = terms.where("word")
    text = _whole()
    held = items.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"))
    need = words.groupBy("query_id").agg(F.count("*").alias("n"))
    met = held.join(words, "term").groupBy("query_id", "id").agg(F.count("*").alias("m")).join(need, "query_id").where("m = n").select("query_id", "id")
    others = terms.where("NOT word").groupBy("query_id").agg(F.collect_list("term").alias("others"))
    left = met.join(others, "query_id", "left").join(items.select("id", text.alias("_text")), "id")
    return left.where("others IS NULL OR forall(others, t -> contains(_text, t))").select("query_id", "id")


def short_terms(items: DataFrame, words: list[str]) -> DataFrame:
    """Items of which each word is a substring of some column; those with a word in a title first, then newest. Words are text, never SQL."""
    rows, title = items, F.lit(False)
    for word in (F.lit(w.lower()) for w in words):
        rows = rows.where(reduce(Column.__or__, [F.contains(_low(c), word) for c in WEIGHTS if c in items.columns]))
        title = title | F.contains(_low("title_cn"), word) | F.contains(_low("title_original"), word)
    return rows.withColumn("title_hit", title).orderBy(F.desc("title_hit"), F.desc_nulls_last("published_at"), "id")
