"""Scores, caps and orders of a digest."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.tables import travels

travels(__name__)

MEDIA_FLOOR, MEDIA_TOTAL, MEDIA_EACH = 60, 5, 2
PENALTY_MOST = 8.0


def importance() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.coalesce(F.col("importance_score").cast("double"), F.lit(35.0)), F.lit(100.0))) / 100


def source_class() -> Column:
    kind = F.col("source_type")
    return F.when(kind == "official", 1.0).when(kind == "research", 0.55).when(kind == "media", 0.15).otherwise(0.10)


def recency(start: Column, end: Column) -> Column:
    """Place in the window, 0 to 1; 0 without time or window."""
    span = F.unix_micros(end) - F.unix_micros(start)
    at = (F.unix_micros("published_at") - F.unix_micros(start)) / F.when(span > 0, span)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(at, F.lit(1.0))), F.lit(0.0))


def content() -> Column:
    """How complete the body is: the method's weight, halved for an empty body."""
    how = F.col("content_extraction_method")
    weight = F.when(how == "web", 1.0).when(how == "rss_full", 0.9).when(how == "rss_summary", 0.3).otherwise(0.2)
    return weight * (1 + F.least(F.length(F.coalesce("content_original", F.lit(""))) / 4000.0, F.lit(1.0))) / 2


def cluster_bonus(size: Column) -> Column:
    return F.least(F.greatest(size - 1, F.lit(0)) * 0.5, F.lit(2.0))


def base_score(start: Column, end: Column, size: Column) -> Column:
    """0 to 100 before diversity, at full precision."""
    return 100 * (0.60 * importance() + 0.20 * source_class() + 0.08 * recency(start, end) + 0.05 * content() + 0.06 * cluster_bonus(size))


def rounded(score: Column) -> Column:
    """To four places; halves go up, also where they are short of one by the rounding of sums."""
    return F.floor(score * 10_000 + 0.500001) / 10_000


def media_decisions(items: DataFrame) -> DataFrame:
    """items with reason (null for classes that are exempt): floor, then two a source, then five in all; kept tells what stays."""
    media = F.col("source_type") == "media"
    order = [F.col("importance_score").desc(), F.col("published_at").desc_nulls_last(), F.col("id").asc()]
    able = items.where(media & (F.col("importance_score") >= MEDIA_FLOOR)).withColumn("_in_source", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
    # a row beyond its source's cap takes no place in the total; only as many as the total and one a source can matter, so the rest need no global order
    first = able.where(F.col("_in_source") <= MEDIA_EACH)
    best = first.orderBy(*order).limit(MEDIA_TOTAL).select("id", F.lit(True).alias("_best"))
    able = able.join(best, "id", "left").withColumn("_kept", F.count("_best").over(Window.partitionBy("source")))
    out = items.join(able.select("id", "_best", "_kept"), "id", "left")
    reason = (
        F.when(~media, F.lit(None))
        .when(F.col("importance_score").isNull(), "missing_importance")
        .when(F.col("importance_score") < MEDIA_FLOOR, "below_threshold")
        .when(F.col("_best"), "kept")
        .when(F.col("_kept") >= MEDIA_EACH, "per_source_cap")
        .otherwise("total_cap")
    )
    return out.withColumn("reason", reason).withColumn("kept", F.coalesce(F.col("reason") == "kept", F.lit(True))).drop("_best", "_kept")


def domain_caps(candidates: DataFrame, each: int = 2, most: int = 24) -> DataFrame:
    """The best candidates by score, newest, URL: two a domain, 24 in all; position counts from 1."""
    order = [F.col("rrf_score").desc(), F.coalesce(F.unix_micros("published_at"), F.lit(0)).desc(), F.col("url").asc()]
    rows = candidates.withColumn("_in_domain", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where(F.col("_in_domain") <= each).drop("_in_domain")
    # as few as the total, so numbering them in one task is bounded
    return rows.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def selection_counts(candidates: DataFrame, each: int = 2, most: int = 24) -> DataFrame:
    """selected, dropped_domain_cap, dropped_candidate_cap of candidates taken in the order of domain_caps: a domain's cap counts what was taken of it, not what it lost to the total."""
    taken = domain_caps(candidates, each, most).groupBy("domain").agg(F.count("*").alias("taken"))
    by_domain = candidates.groupBy("domain").agg(F.count("*").alias("n")).join(taken, "domain", "left")
    n, got = F.col("n"), F.coalesce("taken", F.lit(0))
    rest = n - got
    return by_domain.agg(F.coalesce(F.sum(got), F.lit(0)).alias("selected"), F.coalesce(F.sum(F.when(got >= each, rest).otherwise(0)), F.lit(0)).alias("dropped_domain_cap"), F.coalesce(F.sum(F.when(got < each, rest).otherwise(0)), F.lit(0)).alias("dropped_candidate_cap"))


class _Cells:
    """Rows of a digest that wait for a pick, by company, topic and source. All rows of a cell have one penalty, so only its first can be the next pick."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.waiting: list[deque] = []
        self.first = np.empty(0)
        self.of = np.empty((3, 0), np.int64)  # each cell's company, topic and source
        self.names: list[dict[str, int]] = [{}, {}, {}]
        self.seen = [np.zeros(0), np.zeros(0), np.zeros(0)]

    def put(self, row: tuple) -> bool:
        """row: score, us, id, company, topic, source; in the order of scores. Tells whether it is the first of its cell."""
        key = row[3:]
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.waiting)
            self.waiting.append(deque())
            places = []
            for kind, name in enumerate(key):
                places.append(self.names[kind].setdefault(name, len(self.names[kind])))
                if places[-1] == len(self.seen[kind]):
                    self.seen[kind] = np.append(self.seen[kind], 0.0)
            self.of = np.append(self.of, np.array(places)[:, None], axis=1)
            self.first = np.append(self.first, -np.inf)
        first = not self.waiting[number]
        if first:
            self.first[number] = row[0]
        self.waiting[number].append(row)
        return first

    def costs(self) -> np.ndarray:
        cost = np.zeros(len(self.waiting))
        for kind, (weight, free) in enumerate(((3.0, ""), (2.0, "other"), (1.0, ""))):
            counts = self.seen[kind] * weight
            if free in self.names[kind]:
                counts[self.names[kind][free]] = 0.0
            cost += counts[self.of[kind]]
        return np.minimum(cost, PENALTY_MOST)

    def best(self) -> tuple[float, int, float]:
        """The best final score, its cell and penalty; of equal ones the newest, then the smallest id."""
        if not self.waiting:
            return -np.inf, -1, 0.0
        cost = self.costs()
        final = self.first - cost
        most = final.max()
        if most == -np.inf:
            return most, -1, 0.0
        number = min(np.flatnonzero(final == most).tolist(), key=lambda n: (-self.waiting[n][0][1], self.waiting[n][0][2]))
        return most, number, cost[number]

    def take(self, number: int) -> tuple:
        row = self.waiting[number].popleft()
        self.first[number] = self.waiting[number][0][0] if self.waiting[number] else -np.inf
        for kind in range(3):
            self.seen[kind][self.of[kind, number]] += 1
        return row


#: Picks that a task sends together.
PICKS = 10_000


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest_date", "base_score", "us", "id", "company", "topic", "source"]
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    out = []

    def sent() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["digest_date", "id", "penalty", "final_score", "rank"])

    for day, of_day in groupby(rows, key=lambda r: r[0]):
        cells, rank = _Cells(), 0
        ahead, changed = next(of_day, None), True
        while True:
            if changed:
                most, number, cost = cells.best()
            # a row that is not read yet has no more than its base score
            if ahead is not None and ahead[1] >= most:
                changed = cells.put((ahead[1], -np.inf if ahead[2] is None else ahead[2], ahead[3], ahead[4] or "", ahead[5] or "", ahead[6] or ""))
                ahead = next(of_day, None)
            elif number < 0:
                break
            else:
                row = cells.take(number)
                rank, changed = rank + 1, True
                out.append((day, row[2], cost, most, rank))
                if len(out) == PICKS:
                    yield sent()
                    out.clear()
    if out:
        yield sent()


def diverse(items: DataFrame) -> DataFrame:
    """digest_date, id, penalty, final_score, rank: each pick is the best after a penalty for companies, topics and sources picked before.

    A digest is read in the order of its base scores; a task holds the rows that a penalty may still bring to the front, and compares one row for each company, topic and source that has any.
    """
    rows = items.select("digest_date", "id", F.col("base_score").cast("double").alias("base_score"), F.unix_micros("published_at").cast("double").alias("us"), "company", "topic", "source")
    # dealt by a hash: a deal by the day itself is left out where a join before it was by day, and that join's rows may then be read as its tasks wrote them, a day in several tasks
    ordered = rows.repartition(F.xxhash64("digest_date")).sortWithinPartitions("digest_date", F.desc("base_score"), F.desc_nulls_last("us"), "id")
    return ordered.mapInArrow(_picked, "digest_date string, id string, penalty double, final_score double, rank int")


def diverse_top(items: DataFrame, n: int) -> DataFrame:
    """The first n of diverse(): a penalty is at most 8, so rows more than 8 below the n-th base score cannot be among them."""
    order = Window.partitionBy("digest_date").orderBy(F.col("base_score").desc())
    nth = items.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= n).groupBy("digest_date").agg(F.min("base_score").alias("_least"), F.count("*").alias("_n"))
    near = items.join(nth, "digest_date").where(f"_n < {n} OR base_score >= _least - 8").drop("_least", "_n")
    return diverse(near).where(F.col("rank") <= n)


def reciprocal_ranks(hits: DataFrame, k: int = 60) -> DataFrame:
    """url, domain, published_at, rrf_score, n_queries: a URL counts once in a query, with its best rank."""
    best = hits.groupBy("url", "query").agg(F.min("rank").alias("rank"), F.max("published_at").alias("published_at"), F.min("domain").alias("domain"))
    return best.groupBy("url").agg(F.min("domain").alias("domain"), F.max("published_at").alias("published_at"), F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.count("*").alias("n_queries"))
