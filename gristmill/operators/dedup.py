"""Duplicates by URL, by title within a horizon, and by event."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.urls import canonical_url
from gristmill.operators.graph import least_below
from gristmill.operators.tables import stored, travels

travels(__name__)

HORIZON = 48 * 3_600_000_000


def first_by_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def with_priority(articles: DataFrame, sources: DataFrame, by: str = "source_id", missing: int = 1000) -> DataFrame:
    """articles with priority of their source; `missing` where the source is unknown."""
    known = sources.select(F.col(by if by == "source_id" else "name").alias(by), "priority")
    return articles.join(known, by, "left").withColumn("priority", F.coalesce("priority", F.lit(missing)))


def winner_order() -> list[Column]:
    """Official first, then priority, earliest (null last), canonical URL, URL."""
    return [(F.col("source_type") != "official").asc(), F.col("priority").asc(), F.col("published_at").asc_nulls_last(), F.col("canonical_url").asc(), F.col("url").asc()]


def by_url(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """One winner for each canonical URL (the URL itself where that is empty)."""
    rows = with_priority(articles, sources).withColumn("canonical_url", canonical_url(F.col("url")))
    rows = rows.withColumn("_key", F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("url")))
    return first_by_key(rows, ["_key"], *winner_order()).drop("_key")


class Spans:
    """Times covered by numbered clusters, from the first member's less the horizon to the last one's plus the horizon. Which cluster is the first to cover a time is looked up in the time's own stretch."""

    def __init__(self, horizon: int):
        self.horizon = horizon
        self.ends: dict[int, tuple[int, int]] = {}
        self.at: dict[int, list[int]] = {}  # numbers by stretch of one horizon, none behind one that covers all of it

    def _covers(self, number: int, first: int, last: int) -> bool:
        low, high = self.ends[number]
        return low - self.horizon <= first and last <= high + self.horizon

    def find(self, us: int) -> int | None:
        return next((n for n in self.at.get(us // self.horizon, ()) if self._covers(n, us, us)), None)

    def put(self, number: int, us: int) -> None:
        old, h = self.ends.get(number), self.horizon
        now = (us, us) if old is None else (min(old[0], us), max(old[1], us))
        if now == old:
            return
        self.ends[number] = now
        first, last = now[0] // h - 1, now[1] // h + 1
        if old is None:
            changed = range(first, last + 1)
        else:
            changed = [*range(first, old[0] // h), *range(old[1] // h + 1, last + 1)]
        for s in changed:
            numbers, ends = self.at.setdefault(s, []), (s * h, (s + 1) * h - 1)
            if number not in numbers and not (numbers and numbers[-1] < number and self._covers(numbers[-1], *ends)):
                insort(numbers, number)
            if self._covers(number, *ends):
                del numbers[bisect_right(numbers, number) :]


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and cluster of rows that come chain by chain, in scan order: a row joins the first cluster with a member within the horizon.

    A member came within the horizon of another, so two times tell what a cluster covers; and founders lie further apart than the horizon. So what is carried from row to row, and from batch to batch, grows
    with the time that a chain spans, not with its rows.
    """
    chain, spans, founders = None, Spans(HORIZON), []
    for batch in batches:
        keys, names = batch.column("key").to_pylist(), []
        for title, number, us, key in zip(*(batch.column(c).to_pylist() for c in ("title_key", "_chain", "us")), keys, strict=True):
            if (title, number) != chain:
                chain, spans, founders = (title, number), Spans(HORIZON), []
            found = spans.find(us)
            if found is None:
                found = len(founders)
                founders.append(key)
            spans.put(found, us)
            names.append(founders[found])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string())], ["key", "cluster"])


def by_title(articles: DataFrame) -> DataFrame:
    """articles (as by_url leaves them) with cluster: rows of one title, each within 48 hours of an earlier member.

    Rows of a title whose gaps are within the horizon are a chain; a chain that spans no more than the horizon is one cluster, whatever the
    scan order, and only longer chains are read row by row, as a stream of which no task holds more than the clusters. Rows without title or time stand alone.
    """
    rows = articles.withColumn("title_key", T.normal_title(F.col("title"))).withColumn("key", F.concat_ws("\n", "canonical_url", "url")).withColumn("us", F.unix_micros("published_at"))
    alone = (F.col("title_key") == "") | F.col("us").isNull()
    order = Window.partitionBy("title_key").orderBy("us", "key")
    gap = F.col("us") - F.lag("us").over(order)
    chained = rows.where(~alone).withColumn("_chain", F.sum(F.when(gap <= HORIZON, 0).otherwise(1)).over(order))
    chain = Window.partitionBy("title_key", "_chain")
    chained = chained.withColumn("_long", F.max("us").over(chain) - F.min("us").over(chain) > HORIZON).withColumn("_first", F.min(F.struct("canonical_url", "url")).over(chain))
    short = chained.where("NOT _long").withColumn("cluster", F.concat_ws("\n", "_first.canonical_url", "_first.url"))
    long = chained.where("_long")
    scanned = long.select("title_key", "_chain", "key", "us", "canonical_url", "url").repartition("title_key", "_chain").sortWithinPartitions("title_key", "_chain", "canonical_url", "url")
    named = scanned.mapInArrow(_clustered, "key string, cluster string")
    columns = [*rows.columns, "cluster"]
    return (
        short.select(columns)
        .unionByName(long.join(named, "key").select(columns))
        .unionByName(rows.where(F.coalesce(alone, F.lit(True))).withColumn("cluster", F.col("key")).select(columns))
        .drop("key", "us")
    )


def title_winners(clustered: DataFrame) -> DataFrame:
    return first_by_key(clustered, ["cluster"], *winner_order())


def title_links(articles: DataFrame) -> DataFrame:
    """a, b: each row and the one before it in time with the same normalised title, where that is within 48 hours. Chains of links hold all pairs within the horizon.

    Rows are put in order inside stretches of 48 hours; the first of a stretch meets the last of the one before by a join of one row a stretch.
    """
    rows = articles.where("published_at IS NOT NULL").select("doc_id", F.unix_micros("published_at").alias("us"), T.normal_title(F.col("title")).alias("k")).where("k <> ''")
    rows = rows.withColumn("slot", F.floor(F.col("us") / HORIZON))
    order = Window.partitionBy("k", "slot").orderBy("us", "doc_id")
    inside = rows.select(F.lag("doc_id").over(order).alias("a"), F.col("doc_id").alias("b")).where("a IS NOT NULL")
    ends = rows.groupBy("k", "slot").agg(F.min(F.struct("us", "doc_id")).alias("first"), F.max(F.struct("us", "doc_id")).alias("last"))
    before = ends.select("k", (F.col("slot") + 1).alias("slot"), "last")
    across = ends.select("k", "slot", "first").join(before, ["k", "slot"]).where(F.col("first.us") - F.col("last.us") <= HORIZON)
    return inside.unionByName(across.select(F.col("last.doc_id").alias("a"), F.col("first.doc_id").alias("b")))


@dataclass(frozen=True)
class Events:
    """Items as classes of equal features. members: id, us, class; features: one row for each class, with how many members it has; pairs: a, b, reason, score, title_similarity of
    classes whose members match wherever they lie within the horizon, a <= b, the class with itself among them."""

    members: DataFrame
    features: DataFrame
    pairs: DataFrame


def event_features(items: DataFrame) -> DataFrame:
    """What decides whether two items match: token sets, versions, figures, identifiers and stances of headline and body; items that agree in all are of one class. A class is named by 16 bytes of SHA-256, as its name travels with each of its rare tokens and pairs."""
    title = F.concat_ws(" ", F.coalesce("title_original", F.lit("")), F.coalesce("title_cn", F.lit("")))
    body = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("why_it_matters", F.lit("")))
    both = F.array_distinct(F.concat(F.col("title_tokens"), F.col("body_tokens")))
    sets = items.select("id", F.unix_micros("published_at").alias("us"), F.array_sort(T.tokens(title)).alias("title_tokens"), F.array_sort(T.tokens(body)).alias("body_tokens"), (F.trim(body) == "").alias("bare"), F.array_sort(T.distinctive(title)).alias("terms")).where("us IS NOT NULL")
    more = {"versions": T.versions(both), "figures": T.substantive(T.figures(both)), "stances": T.stances(both), "class": F.unhex(F.substring(F.sha2(F.to_json(F.struct("title_tokens", "body_tokens", "bare", "terms")), 256), 1, 32))}
    return sets.withColumns(more)


def _prefixes(features: DataFrame, spans: DataFrame, column: str, least: float) -> DataFrame:
    """class, slot, token, size and turn: each set's rarest tokens, enough that two sets with Dice of `least` or more share one, in each stretch of time in which the class has members."""
    each = features.select("class", F.size(column).alias("size"), F.explode(column).alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df"))
    turn = F.row_number().over(Window.partitionBy("class").orderBy("df", "token"))
    keep = F.col("size") - F.ceil(least * F.col("size") / (2 - least)) + 1
    return each.join(common, "token").withColumn("turn", turn).where(F.col("turn") <= keep).drop("df").join(spans, "class")


def _candidates(features: DataFrame, spans: DataFrame, column: str, least: float) -> DataFrame:
    """Pairs of classes with members in the same or neighbouring 48 hours that share a rare token; by its place in both orders and their lengths they may have Dice of `least`."""
    rows = _prefixes(features, spans, column, least)
    left = rows.select(F.col("class").alias("a"), "token", F.col("size").alias("a_size"), F.col("turn").alias("a_turn"), F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    right = rows.select(F.col("class").alias("b"), "token", F.col("size").alias("b_size"), F.col("turn").alias("b_turn"), "slot")
    needed = F.ceil(F.lit(least) * (F.col("a_size") + F.col("b_size")) / 2)
    # where the token is the first that both have, no more can follow it in both than follow it in either
    possible = F.least(F.col("a_size") - F.col("a_turn"), F.col("b_size") - F.col("b_turn")) + 1
    pairs = left.join(right, ["token", "slot"]).where("a <> b").where((possible >= needed) & (F.least("a_size", "b_size") >= needed))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def event_classes(items: DataFrame) -> Events:
    """Classes of the items, and which of them match. Gates in order: versions, stance, body, title. Pairs grow with the classes, not with their members."""
    f = stored(event_features(items), "features")
    members = f.select("id", "us", "class")
    columns = [c for c in f.columns if c not in ("id", "us", "class")]
    features = stored(f.groupBy("class").agg(F.count("*").alias("members"), *[F.first(c).alias(c) for c in columns]), "classes")
    spans = members.select("class", F.floor(F.col("us") / HORIZON).alias("slot")).distinct()
    own = features.where("members > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    pairs = _candidates(features.where("NOT bare"), spans, "body_tokens", 0.45).union(_candidates(features, spans, "title_tokens", 0.90)).distinct().union(own)
    a, b = (features.select([F.col(c).alias(x if c == "class" else f"{x}_{c}") for c in features.columns]) for x in "ab")
    p = pairs.join(a, "a").join(b, "b")
    p = p.where("size(a_versions) = 0 OR size(b_versions) = 0 OR arrays_overlap(a_versions, b_versions)").where(~T.opposed(F.col("a_stances"), F.col("b_stances")))
    p = p.withColumn("title_similarity", T.dice(F.col("a_title_tokens"), F.col("b_title_tokens"))).withColumn("body", T.dice(F.col("a_body_tokens"), F.col("b_body_tokens")))
    shared = F.arrays_overlap("a_terms", "b_terms")
    reason = (
        F.when(F.col("a_bare") | F.col("b_bare"), F.when((F.col("title_similarity") >= 0.90) & shared, "title_similarity"))
        .when(F.col("body") < 0.62, F.when((F.col("body") >= 0.45) & (F.col("title_similarity") >= 0.70) & F.arrays_overlap("a_figures", "b_figures"), "same_headline_and_figure"))
        .when(F.col("title_similarity") >= F.when(shared, 0.30).otherwise(0.45), F.when(shared, "shared_term_text_similarity").otherwise("text_similarity"))
    )
    score = F.when(F.col("a_bare") | F.col("b_bare"), F.col("title_similarity")).otherwise((F.col("title_similarity") + F.col("body")) / 2)
    found = p.select("a", "b", reason.alias("reason"), score.alias("score"), "title_similarity").where("reason IS NOT NULL")
    return Events(members, features, stored(found, "pairs"))


def _met(events: Events, apart: Column) -> DataFrame:
    """Members of matching classes within the horizon: x and y, not the same, with the pair's columns; apart: which stretches of time of x (slot) and y (other) are looked at."""
    slot = F.floor(F.col("us") / HORIZON)
    x = events.members.select(F.col("id").alias("x"), F.col("us").alias("x_us"), F.col("class").alias("a"), slot.alias("slot"))
    y = events.members.select(F.col("id").alias("y"), F.col("us").alias("y_us"), F.col("class").alias("b"), slot.alias("other"))
    near = x.join(events.pairs, "a").withColumn("other", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))).where(apart)
    return near.join(y, ["b", "other"]).where(F.abs(F.col("x_us") - F.col("y_us")) <= HORIZON).where("x <> y AND (a <> b OR x < y)")


def matches_of(events: Events) -> DataFrame:
    """a, b, reason, score, title_similarity, hours_apart of every two items that tell one event, a < b."""
    hours = F.abs(F.col("x_us") - F.col("y_us")) / 3_600_000_000
    return _met(events, F.lit(True)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "reason", "score", "title_similarity", hours.alias("hours_apart"))


def match_events(items: DataFrame) -> DataFrame:
    """a, b, reason, score, title_similarity, hours_apart of every two items that tell one event, a < b. As many rows as there are such pairs; event_classes tells the same in fewer."""
    return matches_of(event_classes(items))


def previous(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with before: the last value that is not null of the rows before in the order of a key. Ranges of the order are looked at by themselves, then their ends, so a hot key splits."""
    parts = stored(rows.repartitionByRange(*keys, order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.last(value, True).over(Window.partitionBy("part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = parts.groupBy("part", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("end"))
    ended = F.last("end", True).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range of the key
    ends = ends.withColumn("ended", ended).drop("end")
    return parts.withColumn("inside", inside).join(ends, ["part", *keys], "left").withColumn("before", F.coalesce("inside", "ended")).drop("part", "inside", "ended")


def event_links(events: Events) -> DataFrame:
    """u, v: matches (v < u) enough that whatever can be reached by going down over matches can be reached by going down over these.

    Where a class matches itself, its members of one stretch of 48 hours all match: each is tied to the one before it. An item that matches such a class is tied to the class's
    last item before it in the stretch, from which all before can be reached. Members in neighbouring stretches, and of classes that do not match themselves, are tied one by one.
    """
    slotted = events.members.withColumn("slot", F.floor(F.col("us") / HORIZON))
    alike = events.pairs.where("a = b").select(F.col("a").alias("of"))
    both = events.pairs.select("a", "b").union(events.pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    chained = both.join(alike.withColumnRenamed("of", "b"), "b", "left_semi")
    asks = slotted.join(chained.withColumnRenamed("a", "class"), "class").select(F.col("b").alias("to"), F.when(F.col("class") != F.col("b"), F.col("class")).alias("of"), "slot", "id")
    # one order for each two classes, in which the second's members are looked for
    asked = asks.where("of IS NOT NULL").withColumn("member", F.lit(None).cast("string"))
    held = slotted.join(chained.where("a <> b").withColumnRenamed("b", "class"), "class").select(F.col("class").alias("to"), F.col("a").alias("of"), "slot", "id", F.col("id").alias("member"))
    own = slotted.join(alike.withColumnRenamed("of", "class"), "class").select(F.col("class").alias("to"), F.col("class").alias("of"), "slot", "id", F.col("id").alias("member"))
    tied = previous(asked.unionByName(held).unionByName(own), ["to", "of", "slot"], "id", "member")
    tied = tied.where("before IS NOT NULL AND (member IS NULL OR to = of)").select(F.col("id").alias("u"), F.col("before").alias("v"))
    single = _met(events, F.col("slot") != F.col("other")).select("x", "y")
    alone = events.pairs.join(alike.withColumnRenamed("of", "a"), "a", "left_anti").unionByName(events.pairs.join(alike.withColumnRenamed("of", "b"), "b", "left_anti")).distinct()
    single = single.union(_met(Events(events.members, events.features, alone), F.col("slot") == F.col("other")).select("x", "y"))
    return tied.union(single.select(F.greatest("x", "y"), F.least("x", "y"))).distinct()


def event_clusters(items: DataFrame, links: DataFrame) -> DataFrame:
    """id and cluster (its first member's id) of every item. links: u, v or matches a, b.

    In id order, each item joins the first cluster that holds one of its matches before it; clusters never merge. That cluster's first member is the smallest item that can be reached by going down
    over matches: it begins with an item that has none before it, and a step down never leads to a cluster begun before the first.
    """
    edges = links.select(F.col("b").alias("u"), F.col("a").alias("v")) if "a" in links.columns else links
    below = least_below(edges)
    return items.select("id").join(below.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("least", "id").alias("cluster"))


def merge_evidence(matches: DataFrame, clusters: DataFrame, winners: DataFrame) -> DataFrame:
    """id, winner, reason, score of each folded item: the match that admitted it (with the first member before it), else its match with the winner, else that it came through others."""
    a, b = (clusters.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}")) for x in "ab")
    inside = matches.join(a, "a").join(b, "b").where("ca = cb")
    admitted = inside.groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct("reason", "score"), "a").alias("admitted"))
    folded = clusters.join(winners.select("cluster", F.col("id").alias("winner")), "cluster").where("id <> winner")
    both = [inside.select(F.col(x).alias("id"), F.col(y).alias("winner"), F.struct("reason", "score").alias("direct")) for x, y in ("ab", "ba")]
    out = folded.join(admitted, "id", "left").join(both[0].unionByName(both[1]), ["id", "winner"], "left")
    why = F.coalesce("admitted", "direct", F.struct(F.lit("transitive_cluster").alias("reason"), F.lit(0.0).alias("score")))
    return out.select("id", "winner", why.alias("why")).select("id", "winner", "why.reason", "why.score")


def event_winners(items: DataFrame, clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """The winner of each cluster and cluster_size: class, priority, importance, completeness, earliest, id."""
    rank = F.when(F.col("source_type") == "official", 0).when(F.col("source_type") == "research", 1).when(F.col("source_type") == "media", 2).otherwise(3)
    rows = with_priority(items.join(clusters, "id"), sources, "source")
    complete = F.length(F.coalesce("summary", F.lit(""))) + F.length(F.coalesce("why_it_matters", F.lit("")))
    order = [rank.asc(), F.col("priority").asc(), F.coalesce("importance_score", F.lit(-1)).desc(), complete.desc(), F.col("published_at").asc_nulls_last(), F.col("id").asc()]
    rows = rows.withColumn("cluster_size", F.count("*").over(Window.partitionBy("cluster")))
    return first_by_key(rows, ["cluster"], *order)
