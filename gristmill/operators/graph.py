"""Connected components of an edge table by large-star and small-star passes, and least nodes below. Nothing but two sums a pass reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.tables import Scratch, stored, travels

travels(__name__)


def _passed(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over rows (u, v) with u > v.

    Large: each node's larger neighbours are tied to its smallest. Small: each node's smaller neighbours and itself are tied to the smallest.
    Minima are pre-aggregated in the map tasks; the joins back have one row for each node on one side, so a hot node splits.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    small = small.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60, within: str | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (u, v); null or equal ends are left out. within: the folder of the result."""
    with Scratch(edges.sparkSession) as scratch:
        return stored(_components(edges, most, scratch), "components", within)


def _components(edges: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    now = scratch.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    state = None
    for _ in range(most):
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        now = scratch.stored(_passed(now), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most} passes")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _fewer(down: DataFrame) -> DataFrame:
    """Edges enough that every node reaches the same least one: of a node's edges to nodes with none the smallest, and not one to a node that its largest lower neighbour leads to as well."""
    rows = down.join(down.select(F.col("u").alias("v"), F.lit(True).alias("on")).distinct(), "v", "left")
    ends = rows.groupBy("u").agg(F.min(F.when(F.col("on").isNull(), F.col("v"))).alias("end"), F.max("v").alias("top"))
    rows = rows.join(ends, "u").where("on OR v = end OR v = top")
    through = down.select(F.col("u").alias("top"), "v", F.lit(True).alias("through"))
    return rows.join(through, ["top", "v"], "left").where("through IS NULL").select("u", "v")


def _followed(steps: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """node, at: where each node ends that has one step down (u, v). The way is doubled each round."""
    now = scratch.stored(steps.select(F.col("u").alias("node"), F.col("v").alias("at")), "steps")
    for _ in range(most):
        further = now.select(F.col("node").alias("at"), F.col("at").alias("next"))
        now = scratch.stored(now.select("node", "at").join(further, "at", "left").select("node", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "steps")
        if not now.agg(F.count_if("moved")).first()[0]:
            return now.drop("moved")
    raise RuntimeError(f"steps did not end in {most} rounds")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and least of edges that come component by component in the order of u, so what is below u is told before it. A node is kept until the last edge that leads to it."""
    known: dict = {}
    now = least = kind = None

    def sent(nodes: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(found, kind)], ["node", "least"])

    for batch in batches:
        kind, nodes, found = batch.column("u").type, [], []
        for u, v, last, asked in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "last", "asked")), strict=True):
            below = known.pop(v, v) if last else known.get(v, v)
            if u != now:
                if now is not None:
                    nodes.append(now)
                    found.append(least)
                now, least = u, below
            least = min(least, below)
            if asked:
                known[u] = least
        yield sent(nodes, found)
    if now is not None:
        yield sent([now], [least])


def _scanned(down: DataFrame, scratch: Scratch) -> DataFrame:
    """node, least of every u: each component of the edges is read as a stream in the order of u."""
    parts = components(down, within=scratch.path).select(F.col("node").alias("u"), "component")
    last = down.groupBy("v").agg(F.max("u").alias("last"))
    asked = last.select(F.col("v").alias("u"), F.lit(True).alias("asked"))
    rows = down.join(parts, "u").join(last, "v").join(asked, "u", "left")
    rows = rows.select("component", "u", "v", (F.col("last") == F.col("u")).alias("last"), F.col("asked").isNotNull().alias("asked"))
    # by a hash, which no join before it is dealt by: Spark leaves out a deal that a join made already, and may then read that one's rows as they were written
    ordered = rows.repartition(F.xxhash64("component")).sortWithinPartitions("component", "u", "v")
    kind = down.schema["u"].dataType.simpleString()
    return ordered.mapInArrow(_told, f"node {kind}, least {kind}")


def least_below(edges: DataFrame, most: int = 200, within: str | None = None) -> DataFrame:
    """node, least for every node of edges (u, v) with u > v: the smallest node that can be reached from it by going down.

    Edges that others make needless are left out; a node with one edge left is where that leads, so chains of those are followed, in as many rounds as the longest has binary digits. Nodes with several
    ways down go by an order that no rounds shorten: what is left of each component is read as a stream, of which a task holds the nodes that later edges lead to.
    Each join has one row for a node on one side, so a hot node splits.
    """
    with Scratch(edges.sparkSession) as scratch:
        down = scratch.stored(edges.select("u", "v").where("u > v").distinct(), "down")
        fewer = scratch.stored(_fewer(down), "fewer")
        ways = scratch.stored(fewer.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")), "ways")
        single = _followed(ways.where("n = 1").select("u", "v"), most, scratch)
        several = fewer.join(ways.where("n > 1").select("u"), "u", "left_semi")
        moved = several.join(single.select(F.col("node").alias("v"), "at"), "v", "left").select("u", F.coalesce("at", "v").alias("v")).distinct()
        split = scratch.stored(_scanned(scratch.stored(moved, "several"), scratch), "split")
        through = single.join(split.select(F.col("node").alias("at"), "least"), "at", "left").select("node", F.coalesce("least", "at").alias("least"))
        ends = down.select(F.col("v").alias("node")).distinct().join(ways.select(F.col("u").alias("node")), "node", "left_anti")
        return stored(split.unionByName(through).unionByName(ends.withColumn("least", F.col("node"))), "least", within)
