"""Mix sources to target weights with hash-threshold histograms.

A document's place in its source is a hash of its id. For each source the words to take are a whole number of passes over the source
plus a remainder; the remainder is every document whose hash lies below a threshold. The threshold is found digit by digit:
sum words by source and hash digit, keep the digits that fit whole, and look again at the one boundary digit only. Nothing is sorted.

DataFrame functions only. Defined cases: a null text has no words; a null source is a source, last in order; repeated rows share a hash
and so are taken or left together; a row without id has the hash of its text, so that such rows are spread over their source like any others (those
of one text are taken or left together); a source without words has target 0; an empty table gives an empty result. Texts of any length are only counted;
other columns pass through, but a column mix_copies of the input gives way to the mix's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import apart, stored, word_count

#: Digits of the hash: six of eight bits.
DIGITS, BITS = 6, 8
WEIGHTS = (1, 2, 3)
MOST = 3


def place(key: Column, text: Column) -> Column:
    """48 bits of a hash of the id, or of the text where there is none."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit(""))), 1, DIGITS * BITS // 4), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with n, their rank by code point with null last: ranks inside range partitions plus the sizes of those before, so no task sees all."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    up_to = F.sum("_size").over(Window.orderBy("_part"))  # one row for each range partition
    before = sizes.select(F.col("_part").alias("_p"), (up_to - F.col("_size")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(before, parts["_part"] == before["_p"]).withColumn("n", rank + F.col("_before")).drop("_part", "_p", "_before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target for a table of source and source_size.

    Weights repeat over the sources in code point order. A target stops at most times its source; what is over is shared again by weight
    among the others, round by round, until none is above. The driver holds two sums a round.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    table = stored(_numbered(sizes).withColumn("_w", weight.cast("long")).drop("n"), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = most * F.col("source_size")
    full, left, share = F.lit(False), total, table.agg(F.sum("_w")).first()[0] or 1
    while True:
        over = full | (F.col("_w").cast("double") * left / share > cap)
        held, free = table.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("_w")))).first()
        now, full = (total - (held or 0), free or 0), over
        if now[1] == 0 or now == (left, share):
            break
        left, share = now
    # The last round's test holds for every source, so it also tells the capped from the others.
    by_weight = F.col("_w").cast("double") * F.lit(float(left)) / F.lit(float(share))
    return table.select("source", "source_size", F.when(by_weight > cap, cap.cast("double")).otherwise(by_weight).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with passes and threshold: rows whose place is below the threshold are taken once more.

    sized has source, size and place. One round per digit: a source's histogram has 256 rows; those under the budget are added up, the next is opened.
    """
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = goals.withColumn("_left", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long"))
    for level in range(DIGITS):
        low = BITS * (DIGITS - 1 - level)
        digit = F.pmod(F.shiftright(F.col("place"), low), F.lit(1 << BITS)).cast("int")
        keys = state.select(F.col("source").alias("_s"), F.col("threshold").alias("_t"))
        inside = sized.join(keys, sized["source"].eqNullSafe(keys["_s"])).where(F.shiftright("place", low + BITS) == F.shiftright("_t", low + BITS))
        sums = inside.groupBy("_s", digit.alias("_d")).agg(F.sum("size").alias("_sum"))
        up_to = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_d"))
        sums = sums.withColumn("_up", up_to).join(state.select(F.col("source").alias("_s2"), "_left"), F.col("_s").eqNullSafe(F.col("_s2")))
        fits = F.col("_up") <= F.col("_left")
        # the boundary digit is the first that does not fit; where all fit, all are below the threshold
        cut = sums.groupBy("_s").agg(F.coalesce(F.min(F.when(~fits, F.col("_d"))), F.lit(1 << BITS)).alias("_cut"), F.coalesce(F.max(F.when(fits, F.col("_up"))), F.lit(0)).alias("_used"))
        state = stored(
            state.join(cut, state["source"].eqNullSafe(cut["_s"]), "left")
            .withColumn("threshold", F.col("threshold") + F.shiftleft(F.coalesce("_cut", F.lit(0)).cast("long"), low))
            .withColumn("_left", F.col("_left") - F.coalesce("_used", F.lit(0)))
            .select(*state.columns),
            "thresholds",
        )
    return state.drop("_left")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and how many copies of it the mix takes."""
    sized = stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), place(F.col(key), F.col(text)).alias("place")), "sizes")
    found = thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))).withColumnRenamed("source", "_s")
    copies = F.col("passes") + (F.col("place") < F.col("threshold")).cast("long")
    return (
        sized.join(found, sized["source"].eqNullSafe(found["_s"]))
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns, and mix_copies: how often each is taken. Of a source without words every document is taken once."""
    return apart(docs.drop("mix_copies"), _mixed_documents)


def _mixed_documents(docs: DataFrame) -> DataFrame:
    sized = stored(docs.select("source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place")), "sizes")
    found = thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))).select(F.col("source").alias("__s"), F.col("passes").alias("__p"), F.col("threshold").alias("__t"))
    copies = F.col("__p") + (place(F.col("doc_id"), F.col("text")) < F.col("__t")).cast("long")
    return docs.join(found, docs["source"].eqNullSafe(found["__s"])).withColumn("mix_copies", copies).where("mix_copies > 0").select(*docs.columns, "mix_copies")
