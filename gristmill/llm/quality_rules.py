"""Host-level quality rules: document failures, summed by host, shrunk with an empirical beta prior, joined back.

DataFrame functions only. Whole texts are read once; everything after that runs on one narrow row per document.

Defined cases: a null text has no words and fails as too short; a null host is a host of its own; repeated rows
each get their row; an empty table gives an empty result; columns of the input other than the key, text and host are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, apart, stored

#: Low bits of a packed window key that hold its place; longer texts take the struct sort.
PLACE_BITS = 21


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    #: A document fails if more than this share (percent) of its words lies in repeated windows.
    max_repeat_percent: int = 20
    window: int = 5
    #: A host is rejected if its shrunk failure rate is above this.
    max_host_rate: float = 0.5
    #: Bounds of the prior's strength, in documents.
    min_strength: float = 2.0
    max_strength: float = 1e6


def _none() -> Column:
    return F.expr("CAST(array() AS ARRAY<BIGINT>)")


def _pairs(left: str, right: str, by: int, size: Column) -> Column:
    """Hash left[i] with right[i + by]: keys of longer windows from keys of shorter ones."""
    return F.zip_with(F.slice(left, 1, size), F.slice(right, by + 1, size), lambda a, b: F.xxhash64(a, b))


def _neighbours(order: Column, same) -> Column:
    """Places of the entries of a sorted array that equal the one before or after; each entry holds key and place."""
    size = F.size(order)
    after = F.zip_with(order, F.slice(order, 2, size), lambda a, b: F.struct(a.alias("at"), F.coalesce(same(a, b), F.lit(False)).alias("hit")))
    before = F.concat(F.slice(order, 1, 1), F.slice(order, 1, F.greatest(size - 1, F.lit(0))))
    both = F.zip_with(after, before, lambda a, b: F.struct(a["at"].alias("at"), (a["hit"] | (same(a["at"], b) & (a["at"] != b))).alias("hit")))
    return F.transform(F.filter(both, lambda x: x["hit"]), lambda x: x["at"])


def measured(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, all of the whole text.

    Windows of five words are hashed by doubling (two, four, five words). Only a text in which a key comes twice has its keys
    sorted: as packed longs, or as structs where packing would mix two keys up.
    """
    assert rules.window == 5, "windows are built as 2 + 2 + 1 words"
    mask = F.lit(-(1 << PLACE_BITS)).cast("long")
    n = F.col("n_words").cast("int")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = (
        docs.withColumn("_words", F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.expr("CAST(array() AS ARRAY<STRING>)")))
        .withColumn("n_symbols", F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"))
        .withColumn("_lines", F.coalesce(lines, F.expr("CAST(array() AS ARRAY<STRING>)")))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("_one", F.transform("_words", lambda x: F.xxhash64(x)))
        .drop("_words")
        .withColumn("_two", _pairs("_one", "_one", 1, F.greatest(n - 1, F.lit(0))))
        .withColumn("_four", _pairs("_two", "_two", 2, F.greatest(n - 3, F.lit(0))))
        .withColumn("_keys", _pairs("_four", "_one", 4, F.greatest(n - 4, F.lit(0))))
        .drop("_one", "_two", "_four")
    )
    distinct = F.size(F.array_distinct("_keys"))
    packed = F.transform("_keys", lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long")))
    clear = (F.size("_keys") < (1 << PLACE_BITS)) & (F.size(F.array_distinct(F.transform("_keys", lambda x: x.bitwiseAND(mask)))) == distinct)
    out = (
        out.withColumn("_packed", F.when(distinct == F.size("_keys"), _none()).when(clear, F.sort_array(packed)))
        .withColumn("_slow", F.when(F.col("_packed").isNull(), F.array_sort(F.transform("_keys", lambda x, i: F.struct(x.alias("k"), i.cast("long").alias("i"))))))
    )
    fast = F.transform(_neighbours(F.col("_packed"), lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")))
    slow = F.transform(_neighbours(F.col("_slow"), lambda a, b: a["k"] == b["k"]), lambda x: x["i"])
    covered = F.zip_with("_at", F.slice(F.col("_at"), 2, F.size("_at")), lambda a, b: F.least(F.lit(5).cast("long"), F.coalesce(b - a, F.lit(5).cast("long"))))
    return (
        out.withColumn("_at", F.when(F.size("_packed") == 0, _none()).otherwise(F.sort_array(F.when(F.col("_packed").isNotNull(), fast).otherwise(slow))))
        .withColumn("n_repeat_words", F.when(F.size("_at") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)))
        .drop("_keys", "_packed", "_slow", "_at")
        .withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    )


def host_verdicts(flagged: DataFrame, rules: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunk failure rate) and host_rejected.

    The prior's mean and strength come from the spread of the hosts' own rates (method of moments): three numbers, fetched as literals.
    """
    hosts = flagged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = stored(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    mean = 0.0 if mean is None else mean
    strength = mean * (1 - mean) / spread - 1 if spread else rules.max_strength
    strength = min(max(strength, rules.min_strength), rules.max_strength)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > rules.max_host_rate)


def judged(flagged: DataFrame, rules: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """flagged (rows with base_failed) with host_rejected and kept. The host table is joined by Spark's choice: it is broadcast only below the session's size bound."""
    verdicts = host_verdicts(flagged, rules, host).select("_host", "host_rejected")
    return (
        flagged.join(verdicts, flagged[host].eqNullSafe(verdicts["_host"]), "left")
        .drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
    )


def scored(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the measures, base_failed, kept and host_rejected of every document."""
    narrow = measured(docs.select("doc_id", "source", "text"), rules).drop("text")
    return judged(stored(narrow, "rules"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


def accepted(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns. The texts that pass the base rules are written once; host verdicts then filter that table.

    Without the table the filter would be pushed below the measures and work them out anew for each use.
    """
    return apart(docs, lambda docs: _accepted(docs, rules))


def _accepted(docs: DataFrame, rules: QualityRules) -> DataFrame:
    flagged = measured(docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), F.col("text").alias("_text")), rules, "_text")
    flagged = stored(flagged.select("_row", "_source", "base_failed").withColumn("_row", F.when(~F.col("base_failed"), F.col("_row"))), "rules")
    return judged(flagged, rules, "_source").where("kept").select("_row.*")
