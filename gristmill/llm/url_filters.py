"""URL filters over time: dated list entries become validity intervals, and each capture meets the entries active when it was fetched.

A pattern is a host; it covers the host and all below it. An entry adds a pattern to a list or removes it at a time, and counts from that time on;
of entries at the same time a removal is the last. Intervals are cut at the turn of months, so the as-of join is an equality on host suffix and
month with a comparison inside: a pattern with a long history meets a capture in one month only, and a host with many captures is a key whose
other side is small, which Spark splits.

DataFrame functions only. Captures that are equal in page, URL and time are evaluated once and joined back, so every capture keeps its row.
Defined cases: a null URL or time matches nothing and stays; entries without list, pattern or time are left out, equal entries are one; an empty list blocks
nothing, no captures give no rows; ties among patterns go to the longest, then the first by code point; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and the hosts above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: open) from entries of list, pattern, added, at."""
    last = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL").groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.min("added").alias("added"))
    until = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return last.withColumn("valid_to", until).where("added").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, fetched_at, host, blocked, lists (comma-joined, in order), pattern (the longest that matched), n_lists of every capture."""
    captures = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at")
    horizon = captures.agg(F.max("fetched_at")).first()[0]
    valid = intervals(entries)
    end = F.coalesce(F.least("valid_to", F.lit(horizon)), F.lit(horizon))
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.greatest("valid_from", end), "month"), F.expr("INTERVAL 1 MONTH"))
    valid = valid.withColumn("month", F.explode(months))
    # what is asked is a host at a time, whichever pages have it
    asked = captures.where("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct()
    asked = asked.withColumn("suffix", F.explode(suffixes(F.col("host")))).withColumn("fetch_month", F.trunc("fetched_at", "month"))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    met = asked.join(valid, (F.col("suffix") == F.col("pattern")) & (F.col("fetch_month") == F.col("month")) & active)
    best = F.min(F.struct((-F.length("pattern")).alias("n"), "pattern"))
    found = met.groupBy("host", "fetched_at").agg(F.collect_set("list").alias("lists"), best.alias("best"))
    out = captures.join(found, ["host", "fetched_at"], "left").withColumn("lists", F.coalesce("lists", F.expr("CAST(array() AS ARRAY<STRING>)")))
    return out.select(
        "page_id",
        "fetched_at",
        "host",
        (F.size("lists") > 0).alias("blocked"),
        F.array_join(F.array_sort("lists"), ",").alias("lists"),
        F.col("best.pattern").alias("pattern"),
        F.size("lists").cast("long").alias("n_lists"),
    )
