"""Tables in the shared folder, and table maintenance. Parquet has no merge: each function gives the table's next version."""

from __future__ import annotations

import os
import re
import sys
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import short_error


def travels(module: str) -> None:
    """Functions of this module go to tasks by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine that has none gets a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def unique() -> str:
    return uuid.uuid4().hex


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file (ASCII) that appears whole or not at all; False if there is one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{unique()}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.writeBytes(text)
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        return False
    return True


def numbers_in(spark: SparkSession, path: str) -> list[int]:
    """The files of a folder that have a number for a name, in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(x) for x in names if x.isdigit())


def stored(df: DataFrame, name: str = "table", within: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (or in `within`) and read it back.

    Cuts the lineage at a table that outlives any executor; every call takes a folder of its own, so a rerun never reads another's rows.
    """
    path = f"{within or folder(df.sparkSession)}/{name}-{unique()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator needs only until its result is stored; they go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{folder(spark)}/scratch-{unique()}"

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, self.path)

    def __exit__(self, *failed) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def upserted(old: DataFrame, new: DataFrame, key: str, keep_if_empty: tuple[str, ...] = (), body: str = "") -> DataFrame:
    """old with the rows of new put over it by key. The columns keep_if_empty are taken over only where the new body is not empty. Rows without a key stay as they are, old and new ones."""
    o, n = old.withColumn("_is_old", F.lit(True)).alias("o"), new.withColumn("_is_new", F.lit(True)).alias("n")
    is_new = F.col("_is_new").isNotNull()
    has_body = F.coalesce(F.col(f"n.{body}") != "", F.lit(False)) if body else F.lit(True)

    def value(c: str) -> Column:
        wins = is_new & (has_body | F.col("_is_old").isNull()) if c in keep_if_empty else is_new
        return F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[value(c) for c in old.columns if c != key])


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """old with the patch's columns where the patch has the key; keys that old lacks are ignored."""
    columns = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(p, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks; created tells them apart."""
    fresh = new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti")
    return old.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def deleted(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return old.join(keys, on, "left_anti")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of new's keys replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def run_started(runs: DataFrame) -> DataFrame:
    """Log rows of runs (run_id, started_at) that begin."""
    return runs.select("run_id", F.lit(0).alias("step"), "started_at", F.lit("running").alias("status"), *[F.lit(None).cast(k).alias(c) for c, k in (("fetched", "bigint"), ("valid", "bigint"), ("error", "string"))])


def run_ended(runs: DataFrame) -> DataFrame:
    """Log rows of runs (run_id, started_at, success, fetched, valid, error) that end."""
    status = F.when(F.col("success"), "success").otherwise("failed")
    return runs.select("run_id", F.lit(1).alias("step"), "started_at", status.alias("status"), F.col("fetched").cast("bigint").alias("fetched"), F.col("valid").cast("bigint").alias("valid"), short_error(F.col("error")).alias("error"))


def latest_runs(log: DataFrame) -> DataFrame:
    """The latest row of each run."""
    columns = [c for c in log.columns if c not in ("run_id", "step")]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*columns), "step").alias("row")).select("run_id", "row.*")


def enrichment_stats(rows: DataFrame) -> DataFrame:
    """One row of counts of rows of hit, answered, valid and tokens: candidates, cache_hits, success, fallback, failed, tokens."""
    hit, good = F.col("hit"), F.col("answered") & F.col("valid")
    spent = F.sum(F.when(~hit & F.col("answered"), F.col("tokens")).otherwise(0))
    return rows.agg(F.count("*").alias("candidates"), F.count_if(hit).alias("cache_hits"), F.count_if(~hit & good).alias("success"), F.count_if(~hit & ~good).alias("fallback"), F.count_if(~hit & ~F.col("answered")).alias("failed"), spent.cast("bigint").alias("tokens"))


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.union, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in sorted(tables.items())])


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
