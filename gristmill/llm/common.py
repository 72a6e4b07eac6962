"""Helpers shared by the operators: word patterns, tables in the shared folder, kernels that travel by value."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.tables import Scratch, stored  # noqa: F401  the operators take them from here

#: A word as the contracts define it: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def travels(module: str) -> None:
    """Functions of this module go to tasks by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: The columns of documents; operators have names of their own for everything else.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the input's other columns under numbered names that no operator uses; in the result they have their own again."""
    names = {c: f"other_column_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = work(docs.select(*[quoted(c).alias(names.get(c, c)) for c in docs.columns]))
    back = {n: c for c, n in names.items()}
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns])


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows out evenly, whatever their keys, before work that is heavy for each row."""
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
