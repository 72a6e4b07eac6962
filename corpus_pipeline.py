"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, mixing, near_duplicates, quality_rules, suffix_dedup
from gristmill.llm.common import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the quality rules reject."""
    return quality_rules.accepted(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_duplicates.representatives(docs, size=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that start earlier as well."""
    return suffix_dedup.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; drop documents that are mostly benchmark."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, and how many copies of each."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicate),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: SQL cannot express the chain; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
