"""The operators' queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import (
    alignment,
    collocations,
    decontaminate,
    licenses,
    lm_scoring,
    mixing,
    near_duplicates,
    packing,
    quality_rules,
    resample,
    suffix_dedup,
    suffix_trees,
    url_filters,
)
from gristmill.llm.common import documents
from gristmill.llm.oracles import SQL


def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents labelled as good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")


def captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time that follows from the id: any minute of 2024."""
    minute = (F.col("page_id") * 37) % 527040
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on the hosts of the pages, by a hash of the host: added, removed, and for some added again; some cover the domain above."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long"))
    pattern = F.when(F.col("h") % 5 == 0, F.substring_index("host", ".", -2)).otherwise(F.col("host"))
    name = F.when(F.col("h") % 3 == 0, "malware").when(F.col("h") % 3 == 1, "adult").otherwise("piracy")
    start = F.lit(1704067200) + (F.col("h") % 250) * 86400
    gone = start + (F.col("h") % 45 + 1) * 86400
    first = F.struct(F.lit(True).alias("added"), start.alias("s"))
    last = F.struct(F.lit(False).alias("added"), gone.alias("s"))
    again = F.struct(F.lit(True).alias("added"), (gone + 2592000).alias("s"))
    events = F.explode(F.when(F.col("h") % 2 == 0, F.array(first, last, again)).otherwise(F.array(first, last)))
    entries = hosts.select(name.alias("list"), pattern.alias("pattern"), events.alias("e"))
    return entries.select("list", "pattern", F.col("e.added").alias("added"), F.timestamp_seconds("e.s").alias("at"))


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(documents(spark, sf_dir), good_documents(spark, sf_dir))


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(documents(spark, sf_dir))


def op3_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op4_license_compression_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.scored(documents(spark, sf_dir), size=4)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.scored(documents(spark, sf_dir))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(documents(spark, sf_dir), good_documents(spark, sf_dir))


def op9_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.scored(documents(spark, sf_dir))


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filters.evaluated(captures(pages), list_entries(pages))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(documents(spark, sf_dir))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cross_entropy_difference": op1_cross_entropy_difference,
        "op2_host_quality_rules": op2_host_quality_rules,
        "op3_hash_threshold_mix": op3_hash_threshold_mix,
        "op4_license_compression_scan": op4_license_compression_scan,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_minhash_near_duplicates": op6_minhash_near_duplicates,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_importance_resampling": op8_importance_resampling,
        "op9_suffix_tree_dedup": op9_suffix_tree_dedup,
        "op10_temporal_url_filter": op10_temporal_url_filter,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
