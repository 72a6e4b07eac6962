"""Tables in files by range of a key, and searches among sorted bounds.

A table is a folder of files, each with the rows of one range of the key, and of manifests, one a version: which file holds which range. A change rewrites the files of the ranges that it touches
and commits by a new manifest; until then readers see the version before, and a change that fails leaves only files that no manifest names. A manifest has a line a file, whatever the rows; it is all that the driver sees.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

from gristmill.operators.tables import deleted, numbers_in, patched, put_once, travels, unique, upserted

travels(__name__)

#: Rows of a range, as a table is created or a range grows beyond twice as many.
RANGE_ROWS = 1_000_000
#: Bytes of their values, before compression, likewise: rows may be short or hold whole texts.
RANGE_BYTES = 64_000_000


def place(key: Column, bounds: list) -> Column:
    """How many of some sorted bounds are not above a key, by binary search; 0 for null. The bounds go to the tasks with the plan."""

    def found(keys: pd.Series) -> pd.Series:
        some = keys.notna()
        out = np.zeros(len(keys), np.int32)
        out[some] = [bisect_right(bounds, k) for k in keys[some]] if not bounds or isinstance(bounds[0], str) else np.searchsorted(np.array(bounds), keys[some], "right")
        return pd.Series(out)

    return F.pandas_udf(found, "int")(key)


def in_windows(rows: DataFrame, windows: DataFrame, name: str, at: str = "published_at") -> DataFrame:
    """rows with the name of the window (start, end] that holds their time, null in a gap.

    windows: name, start, end; of any length, with or without gaps, none over another. Their ends, one a digest, are searched as a sorted array; no row meets more than one window.
    """
    bounds = windows.where("start < end").select(F.col(name).alias("name"), F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end")).orderBy("end").collect()
    for before, after in zip(bounds, bounds[1:], strict=False):
        if after.start < before.end:
            raise ValueError(f"windows {before.name} and {after.name} overlap")
    known = rows.sparkSession.createDataFrame([(i, b.name, b.start) for i, b in enumerate(bounds)], f"window_number int, window_name {windows.schema[name].dataType.simpleString()}, window_start long")
    # the first window that ends no earlier
    numbered = rows.withColumn("window_number", place(F.unix_micros(at) - 1, [b.end for b in bounds]))
    inside = F.unix_micros(at) > F.col("window_start")
    return numbered.join(known, "window_number", "left").withColumn(name, F.when(inside, F.col("window_name"))).drop("window_number", "window_name", "window_start")


def width(schema: StructType) -> Column:
    """About how many bytes the values of a row take, before compression."""

    def of(field: StructField) -> Column:
        kind, c = field.dataType, F.col(field.name)
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        if isinstance(kind, (ArrayType, MapType, StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long")
        return F.lit(8).cast("long")

    return sum((of(f) for f in schema.fields), F.lit(0).cast("long"))


class Conflict(RuntimeError):
    """Another change was committed in between."""


@dataclass(frozen=True)
class RangeTable:
    """A version of a table. files: a folder for each range, by its number; bounds: where each range but the first begins."""

    spark: SparkSession
    path: str
    key: str
    version: int
    schema: str
    bounds: list
    files: list[str]
    range_rows: int = RANGE_ROWS
    range_bytes: int = RANGE_BYTES

    @classmethod
    def created(cls, rows: DataFrame, key: str, path: str, range_rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES) -> RangeTable:
        """A new table of rows at path. key: a text or an integer. A range, which one task writes, has about range_rows rows or range_bytes bytes, whichever is reached first."""
        empty = cls(rows.sparkSession, path, key, 0, rows.schema.json(), [], [], range_rows, range_bytes)
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(width(rows.schema)), F.lit(0)).alias("bytes")).first()
        return empty._committed(*empty._split(rows, empty._ranges(size.n, size.bytes)))

    def _ranges(self, n: int, size: int) -> int:
        """In how many ranges so many rows and bytes go."""
        return max(1, -(-n // self.range_rows), -(-size // self.range_bytes))

    @classmethod
    def opened(cls, spark: SparkSession, path: str, version: int | None = None) -> RangeTable:
        """The latest version, or another that is still there."""
        last = numbers_in(spark, f"{path}/manifest")[-1] if version is None else version
        held = json.loads(spark.read.text(f"{path}/manifest/{last}", wholetext=True).first()[0])
        return cls(spark, path, held["key"], last, held["schema"], held["bounds"], held["files"], held["range_rows"], held.get("range_bytes", RANGE_BYTES))

    def rows(self, of: list[int] | None = None) -> DataFrame:
        """All rows, or those of some ranges."""
        schema = StructType.fromJson(json.loads(self.schema))
        files = [f"{self.path}/{f}" for f in (self.files if of is None else [self.files[i] for i in of])]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The ranges in which some keys lie: at most as many as there are files."""
        return sorted(r.n for r in keys.select(place(F.col(self.key), self.bounds).alias("n")).distinct().collect())

    def upserted(self, new: DataFrame, keep_if_empty: tuple[str, ...] = (), body: str = "") -> RangeTable:
        """The next version, with the rows of new put over those of this one by key; see tables.upserted."""
        return self._changed(new, lambda old, new: upserted(old, new, self.key, keep_if_empty, body))

    def patched(self, patch: DataFrame) -> RangeTable:
        return self._changed(patch, lambda old, new: patched(old, new, self.key))

    def deleted(self, keys: DataFrame) -> RangeTable:
        return self._changed(keys, lambda old, new: deleted(old, new.select(self.key), [self.key]))

    def replaced(self, new: DataFrame) -> RangeTable:
        """The next version, in which the rows of new stand for all that have their keys."""
        return self._changed(new, lambda old, new: deleted(old, new.select(self.key).distinct(), [self.key]).unionByName(new))

    def _changed(self, new: DataFrame, change) -> RangeTable:
        touched = self.touched(new)
        bounds, files = [], []
        at = place(F.col(self.key), self.bounds)
        made = change(self.rows(touched), new).withColumn("range_number", at)
        folder = f"data/{unique()}"
        # each range to a task of its own; by a hash of their numbers several would meet in one
        turn = place(F.col("range_number"), touched) - 1 if touched else F.lit(0)
        made.repartitionById(len(touched) or 1, turn).sortWithinPartitions("range_number", self.key).write.partitionBy("range_number").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        sizes = {}
        if touched:
            written = self.spark.read.schema(made.schema).parquet(f"{self.path}/{folder}").groupBy("range_number")
            sizes = {r.range_number: (r.n, r.bytes) for r in written.agg(F.count("*").alias("n"), F.sum(width(self.rows([]).schema)).alias("bytes")).collect()}
        for n, file in enumerate(self.files):
            low = [self.bounds[n - 1]] if n else []
            if n not in touched:
                parts = [], [file]
            elif n in sizes and (sizes[n][0] > 2 * self.range_rows or sizes[n][1] > 2 * self.range_bytes):
                grown = self.spark.read.schema(self.rows().schema).parquet(f"{self.path}/{folder}/range_number={n}")
                parts = self._split(grown, self._ranges(*sizes[n]))
            else:
                parts = [], [f"{folder}/range_number={n}"] if n in sizes else [self._empty()]
            bounds, files = [*bounds, *low, *parts[0]], [*files, *parts[1]]
        return self._committed(bounds, files)

    def _split(self, rows: DataFrame, n: int) -> tuple[list, list[str]]:
        """Bounds and files of rows in n ranges; equal keys stay together."""
        folder = f"data/{unique()}"
        parts = rows.repartitionByRange(n, F.col(self.key).asc_nulls_first()).withColumn("range_number", F.spark_partition_id())
        parts.write.partitionBy("range_number").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(parts.schema).parquet(f"{self.path}/{folder}")
        ends = made.groupBy("range_number").agg(F.min(self.key).alias("low")).orderBy("range_number").collect()
        return [e.low for e in ends[1:]], [f"{folder}/range_number={e.range_number}" for e in ends] or [self._empty()]

    def _empty(self) -> str:
        folder = f"data/{unique()}"
        self.rows([]).coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder

    def _committed(self, bounds: list, files: list[str]) -> RangeTable:
        """The next version, told by a manifest that appears whole or not at all."""
        version = self.version + 1
        text = json.dumps({"key": self.key, "schema": self.schema, "range_rows": self.range_rows, "range_bytes": self.range_bytes, "bounds": bounds, "files": files})
        if not put_once(self.spark, f"{self.path}/manifest/{version}", text):
            raise Conflict(f"version {version} of {self.path} is another's")
        return RangeTable(self.spark, self.path, self.key, version, self.schema, bounds, files, self.range_rows, self.range_bytes)
