"""Importance resampling: hashed n-gram models of target and raw text, log weights per document, and a Gumbel top-k sample.

Words and pairs of words are hashed into a fixed number of buckets. The target model is counted over the documents labelled as good, the raw
model over all. A document's log weight is the sum over its n-grams of log target share less log raw share; with Gumbel noise added, the k
largest keys are a sample without replacement in proportion to the weights. Noise is drawn from a hash of the id, so reruns agree.

The k-th largest key is found by histograms of its digits, one pass a digit over a table of one narrow row per document; nothing is sorted.

Defined cases: a document without words has log weight 0, long texts have as many n-grams as they have; rows without an id share one noise value of
their own and are never among the target's documents; other columns are not read; ties in the key are broken by the hash of the id, then
by the number of the row, so the sample holds exactly k rows (rows that tie in both are equal in all that is returned); without labels all weights are equal; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored, travels
from gristmill.llm.kernels import LOWER, Words

travels(__name__)


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    #: The share of all documents that the sample holds.
    share: float = 0.75
    #: Added to each bucket's count.
    smooth: float = 1.0
    seed: int = 0


def grams(text: bytes | None, words: Words, buckets: int) -> np.ndarray:
    """Buckets of the words and pairs of words of a whole text."""
    parts = (text or b"").translate(LOWER).split()
    one = words.of(parts)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    two ^= two >> np.uint64(29)
    return (np.concatenate((one, two)) % np.uint64(buckets)).astype(np.int64)


def _counted(buckets: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros((2, buckets), np.int64), Words()
        for batch in batches:
            for text, good in zip(batch.column("text").cast(pa.large_binary()), batch.column("good").to_pylist(), strict=True):
                found = np.bincount(grams(text.as_py(), words, buckets), minlength=buckets)
                counts[0] += found
                if good:
                    counts[1] += found
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "target"])

    return counted


def ratios(docs: DataFrame, good: DataFrame, spec: Resampling) -> np.ndarray:
    """Log target share less log raw share of each bucket. good: doc_id of the target's documents."""
    marked = docs.join(good.select("doc_id").distinct().withColumn("good", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
    rows = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counted(spec.buckets), "bucket long, raw long, target long")
    table = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    shares = []
    for name in ("target", "raw"):
        counts = np.full(spec.buckets, spec.smooth)
        counts[table.column("bucket").to_numpy()] += table.column(name).to_numpy()
        shares.append(np.log(counts / counts.sum()))
    return shares[0] - shares[1] if sum(table.column("target").to_pylist()) else np.zeros(spec.buckets)


def noise(ids: list[int | None], seed: int) -> np.ndarray:
    """Gumbel noise of each id."""
    drawn = np.array([xxhash.xxh3_64_intdigest(str(i), seed) for i in ids], np.uint64)
    even = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(even))


def _weighed(sent: Broadcast, spec: Resampling):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, words = sent.value, Words()
        for batch in batches:
            weights = np.array([ratio[grams(t.as_py(), words, spec.buckets)].sum() for t in batch.column("text").cast(pa.large_binary())], float)
            keys = weights + noise(batch.column("doc_id").to_pylist(), spec.seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights), pa.array(keys)], ["doc_id", "log_weight", "key"])

    return weighed


def largest(keys: DataFrame, k: int, key: str = "key", id: str = "doc_id") -> DataFrame:
    """keys with kept, true of the k rows with the largest keys. Five digits of the key, four of the id's hash, then six of the row's number, each by one histogram of at most 4096 rows."""
    scaled = (F.col(key) * (1 << 20)).cast("decimal(38,0)") + (1 << 58)
    high = F.greatest(F.least(scaled, F.lit((1 << 59) - 1)), F.lit(0)).cast("long")
    low = F.shiftrightunsigned(F.xxhash64(F.col(id).cast("string")), 16)
    digits = [F.pmod(F.shiftright(F.col("_high"), 12 * i), F.lit(4096)) for i in reversed(range(5))] + [F.pmod(F.shiftright(F.col("_low"), 12 * i), F.lit(4096)) for i in reversed(range(4))]
    digits += [F.pmod(F.shiftright(F.col("_row"), 12 * i), F.lit(4096)) for i in reversed(range(6))]
    table = stored(keys.withColumn("_high", high).withColumn("_low", low).withColumn("_row", F.monotonically_increasing_id()), "keys")
    above, inside, left = F.lit(False), F.lit(True), k
    for digit in digits:
        counts = sorted(table.where(inside).groupBy(digit.alias("d")).count().collect(), reverse=True)
        cut = 4096
        for d, n in counts:
            if n > left:
                break
            left, cut = left - n, d
        above = above | (inside & (digit >= cut))
        rest = [d for d, _ in counts if d < cut]
        if not rest or left <= 0:
            break
        inside = inside & (digit == max(rest))
    return table.withColumn("kept", above).drop("_high", "_low", "_row")


def resampled(docs: DataFrame, good: DataFrame, spec: Resampling = Resampling()) -> DataFrame:
    """doc_id, log_weight, key, kept of every document; kept marks the sample."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(ratios(docs, good, spec))
    keys = stored(docs.mapInArrow(_weighed(sent, spec), "doc_id long, log_weight double, key double"), "weights")
    return largest(keys, int(spec.share * keys.count()))
