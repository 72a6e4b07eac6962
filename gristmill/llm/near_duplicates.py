"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges.

1. Every whole text becomes the set of its word shingles. Texts with the same set are one class; its smallest id stands for it.
2. One hash pass fills 128 bins. An empty bin borrows from the first filled bin of its own fixed order of bins, the same in all texts.
3. Four bins make a band. In a bucket (band and its bins) each class is tied to the smallest: as many edges as members.
4. Edges are confirmed on the full sets of shingles, then joined to components.
5. Stars alone can miss a link between two members of which one is unlike the centre. Where a bucket still holds several components, the members
   outside the largest are held against members of the others by their full sets, in blocks: first one block a bucket, then, with what that joined
   contracted, all of them. A block of members held against another gives no more pairs than it has members, as pairs that others already join are
   left out; so pairs grow with the members, not with their square. They are confirmed like the edges of stars.

Two texts at similarity 0.8 share a band with probability 1 - (1 - 0.8^4)^32, all but 5e-8; higher similarities miss less.

Defined cases: a null, empty or wordless text has an empty set and links with nothing; a text with fewer words than a shingle is one shingle. Rows that
repeat a doc_id each have their own set and may be linked with different rows; equal rows are one class. A row without doc_id is compared with nothing and
stays; ties go to the smaller id, then to the smaller hash of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, apart, stored, travels
from gristmill.llm.kernels import LOWER, Words, mixed
from gristmill.operators.graph import components

travels(__name__)

BINS, ROWS = 128, 4
#: Percent of the union that the intersection must reach.
PERCENT = 80
#: Shingles and members of a block.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 16, 256
#: Distinct shingles that are compared at once.
AT_ONCE = 1 << 14
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Column in which rows carry their id and the hash of their text.
KEY = "__key"


def shingled(text: bytes, size: int, hashes: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.translate(LOWER).split()
    ids = hashes.of(words)
    n = min(size, len(ids))
    if not n:
        return ids
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * FACTOR + ids[j : len(ids) - n + 1 + j]
    return np.unique(mixed(out))


def orders(bins: int = BINS) -> np.ndarray:
    """For each bin, the turn at which it would borrow from each other bin."""
    return np.argsort(np.random.default_rng(7).random((bins, bins)), axis=1).argsort(axis=1)


def signature(shingles: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin; the top bits of a hash tell its bin. Needs a shingle."""
    bins = len(turns)
    at = (shingles >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)
    out = np.zeros(bins, np.uint64)
    out[filled] = shingles[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        out[empty] = out[filled[turns[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of a signature; the band's number is part of it."""
    parts = values.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * FACTOR + parts[:, j])
    return out


def _described(size: int):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, hashes = orders(), Words()
        for batch in batches:
            counts, prints, keys = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                found = shingled(text or b"", size, hashes)
                counts.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(bands(signature(found, turns)).view(np.int64) if len(found) else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), listed], ["doc_id", "key", "n_shingles", "print", "bands"])

    return described


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash that tells rows of one id apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n_shingles, print (128 bits that tell sets apart, null for none), bands (their keys) of every document."""
    return keyed(docs).mapInArrow(_described(size), "doc_id long, key long, n_shingles long, print binary, bands array<long>")


def word_sets(text: bytes, size: int) -> set:
    words = text.translate(LOWER).split()
    n = min(size, len(words))
    return set(zip(*(words[j:] for j in range(n)), strict=False)) if n else set()


def _confirmed(size: int, percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, known = None, set()
        for batch in batches:
            v, u, centres, texts = (batch.column(c).cast(pa.large_binary()).to_pylist() if c.endswith("text") else batch.column(c).to_pylist() for c in ("v", "u", "v_text", "u_text"))
            linked = []
            for i in range(len(v)):
                if v[i] != centre:
                    centre, known = v[i], word_sets(centres[i], size)
                other = word_sets(texts[i], size)
                both = len(known & other)
                linked.append(100 * both >= percent * (len(known) + len(other) - both))
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return confirmed


def links(pairs: DataFrame, texts: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (u, v) whose full shingle sets are similar enough. A centre that many pairs share is a hot key of a join with one row on its other side."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("u_text")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("v_text")), "v")
    return both.mapInArrow(_confirmed(size, percent), "u long, v long")


def _packed(size: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, hashes = orders(), Words()
        for batch in batches:
            sets = [shingled(text or b"", size, hashes) for text in batch.column("text").cast(pa.large_binary()).to_pylist()]
            keys = [bands(signature(x, turns)).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "bands", "shingles"])

    return packed


class Members:
    """Some members of a bucket: ids, components, band keys, sizes and sets of shingles."""

    def __init__(self, rows: list[dict]):
        self.ids, self.components = (np.array([r[c] for r in rows], np.int64) for c in ("node", "component"))
        self.bands = np.frombuffer(b"".join(r["bands"] for r in rows), np.int64).reshape(len(rows), -1)
        self.sizes = np.array([len(r["shingles"]) // 8 for r in rows])
        self.shingles = np.frombuffer(b"".join(r["shingles"] for r in rows), np.uint64)
        self.owners = np.repeat(np.arange(len(rows)), self.sizes)

    def common(self, other: Members) -> np.ndarray:
        """How many shingles each of these shares with each of the others."""
        values, places = np.unique(np.concatenate((self.shingles, other.shingles)), return_inverse=True)
        own, others = places[: len(self.shingles)], places[len(self.shingles) :]
        both = np.flatnonzero(np.isin(np.arange(len(values)), own) & np.isin(np.arange(len(values)), others))
        out = np.zeros((len(self.ids), len(other.ids)), np.float32)
        for i in range(0, len(both), AT_ONCE):
            part, sides = both[i : i + AT_ONCE], []
            for members, at in ((self, own), (other, others)):
                here = np.searchsorted(part, at)
                inside = (here < len(part)) & (part[np.minimum(here, len(part) - 1)] == at)
                side = np.zeros((len(members.ids), len(part)), np.float32)
                side[members.owners[inside], here[inside]] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
        return out


def spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of some edges join what those before have not joined."""
    to: dict[int, int] = {}
    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        for x in (a, b):
            to.setdefault(x, x)
        while to[a] != a:
            to[a] = a = to[to[a]]
        while to[b] != b:
            to[b] = b = to[to[b]]
        out.append(a != b)
        to[a] = b
    return np.array(out, bool)


def _across(percent: int):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, asked, members in zip(batch.column("bucket").to_pylist(), batch.column("asked"), batch.column("members"), strict=True):
                a, b = Members(asked.as_py()), Members(members.as_py())
                both = a.common(b)
                linked = (100 * both >= percent * (a.sizes[:, None] + b.sizes[None, :] - both)) & (a.components[:, None] != b.components[None, :])
                i, j = np.nonzero(linked)
                if len(i):
                    # a pair counts in the first bucket that it shares
                    same = a.bands[i] == b.bands[j]
                    first = a.bands[i, same.argmax(axis=1)] == bucket
                    i, j = i[first], j[first]
                    keep = spanning(a.components[i], b.components[j])
                    u, v = a.ids[i[keep]], b.ids[j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return across


def across(crowded: DataFrame, groups: DataFrame, packed: DataFrame, percent: int, scratch: Scratch, one_block: bool) -> DataFrame:
    """Pairs (u, v) of members of different components in one bucket of three or more whose sets are similar enough; of pairs that join the same components, some."""
    named = crowded.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    several = parts.groupBy("bucket").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("shingles") / BLOCK_SHINGLES))
    several = several.where("parts > 1").select("bucket", "main", blocks.alias("blocks"))
    # where one block holds a bucket, the first round has seen all pairs
    several = scratch.stored(several if one_block else several.where("blocks > 1"), "several")
    rows = named.join(several, "bucket").join(packed, "node")
    rows = rows.select("bucket", F.pmod(F.xxhash64("node"), "blocks").alias("block"), (F.col("component") != F.col("main")).alias("other"), F.struct("node", "component", "bands", "shingles").alias("m"))
    rows = scratch.stored(rows, "rows")
    asked = rows.where("other").groupBy("bucket", "block").agg(F.collect_list("m").alias("asked")).select("bucket", "asked")
    members = (rows.where("block = 0") if one_block else rows).groupBy("bucket", "block").agg(F.collect_list("m").alias("members")).select("bucket", "members")
    return asked.join(members, "bucket").mapInArrow(_across(percent), "u long, v long").distinct()


def linked(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, class (smallest id with the same set; null for an empty set), component (smallest id that links reach) and first (whether the row's text stands for the component)."""
    with Scratch(docs.sparkSession) as scratch:
        sets = scratch.stored(described(docs, size), "described")
        known = sets.where("print IS NOT NULL AND doc_id IS NOT NULL")
        # ids that stand for several sets: their classes take numbers from a hash
        unlike = known.groupBy("doc_id").agg(F.min(F.xxhash64("print")).alias("a"), F.max(F.xxhash64("print")).alias("b")).where("a <> b").select(F.col("doc_id").alias("id"), F.lit(True).alias("unlike"))
        # a class by its print; equal sets have equal bands
        classes = known.groupBy("print").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        classes = classes.select("print", F.col("least.doc_id").alias("id"), F.col("least.key").alias("key"), "n_shingles", "bands").join(unlike, "id", "left")
        classes = scratch.stored(classes.withColumn("node", F.when(F.col("unlike"), F.xxhash64("print")).otherwise(F.col("id"))).drop("unlike"), "classes")
        members = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
        # stored, so that its size tells how to join it
        shared = scratch.stored(members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "shared")
        members = scratch.stored(members.join(shared, "bucket").select("bucket", "node", "n_shingles", "centre", "n"), "buckets")
        near = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")  # else the union is too large
        stars = members.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v"), F.col("n_shingles").alias("a_n")).distinct()
        stars = stars.join(classes.select(F.col("node").alias("v"), F.col("n_shingles").alias("b_n")), "v").where(near)
        stars = scratch.stored(stars.select("u", "v"), "stars")
        crowded = members.where("n > 2").select("bucket", "node", "n_shingles")
        involved = reduce(DataFrame.union, [stars.select("u"), stars.select("v"), crowded.select("node")]).toDF("node").distinct()
        involved = classes.join(involved, "node").select("node", F.col("id").alias("doc_id"), "key")
        texts = scratch.stored(keyed(docs).join(involved, ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"]), "texts")
        found = scratch.stored(links(stars, texts, size, percent), "links")
        groups = components(found, within=scratch.path)
        packed = texts.join(crowded.select("node").distinct(), "node", "left_semi").mapInArrow(_packed(size), "node long, bands binary, shingles binary")
        packed = scratch.stored(packed, "packed")
        for one_block in (True, False):
            more = scratch.stored(across(crowded, groups, packed, percent, scratch, one_block), "pairs")
            more = scratch.stored(links(more, texts, size, percent), "links")
            if not more.isEmpty():
                found = found.unionByName(more)
                groups = components(found, within=scratch.path)
        named = classes.select("print", "node", F.col("id").alias("class"), F.col("key").alias("class_key")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # classes of an id that stands for several have other numbers than ids, so the smallest id is looked for
        least = named.groupBy("component").agg(F.min(F.struct(F.col("class"), F.col("print"))).alias("least"))
        named = named.join(least, "component").select("print", "class", "class_key", F.col("least.class").alias("component"), (F.col("print") == F.col("least.print")).alias("first"))
        out = sets.withColumn("print", F.when(F.col("doc_id").isNotNull(), F.col("print"))).join(named, "print", "left")
        return stored(out.select("doc_id", "key", "n_shingles", "class", F.coalesce("component", "doc_id").alias("component"), F.coalesce(F.col("first") & (F.col("key") == F.col("class_key")), F.lit(True)).alias("first")), "components")


def scored(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, and class_id."""
    found = linked(docs, size)
    kept = F.col("doc_id").eqNullSafe(F.col("component"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"), F.coalesce("class", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, size: int) -> DataFrame:
    """docs without those that another stands for, with all their columns: of each component one text of the smallest id stays, of rows equal in id and text one."""
    return apart(docs, lambda docs: _representatives(docs, size))


def _representatives(docs: DataFrame, size: int) -> DataFrame:
    found = linked(docs, size)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    gone = found.where("doc_id <> component OR NOT first").select(F.struct("doc_id", "key").alias(KEY)).distinct()
    out = docs.withColumn(KEY, key).join(gone, KEY, "left_anti")
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        out = out.where(F.col(KEY)["doc_id"].isNotNull()).dropDuplicates([KEY]).unionByName(out.where(F.col(KEY)["doc_id"].isNull()))
    return out.select(*docs.columns)
