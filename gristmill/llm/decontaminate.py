"""Benchmark decontamination: a hash set of normalised test n-grams goes to every task, which scans whole texts and verifies each hit.

Words are runs of digits, a-z (A-Z lowered) and characters beyond ASCII. A window is ten consecutive words of an item; an item with fewer is one window.
What travels is two 64-bit hashes a window, with different bases: the first is looked up, the second verifies a hit. The few hits are then joined with the
items' windows, which are hashed in tasks too and never come to the driver whole.

The set is sent in blocks of a bounded number of windows; ordinary benchmarks are one. More blocks are more scans of the documents, and give only their
hits; texts are not written for it. Blocks change no result: hits of all blocks are gathered before a document is judged or cut, and a cut text is scanned again
for all blocks, until none has a hit.

Defined cases: null or empty texts and items have no words and no hits; equal rows are each judged, as are rows that repeat an id or have none; rows are
never compared with one another, so ties, clashing names and very long texts need nothing special; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import apart, stored, travels
from gristmill.llm.kernels import Words, mixed

travels(__name__)

WINDOW = 10
#: Windows in one block of 16 bytes each, which bounds what is sent to every task.
AT_ONCE = 4_000_000

#: Lower-cases A-Z and turns every byte that is no word into a space; bytes over 0x7F belong to characters beyond ASCII.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def rolled(ids: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Hash of each window of n words."""
    size = len(ids) - n + 1
    out = np.zeros(max(size, 0), np.uint64)
    for j in range(n if size > 0 else 0):
        out = out * factor + ids[j : j + size]
    return mixed(out)


class Windows:
    """Windows by their length: hashes, sorted, and for each the hash that verifies it. A table of flags by the first bits of the hash answers most look-ups."""

    def __init__(self, size: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.words, self.known = Words(), {}
        for n in np.unique(size).tolist():
            own = size == n
            order = np.lexsort((second[own], first[own]))
            a, b = first[own][order], second[own][order]
            bits = min(max(len(a).bit_length() + 4, 16), 26)
            flags = np.zeros(1 << bits, bool)
            flags[a >> np.uint64(64 - bits)] = True
            self.known[n] = a, b, flags, np.uint64(64 - bits)

    def found(self, text: bytes) -> tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """How many words a text has; and for each length the places of its windows that are known, with both hashes."""
        ids = self.words.of(text.translate(FOLD).split())
        out = []
        for n, (first, second, flags, shift) in self.known.items():
            a = rolled(ids, n, FACTORS[0])
            at = np.flatnonzero(flags[a >> shift])
            if not len(at):
                continue
            a = a[at]
            b = rolled(ids, n, FACTORS[1])[at]
            place, stop = np.searchsorted(first, a), np.searchsorted(first, a, "right")
            # equal first hashes of unlike windows stand side by side
            hit = np.zeros(len(at), bool)
            while (left := place < stop).any():
                hit[left] |= second[place[left]] == b[left]
                place = place + left
            if hit.any():
                out.append((n, at[hit], a[hit], b[hit]))
        return len(ids), out

    def hits(self, text: bytes) -> tuple[int, np.ndarray]:
        """How many words a text has, and which of them are hit."""
        n, found = self.found(text)
        edges = np.zeros(n + 1, np.int64)
        for size, at, _, _ in found:
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
        return n, np.cumsum(edges[:-1]) > 0


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the stretches from the first to the last byte of each run of hit words."""
    spans = [m.span() for m in WORD_BYTES.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    at, kept = 0, []
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept.append(text[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*kept, text[at:]])


def without_hits(windows: Windows, text: bytes) -> bytes:
    """The text without the stretches of hit words, until no window occurs."""
    while True:
        _, hit = windows.hits(text)
        if not hit.any():
            return text
        text = without(text, hit)


def _hashed(n: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            columns = [[], [], [], []]
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                ids = words.of((text.as_py() or b"").translate(FOLD).split())
                if size := min(n, len(ids)):
                    hashes = [rolled(ids, size, f).view(np.int64) for f in FACTORS]
                    for column, values in zip(columns, ([item] * len(hashes[0]), np.full(len(hashes[0]), size), *hashes), strict=True):
                        column.append(pa.array(values))
            if columns[0]:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(k) for x in c]) for c, k in zip(columns, kinds, strict=True)], ["item", "size", "first", "second"])

    return hashed


def windows_of(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item, size, first, second: both hashes of the windows of every item."""
    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_hashed(n), "item string, size int, first long, second long")


def blocks(windows: DataFrame, at_once: int) -> list[Broadcast]:
    """The distinct windows in blocks of about `at_once`, dealt by their hash."""
    distinct = windows.select("size", "first", "second").distinct()
    n = -(-distinct.count() // at_once)
    out = []
    for k in range(n):
        table = (distinct if n == 1 else distinct.where(F.pmod("first", F.lit(n)) == k)).toArrow()
        columns = [table.column("size").to_numpy(), *(table.column(c).to_numpy().view(np.uint64) for c in ("first", "second"))]
        out.append(windows.sparkSession.sparkContext.broadcast(columns))
    return out


SCANNED = "doc_id long, key long, n_words long, hits array<struct<at: int, size: int, first: long, second: long>>"


def _scan(sent: Broadcast | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*(sent.value if sent else [np.zeros(0, np.uint64)] * 3))
        kind = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("first", pa.int64()), ("second", pa.int64())]))
        for batch in batches:
            n_words, hits = [], []
            for text in batch.column("text").cast(pa.large_binary()):
                n, found = windows.found(text.as_py() or b"")
                n_words.append(n)
                hits.append([{"at": i, "size": size, "first": a, "second": b} for size, *x in found for i, a, b in zip(x[0].tolist(), *(h.view(np.int64).tolist() for h in x[1:]), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(hits, kind)], ["doc_id", "key", "n_words", "hits"])

    return scan


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def hits(docs: DataFrame, benchmark: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_words, places (numbers of the hit words), items (ids as strings, sorted) of every document."""
    windows = stored(windows_of(benchmark), "windows")
    scans = [stored(_keyed(docs).mapInArrow(_scan(sent), SCANNED), "scanned") for sent in blocks(windows, at_once) or [None]]
    # rows equal in id and text have equal hits
    found = reduce(DataFrame.union, scans).select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.*").distinct()
    items = windows.groupBy("size", "first", "second").agg(F.collect_set("item").alias("items"))
    met = found.join(items, ["size", "first", "second"])
    spans = F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1))
    met = met.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.array_distinct(F.flatten(spans))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = scans[0].select("doc_id", "key", "n_words")
    out = out.join(met, out["doc_id"].eqNullSafe(met["d"]) & (out["key"] == met["k"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("places", F.expr("CAST(array() AS ARRAY<INT>)")).alias("places"), F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"))


def scored(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


def _with_texts(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type))


def _cut(sent: Broadcast, most: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*sent.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            keep = []
            for i, text in enumerate(texts):
                n, hit = windows.hits(text or b"")
                keep.append(bool(hit.sum() <= most * n))
                if hit.any() and keep[-1]:
                    texts[i] = without_hits(windows, text)
            yield _with_texts(batch, texts).filter(pa.array(keep, pa.bool_()))

    return cut


#: Columns in which the documents of a round carry their key, how many words they have and which are hit.
KEY, N_WORDS, PLACES = "__key", "__n_words", "__places"


def _without_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        for i, (n, places) in enumerate(zip(batch.column(N_WORDS).to_pylist(), batch.column(PLACES).to_pylist(), strict=True)):
            hit = np.zeros(n, bool)
            hit[places] = True
            texts[i] = without(texts[i], hit)
        out = _with_texts(batch, texts)
        yield out.select([c for c in out.schema.names if c not in (KEY, N_WORDS, PLACES)])


def _cleaned_by_rounds(docs: DataFrame, sent: list[Broadcast], most: float) -> DataFrame:
    """The same with several blocks: a round scans for all, then cuts; the next has the documents that were cut. A cut text is shorter, so rounds end."""
    schema, out = docs.schema, None
    while True:
        scans = reduce(DataFrame.union, [_keyed(docs).mapInArrow(_scan(x), SCANNED).where(F.size("hits") > 0) for x in sent])
        # by the hash of the text: equal texts have equal hits
        spans = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))
        found = scans.groupBy(F.col("key").alias(KEY)).agg(F.max("n_words").alias(N_WORDS), F.array_distinct(F.flatten(F.collect_set(spans))).alias(PLACES))
        found = stored(found, "hits")
        keyed = docs.withColumn(KEY, F.xxhash64("text"))
        done = keyed.join(found.select(KEY), KEY, "left_anti").select(*docs.columns)
        hit = keyed.join(found, KEY)
        if out is None:
            # the share is that of the uncut text
            out, hit = done, hit.where(F.size(PLACES) <= most * F.col(N_WORDS))
        else:
            out = out.unionByName(done)
        if hit.isEmpty():
            return out
        docs = stored(hit.select(*docs.columns, KEY, N_WORDS, PLACES).mapInArrow(_without_found, schema), "cut")


def cleaned(docs: DataFrame, benchmark: DataFrame, most: float = 0.5, at_once: int = AT_ONCE) -> DataFrame:
    """docs without hit stretches; a document of which more than the share `most` is hit goes whole. n_chars follows the text where there is such a column."""
    return apart(docs, lambda docs: _cleaned(docs, benchmark, most, at_once))


def _cleaned(docs: DataFrame, benchmark: DataFrame, most: float, at_once: int) -> DataFrame:
    sent = blocks(stored(windows_of(benchmark), "windows"), at_once)
    if len(sent) == 1:
        docs = docs.mapInArrow(_cut(sent[0], most), docs.schema)
    elif sent:
        docs = _cleaned_by_rounds(docs, sent, most)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
