"""Cross-entropy difference: a target and a background n-gram model over one vocabulary, and their per-token losses on every document.

A text is the sequence of its words (A-Z lower-cased) between a start and an end mark. The vocabulary is every word of the corpus, and the end mark.
Both models are bigram models smoothed in the same way: P(w | v) = (c(v w) + strength * P(w)) / (c(v) + strength) and
P(w) = (c(w) + smooth) / (N + smooth * V), so that after any v the probabilities of the vocabulary sum to one. The background is counted over all
documents, the target over those named as good. A document is scored by what the others say: its own counts are taken out of both models, so a text
that occurs twice has a lower background loss than one that occurs once. A document's score is its mean loss under the target less that under the
background: the lower, the more it is like the target.

Counts are exact and grow with the corpus, so no task holds them all. Documents are dealt into chunks; a chunk sends the distinct words and pairs that it
holds, with how often, to parts of the space of hashes; a part adds up what all chunks send and answers each with the totals of what it asked; a chunk then
scores its documents. A gram that is everywhere costs a row entry a chunk, not one an occurrence. Chunks and parts follow the size of the corpus.

Grams are compared by keys that are so much longer than the number of grams needs that one shares its key with another with a probability under one in
a million, up to 64 bits. Keys are sent as differences, counts as bytes where they are small. Defined cases: a document without words has no tokens and null losses and is in neither model; without named
documents the target is uniform; equal rows are scored each by itself and see one another; a row without doc_id is counted and scored, but is never good;
rows that repeat a named id are all good; a text of any length is one document of its chunk; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import travels
from gristmill.llm.kernels import LOWER, Words, mixed

travels(__name__)

FACTOR = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(1), np.uint64(2)
#: Characters of text in a chunk, until chunks and parts are so many that a chunk would ask a part for fewer grams than the second number.
CHUNK_CHARS, LEAST_ASKED = 6_000_000, 16
#: Bits of a key beyond those that number the grams.
SPARE_BITS = 20


@dataclass(frozen=True)
class LanguageModel:
    #: How many occurrences of a word the unigram estimate counts for among those of its followers.
    strength: float = 4.0
    #: Added to each word's count.
    smooth: float = 0.5


@dataclass(frozen=True)
class Plan:
    """Chunks, and as many parts; bits of a key, of which the last tells pairs from words."""

    parts: int
    bits: int

    @classmethod
    def of(cls, docs: DataFrame) -> Plan:
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        parts = max(1, min(-(-chars // CHUNK_CHARS), int((chars / 6 / LEAST_ASKED) ** 0.5)))
        return cls(parts, min(64, chars.bit_length() + SPARE_BITS + 1))

    def single(self, words: np.ndarray) -> np.ndarray:
        return self.cut(mixed(words * FACTOR))

    def paired(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.cut(mixed(mixed(first * FACTOR) + second)) | np.uint64(1)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(65 - self.bits) << np.uint64(1)

    @property
    def start(self) -> np.uint64:
        return self.single(np.array([START]))[0]

    def slices(self, keys: np.ndarray) -> np.ndarray:
        """Where each part of the space of keys begins and ends in sorted keys."""
        bounds = np.array([(k << self.bits) // self.parts for k in range(1, self.parts)], np.uint64)
        return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], np.int64)
    return counts


def differences(keys: np.ndarray) -> bytes:
    """The first of some ascending keys, then each one's distance from the one before, in as few bytes as the largest needs."""
    steps = np.diff(keys)
    width = -(-int(steps.max()).bit_length() // 8) if len(steps) else 0
    return keys[:1].tobytes() + steps.view(np.uint8).reshape(len(steps), 8)[:, :width].tobytes()


def summed(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    steps[1:, : (len(data) - 8) // max(n - 1, 1)] = np.frombuffer(data[8:], np.uint8).reshape(n - 1, -1) if n > 1 else 0
    return np.cumsum(steps.view(np.uint64).ravel())


class Chunk:
    """The predictions of some texts: for each its text, and the places of the word, of what stands before and of the pair among the chunk's distinct grams."""

    def __init__(self, texts: list[bytes | None], words: Words, plan: Plan):
        parts = [words.of((t or b"").translate(LOWER).split()) for t in texts]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        some = self.lengths > 0
        self.text = np.repeat(np.flatnonzero(some), self.lengths[some] + 1)
        n = len(self.text)
        word = np.concatenate([x for p in parts if len(p) for x in (p, [END])] or [[]]).astype(np.uint64)
        del parts
        self.first = np.concatenate(([True], self.text[1:] != self.text[:-1])) if n else np.zeros(0, bool)
        before = np.where(self.first, START, np.roll(word, 1))
        grams = np.concatenate((plan.single(word), [plan.start], plan.paired(before, word)))
        del word, before
        self.keys, places = np.unique(grams, return_inverse=True)
        # the start mark is no prediction, but counts as what stands before
        self.word, self.start, self.pair = places[:n], places[n], places[n + 1 :]
        self.before = np.where(self.first, self.start, np.roll(self.word, 1))

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each gram occurs in the chosen predictions."""
        out = np.bincount(self.word[of], minlength=len(self.keys)) + np.bincount(self.pair[of], minlength=len(self.keys))
        out[self.start] += np.count_nonzero(self.first & of)
        return out

    def own(self, of: np.ndarray) -> np.ndarray:
        """How often the gram `of` each prediction occurs in its own text."""
        _, places, counts = np.unique(self.text * np.int64(len(self.keys)) + of, return_inverse=True, return_counts=True)
        return counts[places]

    def own_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the word, of what stands before (a word of the text too, or its only start mark) and of the pair."""
        word = self.own(self.word)
        return word, np.where(self.first, 1, np.roll(word, 1)), self.own(self.pair)


def _split(table: pa.Table) -> tuple[list, list[bytes | None], np.ndarray]:
    """Ids and texts of the documents of a chunk, and which are good: rows without a text of their own are the named ids."""
    named = {d for d, row in zip(table.column("doc_id").to_pylist(), table.column("row").to_pylist(), strict=True) if not row}
    docs = table.filter(table.column("row"))
    ids = docs.column("doc_id").to_pylist()
    return ids, docs.column("text").cast(pa.large_binary()).to_pylist(), np.array([d in named for d in ids], bool)


def _asked(plan: Plan):
    words = Words()

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        _, texts, good = _split(table)
        chunk = Chunk(texts, words, plan)
        counts = chunk.counts(np.ones(len(chunk.text), bool)), chunk.counts(good[chunk.text])
        at = plan.slices(chunk.keys)
        ranges = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        columns = [[differences(chunk.keys[a:b]) for a, b in ranges], *([packed(c[a:b]) for a, b in ranges] for c in counts)]
        numbers = [pa.array(range(plan.parts), pa.int32()), pa.array([key[0].as_py()] * plan.parts, pa.int64()), pa.array([b - a for a, b in ranges], pa.int64())]
        return pa.Table.from_arrays([*numbers, *[pa.array(c, pa.binary()) for c in columns]], ["part", "chunk", "n", "keys", "background", "target"])

    return asked


def _answered(plan: Plan):
    def answered(table: pa.Table) -> pa.Table:
        """The totals of what each chunk asked, and the part's share of the figures of the whole corpus: words, and tokens of either model."""
        sizes = table.column("n").to_pylist()
        keys, places = np.unique(np.concatenate([summed(x, n) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True) if n] or [np.zeros(0, np.uint64)]), return_inverse=True)
        ends = np.cumsum(sizes)[:-1]
        word = (keys & np.uint64(1) == 0) & (keys != plan.start)
        answers, sums = [], []
        for c in ("background", "target"):
            sent = np.concatenate([unpacked(x, n) for x, n in zip(table.column(c).to_pylist(), sizes, strict=True)])
            total = np.bincount(places, weights=sent, minlength=len(keys)).astype(np.int64)
            sums.append(int(total[word].sum()))
            answers.append([packed(total[p]) for p in np.split(places, ends)])
        figures = [pa.array([x] * table.num_rows, pa.int64()) for x in (int(word.sum()), *sums)]
        return pa.Table.from_arrays([table.column("part"), table.column("chunk"), *[pa.array(a, pa.binary()) for a in answers], *figures], ["part", "chunk", "background", "target", "words", "n_background", "n_target"])

    return answered


def losses(counts: np.ndarray, out: np.ndarray, total: np.ndarray, words: int, chunk: Chunk, own: tuple, spec: LanguageModel) -> np.ndarray:
    """Loss of each prediction, in nats. counts: of each gram; out: whether the text itself is in the model; total: tokens of the model without it."""
    word, before, pair = (counts[x] - out * n for x, n in zip((chunk.word, chunk.before, chunk.pair), own, strict=True))
    alone = (word + spec.smooth) / (total + spec.smooth * words)
    return -np.log((pair + spec.strength * alone) / (before + spec.strength))


def _scored(spec: LanguageModel, plan: Plan):
    kept = Words()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, good = _split(left)
        chunk = Chunk(texts, kept, plan)
        del texts
        right = right.sort_by("part")
        sizes = np.diff(plan.slices(chunk.keys)).tolist()
        words = sum(right.column("words").to_pylist())
        own, size = chunk.own_counts(), np.bincount(chunk.text, minlength=len(ids))
        means = []
        for name, of in (("target", good), ("background", np.ones(len(ids), bool))):
            counts = np.concatenate([unpacked(x, n) for x, n in zip(right.column(name).to_pylist(), sizes, strict=True)])
            total = sum(right.column(f"n_{name}").to_pylist()) - of * size
            loss = losses(counts, of[chunk.text], total[chunk.text], words, chunk, own, spec)
            means.append(np.bincount(chunk.text, weights=loss, minlength=len(ids)) / np.maximum(size, 1))
        none = size == 0
        columns = [pa.array(ids, pa.int64()), pa.array(chunk.lengths, pa.int64()), *[pa.array(m, mask=none) for m in means], pa.array(means[0] - means[1], mask=none)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"])

    return scored


def scored(docs: DataFrame, good: DataFrame, spec: LanguageModel = LanguageModel()) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a prediction: each word, and the end), loss_difference of every document. good: doc_id of the target's documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("row"))
    named = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("row")).where("doc_id IS NOT NULL")
    plan = Plan.of(docs)
    # by the id, so that named ids find their documents without a join of texts; rows without one by their text
    rows = docs.unionByName(named).withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(plan.parts)))
    asked = rows.groupBy("chunk").applyInArrow(_asked(plan), "part int, chunk long, n long, keys binary, background binary, target binary")
    answered = asked.groupBy("part").applyInArrow(_answered(plan), "part int, chunk long, background binary, target binary, words long, n_background long, n_target long")
    return rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_scored(spec, plan), "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double")
