"""Cross-tokenizer alignment: groups of tokens between the byte offsets where tokens of two vocabularies both end, and how often their ids are linked.

A text with a space in front is encoded by both vocabularies. What a byte range of it holds is a fragment: its open prefix (the tokens through the first common end), its closed
groups, and its open suffix (the tokens behind the last common end); a range without a common end is open as a whole. Fragments are a monoid: joining two closes
the group between them, and it does not matter in which order neighbours are joined. A text up to SECTION_BYTES is one fragment. A longer one is cut into byte ranges at places where either vocabulary cuts as well
(see subwords); its ranges are dealt to tasks, and rounds of grouping join up to FAN neighbours each, until one fragment a text is left.

Links of ids are counted by documents like this: documents are dealt into chunks by a hash of id and text; a chunk sends its distinct pairs, with in how many of its documents
each is linked, to parts of the space of pairs; a part adds up, finds the highest count of each first id, and answers each chunk what it asked. All pairs of a first id are in one part. A pair that is everywhere costs an
entry a chunk, not one a document. Chunks and parts follow the size of the corpus.

Within a group, ids are linked by all pairs of token occurrences: the pairs are the product of the distinct ids with their numbers, so a very long group (a run that no common end breaks) is not
multiplied out by occurrence.

Defined cases: a null or empty text, or one whose joined token bytes of either vocabulary are not the text with a space in front, has no tokens: zeros and an empty string. Spellings of special tokens
are plain text. Rows that repeat an id or a text are documents of their own; a row without id is one as well; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, spread, stored, travels
from gristmill.llm.lm_scoring import differences, packed, summed, unpacked
from gristmill.llm.subwords import BETWEEN, BytePairs, Pieces, Units, Vocabularies, dealt

travels(__name__)

#: Bytes of a text that is one fragment, and about those of a byte range of a longer one.
SECTION_BYTES = 65_536
#: Fragments that a task joins at once.
FAN = 16
#: Characters of text in a chunk, until a chunk would ask a part for fewer pairs than the second number.
CHUNK_CHARS, LEAST_ASKED = 4_000_000, 16
#: Pairs of a group from which they are multiplied by distinct ids.
WIDE = 1024
FRAGMENT = "row long, at long, doc_id long, valid boolean, n_a long, n_b long, n_groups long, common boolean, prefix_a binary, prefix_b binary, groups binary, suffix_a binary, suffix_b binary, pairs binary, times binary"


def spelled(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, cells: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;` of each group in order, and where each group's bytes end. in_a, in_b: tokens of each group; cells: digits of all numbers, each with 0 for what it lacks."""
    groups = len(in_a)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)
    out = np.zeros((len(a) + len(b), cells.shape[1] + 1), np.uint8)
    out[at_a, :-1], out[at_b, :-1] = cells[a], cells[b]
    out[:, -1] = ord(",")
    ends = np.cumsum(in_a + in_b)
    out[ends - in_b - 1, -1] = ord("|")
    out[ends - 1, -1] = ord(";")
    sizes = np.cumsum(np.count_nonzero(out, axis=1))
    flat = out.ravel()
    return flat[flat > 0].tobytes(), sizes[ends - 1] if groups else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def linked(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair (first id * width + second id) and number of links of the groups' ids."""
    start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    wide = in_a * in_b > WIDE
    reps = np.where(wide, 0, in_b)
    of = np.repeat(np.arange(len(in_a)), in_a)  # the group of each first token
    group = np.repeat(of, reps[of])
    pair = np.repeat(a, reps[of]) * np.int64(width) + b[_ranges(start_b[of], reps[of])]
    times = np.ones(len(pair), np.int64)
    more = [(group, pair, times)]
    for g in np.flatnonzero(wide).tolist():
        x, n = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
        y, m = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
        more.append((np.full(len(x) * len(y), g), (x[:, None] * np.int64(width) + y).ravel(), np.outer(n, m).ravel()))
    return tuple(np.concatenate(c) for c in zip(*more, strict=True)) if len(more) > 1 else more[0]


def by_pair(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(pair, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, times)
    return found, total


@dataclass
class Fragment:
    """The tokens of a byte range. Without a common end all are in the prefix."""

    common: bool = False
    prefix: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    suffix: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    n_groups: int = 0
    groups: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_a: int = 0
    n_b: int = 0

    @classmethod
    def of(cls, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, tables: Tables) -> Fragment:
        """ends: offsets from wherever both count, so that equal offsets are common ends."""
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(common):
            return cls(prefix=(a, b), n_a=len(a), n_b=len(b))
        at_a, at_b = (np.searchsorted(ends, common) + 1 for ends in (ends_a, ends_b))
        inner = a[at_a[0] : at_a[-1]], b[at_b[0] : at_b[-1]], np.diff(at_a), np.diff(at_b)
        _, pair, times = linked(*inner, tables.width)
        return cls(True, (a[: at_a[0]], b[: at_b[0]]), (a[at_a[-1] :], b[at_b[-1] :]), len(common) - 1, spelled(*inner, tables.cells)[0], *by_pair(pair, times), len(a), len(b))

    def then(self, other: Fragment, tables: Tables) -> Fragment:
        """What both ranges hold; other follows."""
        n = {"n_a": self.n_a + other.n_a, "n_b": self.n_b + other.n_b}
        between = tuple(np.concatenate(x) for x in zip(self.suffix if self.common else self.prefix, other.prefix, strict=True))
        if not self.common:
            return Fragment(other.common, between, other.suffix, other.n_groups, other.groups, other.pairs, other.times, **n)
        if not other.common:
            return Fragment(True, self.prefix, between, self.n_groups, self.groups, self.pairs, self.times, **n)
        text, pair, times = closed(between, tables)
        pair, times = by_pair(np.concatenate((self.pairs, pair, other.pairs)), np.concatenate((self.times, times, other.times)))
        return Fragment(True, self.prefix, other.suffix, self.n_groups + 1 + other.n_groups, self.groups + text + other.groups, pair, times, **n)

    def whole(self, tables: Tables) -> Fragment:
        """As the fragment of a whole text, which begins behind a common end: the prefix is its first group."""
        start = Fragment(common=True)
        return start.then(self, tables)


def closed(tokens: tuple[np.ndarray, np.ndarray], tables: Tables) -> tuple[bytes, np.ndarray, np.ndarray]:
    group = *tokens, *(np.array([len(x)]) for x in tokens)
    return spelled(*group, tables.cells)[0], *linked(*group, tables.width)[1:]


class Tables:
    """Both vocabularies, read once in a task."""

    def __init__(self, data: tuple[bytes, str, bytes]):
        self.first, self.second = BytePairs(*data[:2]), Pieces(data[2])
        self.width = self.second.size
        most = max(self.first.size, self.second.size)
        self.cells = np.array([list(str(i).rjust(len(str(most)), "\0").encode()) for i in range(most)], np.uint8)


@dataclass
class Tokens:
    """Both vocabularies' tokens of some texts, one behind the other, of which each is a common end's text or left out."""

    valid: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    #: Where each valid text's tokens end.
    to_a: np.ndarray
    to_b: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, tables: Tables) -> Tokens:
        """texts: neither null nor empty."""
        units = Units.of(texts)
        a, b = tables.first.spaced(units.distinct), tables.second.spaced(units.distinct)
        whole = _same(units.distinct, b, tables.second)
        valid = np.logical_and.reduceat(whole[units.places], units.starts[:-1]) if len(texts) else np.zeros(0, bool)
        places = units.places[np.repeat(valid, np.diff(units.starts))]
        last = np.cumsum(np.diff(units.starts)[valid]) - 1
        (a, to_a), (b, to_b) = dealt(*a, places), dealt(*b, places)
        return cls(valid, a, b, np.cumsum(tables.first.sizes[a]), np.cumsum(tables.second.sizes[b]), to_a[last], to_b[last])


def _same(units: pa.Array, ids: tuple[np.ndarray, np.ndarray], pieces: Pieces) -> np.ndarray:
    """Whether the pieces of each unit spell it, with a space in front."""
    sizes = pc.binary_length(units).to_numpy().astype(np.int64) + 1
    spelled, ends = dealt(pieces.letters, pieces.ends, ids[0])
    plain = np.frombuffer(b" " + " ".join(units.to_pylist()).encode(), np.uint8)
    if np.array_equal(np.append(0, ends)[ids[1]], np.cumsum(sizes)) and np.array_equal(spelled, plain):
        return np.ones(len(units), bool)
    ends = np.append(0, np.append(0, ends)[ids[1]])
    return np.array([spelled[x:y].tobytes() == b" " + t.encode() for t, x, y in zip(units.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)], bool)


@dataclass
class Aligned:
    """Groups of some whole texts; sums a text are taken over ranges of groups."""

    tokens: Tokens
    in_a: np.ndarray
    in_b: np.ndarray
    #: Where each text's groups end.
    to: np.ndarray

    @classmethod
    def of(cls, tokens: Tokens) -> Aligned:
        """The end of a text is a common end, so texts are aligned together."""
        marks = np.zeros((tokens.ends_a[-1] if len(tokens.ends_a) else 0) + 1, bool)
        marks[tokens.ends_a] = True
        last_b = np.flatnonzero(marks[tokens.ends_b])
        marks[:] = False
        marks[tokens.ends_b] = True
        last_a = np.flatnonzero(marks[tokens.ends_a])
        return cls(tokens, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1), np.searchsorted(last_a, tokens.to_a - 1) + 1)

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, pair, times = linked(self.tokens.a, self.tokens.b, self.in_a, self.in_b, width)
        return np.searchsorted(self.to, group, side="right"), pair, times


# Very long texts: byte ranges, fragments, rounds of joining.


def sections(text: str) -> Iterator[str]:
    """Byte ranges of a text, each cut at a safe place; the space between two goes to neither, as both vocabularies put it in front of a unit."""
    begin = 0
    while len(text) - begin > SECTION_BYTES:
        cut = BETWEEN.search(text, begin + SECTION_BYTES // 2)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, doc, text in zip(*(batch.column(c) for c in ("row", "doc_id")), batch.column("text").to_pylist(), strict=True):
            for at, part in enumerate(sections(text)):
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([at]), pa.array([doc.as_py()], pa.int64()), pa.array([part], pa.large_string())], ["row", "at", "doc_id", "text"])


def _rows(found: list[tuple[int, int, int | None, Fragment | None]]) -> pa.Table:
    """Rows of FRAGMENT; no fragment where the text is not valid."""
    out = [[] for _ in range(15)]
    for row, at, doc, x in found:
        y = x or Fragment()
        values = row, at, doc, x is not None, y.n_a, y.n_b, y.n_groups, y.common, *(v.tobytes() for v in y.prefix), y.groups, *(v.tobytes() for v in y.suffix), y.pairs.tobytes(), y.times.tobytes()
        for column, value in zip(out, values, strict=True):
            column.append(value)
    kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()] + [pa.binary()] * 7
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in FRAGMENT.split(", ")])


def _read(x: dict) -> Fragment | None:
    if not x["valid"]:
        return None
    number = lambda c: np.frombuffer(x[c], np.int64)
    return Fragment(x["common"], (number("prefix_a"), number("prefix_b")), (number("suffix_a"), number("suffix_b")), x["n_groups"], x["groups"], number("pairs"), number("times"), x["n_a"], x["n_b"])


def _fragments(sent: Broadcast):
    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row, at, doc = (batch.column(c)[i].as_py() for c in ("row", "at", "doc_id"))
                t = Tokens.of(batch.column("text").slice(i, 1).cast(pa.large_string()), tables)
                yield from _rows([(row, at, doc, Fragment.of(t.a, t.ends_a, t.b, t.ends_b, tables) if t.valid[0] else None)]).to_batches()

    return fragments


def _joined(sent: Broadcast):
    def joined(table: pa.Table) -> pa.Table:
        tables = Tables(sent.value)
        rows = table.sort_by("at").to_pylist()
        found = _read(rows[0])
        for x in rows[1:]:
            other = _read(x)
            found = found.then(other, tables) if found and other else None
        return _rows([(rows[0]["row"], rows[0]["at"] // FAN, rows[0]["doc_id"], found)])

    return joined


def long_texts(docs: DataFrame, sent: Broadcast, scratch: Scratch) -> DataFrame:
    """One fragment for each of docs (doc_id, text)."""
    # numbered and cut where they lie, then stored: numbers stay
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    parts = scratch.stored(numbered.mapInArrow(_cut, "row long, at long, doc_id long, text string"), "sections")
    most = parts.agg(F.max("at")).first()[0] or 0
    found = spread(parts).mapInArrow(_fragments(sent), FRAGMENT)
    while most > 0:
        found = found.groupBy("row", F.floor(F.col("at") / FAN).alias("to")).applyInArrow(_joined(sent), FRAGMENT)
        most //= FAN
    return scratch.stored(found, "long")


# All texts: chunks ask, parts answer.


@dataclass(frozen=True)
class Plan:
    """Chunks, and as many parts. A pair's first id is spread over its bits, so that parts are ranges of alike size."""

    parts: int
    bits: int
    width: int

    @classmethod
    def of(cls, docs: DataFrame, size: int, width: int) -> Plan:
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        parts = max(1, min(-(-chars // CHUNK_CHARS), int((chars / 2 / LEAST_ASKED) ** 0.5), size))
        return cls(parts, (size - 1).bit_length(), width)

    def keys(self, pair: np.ndarray) -> np.ndarray:
        first, second = np.divmod(pair, self.width)
        return (first * 40_503 % (1 << self.bits) * self.width + second).astype(np.uint64)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return keys // np.uint64(self.width)

    def slices(self, keys: np.ndarray) -> np.ndarray:
        """Where each part begins and ends in sorted keys."""
        bounds = np.array([(k << self.bits) // self.parts * self.width for k in range(1, self.parts)], np.uint64)
        return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and where each stood; of equal ones the first first. Key and place sort as one number where both fit."""
    bits = max(1, len(keys).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + bits > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


class Chunk:
    """The rows of a chunk: texts aligned here, and fragments of very long ones."""

    def __init__(self, table: pa.Table, tables: Tables, plan: Plan):
        self.n = table.num_rows
        text = table.column("text").combine_chunks().cast(pa.large_string())
        has = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
        has = has.combine_chunks() if isinstance(has, pa.ChunkedArray) else has
        self.short = np.flatnonzero(has.to_numpy(zero_copy_only=False))
        tokens = Tokens.of(text.filter(has), tables)
        self.short = self.short[tokens.valid]
        self.aligned = Aligned.of(tokens)
        doc, pair, times = self.aligned.links(plan.width)
        self.long = [(i, _read(x).whole(tables)) for i, x in enumerate(table.select([c.split()[0] for c in FRAGMENT.split(", ") if c.split()[0] != "doc_id"]).to_pylist()) if x["valid"]]
        self.doc = np.concatenate((self.short[doc], *[np.full(len(x.pairs), i) for i, x in self.long]))
        self.times = np.concatenate((times, *[x.times for _, x in self.long]))
        keys = plan.keys(np.concatenate((pair, *[x.pairs for _, x in self.long])))
        # equal keys stay in order of their documents, of which each so comes together
        keys, order = in_order(keys)
        self.first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        self.keys, self.at = keys[self.first], np.empty(len(keys), np.int64)
        self.at[order] = np.cumsum(self.first) - 1
        self.order = order

    def documents(self) -> np.ndarray:
        """In how many documents each of the keys is linked."""
        doc = self.doc[self.order]
        new = self.first | np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        return np.add.reduceat(new.astype(np.int64), np.flatnonzero(self.first)) if len(doc) else np.zeros(0, np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of values, given for each of the keys, over its links."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.doc, values[self.at] * self.times)
        return out

    def counts(self) -> list[np.ndarray]:
        """Tokens of either vocabulary and groups of each row."""
        t = self.aligned.tokens
        out = [np.zeros(self.n, np.int64) for _ in range(3)]
        for column, ends in zip(out, (t.to_a, t.to_b, self.aligned.to), strict=True):
            column[self.short] = np.diff(ends, prepend=0)
        for i, x in self.long:
            for column, value in zip(out, (x.n_a, x.n_b, x.n_groups), strict=True):
                column[i] = value
        return out

    def digests(self, cells: np.ndarray) -> list[str]:
        out = [""] * self.n
        t = self.aligned.tokens
        text, ends = spelled(t.a, t.b, self.aligned.in_a, self.aligned.in_b, cells)
        ends = ends[self.aligned.to - 1]
        for i, begin, end in zip(self.short.tolist(), np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True):
            out[i] = hashlib.sha256(text[begin : end - 1]).hexdigest()
        for i, x in self.long:
            out[i] = hashlib.sha256(x.groups[:-1]).hexdigest()
        return out


def _asked(sent: Broadcast, plan: Plan):
    kept = []

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        kept[:] = kept or [Tables(sent.value)]
        chunk = Chunk(table, kept[0], plan)
        counts, at = chunk.documents(), plan.slices(chunk.keys)
        ranges = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        columns = [pa.array([differences(chunk.keys[a:b]) for a, b in ranges], pa.binary()), pa.array([packed(counts[a:b]) for a, b in ranges], pa.binary())]
        numbers = [pa.array(range(plan.parts), pa.int32()), pa.array([key[0].as_py()] * plan.parts, pa.int64()), pa.array([b - a for a, b in ranges], pa.int64())]
        return pa.Table.from_arrays([*numbers, *columns], ["part", "chunk", "n", "keys", "documents"])

    return asked


def _answered(plan: Plan):
    def answered(table: pa.Table) -> pa.Table:
        """For each chunk the totals of what it asked, and whether each is the highest of its first id."""
        sizes = table.column("n").to_pylist()
        sent = [unpacked(x, n) for x, n in zip(table.column("documents").to_pylist(), sizes, strict=True)]
        keys, places = np.unique(np.concatenate([summed(x, n) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True) if n] or [np.zeros(0, np.uint64)]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, places, np.concatenate(sent))
        begins = np.flatnonzero(np.diff(plan.first(keys).astype(np.int64), prepend=-1))
        most = np.maximum.reduceat(total, begins) if len(keys) else total
        best = total == np.repeat(most, np.diff(np.append(begins, len(keys))))
        answers = np.split(places, np.cumsum(sizes)[:-1])
        columns = [pa.array([packed(total[p]) for p in answers], pa.binary()), pa.array([np.packbits(best[p]).tobytes() for p in answers], pa.binary())]
        return pa.Table.from_arrays([table.column("part"), table.column("chunk"), *columns], ["part", "chunk", "total", "best"])

    return answered


def _scored(sent: Broadcast, plan: Plan):
    kept = []

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        kept[:] = kept or [Tables(sent.value)]
        chunk = Chunk(left, kept[0], plan)
        right = right.sort_by("part")
        sizes = np.diff(plan.slices(chunk.keys)).tolist()
        total = np.concatenate([unpacked(x, n) for x, n in zip(right.column("total").to_pylist(), sizes, strict=True)])
        best = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(right.column("best").to_pylist(), sizes, strict=True)])
        columns = [*chunk.counts(), chunk.sums(np.ones(len(total), np.int64)), chunk.sums(best.astype(np.int64)), chunk.sums(total)]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.Table.from_arrays([left.column("doc_id"), *[pa.array(c) for c in columns], pa.array(chunk.digests(kept[0].cells), pa.string())], names)

    return scored


def scored(docs: DataFrame, vocabularies: Vocabularies = Vocabularies()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    data = vocabularies.read()
    tables = Tables(data)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent, plan = docs.sparkSession.sparkContext.broadcast(data), Plan.of(docs, tables.first.size, tables.width)
    is_long = F.coalesce(F.octet_length("text") > SECTION_BYTES, F.lit(False))
    columns = [c for c in FRAGMENT.split(", ") if c.split()[0] != "doc_id"]
    with Scratch(docs.sparkSession) as scratch:
        long = long_texts(docs.where(is_long), sent, scratch).withColumn("text", F.lit(None).cast("string"))
        short = docs.where(~is_long).select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns])
        rows = short.unionByName(long).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", "row"), F.lit(plan.parts)))
        asked = rows.groupBy("chunk").applyInArrow(_asked(sent, plan), "part int, chunk long, n long, keys binary, documents binary")
        answered = asked.groupBy("part").applyInArrow(_answered(plan), "part int, chunk long, total binary, best binary")
        out = rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_scored(sent, plan), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return stored(out, "aligned")
