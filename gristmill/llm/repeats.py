"""Repeated windows of a corpus from its suffixes, ordered only through the tokens of a window.

A window is T consecutive tokens of one document: the suffix that starts there, cut at depth T. Suffixes whose front is not shared repeat nowhere and are
dropped; the others are dealt out by a front they share and put in order there, digit by digit from the front; those equal through T tokens are the
repeated windows.

1. What makes the first pass small: a window's anchor is the suffix within it whose front of k tokens has the smallest hash. Equal windows have equal
   anchors, and neighbouring windows mostly the same one, so a run of neighbours travels as one row with the anchor's front as digit and a hash of the whole
   run. A run whose hash came earlier is repeated as a whole. Runs that share the front but differ are in question; the rest is dropped.
2. The runs in question are dealt out with their tokens, by a front as long as a group needs to fit in memory: the k tokens of the anchor; for a crowded
   front, the part that a few neighbours share; for the most crowded, all T tokens of each window, which are then read through once.
3. A task puts the suffixes of its groups in order by most-significant-digit passes: a pass looks at one digit more, and only where two or more are equal.

Hot fronts: each task first combines its own rows. Of equal runs it sends the first, and remembers those that came twice for what it reads later; a
front with many runs in one task is known to be shared, so the task sends one mark in place of its runs. The runs go on under their document's number;
`run`, which nobody reads of such a row, holds their true digit.

Fronts and runs are compared by two 64-bit hashes of different bases; in step 3 the tokens themselves are compared (of words, their 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import stored, travels
from gristmill.llm.kernels import Words, mixed

travels(__name__)

#: Tokens that are worked on at once in a task.
CHUNK = 1_500_000
#: Runs of one digit that a chunk sends singly; with more it sends a mark.
MANY = 8
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BASE2, INVERSE2 = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
#: Hot runs and digits that a task remembers.
REMEMBERED = 200_000
#: Runs in question of one digit at which its rows are dealt by a longer front, and how many times that for the longest.
CROWDED, LONGEST = 1_000, 16
#: Runs that a task puts in order at once; groups stay whole.
AT_ONCE = 20_000
#: What a row is: a mark, a run to compare, a run known to share its digit, windows known to be repeated, a single window.
MARK, RUN, SHARED, REPEATED, WINDOW = 0, 1, 2, 3, 4
ROW = "digit long, run long, doc long, at long"
#: The run of a mark, which puts it before all others of its digit.
BEFORE = np.iinfo(np.int64).min
#: Column in which texts carry what repeats in them.
FOUND_COLUMN = "__found"


def packed(lo: np.ndarray, n: np.ndarray, o: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Place, number of windows (under 512), distance (under 512) and kind in one long that sorts by place. Of repeated windows `run` holds the number."""
    return lo.astype(np.int64) << 21 | np.where(kind == REPEATED, 0, n).astype(np.int64) << 12 | o.astype(np.int64) << 3 | kind.astype(np.int64)


def unpacked(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at = cols["at"]
    kind = at & 7
    return cols | {"kind": kind, "lo": at >> 21, "n": np.where(kind == REPEATED, cols["run"], at >> 12 & 511), "o": at >> 3 & 511}


@dataclass(frozen=True)
class Windows:
    """T tokens in a window, k in an anchor's front; words or bytes; how many neighbouring windows of a crowded front stay together."""

    threshold: int
    gram: int
    words: bool
    middle: int

    @property
    def wide(self) -> int:
        """The most windows that have one anchor."""
        return self.threshold - self.gram + 1


class Tokens:
    """Texts as 64-bit tokens."""

    def __init__(self, words: bool):
        self.words = words
        self.known = Words()
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def of(self, text: bytes) -> np.ndarray:
        if self.words:
            return self.known.of(text.split())
        return self.table[np.frombuffer(text, np.uint8)]


class Powers:
    def __init__(self, base: int, inverse: int):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for base in (self.base, self.inverse):
                part = np.full(n, base, np.uint64)
                part[0] = 1
                out.append(np.cumprod(part))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


class Prefixes:
    """Hash of any stretch of a token array, from sums of tokens times powers (all modulo 2^64)."""

    def __init__(self, tokens: np.ndarray, powers: Powers):
        self.up, down = powers.to(len(tokens) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * down[:-1])))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start])

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k])


def leftmost_least(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the first smallest value of each w neighbours."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < w:
        by = min(size, w - size)
        later = values[by:] < values[:-by]
        at, values = np.where(later, at[by:], at[:-by]), np.where(later, values[by:], values[:-by])
        size += by
    return at


def chunks(batches: Iterator[pa.RecordBatch], tokens: Tokens) -> Iterator[tuple]:
    """(rows: lists of batch row, tokens: one array, starts, what the tokens stand for: bytes or the tokens again) of about CHUNK tokens; a longer text makes a chunk of its own."""

    def made() -> tuple:
        x = np.concatenate(parts)
        return rows, x, np.cumsum([0] + [len(p) for p in parts]), x if tokens.words else np.frombuffer(b"".join(texts), np.uint8)

    rows, parts, texts, size = [], [], [], 0
    for batch in batches:
        others = {c: batch.column(n).to_pylist() for c, n in (("doc_id", "doc_id"), ("found", FOUND_COLUMN)) if n in batch.schema.names}
        for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
            text = text.as_py() or b""
            part = tokens.of(text)
            if size and size + len(part) > CHUNK:
                yield made()
                rows, parts, texts, size = [], [], [], 0
            rows.append({c: v[i] for c, v in others.items()})
            parts.append(part)
            texts.append(b"" if tokens.words else text)
            size += len(part)
    if rows:
        yield made()


def first_runs(x: np.ndarray, starts: np.ndarray, spec: Windows, powers: tuple[Powers, Powers]) -> tuple:
    """Digit, run hash, place of the first window (in x), number of windows and distance of the gram, of every run in x; a long x goes in overlapping parts."""
    t, k = spec.threshold, spec.gram
    sizes = np.diff(starts)
    out = []
    for begin in range(0, max(len(x) - t + 1, 0), CHUNK):
        part = x[begin : begin + CHUNK + t - 1]
        prefixes = Prefixes(part, powers[0])
        n = len(part) - t + 1
        grams = prefixes.grams(k)
        least = leftmost_least(grams, t - k + 1)[:n]
        # windows that lie within one document
        doc = np.repeat(np.arange(len(sizes)), sizes)[begin : begin + n]
        inside = np.arange(begin, begin + n) + t <= starts[1:][doc]
        new = inside & np.concatenate(([True], ~inside[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(new)
        if not len(first):
            continue
        ends = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True]))) + 1
        whole = Prefixes(part, powers[1]).of(first, ends - 1 + t)
        out.append((grams[least[first]], mixed(whole + (ends - first).astype(np.uint64)), first + begin, ends - first, least[first] - first))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else ()


def later_runs(x: np.ndarray, lo: np.ndarray, n: np.ndarray, o: np.ndarray, step: int, spec: Windows, powers: tuple[Powers, Powers]) -> tuple:
    """The same of runs cut shorter: windows whose distance from the gram is the same number of whole steps stay together."""
    t = spec.threshold
    each = np.repeat(np.arange(len(lo)), n)
    place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    at, far = lo[each] + place, o[each] - place
    part = far // step
    new = np.concatenate(([True], (each[1:] != each[:-1]) | (part[1:] != part[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(each)])))
    gram, steps = at[first] + far[first], part[first]
    a, b = Prefixes(x, powers[0]), Prefixes(x, powers[1])
    # tokens that all windows of the step share
    start = gram - steps * step
    digit = a.of(start, start - step + 1 + t)
    if step == 1:
        run = b.of(start, start + t)
    else:
        run = mixed(b.of(at[first], at[first] + size - 1 + t) + (size + 256 * (far[first] - steps * step)).astype(np.uint64))
    return digit, run, at[first], size, far[first]


class Seen:
    """What a task knows from chunks before: digits that it has marked, and of runs that came twice the first place that it has sent."""

    def __init__(self):
        self.marked = self.runs = np.zeros(0, np.uint64)
        self.doc = self.lo = np.zeros(0, np.int64)

    def before(self, runs: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which runs were sent from an earlier place, and which from this very one."""
        if not len(self.runs):
            return np.zeros(len(runs), bool), np.zeros(len(runs), bool)
        at = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
        known = self.runs[at] == runs
        earlier = (self.doc[at] < doc) | ((self.doc[at] == doc) & (self.lo[at] < lo))
        return known & earlier, known & (self.doc[at] == doc) & (self.lo[at] == lo)

    def add(self, marked: np.ndarray, runs: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> None:
        if len(self.marked) + len(self.runs) > REMEMBERED:
            self.__init__()
        self.marked = np.union1d(self.marked, marked)
        runs, doc, lo = (np.concatenate(c) for c in ((self.runs, runs), (self.doc, doc), (self.lo, lo)))
        order = np.lexsort((lo, doc, runs))
        first = order[np.concatenate(([True], runs[order][1:] != runs[order][:-1]))] if len(order) else order
        self.runs, self.doc, self.lo = runs[first], doc[first], lo[first]


def rows_of(digit, run, doc, lo, n, o, seen: Seen | None, **more: np.ndarray) -> dict[str, np.ndarray]:
    """Rows to send, after a chunk's own repeats are found: columns of ROW, and more. With seen, digits with over MANY runs get a mark."""
    order = np.lexsort((lo, doc, run, digit))
    digit, run, doc, lo, n, o = (c[order] for c in (digit, run, doc, lo, n, o))
    more = {c: v[order] for c, v in more.items()}
    new = np.concatenate(([True], digit[1:] != digit[:-1])) if len(digit) else np.zeros(0, bool)
    unlike = new.copy()
    unlike[1:] |= run[1:] != run[:-1]
    kind = np.where(unlike, RUN, REPEATED)
    group = np.cumsum(new) - 1
    # a document given twice is not its own repeat
    first = np.maximum.accumulate(np.where(unlike, np.arange(len(unlike)), 0))
    same = ~unlike & (doc == doc[first]) & (lo == lo[first])
    marks = np.zeros(0, np.int64)
    if seen is not None and len(digit):
        both = mixed(digit * np.uint64(BASE) + run)
        earlier, again = seen.before(both, doc, lo)
        kind = np.where(unlike & earlier, REPEATED, kind)
        same |= unlike & again
        known = np.isin(digit, seen.marked)
        many = (np.bincount(group, weights=unlike, minlength=1)[group] > MANY) | known
        kind = np.where(many & (kind == RUN), SHARED, kind)
        marks = np.flatnonzero(many & new & ~known)
        twice = np.flatnonzero(unlike & ~earlier & np.append(~unlike[1:], False))
        seen.add(digit[marks], both[twice], doc[twice], lo[twice])
    keep = np.concatenate((np.flatnonzero(~same), marks))
    kind = np.concatenate((kind[~same], np.full(len(marks), MARK)))
    out = {"digit": digit, "run": run, "doc": doc, "lo": lo, "n": n, "o": o} | more
    out = {c: v[keep] for c, v in out.items()}
    true = out["digit"]
    out["digit"] = np.where((kind == SHARED) | (kind == REPEATED), mixed(out["doc"].astype(np.uint64)), out["digit"])
    out["run"] = np.where(kind == MARK, BEFORE, np.where(kind == REPEATED, out["n"], np.where(kind == SHARED, true.view(np.int64), out["run"].view(np.int64))))
    # rows of a document side by side compress better
    order = np.lexsort((out["lo"], out["doc"]))
    return {c: v[order] for c, v in (out | {"kind": kind}).items()}


def batch_of(rows: dict[str, np.ndarray], **more: list) -> Iterator[pa.RecordBatch]:
    columns = [rows["digit"].view(np.int64), rows["run"].view(np.int64), rows["doc"].astype(np.int64), packed(rows["lo"], rows["n"], rows["o"], rows["kind"])]
    for i in range(0, len(columns[0]), 20_000):
        arrays = [pa.array(c[i : i + 20_000]) for c in columns] + [pa.array(c[i : i + 20_000], pa.binary()) for c in more.values()]
        yield pa.RecordBatch.from_arrays(arrays, ["digit", "run", "doc", "at", *more])


def already(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Rows that pass on what is known to be repeated."""
    return {"digit": mixed(doc.astype(np.uint64)), "run": n.astype(np.int64), "doc": doc, "lo": lo, "n": n, "o": np.zeros(len(doc), int), "kind": np.full(len(doc), REPEATED)}


def _first(spec: Windows):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, powers, seen = Tokens(spec.words), (Powers(BASE, INVERSE), Powers(BASE2, INVERSE2)), Seen()
        for rows, x, starts, _ in chunks(batches, tokens):
            if runs := first_runs(x, starts, spec, powers):
                digit, run, lo, n, o = runs
                at = np.searchsorted(starts, lo, "right") - 1
                docs = np.array([r["doc_id"] for r in rows], np.int64)[at]
                yield from batch_of(rows_of(digit, run, docs, lo - starts[at], n, o, seen))

    return first


def runs_merged(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of the maximal runs that some runs cover."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + n)[order])
    first = np.flatnonzero(np.concatenate(([True], at[1:] > end[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], end[last] - at[first]


#: What the first pass leaves, with the digit of a run in question: its front, whatever kind of row brought it.
FOUND = "doc long, lo long, n int, o int, digit long, repeated boolean"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digit, run, document and place: later rows of a run are repeated; the first rows of runs that share a digit are in question."""
    names = ("doc", "lo", "n", "o", "digit")
    held: dict | None = None  # first row of a digit, while no other run of the digit has come
    digit = run = doc = lo = None
    for batch in batches:
        cols = unpacked({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        known = cols["kind"] >= SHARED
        true = cols | {"digit": np.where(cols["kind"] == SHARED, cols["run"], cols["digit"])}
        out = [{c: true[c][known] for c in names} | {"repeated": cols["kind"][known] == REPEATED}]
        cols = {c: v[~known] for c, v in cols.items()}
        if size := len(cols["digit"]):
            d, r = cols["digit"], cols["run"]
            new = np.concatenate(([d[0] != digit], d[1:] != d[:-1]))
            unlike = new | np.concatenate(([r[0] != run or mark], (r[1:] != r[:-1]) | (cols["kind"][:-1] == MARK))) if digit is not None else new | np.concatenate(([True], (r[1:] != r[:-1]) | (cols["kind"][:-1] == MARK)))
            # place of the first row of each row's run; -1 for one of an earlier batch
            first = np.maximum.accumulate(np.where(unlike, np.arange(size), -1))
            first_doc = np.where(first < 0, doc if doc is not None else 0, cols["doc"][first])
            first_lo = np.where(first < 0, lo if lo is not None else 0, cols["lo"][first])
            again = ~unlike & (cols["kind"] == RUN) & ~((cols["doc"] == first_doc) & (cols["lo"] == first_lo))
            out.append({c: cols[c][again] for c in names} | {"repeated": np.ones(again.sum(), bool)})
            # runs in question: first rows of runs whose digit has another run or a mark
            group = np.cumsum(new)
            others = unlike & ~new
            shared = np.bincount(group, weights=others, minlength=group[-1] + 1) > 0
            asked = unlike & (cols["kind"] == RUN) & (others | shared[group])
            if held is not None and (group[0] == 1 or shared[0]):
                if shared[0]:
                    out.append(held)
                held = None
            out.append({c: cols[c][asked] for c in names} | {"repeated": np.zeros(asked.sum(), bool)})
            if group[-1] > 0:
                last = np.flatnonzero(new)[-1]
                held = None
                if not shared[group[-1]] and cols["kind"][last] == RUN:
                    held = {c: cols[c][last : last + 1] for c in names} | {"repeated": np.zeros(1, bool)}
            digit, run, mark = d[-1], r[-1], cols["kind"][-1] == MARK
            doc, lo = first_doc[-1], first_lo[-1]
        got = {c: np.concatenate([x[c] for x in out]) for c in (*names, "repeated")}
        if len(got["doc"]):
            yield pa.RecordBatch.from_arrays([pa.array(got[c].astype(np.int32 if c in ("n", "o") else bool if c == "repeated" else np.int64)) for c in (*names, "repeated")], [*names, "repeated"])


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out by digit, in the order in which a partition reads them through."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "digit").sortWithinPartitions("digit", "run", "doc", "at")


def shared_fronts(texts: DataFrame, spec: Windows) -> DataFrame:
    """FOUND after the first pass."""
    return dealt(texts.select("doc_id", "text").mapInArrow(_first(spec), ROW)).mapInArrow(_compared, FOUND)


def _with_tokens(spec: Windows):
    def with_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ROW and tokens: for each run still in question, under the front (step) it was given."""
        t = spec.threshold
        tokens, powers = Tokens(spec.words), (Powers(BASE, INVERSE), Powers(BASE2, INVERSE2))
        for rows, x, starts, raw in chunks(batches, tokens):
            ids = np.array([r["doc_id"] for r in rows], np.int64)
            asked = []
            for i, r in enumerate(rows):
                lo, n, o, step = (np.array([f[c] for f in r["found"]]) for c in ("lo", "n", "o", "step"))
                if (known := step == 0).any():
                    at, size = runs_merged(lo[known], n[known])
                    yield from batch_of(already(np.full(len(at), r["doc_id"]), at, size), tokens=[None] * len(at))
                if not known.all():
                    asked.append((lo[~known] + starts[i], n[~known], o[~known], step[~known]))
            if not asked:
                continue
            lo, n, o, step = map(np.concatenate, zip(*asked, strict=True))
            for size in (spec.wide, spec.middle, 1):
                if not (own := step == size).any():
                    continue
                if size == spec.wide:
                    at, many, far = lo[own], n[own], o[own]
                    digit = Prefixes(x, powers[0]).of(at + far, at + far + spec.gram)
                    run = mixed(Prefixes(x, powers[1]).of(at, at + many - 1 + t) + (many + 256 * far).astype(np.uint64))
                else:
                    digit, run, at, many, far = later_runs(x, lo[own], n[own], o[own], size, spec, powers)
                row = np.searchsorted(starts, at, "right") - 1
                out = rows_of(digit, run, ids[row], at - starts[row], many, far, None, at=at)
                if size == 1:
                    out["kind"] = np.where(out["kind"] == RUN, WINDOW, out["kind"])
                yield from batch_of(out, tokens=[raw[a : a + m - 1 + t].tobytes() if k == RUN else None for a, m, k in zip(out["at"].tolist(), out["n"].tolist(), out["kind"].tolist(), strict=True)])

    return with_tokens


def sorted_suffixes(digit_of: Callable[[np.ndarray, int], np.ndarray], n: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n suffixes by their digits, and how many digits each shares with the one before. A pass looks at suffixes only whose digits so far another has too."""
    order, shared = np.arange(n), np.full(n, digits)
    starts = np.zeros(n, bool)
    starts[:1], shared[:1] = True, 0
    for d in range(digits):
        among = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if not len(among):
            break
        group, digit = np.cumsum(starts)[among], digit_of(order[among], d)
        by = np.lexsort((digit, group))
        order[among], digit = order[among[by]], digit[by]
        split = among[1:][(group[1:] == group[:-1]) & (digit[1:] != digit[:-1])]
        starts[split], shared[split] = True, d
    return order, shared


def digits_of(data: np.ndarray, at: np.ndarray, spec: Windows) -> tuple[Callable[[np.ndarray, int], np.ndarray], int]:
    """The digits of the suffixes at some places, from the front: a word each, or eight bytes (the last fewer); and their number."""
    if spec.words:
        return lambda i, d: data[at[i] + d], spec.threshold
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    count = -(-spec.threshold // 8)

    def digit(i: np.ndarray, d: int) -> np.ndarray:
        value = np.ascontiguousarray(eight[at[i] + 8 * d]).view(">u8").ravel().astype(np.uint64)
        return value >> np.uint64(8 * max(8 * (d + 1) - spec.threshold, 0))

    return digit, count


def equal_groups(shared: np.ndarray, digits: int) -> np.ndarray:
    """The number of the group of suffixes equal in all digits, for each place in their order."""
    return np.cumsum(shared < digits)


def repeats_of(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, tokens: list[bytes], spec: Windows, grouped: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """doc and place of the suffixes of some runs that are not the first of those equal to them."""
    parts = [np.frombuffer(x, np.uint64 if spec.words else np.uint8) for x in tokens]
    begins = np.cumsum([0] + [len(p) for p in parts[:-1]])
    each = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    digit, digits = digits_of(np.concatenate(parts), begins[each] + place, spec)
    order, shared = sorted_suffixes(digit, len(each), digits)
    group = grouped(shared, digits)
    doc, at = doc[each][order], (lo[each] + place)[order]
    order = np.lexsort((at, doc, group))
    group, doc, at = group[order], doc[order], at[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = ~new & ~((doc == doc[first]) & (at == at[first]))
    return doc[again], at[again]


def _ordered(spec: Windows, grouped: Callable[[np.ndarray, int], np.ndarray]):
    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by digit, run, document and place: doc, lo, n of the repeated windows."""
        names = ("digit", "doc", "lo", "n")

        def made(doc, lo, n) -> Iterator[pa.RecordBatch]:
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int32))], ["doc", "lo", "n"])

        def put_in_order() -> Iterator[pa.RecordBatch]:
            if tokens:
                doc, lo = repeats_of(held["doc"], held["lo"], held["n"], tokens, spec, grouped)
                yield from made(doc, lo, np.ones(len(doc), int))

        held = {c: np.zeros(0, np.int64) for c in names}
        tokens: list[bytes] = []
        window = doc = lo = None
        for batch in batches:
            cols = unpacked({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "tokens"})
            kind = cols["kind"]
            known = kind == REPEATED
            yield from made(cols["doc"][known], cols["lo"][known], cols["n"][known])
            if (own := kind == WINDOW).any():
                d, r, docs, los = cols["digit"][own], cols["run"][own], cols["doc"][own], cols["lo"][own]
                new = np.concatenate(([(d[0], r[0]) != window], (d[1:] != d[:-1]) | (r[1:] != r[:-1])))
                first = np.maximum.accumulate(np.where(new, np.arange(len(d)), -1))
                first_doc = np.where(first < 0, doc if doc is not None else 0, docs[first])
                first_lo = np.where(first < 0, lo if lo is not None else 0, los[first])
                again = ~new & ~((docs == first_doc) & (los == first_lo))
                yield from made(docs[again], los[again], np.ones(again.sum(), int))
                window, doc, lo = (d[-1], r[-1]), first_doc[-1], first_lo[-1]
            if (own := kind == RUN).any():
                held = {c: np.concatenate((held[c], cols[c][own])) for c in names}
                tokens += batch.column("tokens").filter(pa.array(own)).to_pylist()
                if len(tokens) >= AT_ONCE and held["digit"][0] != held["digit"][-1]:
                    # whole groups only; the last may go on
                    cut = int(np.searchsorted(held["digit"], held["digit"][-1]))
                    rest, left = {c: v[cut:] for c, v in held.items()}, tokens[cut:]
                    held, tokens = {c: v[:cut] for c, v in held.items()}, tokens[:cut]
                    yield from put_in_order()
                    held, tokens = rest, left
        yield from put_in_order()

    return ordered


def repeated(docs: DataFrame, spec: Windows, grouped: Callable[[np.ndarray, int], np.ndarray] = equal_groups) -> DataFrame:
    """doc_id and found: the runs of windows (lo, n; each repeats one that starts earlier) of every document that has any.

    Earlier: in a document with a smaller id, or before in the same. Equal rows count as one document; rows without an id take no part.
    grouped tells which neighbours in the order of the suffixes belong together.
    """
    texts = numbered(docs)
    runs = stored(shared_fronts(texts, spec), "runs")
    # stored, so that its size tells how to join it: the runs of a hot front need not meet in one task
    crowded = stored(runs.where("NOT repeated").groupBy("digit").agg(F.count("*").alias("c")).where(F.col("c") > CROWDED), "crowded")
    step = F.when(F.col("repeated"), 0).when(F.col("c").isNull(), spec.wide).when(F.col("c") <= LONGEST * CROWDED, spec.middle).otherwise(1)
    runs = runs.join(crowded, "digit", "left").select("doc", F.struct("lo", "n", "o", step.alias("step")).alias("run"))
    runs = runs.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("run").alias(FOUND_COLUMN))
    # with all columns, like the join that ends a plan, so that both read one exchange
    rows = texts.join(runs, "doc_id").mapInArrow(_with_tokens(spec), f"{ROW}, tokens binary")
    found = dealt(rows).mapInArrow(_ordered(spec, grouped), "doc long, lo long, n int")
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "n")).alias("found"))


def with_own_ids(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs). Where rows with unlike texts repeat a doc_id, work gets numbers in its place: in order of the id, then of a hash of the text; the result has the ids again."""
    known = docs.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return work(docs)
    keys = known.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash")).distinct()
    parts = stored(keys.repartitionByRange("__id", "__hash").withColumn("__part", F.spark_partition_id()), "ids")
    up_to = F.sum("__size").over(Window.orderBy("__part"))  # one row for each range partition
    before = parts.groupBy("__part").agg(F.count("*").alias("__size")).select("__part", (up_to - F.col("__size")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__id", "__hash"))
    numbers = stored(parts.join(before, "__part").select("__id", "__hash", (place + F.col("__before")).cast("long").alias("__number")), "ids")
    rows = docs.join(numbers, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    out = work(stored(rows.withColumn("doc_id", F.col("__number")).select(*docs.columns), "numbered"))
    ids = numbers.select("__id", "__number")
    return out.join(ids, F.col("doc_id") == F.col("__number"), "left").withColumn("doc_id", F.col("__id")).select(*out.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """The one form in which all joins of a plan read the texts, so that they share one exchange."""
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.select("doc_id", *[c for c in docs.columns if c != "doc_id"]).where("doc_id IS NOT NULL")


def with_repeats(docs: DataFrame, found: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(batches) over docs joined with what repeats in them; rows without doc_id come with nothing."""
    joined = numbered(docs).join(found.withColumnRenamed("found", FOUND_COLUMN), "doc_id", "left")
    alone = docs.where("doc_id IS NULL").withColumn("doc_id", F.lit(None).cast("long")).withColumn(FOUND_COLUMN, F.lit(None).cast(joined.schema[FOUND_COLUMN].dataType)).select(*joined.columns)
    return joined.unionByName(alone).mapInArrow(make, schema)


def covered(found: list[dict] | None, size: int, threshold: int) -> np.ndarray:
    """Which of `size` tokens lie in repeated windows."""
    if not found:
        return np.zeros(size, bool)
    lo = np.array([f["lo"] for f in found])
    end = lo + np.array([f["n"] for f in found]) - 1 + threshold
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, lo, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0
