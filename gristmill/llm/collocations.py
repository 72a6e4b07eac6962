"""Phrase collocation mining: counts of all phrases of up to four words from one count of padded windows.

1. A window is a word with up to three words that follow it in its piece: four lead columns, padded at the end of the piece. Windows alone are counted.
2. ROLLUP over the columns sums windows with a common front, so each front's sum is the count of the phrase it spells: of one to four words, and with no word
   of all words of the lang. No shorter phrase is ever exploded.
3. Phrases that occur often enough are cut in every place, scored by their rarest cut, dropped if a longer phrase nearly always holds them, and ranked.

Windows are cut short where they cannot matter. Two passes before count hashes, of words and neighbours, and of three words whose neighbours are frequent; the frequent ones set bits
of a map of fixed size (MAP_BITS), which goes to all tasks. A window ends, padded, where it would hold what is surely too rare, and a word that is in no frequent pair is a window
of no words: no phrase that is counted holds it. Hashes that share a bit only leave a window longer than it need be, so all counts are exact; a corpus with more frequent phrases than
bits has longer windows, not other results.

Ranks come from ranges: phrases are dealt out by range of (lang, score, a, phrase), ranked within, and moved up by the rows of the ranges before. No task holds a lang.

Defined cases: a null or empty text has no words; a null lang is `und`; a text of any length, equal rows and rows of one id count as they stand, as no id is read; words are
compared by bytes; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, stored, travels
from gristmill.llm.kernels import mixed

travels(__name__)

LONGEST = 4
#: Stands alone for the end of a piece, which no word holds.
BREAK = b"\n"
#: Lower-cases A-Z, puts the break for what ends a piece and a space for what stands between words.
TABLE = bytes(0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Bytes of text that a task looks at together.
BLOCK_BYTES = 1_500_000
#: Bits of the map of frequent words and neighbours: 16 MB whatever the corpus.
MAP_BITS = 27
#: Bits of a hash beyond those that number the words of the corpus.
SPARE_BITS = 8


@dataclass(frozen=True)
class Collocations:
    #: Occurrences that a candidate has at least.
    least: int = 30
    #: A phrase goes if a longer one that holds it has this share, in percent, of its count.
    held: int = 80
    #: Phrases a lang.
    most: int = 2000


@dataclass(frozen=True)
class Tokens:
    """The distinct words of some texts, and the number of the word at each place; -1 at the end of a piece."""

    words: pa.Array
    places: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        spaced = BREAK.join([*texts, b""]).translate(TABLE).replace(BREAK, b" \n ")
        coded = pc.split_pattern(pa.array([spaced], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy()
        number = np.full(len(words), -1, np.int32)
        is_word = pc.invert(pc.is_in(words, pa.array(["", "\n"], words.type)))
        some = is_word.to_numpy(zero_copy_only=False)
        number[some] = np.arange(int(some.sum()))
        places = places[places != pc.index(words, pa.scalar("", words.type)).as_py()]
        return cls(words.filter(is_word), number[places])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Tokens]]:
    """A lang, and the words of some of its texts."""
    block, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            block[lang].append(text.as_py() or b"")
            size += len(block[lang][-1])
            if size >= BLOCK_BYTES:
                yield from ((k, Tokens.of(v)) for k, v in block.items())
                block, size = defaultdict(list), 0
    yield from ((k, Tokens.of(v)) for k, v in block.items())


class Places:
    """The words of a block by hash, and what is known of the phrases that begin at each place."""

    def __init__(self, found: Tokens, lang: str, bits: int):
        distinct = np.array([xxhash.xxh3_64_intdigest(w) for w in found.words.cast(pa.large_binary()).to_pylist()] + [0], np.uint64)
        hashes = distinct[found.places]
        self.word = found.places >= 0
        self.keys = [mixed(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang)))]
        for k in range(1, LONGEST - 1):  # of the phrases of one to three words
            self.keys.append(mixed(self.keys[-1] + np.append(hashes[k:], hashes[:k])))
        self.keys.append(mixed(~self.keys[0]))
        *self.keys, self.paired = (x >> np.uint64(64 - bits) for x in self.keys)

    def long(self, map: np.ndarray, bits: int, size: int) -> list[np.ndarray]:
        """For one to `size` words: whether such a phrase begins at a place, and may occur often enough as far as the map tells of phrases of up to three words."""
        out = [self.word & often(map, self.keys[0], bits)]
        for k in range(1, size):
            out.append(out[-1] & np.append(out[-1][1:], False))
            if k < len(self.keys):
                out[-1][out[-1]] &= often(map, self.keys[k][out[-1]], bits)
        return out


def often(map: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    place = (keys >> np.uint64(bits - MAP_BITS)).astype(np.int64)
    return (map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _keyed(bits: int, least: int, sent: Broadcast | None = None):
    """Counts of words and neighbours; or, where a map of these is known, of three words that may matter, and the words of frequent neighbours."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _blocks(batches):
            at = Places(found, lang, bits)
            if sent:
                pairs = at.long(sent.value, bits, 2)[1]
                keys = at.keys[2][pairs & np.append(pairs[1:], False)]
            else:
                keys = np.concatenate((at.keys[0][at.word], at.keys[1][at.word & np.append(at.word[1:], False)]))
            keys, counts = np.unique(keys, return_counts=True)
            if sent:
                # the words of frequent neighbours, which are as frequent
                words_of = np.unique(at.paired[pairs | np.append(False, pairs[:-1])], return_counts=True)[0]
                keys, counts = np.concatenate((keys, words_of)), np.concatenate((counts, np.full(len(words_of), least)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["key", "n"])

    return keyed


def frequent_map(docs: DataFrame, least: int) -> tuple[Broadcast, int]:
    """A bit for each hash of one to three words that occur often enough, in all tasks; and the bits of a hash."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bits = max(MAP_BITS, min(63, chars.bit_length() + SPARE_BITS))
    place = F.shiftrightunsigned("key", bits - MAP_BITS)
    map = np.zeros(1 << (MAP_BITS - 6), np.int64)
    sent = None
    for _ in range(2):
        often = docs.mapInArrow(_keyed(bits, least, sent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        slots = often.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {bits - MAP_BITS}) & 63 as int))")).alias("set")).toArrow()
        map[slots.column("slot").to_numpy()] |= slots.column("set").to_numpy()
        if sent:
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(map.view(np.uint8))
    return sent, bits


def _windows(sent: Broadcast, bits: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct window of some texts; Spark adds up a task's before it sends them."""
        for lang, found in _blocks(batches):
            yield block(lang, found)

    def block(lang: str, found: Tokens) -> pa.RecordBatch:
        at = Places(found, lang, bits)
        longs = at.long(sent.value, bits, LONGEST)
        # a word that is in no frequent phrase is counted in none
        n_words, places = int(at.word.sum()), np.flatnonzero(longs[0] & often(sent.value, at.paired, bits))
        del at
        number = np.zeros(len(longs[0]) + LONGEST, np.int64)  # 0 is padding
        number[places] = found.places[places] + 1
        row = [number[places]]
        for k in range(1, LONGEST):
            row.append(np.where(longs[k][places] & (row[-1] > 0), number[places + k], 0))
        # two numbers to a key, then two keys to a number: exact
        (fronts, front), (backs, back) = (np.unique(row[k] << 32 | row[k + 1], return_inverse=True) for k in (0, 2))
        window, counts = np.unique(front << 32 | back, return_counts=True)
        low = 0xFFFFFFFF
        front, back = fronts[window >> 32], backs[window & low]
        spelled = pa.concat_arrays([pa.array([""], found.words.type), found.words])
        columns = [spelled.take(pa.array(np.append(x, 0))) for x in (front >> 32, front & low, back >> 32, back & low)]
        # padding goes as it stands at the end; last, the words that matter to no phrase: windows of no words
        spelled = pc.ascii_rtrim(pc.binary_join_element_wise(*columns, pa.scalar(" ", found.words.type)), " ").cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * (len(counts) + 1)), spelled, pa.array(np.append(counts, n_words - len(places)))], ["lang", "window", "n"])

    return windows


def phrases(docs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size, f of every phrase of two to four words that occurs at least `least` times, and of the words in them; and with size 0 all words of each lang."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    sent, bits = frequent_map(docs, least)
    w = [f"w{i}" for i in range(LONGEST)]
    windows = docs.mapInArrow(_windows(sent, bits), "lang string, window string, n long")
    # equal windows first, so that fronts are summed of few rows; null is summed over, an empty word is padding
    windows = windows.groupBy("lang", "window").agg(F.sum("n").alias("n"))
    lead = [F.coalesce(F.get(F.split("window", " "), F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(w)]
    sums = windows.select("lang", *lead, "n").rollup("lang", *w).agg(F.sum("n").alias("f")).where("lang IS NOT NULL")
    size = sum((F.col(c).isNotNull().cast("int") for c in w), F.lit(0))
    last = F.coalesce(*[F.col(c) for c in reversed(w)])
    return sums.where((size == 0) | (last != "") & (F.col("f") >= least)).select("lang", F.concat_ws(" ", *w).alias("phrase"), size.alias("size"), "f")


def scores(found: DataFrame, spec: Collocations) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one holds."""
    candidates = found.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    count = found.where("size >= 1")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    spell = lambda start, size: F.concat_ws(" ", F.slice("words", start, size))
    cut = cut.select("lang", "phrase", "a", "k", spell(F.lit(1), F.col("k")).alias("first"), spell(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = cut.join(count.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(count.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as long)")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("size >= 3").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "a", "words", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("at"))
    longest = inner.groupBy("lang", spell(F.col("at"), F.col("n")).alias("phrase")).agg(F.max("a").alias("longer"))
    held = F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * spec.held
    return best.join(longest, ["lang", "phrase"], "left").where(~held).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(scored: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """The first rows of each lang, with rank."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = scratch.stored(scored.repartitionByRange(F.col("lang").asc(), *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("lang", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")  # a row for each range
    near = sizes.withColumn("before", before).where(F.col("before") < most).drop("size")
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)) + F.col("before")
    return parts.join(near, ["lang", "part"]).withColumn("rank", rank).where(F.col("rank") <= most).drop("part", "before")


def mined(docs: DataFrame, spec: Collocations = Collocations()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases."""
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.stored(phrases(docs, spec.least), "phrases")
        best = ranked(scratch.stored(scores(found, spec), "scores"), spec.most, scratch)
        words = found.where("size = 0").select("lang", F.col("f").alias("n"))
        out = best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return stored(out, "collocations")
