"""License scans by conditional compression.

1. Candidate blocks: a template of n words is looked for in every window of somewhat over n words of every whole text. A window is a candidate if most of
   its words are the template's and most of the template's words are in it, so that no list of cue words decides. Of overlapping windows the fullest counts; a block is what an alignment
   with the template covers.
2. Each block is compressed plainly and with each template found there as a raw zstandard dictionary; templates are ranked by the bytes they save.
3. In that order they are confirmed by the wording: words of the template that the block lacks and words of the block that the template lacks, from an
   alignment of the two. A confirmed template takes the block; blocks that overlap a better one go. Words with a digit, such as versions, must all be there.

All templates that reach a block are compared; a text that holds several licenses gets a row for each. Templates are a parameter and small by contract.

Defined cases: null and empty texts have no blocks; ties in savings go to the template with fewer differences, then to the first in the list; equal rows
are each judged; a text of any length is scanned in one pass, in time in proportion to its words; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import travels
from gristmill.llm.license_texts import templates

travels(__name__)

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Blocks whose savings a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class LicenseScan:
    templates: tuple[tuple[str, str], ...] = field(default_factory=lambda: tuple(templates()))
    #: Share of a template's words that a candidate block has at least.
    near: float = 0.7
    #: Share of a template's words that a confirmed block may lack, and may have besides.
    differ: float = 0.1
    level: int = 3


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def aligned(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]]:
    """First aligned word and the one after the last, words of the template that lack between them, and words besides."""
    same = difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks()
    first, last = same[0].b, same[-2].b + same[-2].size if len(same) > 1 else same[0].b
    held, used = set(), set()
    for a, b, n in same:
        held.update(range(a, a + n))
        used.update(range(b, b + n))
    return first, last, [w for i, w in enumerate(template) if i not in held], [words[i] for i in range(first, last) if i not in used]


class Scanner:
    def __init__(self, scan: LicenseScan):
        self.scan = scan
        self.words = [words_of(text) for _, text in scan.templates]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.member = np.zeros((len(self.words), len(self.ids) + 1), bool)
        for t, ws in enumerate(self.words):
            self.member[t, [self.ids[w] for w in ws]] = True
        self.need = np.array([max(1, -int(-scan.near * len(ws) // 1)) for ws in self.words])
        self.plain = zstandard.ZstdCompressor(level=scan.level, write_content_size=False)
        self.by_template = [
            zstandard.ZstdCompressor(level=scan.level, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            for _, text in scan.templates
        ]
        self.saved: dict[tuple[int, str], float] = {}

    def saving(self, t: int, block: str) -> tuple[int, float]:
        """Compressed bytes that a template saves, and their share."""
        if (t, block) not in self.saved:
            if len(self.saved) > REMEMBERED:
                self.saved.clear()
            data = block.encode()
            alone = len(self.plain.compress(data))
            less = alone - len(self.by_template[t].compress(data))
            self.saved[t, block] = less, less / alone
        return self.saved[t, block]

    def candidates(self, t: int, words: list[str], ids: np.ndarray, begin: int, end: int) -> Iterator[tuple]:
        """(template, first word, word after the last, missing, extra) of the windows between two places in which most words are the template's; the fullest of those that overlap, cut by alignment."""
        here = self.member[t][ids[begin:end]]
        if here.sum() < self.need[t]:
            return
        size, counts = len(self.words[t]) + len(self.words[t]) // 5, np.concatenate(([0], np.cumsum(here)))
        full = counts[np.minimum(np.arange(len(here)) + size, len(here))] - counts[:-1]
        starts = np.flatnonzero(full >= self.need[t])
        at = 0
        while (k := int(np.searchsorted(starts, at))) < len(starts):
            start = int(starts[k])
            rivals = starts[k : np.searchsorted(starts, start + size)]
            best = int(rivals[full[rivals].argmax()])
            first, last, missing, extra = aligned(self.words[t], words[begin + best : min(begin + best + size, end)])
            # what stands before the fullest window may hold the template too
            yield from self.candidates(t, words, ids, begin + start, begin + best + first)
            if len(self.words[t]) - len(missing) >= self.need[t]:
                yield t, begin + best + first, begin + best + last, missing, extra
            # a block that is not exact may reach into one that begins soon after
            at = best + (max(1, len(self.words[t]) // 8) if missing or extra else last)

    def found(self, text: str) -> list[tuple]:
        """line, block, license, saved, missing, extra, confirmed of each block of a text, in order."""
        words = words_of(text)
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int64, len(words))
        # templates of which enough words occur at all
        enough = self.member @ np.bincount(ids, minlength=self.member.shape[1]) >= self.need
        near = [x for t in np.flatnonzero(enough).tolist() for x in self.candidates(t, words, ids, 0, len(words))]
        if not near:
            return []
        low = text.lower()
        # lower case may change the length of a text; then places are those in the lower-cased one
        spans = [m.span() for m in WORD.finditer(low)]
        text = text if len(text) == len(low) else low
        judged = []
        for t, first, last, missing, extra in near:
            block = text[spans[first][0] : spans[last - 1][1]]
            most = int(self.scan.differ * len(self.words[t]))
            confirmed = len(missing) <= most and len(extra) <= most and not any(c.isdigit() for w in missing for c in w)
            less, share = self.saving(t, block)
            judged.append(((not confirmed, -less, len(missing) + len(extra), t), first, last, (block, self.scan.templates[t][0], share, missing, extra, confirmed)))
        out, taken = [], np.zeros(len(words), bool)
        for _, first, last, row in sorted(judged, key=lambda x: x[0]):
            if not taken[first:last].any():
                taken[first:last] = True
                out.append((text.count("\n", 0, spans[first][0]), first, *row))
        return [(line, *row) for line, _, *row in sorted(out, key=lambda x: x[1])]


SCHEMA = "doc_id long, line int, block string, license string, saved double, missing_words array<string>, extra_words array<string>, confirmed boolean"


def _scanned(scan: LicenseScan):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(scan)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_())
        names = ("doc_id", "line", "block", "license", "saved", "missing_words", "extra_words", "confirmed")
        for batch in batches:
            rows = [(doc, *row) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for row in scanner.found(text.as_py() or "")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return scanned


def scanned(docs: DataFrame, scan: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, line (from 0), block, license, saved (share of the block's compressed bytes), missing_words, extra_words, confirmed of every block that is near a template."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned(scan), SCHEMA)
