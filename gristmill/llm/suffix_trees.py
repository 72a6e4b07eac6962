"""Substring dedup of words with prefix-partitioned suffix trees: a word goes if a window of 20 words that covers it starts earlier as well.

1. Suffixes that share no prefix with another are dropped by a first pass over prefixes of eight words (see repeats).
2. The suffixes that are left are dealt out by prefixes of variable length, as long as needed for a group to fit in memory: the eight words alone, 17 words
   for a prefix with many suffixes, all 20 words for one with very many.
3. Each group's subtree is built from its suffixes in order and the words that neighbours share: internal nodes, with their depth and their first and
   last leaf. All but the earliest leaf of a node of depth 20 or more are repeats. A group with 20-word prefixes is a single node, read through once.

Defined cases: a null text has no words; texts under 20 words lose nothing; overlaps count, also within a document; of equal texts the one with the
smallest id stays. Rows equal in id and text count as one document and each get its result; rows with one id and unlike texts are documents of their
own, in order of a hash of the text. A row without doc_id loses nothing. A text of any length is worked on in overlapping parts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import travels
from gristmill.llm.repeats import FOUND_COLUMN, Windows, covered, repeated, with_own_ids, with_repeats

travels(__name__)

WORDS = Windows(threshold=20, gram=8, words=True, middle=4)


def internal_nodes(shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of depth `least` or more of the tree of some suffixes in order, of which each shares so many words with the one before."""
    nodes, open_nodes = [], []
    for leaf, depth in enumerate([*shared.tolist(), 0]):
        first = leaf - 1
        while open_nodes and open_nodes[-1][0] > depth:
            deep, first = open_nodes.pop()
            nodes.append((deep, first, leaf - 1))
        if depth >= least and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, first))
    return nodes


def under_deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for each leaf: that of the node of full depth it hangs under, or its own."""
    group = np.arange(len(shared))
    # a leaf that shares all words with neither neighbour hangs under no such node
    near = np.flatnonzero((shared >= depth) | (np.append(shared[1:], 0) >= depth))
    for _, first, last in internal_nodes(shared[near], depth):
        group[near[first : last + 1]] = near[first]
    return group


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], []]
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column(FOUND_COLUMN).to_pylist(), strict=True):
            words = (text or b"").split()
            gone = covered(found, len(words), WORDS.threshold)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
            for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:2]], pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def work(docs: DataFrame) -> DataFrame:
        return with_repeats(docs, repeated(docs, WORDS, under_deep_nodes), _scored, "doc_id long, n_words long, n_removed long, kept_sha256 string")

    return with_own_ids(docs.select("doc_id", "text"), work)
