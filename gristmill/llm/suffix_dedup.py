"""Suffix-array dedup of bytes: a byte goes if a string of 100 bytes that covers it starts earlier as well.

Suffixes are ordered through 100 bytes by most-significant-digit passes from the front, eight bytes a digit (see repeats); equal groups are the repeated windows.

Defined cases: a null text is empty; texts shorter than the threshold lose nothing; overlaps count, also within a document; of equal texts the one with
the smallest id stays. Rows equal in id and text count as one document and each get its result; rows with one id and unlike texts are documents of
their own, in order of a hash of the text. A row without doc_id loses nothing. A text of any length is worked on in overlapping parts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import apart, travels
from gristmill.llm.repeats import FOUND_COLUMN, Windows, covered, repeated, with_own_ids, with_repeats

travels(__name__)

BYTES = Windows(threshold=100, gram=36, words=False, middle=8)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column(FOUND_COLUMN).to_pylist(), strict=True):
            text = text or b""
            gone = covered(found, len(text), BYTES.threshold)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if found else text
            spans = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[:1].sum()) if found else 0
            for column, value in zip(out, (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def work(docs: DataFrame) -> DataFrame:
        return with_repeats(docs, repeated(docs, BYTES), _scored, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    return with_own_ids(docs.select("doc_id", "text"), work)


def whole_characters(gone: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of the bytes to remove, those of characters that go whole."""
    first = (text & 0xC0) != 0x80
    character = np.cumsum(first) - 1
    stays = np.bincount(character, weights=~gone) > 0
    return ~stays[character]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keep = [], []
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column(FOUND_COLUMN).to_pylist(), strict=True):
            if found and text:
                data = np.frombuffer(text, np.uint8)
                text = data[~whole_characters(covered(found, len(text), BYTES.threshold), data)].tobytes()
                keep.append(bool(text.strip()))
            else:
                keep.append(True)
            texts.append(text)
        batch = batch.drop_columns([FOUND_COLUMN])
        at = batch.schema.get_field_index("text")
        kind = batch.schema.field(at).type
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(kind)).filter(pa.array(keep, pa.bool_()))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without repeated bytes; characters are cut whole, and a document that loses all its words goes. n_chars follows the text where there is such a column."""

    def work(docs: DataFrame) -> DataFrame:
        order = ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
        return with_repeats(docs, repeated(docs, BYTES), _cleaned, docs.select(*order).schema).select(*docs.columns)

    found = apart(docs, lambda docs: with_own_ids(docs, work))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
