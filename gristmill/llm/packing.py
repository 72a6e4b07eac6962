"""Best-fit packing of token sequences by the sum of squares.

Texts become token ids, an end mark included. A longer one than a sequence is cut into full pieces, which are sequences of their own, after a first piece that
holds what is over. All other pieces are packed: dealt into blocks, taken from the longest on, and each put where the sum over all gaps of the squared number of open sequences with
that gap becomes smallest. Among equal choices the fullest sequence takes it; a new one is begun only where none has room (begun whenever that makes the sum smaller, sequences
were 0.5 % over the least possible on whole tables; so they are the least, or one more a block).

A block is as many pieces as a task packs (BLOCK), whatever the corpus; sequences that stay open at its end cost one in thousands. Only numbers and lengths of
pieces are dealt out, the texts are read once where they lie. A block is chosen by a hash of the row's number, so one source, id or text that is everywhere is everywhere in the blocks.

Defined cases: a null or empty text is its end mark alone; rows that repeat an id or a text are documents of their own; a row without id is packed like any other; the end mark's own spelling
in a text is its id, as the tokenizers library has it; a text of any length is cut, never dropped; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, stored, travels
from gristmill.llm.subwords import END_OF_TEXT, BytePairs, Units, Vocabularies, dealt

travels(__name__)

#: Pieces that one task packs.
BLOCK = 40_000
#: Bytes of text that a task encodes together.
ENCODED_BYTES = 8_000_000
NEVER = np.int64(1) << np.int64(60)


@dataclass(frozen=True)
class Packing:
    #: Tokens that a sequence holds at most.
    room: int = 2048
    #: The id after each text.
    end: int = 0
    vocabularies: Vocabularies = Vocabularies()


def packed_sizes(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, from the longest on; sequences are numbered from 0."""
    count = np.zeros(room + 1, np.int64)  # open sequences by gap
    bins: list[list[int]] = [[] for _ in range(room + 1)]
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    made = 0
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        # by gap from size on: a sequence leaves its gap and joins a smaller one; one that becomes full joins none
        joins = count[: room + 1 - size].copy()
        joins[0] = 0
        change = np.where(count[size:] > 0, 2 * (joins - count[size:]) + 1 + (np.arange(len(joins)) > 0), NEVER)
        gap = size + int(change.argmin())
        if change[gap - size] < NEVER:
            chosen = bins[gap].pop()
            count[gap] -= 1
        else:
            chosen, gap, made = made, room, made + 1
        sequence[at], offset[at] = chosen, room - gap
        if gap > size:
            bins[gap - size].append(chosen)
            count[gap - size] += 1
    return sequence, offset


def cuts(n: int, room: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens."""
    first = n if n <= room else n % room or room
    return [(0, first), *((at, room) for at in range(first, n, room))]


def _ids(batches: Iterator[pa.RecordBatch], coder: BytePairs, end: int) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """Each row's id, and the ids of its text with the end mark."""
    mark = np.array([end], np.uint32)
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy()) // ENCODED_BYTES
        for k in np.unique(sizes).tolist():
            some = pa.array(sizes == k)
            doc, part = batch.column("doc_id").filter(some), texts.filter(some)
            special = pc.match_substring(part, END_OF_TEXT)
            for d, ids in zip(doc.filter(special), coder.whole(part.filter(special).to_pylist()), strict=True):
                yield d, np.concatenate((ids, mark))
            doc, part = doc.filter(pc.invert(special)), part.filter(pc.invert(special))
            units = Units.of(part)
            first = units.places[units.starts[:-1]]
            begins, begin = np.unique(first, return_inverse=True)
            begins = coder.whole(units.distinct.take(pa.array(begins)).to_pylist())  # the first unit of a text has no space in front
            ids, ends = dealt(*coder.spaced(units.distinct), units.places)
            ids, ends = ids.astype(np.uint32), np.append(0, ends)
            for i, d in enumerate(doc):
                yield d, np.concatenate((begins[begin[i]], ids[ends[units.starts[i] + 1] : ends[units.starts[i + 1]]], mark))


def _pieces(sent: Broadcast, spec: Packing, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs(*sent.value[:2])
        for batch in batches:
            rows = []
            for doc, ids in _ids(iter([batch]), coder, spec.end):
                for piece, (start, size) in enumerate(cuts(len(ids), spec.room)):
                    part = ids[start : start + size]
                    rows.append((doc.as_py(), piece, start, size, zlib.crc32(part.astype("<u4").tobytes()), part.tolist() if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], names[: 5 + with_ids])

    return pieces


def pieces(docs: DataFrame, spec: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with_ids: and ids."""
    sent = docs.sparkSession.sparkContext.broadcast(spec.vocabularies.read())
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(sent, spec, with_ids), kinds)


def _block(room: int):
    def block(table: pa.Table) -> pa.Table:
        # in an order of its own, whatever the order in which rows arrive
        table = table.sort_by("row")
        sequence, offset = packed_sizes(table.column("length").to_numpy(), room)
        number = table.column("block").to_numpy().astype(np.int64) << 32 | sequence
        return pa.Table.from_arrays([table.column("row"), pa.array(number), pa.array(offset)], ["row", "sequence_id", "offset"])

    return block


def placed(rows: DataFrame, room: int) -> DataFrame:
    """rows (row, unique, and length up to room) with sequence_id and offset, of every row that does not fill a sequence."""
    rows = rows.where(F.col("length") < room).select("row", "length")
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt_out = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt_out.groupBy("block").applyInArrow(_block(room), "row long, sequence_id long, offset long")


def packed(docs: DataFrame, spec: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """The pieces of every document with sequence_id and offset."""
    with Scratch(docs.sparkSession) as scratch:
        # numbered where they lie, then stored: numbers stay
        rows = scratch.stored(pieces(docs, spec, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
        places = placed(rows, spec.room)
        # what fills a sequence is one by itself, numbered below 0
        numbers = {"sequence_id": F.coalesce("sequence_id", -1 - F.col("row")), "offset": F.coalesce("offset", F.lit(0).cast("long"))}
        return stored(rows.join(places, "row", "left").withColumns(numbers).drop("row"), "packed")


def sequences(docs: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """sequence_id, ids and spans (doc_id, piece, offset, length) of every sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))  # as many as a sequence has tokens, at most
    found = packed(docs, spec, with_ids=True).groupBy("sequence_id").agg(parts.alias("parts"))
    spans = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return found.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), spans.alias("spans"))
