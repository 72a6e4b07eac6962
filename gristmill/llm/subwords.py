"""Ids of whole texts by public tokenizers, many texts at a time.

Both vocabularies cut a text before a space that stands between two characters other than white space, whatever is around it: the byte-level pattern never looks
past such a place, and no piece of the other vocabulary has a space behind another character. So texts are split there into units, each distinct unit of a block is encoded once, and the ids are dealt out to
its places. Ids are those that the libraries give for the whole text (tested against them).

The vocabularies' files are read on the driver and sent along; executors need the libraries only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken

from gristmill.llm.common import travels

travels(__name__)

#: White space of either kind of pattern, and what only Python takes for it: texts are cut the less.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: A text in which a space stands at an end or next to white space.
UNEVEN = f"^[{SPACE}]|[{SPACE}]$|[{SPACE}] | [{SPACE}]"
#: The safe places.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
END_OF_TEXT = "<|endoftext|>"


@dataclass(frozen=True)
class Units:
    """Texts as units: the distinct ones, the number of the unit at each place, and where each text's places begin."""

    distinct: pa.Array
    places: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Units:
        """texts without null; an empty text is one empty unit."""
        uneven = pc.match_substring_regex(texts, UNEVEN)
        split = pc.split_pattern(texts, " ")
        if pc.any(uneven).as_py():
            odd = pa.array([BETWEEN.split(x) for x in texts.filter(uneven).to_pylist()], pa.list_(pa.large_string()))
            split = _placed(split, uneven, odd)
        coded = split.flatten().cast(pa.large_string()).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy())))


def _placed(split: pa.Array, uneven: pa.Array, odd: pa.Array) -> pa.Array:
    """split with the lists of odd where uneven."""
    both = pa.concat_arrays([split.cast(odd.type), odd])
    at = np.arange(len(split))
    mask = uneven.to_numpy(zero_copy_only=False)
    at[mask] = len(split) + np.arange(len(odd))
    return both.take(pa.array(at))


def dealt(ids: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all places in order, and where each place's end. ids: of the distinct units; ends: where each unit's end."""
    sizes = np.diff(ends, prepend=0)[places]
    to = np.cumsum(sizes)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(ends[places] - to, sizes)
    return ids[at], to


class BytePairs:
    """A byte-level vocabulary given by ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.size = len(table)
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={END_OF_TEXT: self.size})
        self.spelled = [token for token, _ in sorted(table.items(), key=lambda x: x[1])]
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)

    def spaced(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit with a space in front, and where each unit's end."""
        # a unit with white space at its end would run into the next one
        alone = pc.or_(pc.equal(units, ""), pc.match_substring_regex(units, f"[{SPACE}]$"))
        order = pa.array(np.argsort(alone.to_numpy(zero_copy_only=False), kind="stable"))
        n = len(units) - (pc.sum(alone).as_py() or 0)
        units = units.take(order)
        even, rest = units[:n], units[n:].to_pylist()
        ids = np.array(self.coder.encode_ordinary(" " + " ".join(even.to_pylist())) if n else [], np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(even).to_numpy().astype(np.int64) + 1)) + 1
        if not rest:
            return ids, ends
        more = [self.coder.encode_ordinary(" " + x) for x in rest]
        ids, ends = np.concatenate((ids, np.array(list(chain(*more)), np.int64))), np.append(ends, len(ids) + np.cumsum([len(x) for x in more]))
        back = np.argsort(order.to_numpy())
        return dealt(ids, ends, back)

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of whole texts; the end-of-text mark in a text is its id."""
        return [np.array(self.coder.encode(x, allowed_special="all"), np.uint32) for x in texts]


class Pieces:
    """A vocabulary of pieces with byte fallback."""

    def __init__(self, model: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.coder.get_piece_size()
        self.spelled = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.coder.id_to_piece, range(self.size)))]
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.letters, self.ends = np.frombuffer(b"".join(self.spelled), np.uint8), np.cumsum(self.sizes)

    def spaced(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit, to which the coder adds a space in front, and where each unit's end."""
        found = self.coder.encode(units.to_pylist(), num_threads=1)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.int64, int(ends[-1]) if len(ends) else 0), ends


@dataclass(frozen=True)
class Vocabularies:
    """Names of public files, or paths that the driver can open."""

    byte_pairs: str = "byte_bpe_50k.tiktoken"
    pieces: str = "piece_bpe_32k.model"

    def read(self) -> tuple[bytes, str, bytes]:
        """What the tasks need: ranks, pattern, model."""
        import public_tokenizers

        data = []
        for name in (self.byte_pairs, self.pieces):
            with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
                data.append(file.read())
        return data[0], public_tokenizers.PATTERN, data[1]
