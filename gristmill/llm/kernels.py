"""What several operators do to arrays and bytes inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from gristmill.llm.common import travels

travels(__name__)

#: Lower-cases A-Z.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Words whose hashes a task remembers.
REMEMBERED = 500_000


class Words(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
