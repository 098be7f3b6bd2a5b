"""Binary Golay code [23, 12, 7]: nearest-codeword index of every 23-bit word.

The code is perfect: each word lies within 3 bits of exactly one codeword.
Two words at most 2 bits apart have a word at most 1 bit from both, and that
word's codeword is in the index set of each; so equal indices find them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


@lru_cache(maxsize=1)
def table() -> np.ndarray:
    """int16[2^23]: the 12-bit message of the codeword nearest to each word."""
    words = np.zeros(4096, dtype=np.int32)
    for bit in range(12):
        words ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0).astype(np.int32)
    near = np.empty(1 << BITS, dtype=np.int16)
    message = np.arange(4096, dtype=np.int16)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            near[words ^ sum(1 << p for p in places)] = message
    return near


def index_sets(words: np.ndarray) -> np.ndarray:
    """int16[n, 24]: indices of each word and of its 23 one-bit neighbours (repeats stay)."""
    near = table()
    flips = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.int32)
    return near[words.astype(np.int32)[:, None] ^ flips[None, :]]
