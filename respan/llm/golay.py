"""The binary Golay code [23, 12, 7] as a fuzzy hash.

The code is perfect: every 23-bit word is within 3 bits of exactly one codeword, whose
12 information bits are its index.  A word within 2 bits of its codeword keeps that
codeword when one bit changes.  A word at 3 bits may move to one of 5 others.  So the
words within one bit of each other always share an index if each word takes all indices
to which it, or any word one bit away, decodes: 1 or 6 keys a word.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, INFO = 23, 12
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the cyclic code.
GENERATOR = 0b110001110101


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 12 bits and of the low 11 bits, error pattern of a syndrome."""
    def remainder(word: int) -> int:
        for bit in range(LENGTH - 1, LENGTH - INFO - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - (LENGTH - INFO))
        return word

    bits = [remainder(1 << b) for b in range(LENGTH)]

    def syndrome(word: int) -> int:
        s = 0
        for b in range(LENGTH):
            if word >> b & 1:
                s ^= bits[b]
        return s

    high = np.array([syndrome(w << 11) for w in range(1 << 12)], np.int64)
    low = np.array([syndrome(w) for w in range(1 << 11)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in range(1, 4):
        for at in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in at)
            errors[syndrome(word)] = word
    return high, low, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    high, low, errors = tables()
    words = words.astype(np.int64)
    return (words ^ errors[high[words >> 11] ^ low[words & 0x7FF]]) >> 11


def keys(words: np.ndarray) -> np.ndarray:
    """(count, 6) indices of each word, ascending, -1 where there are fewer."""
    words = words.astype(np.int64)
    around = np.concatenate([words[None], words[None] ^ (1 << np.arange(LENGTH))[:, None]])
    found = np.sort(decode(around).T, axis=1)
    first = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    out = np.full((len(words), 6), -1, np.int64)
    row, col = np.nonzero(first)
    out[row, (np.cumsum(first, axis=1) - 1)[row, col]] = found[row, col]
    return out
