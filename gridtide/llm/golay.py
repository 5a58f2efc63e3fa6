"""The binary Golay code of length 23 as a fuzzy hash for 23-bit words.

The code is perfect: every word lies within distance 3 of exactly one codeword.  A word
is given the index of that codeword; a word at distance 3 also gets the five codewords at
distance 4.  Two words that differ in at most one bit then share an index: if the nearest
codeword of one is within 2 of it, it is within 3 of the other and so its nearest as
well; if it is at 3, it is at 2 or 4 from the other, which lists it in either case.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11
MOST = 6  # indices of one word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 upper bits, and for each syndrome the errors to undo (-1: none)."""
    upper = np.zeros(1 << (LENGTH - CHECK), dtype=np.int64)
    for m in range(len(upper)):
        r = m << CHECK
        for bit in range(LENGTH - 1, CHECK - 1, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - CHECK)
        upper[m] = r
    errors = np.full((1 << CHECK, MOST), -1, dtype=np.int64)
    used = np.zeros(1 << CHECK, dtype=np.int64)
    weight = np.zeros(1 << CHECK, dtype=np.int64)
    for w in range(5):
        for bits in combinations(range(LENGTH), w):
            e = sum(1 << b for b in bits)
            s = upper[e >> CHECK] ^ (e & (1 << CHECK) - 1)
            if w < 4 or weight[s] == 3:
                errors[s, used[s]] = e
                used[s] += 1
                weight[s] = min(w, 3)
    return upper, errors


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices (12 bits) of the codewords near each 23-bit word, -1 where fewer."""
    upper, errors = tables()
    words = words.astype(np.int64)
    e = errors[upper[words >> CHECK] ^ (words & (1 << CHECK) - 1)]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> CHECK)
