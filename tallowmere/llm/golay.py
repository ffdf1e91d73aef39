"""The binary Golay code [23, 12, 7], vectorised: codeword indices near a 23-bit word.

The code is perfect: each word lies within 3 bits of exactly one codeword.  A word at distance 3 also
lies at distance 4 from exactly five further ones.  So the index of the nearest codeword, with those
five where the distance is 3, gives one or six keys, and two words that differ in one bit share a key:
if both decode alike, that one; else both are at distance 3 of their own codeword and at 4 of the
other's.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
POLYNOMIAL = 0b101011100011
KEYS = 6


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word modulo the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (POLYNOMIAL << (bit - 11)), r)
    return r


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of at most 3 bits, and the five errors of 4 bits (-1: none)."""
    leader, others = np.full(2048, -1, np.int64), np.full((2048, KEYS - 1), -1, np.int64)
    for weight in range(4):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        leader[_syndrome(errors)] = errors
    fours = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)], np.int64)
    s = _syndrome(fours)
    order = np.argsort(s, kind="stable")
    s, fours = s[order], fours[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    others[s, place] = fours
    return leader, others


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """``len(words)`` x 6 codeword indices of 12 bits; -1 where a word has one key only."""
    leader, others = _tables()
    w = words.astype(np.int64)
    s = _syndrome(w)
    out = np.full((len(w), KEYS), -1, np.int64)
    out[:, 0] = (w ^ leader[s]) >> 11
    far = others[s]
    out[:, 1:] = np.where(far >= 0, (w[:, None] ^ far) >> 11, -1)
    return out
