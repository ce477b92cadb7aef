"""The perfect binary Golay code of length 23 as a fuzzy hash of short bit strings."""

from __future__ import annotations

import functools

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
LENGTH, DIMENSION = 23, 12


@functools.cache
def codewords() -> np.ndarray:
    """All 4096 codewords; a codeword's index is the message it carries."""
    words = np.zeros(1 << DIMENSION, np.int64)
    for bit in range(DIMENSION):
        words ^= np.where(np.arange(1 << DIMENSION) >> bit & 1, GENERATOR << bit, 0)
    return words


@functools.cache
def keys(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, near) for every string of ``bits`` bits, padded with zeros to the code's length.

    nearest[s]: the index of the one codeword within 3 of s. near[s, :6]: that index, and if it is 3 away also the
    five codewords that are 4 away; unused places hold -1. If s and t differ in at most one bit, nearest[s] is among
    near[t]: that codeword is within 4 of t, and a codeword 4 away exists only where the nearest is 3 away.
    """
    words, size = codewords(), 1 << bits
    nearest, near = np.empty(size, np.int16), np.full((size, 6), -1, np.int16)
    for lo in range(0, size, 1024):
        s = np.arange(lo, min(lo + 1024, size))
        d = np.bitwise_count(s[:, None] ^ words[None, :])
        nearest[s] = d.argmin(1)
        near[s, 0] = nearest[s]
        row, word = np.nonzero((d == 4) & (d.min(1) == 3)[:, None])
        place = np.arange(len(row)) - np.searchsorted(row, row) + 1
        near[s[row], place] = word
    return nearest, near
