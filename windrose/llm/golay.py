"""The binary Golay code (23, 12): nearby codewords of a 23-bit segment as 12-bit indices.

The code is perfect with radius 3. A segment's keys are the indices of all codewords within distance 4: one
where the nearest codeword is at distance 0 to 2, six where it is at distance 3. Two segments that
differ in at most 2 bits always share a key: a word z between them is within 1 of both and within 3 of
its own codeword, which is therefore within 4 of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
KEYS = 6
_GENERATOR = 0b101011100011
WITHIN = 4


def _remainder(word: int) -> int:
    for shift in range(BITS - 1, 10, -1):
        if word >> shift & 1:
            word ^= _GENERATOR << (shift - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    single = [_remainder(1 << i) for i in range(BITS)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i in range(BITS):
        table, bit = (low, i) if i < 12 else (high, i - 12)
        table[np.flatnonzero(np.arange(len(table)) >> bit & 1)] ^= single[i]
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(WITHIN + 1):
        for bits in combinations(range(BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            patterns[syndrome].append(sum(1 << b for b in bits))
    count = np.array([len(p) for p in patterns], np.int64)
    assert set(count) == {1, KEYS}
    padded = np.array([p + p[:1] * (KEYS - len(p)) for p in patterns], np.int32)
    return low, high, padded, count


_LOW, _HIGH, _PATTERNS, _COUNT = _tables()


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``words``, codeword index) of every key of every 23-bit word."""
    words = words.astype(np.int32)
    syndrome = _LOW[words & 0xFFF] ^ _HIGH[words >> 12]
    count = _COUNT[syndrome]
    at = np.repeat(np.arange(len(words)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return at, (words[at] ^ _PATTERNS[syndrome[at], nth]) >> 11
