"""Numpy kernels over the UTF-8 buffers of Arrow string columns: whole texts, a chunk of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, where, what = column.buffers()
    if where is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK, rows: int = 30_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes together; a longer text is a range of its own, never cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n, at + rows)
        yield at, to
        at = to


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from prefix sums of one polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts])


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in small letters, byte for byte."""
    low = _LOWER[data]
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[after]
        low[after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    return low


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of letters, digits and bytes beyond ASCII), and the n + 1 offsets of the documents into them."""
    offsets = offsets - offsets[0] if len(offsets) and offsets[0] else offsets
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct words in small letters as 48-bit hashes, and the n + 1 offsets of the documents into them."""
    starts, ends, of = words(data, offsets)
    hashed = span_hashes(lowered(data), starts, ends) >> np.uint64(16)
    hashed |= np.repeat(np.arange(len(of) - 1, dtype=np.uint64) << np.uint64(48), np.diff(of))
    hashed.sort()
    if len(hashed):
        hashed = hashed[np.concatenate(([True], hashed[1:] != hashed[:-1]))]
    of = np.searchsorted(hashed, np.arange(len(of), dtype=np.uint64) << np.uint64(48))
    return hashed & np.uint64((1 << 48) - 1), of
