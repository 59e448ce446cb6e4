"""Hashes of words and of runs of words, for whole Arrow batches at once.

Words are maximal runs of bytes other than ASCII white space. A word's hash is a polynomial in random
64-bit byte values modulo 2^64, then mixed; a run's hash is a weighted sum of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
GROUP_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.full(size, base % (1 << 64), np.uint64)
        out[0] = 1
        known = np.multiply.accumulate(out)
        if size <= 4 * SEGMENT:
            _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes: first row, last row + 1, their bytes, and where each row begins."""
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, begins: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each row and the total) of the rows that ``begins`` cuts out of ``data``."""
    table = _LOWER_BYTE if lower else _BYTE
    hashes, starts, ends = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        while hi < len(data):
            gap = np.flatnonzero(_BREAK[data[hi : hi + 4096]])
            if gap.size:
                hi += int(gap[0])
                break
            hi = min(len(data), hi + 4096)
        part = data[lo:hi]
        gap = _BREAK[part]
        opens, shuts = np.ones(len(part), bool), np.ones(len(part), bool)
        opens[1:], shuts[:-1] = gap[:-1], gap[1:]
        cut = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, hi)] - lo
        opens[cut] = True
        shuts[cut[cut > 0] - 1] = True
        start, end = np.flatnonzero(opens & ~gap), np.flatnonzero(shuts & ~gap) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers(_MULTIPLIER, len(part)), out=total[1:])
        h = (total[end] - total[start]) * powers(_INVERSE, len(part) + 1)[start]
        hashes.append(mix(h + (end - start).astype(np.uint64)))
        starts.append(start + lo)
        ends.append(end + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(begins), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, begins)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on, across row borders too; shorter by ``k`` - 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    if k <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += h[j : j + n] * np.uint64(pow(_MULTIPLIER, j + 1, 1 << 64))
        return mix(out)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_MULTIPLIER, len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the first word of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
