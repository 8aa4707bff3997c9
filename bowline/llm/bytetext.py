"""Vectorised words over Arrow string columns.

Texts stay one UTF-8 buffer with row offsets, as Arrow holds them; words,
word hashes and word n-gram hashes are NumPy passes over that buffer, so the
cost per row is that of its bytes. ``slices`` bounds the working memory: rows
are taken in runs of about ``SLICE_BYTES``, a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (an odd base has an inverse)."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, 2 * len(held[0]) if held is not None else 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = (np.full(size, b, np.uint64) for b in (base, inverse))
        up[0] = down[0] = 1
        held = _powers[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return held[0][:n], held[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of rows up to ``limit`` bytes."""
    raw, offs = buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, raw[offs[row]:offs[stop]], offs[row:stop + 1] - offs[row]
        row = stop


@dataclass
class Words:
    """The words of a run of rows, in order: byte ranges, hashes, first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(rows) + 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(low: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes with ``is_word``; a word never crosses a row."""
    n = len(low)
    inside = np.zeros(n + 1, np.bool_)
    inside[:n] = is_word[low]
    before = np.zeros(n + 1, np.bool_)
    before[1:] = inside[:n]
    cut = offs[:-1][offs[:-1] < n]
    begins, ends = inside & ~before, before & ~inside
    begins[cut] = inside[cut]
    ends[cut] = before[cut]
    if n:
        ends[0] = False
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = powers(BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(start, end, h, np.searchsorted(start, offs))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; the caller keeps grams inside their rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(GRAM_BASE, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    count = len(h) - n + 1
    return mix((total[n:] - total[:-n]) * down[:count])
