"""Hashes of word and character n-grams over Arrow string columns.

Texts stay one UTF-8 buffer with row offsets, as Arrow holds them: words are
the runs between Unicode white space, found on the bytes, and the hash of any
byte or word range is a difference of two running sums, so every n-gram of
every text costs a few array operations and no Python object. ``runs`` bounds
the working memory: rows are taken in runs of about ``RUN_BYTES``, a longer
text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_BYTE_STEP = np.uint64(0xD6E8FEB86659FD93)  # any odd numbers do
_WORD_STEP = np.uint64(0xA0761D6478BD642F)

# fixed values: Unicode White_Space as UTF-8: single bytes, and what may follow each lead byte
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_SPACE_2 = {0xC2: (0x85, 0xA0)}
_SPACE_3 = {0xE1: ((0x9A, 0x80),), 0xE2: (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)),
            0xE3: ((0x80, 0x80),)}


class Run(NamedTuple):
    """Consecutive rows of a column: their first row, bytes and offsets from 0."""

    row: int
    raw: np.ndarray
    offs: np.ndarray


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """The rows of a string column in runs of about ``limit`` bytes; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    offs = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield Run(row, raw[offs[row]:offs[stop]], offs[row:stop + 1] - offs[row])
        row = stop


def spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to a white space character."""
    out = _SPACE[raw]
    wide = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    wide = wide[_may_follow(raw, wide)]
    out[wide] = out[wide + 1] = True
    out[wide[raw[wide] != 0xC2] + 2] = True
    return out


def _may_follow(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which lead bytes begin a white space character."""
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    lead, second, third = raw[at], padded[at + 1], padded[at + 2]
    out = np.zeros(len(at), np.bool_)
    for first, seconds in _SPACE_2.items():
        out |= (lead == first) & np.isin(second, seconds)
    for first, pairs in _SPACE_3.items():
        here = lead == first
        if here.any():
            out |= here & np.isin(second.astype(np.int32) << 8 | third, [a << 8 | b for a, b in pairs])
    return out


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Spread a hash over all bits, differently for every salt."""
    h = (h + np.uint64(salt)) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(step: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64 for i < n."""
    held = _POWERS.get(int(step))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        back = np.uint64(pow(int(step), -1, 1 << 64))
        both = []
        for base in (step, back):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        held = _POWERS[int(step)] = tuple(both)
    return held[0][:n], held[1][:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, step: np.uint64 = _BYTE_STEP) -> np.ndarray:
    """Hash of values[start:end] for every pair; equal for equal contents wherever they stand."""
    up, down = _powers(step, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return (total[end] - total[start]) * down[start]


class WordRun(NamedTuple):
    """The words of a run: hash and row of each, and the first word of every row (one more at the end)."""

    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def word_bounds(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of every row and one more) of the runs between white space; none crosses a row."""
    inside = np.zeros(len(run.raw) + 2, np.int8)
    inside[1:-1] = ~spaces(run.raw)
    begins, ends = inside[1:] > inside[:-1], inside[1:] < inside[:-1]
    cut = run.offs[1:-1]
    both = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begins[both] = ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, run.offs)


def words(run: Run) -> WordRun:
    start, end, first = word_bounds(run)
    h = mixed(range_hashes(run.raw, start, end), 0)
    return WordRun(h, np.repeat(np.arange(len(run.offs) - 1), np.diff(first)), first)


def word_grams(w: WordRun, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words of one row."""
    count = max(len(w.hash) - n + 1, 0)
    at = np.flatnonzero(w.row[:count] == w.row[n - 1:n - 1 + count])
    return at, mixed(range_hashes(w.hash, at, at + n, _WORD_STEP), n)


def char_grams(run: Run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n characters of one row."""
    start = np.flatnonzero((run.raw & 0xC0) != 0x80)
    edges = np.append(start, len(run.raw))
    count = max(len(start) - n + 1, 0)
    row = np.searchsorted(run.offs, start, "right") - 1
    at = np.flatnonzero(row[:count] == row[n - 1:n - 1 + count])
    return row[at], mixed(range_hashes(run.raw, edges[at], edges[at + n]), 64 + n)
