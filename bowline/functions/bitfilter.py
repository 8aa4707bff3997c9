"""A one-hash bit filter over 64-bit keys: small enough to be sent to a scan, never wrong about a held key."""

from __future__ import annotations

import numpy as np

BITS_PER_KEY = 16  # about 6 in 100 keys that are not held pass by chance


def empty_filter(keys: int, most_bytes: int | None = None) -> np.ndarray:
    """A power of two of bits for so many keys, fewer than ``BITS_PER_KEY`` a key where ``most_bytes`` asks for it."""
    size = 1 << max(6, (BITS_PER_KEY * keys - 1).bit_length())
    while most_bytes is not None and size > 64 and size >> 3 > most_bytes:
        size >>= 1
    return np.zeros(size >> 3, np.uint8)


def put(bits: np.ndarray, keys: np.ndarray) -> None:
    at = keys & np.uint64(8 * len(bits) - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def bit_filter(keys: np.ndarray) -> np.ndarray:
    bits = empty_filter(len(keys))
    put(bits, keys)
    return bits


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(np.bool_)
