"""MD5 of many short messages at once, as array operations (the draws of ``draws`` where texts are arrays)."""

from __future__ import annotations

import numpy as np

# fixed values of the algorithm: rotations of its four rounds, initial state; the sine table by its rule
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SLICE = 1 << 13  # keys whose blocks and state stay in the cache
_SINE = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint64).astype(np.uint32)


def _blocks(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(messages x blocks x 16 words, number of blocks of each) of messages that stand one after the other."""
    n_blocks = (length + 8) // 64 + 1
    width = 64 * int(n_blocks.max(initial=1))
    out = np.zeros(len(length) * width, np.uint8)
    first = np.cumsum(length) - length
    base = np.arange(len(length)) * width
    out[np.arange(len(data)) + np.repeat(base - first, length)] = data
    out[base + length] = 0x80
    bits = (length * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    out[(base + 64 * n_blocks - 8)[:, None] + np.arange(8)] = bits
    return out.view("<u4").reshape(len(length), -1, 16), n_blocks


def md5_words(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The digests' four 32-bit words, in the order of their bytes, of messages that stand one after the other."""
    return _digests(*_blocks(data, length))


def _digests(words: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    state = [np.full(len(words), s, np.uint32) for s in _STATE]
    for block in range(words.shape[1]):
        on = n_blocks > block
        x = np.ascontiguousarray(words[:, block].T)
        a, b, c, d = (v.copy() for v in state)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):  # the arrays are written in place
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _SINE[i]
            f += x[g]
            turn = np.uint32(_TURNS[i // 16][i % 4])
            np.left_shift(f, turn, out=t)
            f >>= np.uint32(32) - turn
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        state = [np.where(on, s + v, s) for s, v in zip(state, (a, b, c, d))]
    return np.stack(state, axis=1).astype("<u4").view(">u4").astype(np.uint32)


def keyed(prefixes: list[bytes], row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of draw keys: the prefix of each key's row, then its position in decimal."""
    size = np.array([len(p) for p in prefixes], np.int64)
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(prefixes), np.uint8)
    digits = np.searchsorted(10 ** np.arange(1, 19), pos, "right") + 1
    length = size[row] + digits
    first = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    n = size[row]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # place within the prefix
    out[np.repeat(first, n) + at] = text[np.repeat(begin[row], n) + at]
    left = pos.copy()
    for k in range(int(digits.max(initial=0))):
        on = digits > k
        out[(first + length - 1 - k)[on]] = 0x30 + left[on] % 10
        left //= 10
    return out, length


def keyed_words(prefixes: list[bytes], row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``md5_words(*keyed(prefixes, row, pos))``: prefixes are laid out in blocks once, and keys taken a slice at a time."""
    size = np.array([len(p) for p in prefixes], np.int64)
    digits = np.searchsorted(10 ** np.arange(1, 19), pos, "right") + 1
    out = np.empty((len(row), 4), np.uint32)
    longest = int(size.max(initial=0)) + int(digits.max(initial=1))
    width = 64 * ((longest + 8) // 64 + 1)
    laid = np.zeros((len(prefixes), width), np.uint8)
    text = np.frombuffer(b"".join(prefixes), np.uint8)
    of = np.repeat(np.arange(len(prefixes)), size)
    laid[of, np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)] = text
    # the digits of every position and the byte that ends a message
    most = int(digits.max(initial=1))
    number = np.arange(int(pos.max(initial=0)) + 1)
    of = np.searchsorted(10 ** np.arange(1, 19), number, "right") + 1
    tails = np.zeros((len(number), most + 1), np.uint8)
    tails[number, of] = 0x80
    for k in range(most):
        on = np.flatnonzero(of > k)
        tails[on, of[on] - 1 - k] = 0x30 + number[on] // 10 ** k % 10
    for lo in range(0, len(row), _SLICE):
        r, p = row[lo:lo + _SLICE], pos[lo:lo + _SLICE]
        keys, at = laid[r], np.arange(len(r)) * width
        keys.reshape(-1)[(at + size[r])[:, None] + np.arange(most + 1)] = tails[p]
        length = size[r] + digits[lo:lo + _SLICE]
        n_blocks = (length + 8) // 64 + 1
        words = keys.view("<u4")
        words[np.arange(len(r)), 16 * n_blocks - 2] = length * 8  # of a length below 2**29 bytes
        out[lo:lo + _SLICE] = _digests(words.reshape(len(r), -1, 16), n_blocks)
    return out
