"""Tokens of normalized texts, found on the Arrow buffer.

A text is read as UTF-8 bytes: every byte gets the class of its character
(alphanumeric or not) by table, tokens are the runs between, and the tokens of
a run of rows are dictionary-encoded, so stop words, counts and vocabulary
look-ups work on distinct tokens and integer codes. A bigram is a pair of codes
and becomes a string only where one is asked for. ``runs`` of ``grams`` bounds
the working memory; nothing is done per token in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bowline.functions.grams import Run, runs

# --- fixed values: must equal the reference's tokenizer -------------------
# English stop words removed after tokenizing (68 words, reference order).
STOP_WORDS = (
    "a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "from", "by", "with", "in", "out",
    "is", "are", "am", "was", "were", "be", "being", "been", "have", "has", "had", "do", "does", "did",
    "will", "would", "shall", "should", "may", "might", "must", "can", "could", "of", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "its",
    "our", "their", "what", "which", "who", "whom", "whose", "when", "where", "why", "how",
)
# A token is kept when its UTF-8 length is at least this many bytes.
MIN_TOKEN_BYTES = 2
# n-gram pieces are joined with this separator.
NGRAM_SEP = "_"
# ---------------------------------------------------------------------------


@cache
def alphanumeric() -> np.ndarray:
    """Whether a code point is alphabetic (Unicode Alphabetic) or numeric (general category N)."""
    import regex
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])  # all but surrogates
    out = np.zeros(0x110000, np.bool_)
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", points.astype("<u4").tobytes().decode("utf-32-le")):
        out[points[m.start():m.end()]] = True
    return out


def inside(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to an alphanumeric character."""
    table = alphanumeric()
    out = np.where(raw < 0x80, table[np.minimum(raw, 0x7F)], False)
    wide = np.flatnonzero(raw >= 0xC0)
    if len(wide):
        lead = raw[wide].astype(np.int64)
        more = 1 + (lead >= 0xE0) + (lead >= 0xF0)  # bytes that follow
        point = lead & np.array([0, 0x1F, 0x0F, 0x07])[more]
        for k in (1, 2, 3):
            on = more >= k
            point[on] = (point[on] << 6) | (raw[wide[on] + k] & 0x3F)
        hit = table[point]
        for k in range(4):
            out[wide[hit & (more >= k)] + k] = True
    return out


class TokenRun(NamedTuple):
    """The tokens of consecutive rows: their codes and rows in order, and the distinct tokens."""

    first_row: int
    rows: int
    codes: np.ndarray
    row: np.ndarray
    words: pa.Array


def tokens_of(run: Run) -> TokenRun:
    flag = np.zeros(len(run.raw) + 2, np.int8)
    flag[1:-1] = inside(run.raw)
    begins, ends = flag[1:] > flag[:-1], flag[1:] < flag[:-1]
    cut = run.offs[1:-1]  # a token never crosses a row
    both = cut[(flag[cut] == 1) & (flag[cut + 1] == 1)]
    begins[both] = ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    kept = end - start >= MIN_TOKEN_BYTES
    start, end = start[kept], end[kept]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    flat = pa.Array.from_buffers(pa.large_string(), len(start),
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(run.raw[at]))])
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    codes = coded.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(run.offs, start, "right") - 1
    stop = pc.is_in(words, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
    if stop.any():
        on = ~stop[codes]
        codes, row = codes[on], row[on]
    return TokenRun(run.row, len(run.offs) - 1, codes, row, words)


def token_runs(column: pa.Array) -> Iterator[TokenRun]:
    """The tokens of a column of normalized texts, run by run."""
    for run in runs(column):
        yield tokens_of(run)


def pairs(t: TokenRun) -> np.ndarray:
    """Positions of the tokens that have a next one in their row (bigrams bridge stop words)."""
    return np.flatnonzero(t.row[1:] == t.row[:-1])


def joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(a, b, NGRAM_SEP)


def token_lists(column: pa.Array, use_ngrams: bool) -> pa.Array:
    """The terms of every text, unigrams before bigrams; null for a null text."""
    parts, sizes = [], []
    for t in token_runs(column):
        row, flat = t.row, t.words.take(pa.array(t.codes))
        if use_ngrams:
            at = pairs(t)
            both = pa.concat_arrays([flat, joined(flat.take(pa.array(at)), flat.take(pa.array(at + 1)))])
            kind = np.repeat([0, 1], [len(row), len(at)])
            row = np.concatenate([row, row[at]])
            order = np.lexsort((kind, row))  # stable: tokens and pairs stay in their order
            flat, row = both.take(pa.array(order)), row[order]
        parts.append(flat)
        sizes.append(np.bincount(row, minlength=t.rows))
    flat = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    offsets = np.concatenate([[0], *([np.cumsum(np.concatenate(sizes))] if sizes else [])]).astype(np.int32)
    mask = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask)


class Vocabulary:
    """A block of a vocabulary, ready to be looked up by codes: terms are tokens or pairs of tokens."""

    def __init__(self, terms: list[str]):
        split = [t.split(NGRAM_SEP, 1) for t in terms]
        words = sorted({w for s in split for w in s})
        number = {w: i for i, w in enumerate(words)}
        self.words, self.size = pa.array(words, pa.string()), max(1, len(words))
        self.single = np.full(len(words) + 1, -1, np.int64)  # the last place stands for any other token
        keys, index = [], []
        for i, s in enumerate(split):
            if len(s) == 1:
                self.single[number[s[0]]] = i
            else:
                keys.append(number[s[0]] * self.size + number[s[1]])
                index.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.pair = np.array(keys, np.int64)[order], np.array(index, np.int64)[order]

    def find(self, t: TokenRun, use_ngrams: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of every term of the run that the block holds."""
        at = pc.fill_null(pc.index_in(t.words, value_set=self.words), len(self.words)).to_numpy(zero_copy_only=False)
        word = at.astype(np.int64)[t.codes]
        index = self.single[word]
        on = index >= 0
        row, index = t.row[on], index[on]
        if use_ngrams and len(self.keys):
            first = pairs(t)
            a, b = word[first], word[first + 1]
            known = (a < len(self.words)) & (b < len(self.words))
            key, place = a[known] * self.size + b[known], t.row[first[known]]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[where] == key
            row, index = np.concatenate([row, place[hit]]), np.concatenate([index, self.pair[where[hit]]])
        return row, index


class RunTerms(NamedTuple):
    """The distinct terms of a run, tokens before pairs: their codes (second -1: a token), occurrences and rows."""

    words: pa.Array
    first: np.ndarray
    second: np.ndarray
    total: np.ndarray
    docs: np.ndarray

    def names(self, at: np.ndarray | None = None) -> pa.Array:
        """The terms, or those at ascending places."""
        first, second = (self.first, self.second) if at is None else (self.first[at], self.second[at])
        n = int(np.count_nonzero(second < 0))
        return pa.concat_arrays([self.words.take(pa.array(first[:n])), joined(
            self.words.take(pa.array(first[n:])), self.words.take(pa.array(second[n:])))])

    def hashes(self) -> np.ndarray:
        """64 bits of every term, the same in every run."""
        of = word_hashes(self.words)
        if not len(self.first):
            return np.zeros(0, np.uint64)
        second = np.where(self.second < 0, np.uint64(0), of[self.second])
        return _mixed(of[self.first] * _PAIR_STEP + second)


_PAIR_STEP = np.uint64(0xD6E8FEB86659FD93)  # any odd numbers do
_MIX_STEPS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX_STEPS[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of every word: a sum over its bytes and their places, mixed."""
    words = words.cast(pa.large_string())
    _, ends, data = words.buffers()
    offs = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
    out = np.zeros(len(words), np.uint64)
    size = np.diff(offs)
    some = np.flatnonzero(size)
    if len(some):
        raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]].astype(np.uint64)
        place = np.arange(len(raw)) - np.repeat(offs[:-1] - offs[0], size)
        out[some] = np.add.reduceat(_mixed((place.astype(np.uint64) << np.uint64(8)) + raw + np.uint64(1)), (offs[:-1] - offs[0])[some])
    return _mixed(out)


def run_terms(t: TokenRun, use_ngrams: bool) -> RunTerms:
    """The distinct terms of a run, counted on their codes."""
    def of(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = np.sort(row * n + codes)
        held = held[np.append(True, held[1:] != held[:-1])[:len(held)]] % max(n, 1)
        return np.bincount(codes, minlength=n), np.bincount(held, minlength=n)

    n = len(t.words)
    total, docs = of(t.codes, t.row, n)
    first = np.flatnonzero(total)
    second, total, docs = np.full(len(first), -1), total[first], docs[first]
    if use_ngrams:
        at = pairs(t)
        key, code = np.unique(t.codes[at] * n + t.codes[at + 1], return_inverse=True)
        more, held = of(code, t.row[at], len(key))
        first, second = np.concatenate([first, key // max(n, 1)]), np.concatenate([second, key % max(n, 1)])
        total, docs = np.concatenate([total, more]), np.concatenate([docs, held])
    return RunTerms(t.words, first, second, total.astype(np.int64), docs.astype(np.int64))


def counts(t: TokenRun, use_ngrams: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(term, occurrences, rows that hold it) of the distinct terms of a run."""
    r = run_terms(t, use_ngrams)
    return r.names(), r.total, r.docs
