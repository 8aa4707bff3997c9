"""Text column functions: normalize, tokenize, n-grams, term bags.

NFC has no Spark SQL function; it is an Arrow function that gets only the rows
that can change under NFC (a character at or above U+0300), all others are null
to it, and gives back those that do; a batch's texts become Python strings a few
rows at a time. Lower-casing is the JVM's. Tokens are found on the Arrow buffer
(``tokens``); n-grams of given arrays and term bags are JVM expressions.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from bowline.functions.common import let
from bowline.functions.tokens import MIN_TOKEN_BYTES, NGRAM_SEP, STOP_WORDS, token_lists

__all__ = ["MIN_TOKEN_BYTES", "NGRAM_SEP", "STOP_WORDS", "BM25_K1", "BAG_TYPE", "nfc", "normalize", "tokenize", "ngrams",
           "process_text", "term_bag"]

# --- fixed values (with those of ``tokens``) --------------------------------
# BM25-like saturation constants (k1; b cancels out in the reference formula).
BM25_K1 = 1.2
# ---------------------------------------------------------------------------

# Every character below U+0300 is NFC-stable and never composes with a
# neighbour below U+0300, so only rows with a character >= U+0300 can change.
_MAY_CHANGE_UNDER_NFC = r"[^\x{0000}-\x{02FF}]"


_STRINGS = 64  # rows of a batch that are Python strings at a time


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """The NFC form of texts that differ from it, null for all others."""
    parts = [pa.nulls(0, pa.string())]
    for a in range(0, len(texts), _STRINGS):
        part = texts.slice(a, _STRINGS)
        if part.null_count == len(part):
            parts.append(pa.nulls(len(part), pa.string()))
        else:
            parts.append(pa.array([n if t is not None and (n := unicodedata.normalize("NFC", t)) != t else None
                                   for t in part.to_pylist()], pa.string()))
    return pa.concat_arrays(parts)


def nfc(text: Column) -> Column:
    """Unicode NFC; rows that it does not change are returned as they are."""
    may_change = text.rlike(_MAY_CHANGE_UNDER_NFC)
    return F.coalesce(_composed(F.when(may_change, text)), text)


def normalize(text: Column) -> Column:
    """NFC then lowercase, nothing else."""
    return F.lower(nfc(text))


@F.arrow_udf(ArrayType(StringType()))
def _tokens(norm: pa.Array) -> pa.Array:
    return token_lists(norm, use_ngrams=False)


@F.arrow_udf(ArrayType(StringType()))
def _terms(norm: pa.Array) -> pa.Array:
    return token_lists(norm, use_ngrams=True)


def tokenize(text: Column) -> Column:
    """Normalized tokens of a text as ARRAY<STRING>: split, byte-length and stop-word filter."""
    return _tokens(normalize(text))


def ngrams(tokens: Column, n: int) -> Column:
    """T5: contiguous n-token windows joined by '_'; empty when n > size."""
    if n < 1:
        raise ValueError("n must be >= 1")
    if n == 1:
        return tokens
    def body(t: Column) -> Column:
        size = F.size(t)
        windows = F.transform(F.sequence(F.lit(1), size - n + 1),
                              lambda i: F.array_join(F.slice(t, i, n), NGRAM_SEP))
        return F.when(size >= n, windows).otherwise(F.array().cast("array<string>"))
    # bound once: the input may hold the NFC UDF, which cannot sit in a lambda
    return let(tokens, body)


def process_text(text: Column, use_ngrams: bool = True) -> Column:
    """Unigrams, then bigrams when enabled (bigrams bridge stop words)."""
    return _terms(normalize(text)) if use_ngrams else tokenize(text)


def term_bag(terms: Column) -> Column:
    """Per-text term frequencies, computed inside the row: no shuffle.

    Sorts the term array and reads run lengths, giving
    ARRAY<STRUCT<token STRING, tf INT>> ordered by token. An empty term array
    gives an empty bag. The sorted array and the run starts are each bound
    once, so nothing is re-evaluated per element.
    """
    def on_sorted(s: Column) -> Column:
        n = F.size(s)

        def on_starts(st: Column) -> Column:
            return F.transform(st, lambda p, k: F.struct(
                s[p].alias("token"),
                (F.coalesce(F.get(st, k + 1), n) - p).alias("tf")))

        starts = F.filter(F.sequence(F.lit(0), n - 1),
                          lambda i: (i == 0) | (s[i] != F.get(s, i - 1)))
        return let(starts, on_starts)

    empty = F.array().cast(BAG_TYPE)
    return F.when(F.size(terms) == 0, empty).otherwise(
        let(F.sort_array(terms), on_sorted))


BAG_TYPE = "array<struct<token:string,tf:int>>"
