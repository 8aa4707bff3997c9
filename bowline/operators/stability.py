"""Embedding stability under text mutations.

Every word of a (text, variant) gets seeded draws (mutated?, kind,
character). Deleted words drop out; the others are ordered by a key that
gives the push / pop-push / double-push order of the mutation without
replaying it:

* ``group`` counts the words up to this one whose kind is not "swap";
* a swapped word that is not the first word left sorts before its group's
  word: (group, 1); a duplicated word stands at (group, 0) and (group, 2);
  every other word at (group, 2). Ties go by position.

So a run of swaps lands, in order, just before the last word that is no
swap. Words are found on the Arrow buffer; draws, order and the new texts are
array operations over all words of a run of rows, and originals and variants
are embedded and compared in the same narrow pipeline: no shuffle, a text is
read once, and only similarities leave the last step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from bowline.functions import draws, grams
from bowline.functions.md5 import keyed_words
from bowline.functions.text import normalize
from bowline.functions.vectors import cosines
from bowline.operators.embed import text_embedder
from bowline.operators.train import Model

# --- fixed values: mutation kinds of the reference, each equally likely ---
KIND_DELETE, KIND_DUPLICATE, KIND_SWAP, KIND_DROP_CHAR = 0, 1, 2, 3
N_KINDS = 4
MIN_CHARS_TO_DROP = 3  # a character is removed only from words of more than 2 characters
# ---------------------------------------------------------------------------

RUN_BYTES = 1 << 18  # bytes of text whose variants are made at once
KEEP = -1  # a word that is not mutated


def drawn_kinds(prefixes: list[bytes], row: np.ndarray, pos: np.ndarray, chars: np.ndarray,
                rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(kind or KEEP, character) of words at ``pos`` of their rows, of so many characters."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = keyed_words(prefixes, row, pos).astype(np.int64)
    kind = np.where(h[:, 0] / draws.TWO_32 < rate, (h[:, 1] * N_KINDS) >> 32, KEEP)
    return kind, (h[:, 2] * chars) >> 32


def mutated_order(kind: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of the words of the mutated texts, in order; rows stay together."""
    left = np.flatnonzero(kind != KIND_DELETE)
    k, r = kind[left], row[left]
    first = np.ones(len(left), np.bool_)
    first[1:] = r[1:] != r[:-1]
    # a row's groups lie after all groups of the rows before it
    group = np.cumsum(k != KIND_SWAP) + r
    rank = np.where((k == KIND_SWAP) & ~first, 1, 2)
    twice = np.flatnonzero(k == KIND_DUPLICATE)
    at = np.concatenate([np.arange(len(left)), twice])
    place = np.concatenate([3 * group + rank, 3 * group[twice]])
    order = np.argsort(place, kind="stable")
    return left[at[order]], r[at[order]]


def _joined(run: grams.Run, start: np.ndarray, end: np.ndarray, chars: np.ndarray, kind: np.ndarray,
            at: np.ndarray, word: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of every row) of the given words of each row, joined by spaces, a drawn character left out."""
    cut = (kind == KIND_DROP_CHAR) & (chars >= MIN_CHARS_TO_DROP)
    lost = np.zeros(len(run.raw) + 1, np.bool_)  # bytes of left out characters; a word is dropped from once
    edges = np.append(np.flatnonzero((run.raw & 0xC0) != 0x80), len(run.raw))
    from_char = np.searchsorted(edges, start[cut]) + at[cut]
    lo, hi = edges[from_char], edges[from_char + 1]
    for k in range(4):
        lost[(lo + k)[lo + k < hi]] = True
    size = (end - start)[word] + 1
    begin = np.cumsum(size) - size
    source = np.arange(int(size.sum())) + np.repeat(start[word] - begin, size)
    space = np.zeros(len(source), np.bool_)
    space[begin + size - 1] = True
    out = np.where(space, 0x20, np.append(run.raw, 0)[source]).astype(np.uint8)
    keep = space | ~lost[source]
    last = np.ones(len(word), np.bool_)
    last[:-1] = row[1:] != row[:-1]
    keep[(begin + size - 1)[last]] = False  # no space after a row's last word
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = kept[np.append(begin, len(source))]
    return out[keep], ends[np.searchsorted(row, np.arange(rows), "right")]


def _mutated(run: grams.Run, prefixes: list[bytes], rate: float) -> pa.Array:
    """The mutated text of every row; a text without words as it is."""
    rows = len(run.offs) - 1
    start, end, first = grams.word_bounds(run)
    row = np.repeat(np.arange(rows), np.diff(first))
    lead = np.concatenate([[0], np.cumsum((run.raw & 0xC0) != 0x80)])
    chars = lead[end] - lead[start]
    kind, at = drawn_kinds(prefixes, row, np.arange(len(start)) - first[row], chars, rate)
    word, of = mutated_order(kind, row)
    data, ends = _joined(run, start, end, chars, kind, at, word, of, rows)
    made = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
                                                           pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(pa.string())


def _versions(part: grams.Run, keys: pa.Array, texts: pa.Array, num_variants: int, rate: float, seed: int):
    """The texts of every variant in turn; a text without words as it is."""
    # as concat_ws does, a NULL id leaves its part of the key out
    start = [f"{seed}|variant" + ("" if k is None else f"|{k}") for k in keys.to_pylist()]
    plain = pa.array(np.diff(grams.word_bounds(part)[2]) == 0)
    texts = texts.cast(pa.string())
    for v in range(1, num_variants + 1):
        yield pc.if_else(plain, texts, _mutated(part, [f"{s}|{v}|".encode() for s in start], rate))


def _fan_out(num_variants: int, rate: float, seed: int):
    """Rows (row, key, text) -> one row per variant with its text."""
    def run(batches):
        for batch in batches:
            for part in grams.runs(batch.column(2), RUN_BYTES):
                rows = len(part.offs) - 1
                row, keys, texts = (batch.column(i).slice(part.row, rows) for i in range(3))
                for v, made in enumerate(_versions(part, keys, texts, num_variants, rate, seed), 1):
                    yield pa.RecordBatch.from_arrays([row, pa.array(np.full(rows, v, np.int32)), made],
                                                     names=["row", "variant", "variant_text"])
    return run


def _side_by_side(num_variants: int, rate: float, seed: int):
    """Rows (doc_id, key, text) -> (doc_id, t0, t1, ...), the text and its variants."""
    def run(batches):
        for batch in batches:
            for part in grams.runs(batch.column(2), RUN_BYTES):
                ids, keys, texts = (batch.column(i).slice(part.row, len(part.offs) - 1) for i in range(3))
                made = list(_versions(part, keys, texts, num_variants, rate, seed))
                yield pa.RecordBatch.from_arrays([ids, texts, *made],
                                                 names=["doc_id", *(f"t{v}" for v in range(num_variants + 1))])
    return run


def _compared(vectors_of):
    """Rows (doc_id, normalized text, its variants' ...) -> (doc_id, variant, similarity)."""
    def run(batches):
        for batch in batches:
            for part in grams.runs(batch.column(1)):
                rows = len(part.offs) - 1
                ids, original, *variants = (c.slice(part.row, rows) for c in batch.columns)
                original = vectors_of(original)
                for v, texts in enumerate(variants, 1):
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(rows, v, np.int32)), pa.array(cosines(vectors_of(texts), original))],
                        names=["doc_id", "variant", "similarity"])
    return run


def _variants(rows: DataFrame, num_variants: int, rate: float, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(row, variant, variant_text); ``row`` is the whole input row."""
    src = rows.select(F.struct(*rows.columns).alias("row"), F.col(id_col).cast("string").alias("key"),
                      F.col(text_col).alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(_fan_out(num_variants, rate, seed), f"row {kind}, variant int, variant_text string")


def text_variants(texts: DataFrame, num_variants: int, mutation_rate: float, seed: int = 42,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """G1 + G2: (doc_id, variant, variant_text) for variant = 1..num_variants.

    A text without words is returned unchanged; a variant whose words were
    all deleted is the empty string.
    """
    out = _variants(texts.select(id_col, text_col), num_variants, mutation_rate, seed, id_col, text_col)
    return out.select(f"row.{id_col}", "variant", "variant_text")


def variant_similarity(texts: DataFrame, model: Model, num_variants: int, mutation_rate: float,
                       seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, variant, similarity) of each text with each of its variants.

    A text and its variants stand side by side in a row until all are embedded, so no vector leaves the
    step that makes it.
    """
    kind = texts.schema[id_col].dataType
    names = [f"t{v}" for v in range(num_variants + 1)]
    base = texts.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    wide = base.mapInArrow(_side_by_side(num_variants, mutation_rate, seed), Ty.StructType(
        [Ty.StructField("doc_id", kind), *[Ty.StructField(c, Ty.StringType()) for c in names]]))
    return wide.select("doc_id", *[normalize(F.col(c)).alias(c) for c in names]).mapInArrow(
        _compared(text_embedder(model)), Ty.StructType(
            [Ty.StructField("doc_id", kind), Ty.StructField("variant", Ty.IntegerType()),
             Ty.StructField("similarity", Ty.DoubleType())]))


def stability_metrics(sims: DataFrame) -> DataFrame:
    """Mean, min (folded from 1.0), max (folded from 0.0), population sd;
    all 0.0 when there are no similarities."""
    s = F.col("similarity")
    m = sims.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("a"), F.min(s).alias("lo"),
                 F.max(s).alias("hi"), F.stddev_pop(s).alias("sd"))
    some = F.col("n") > 0
    return m.select(
        F.when(some, F.col("a")).otherwise(0.0).alias("average_similarity"),
        F.when(some, F.least(F.lit(1.0), F.col("lo"))).otherwise(0.0).alias("min_similarity"),
        F.when(some, F.greatest(F.lit(0.0), F.col("hi"))).otherwise(0.0).alias("max_similarity"),
        F.when(some, F.col("sd")).otherwise(0.0).alias("standard_deviation"))


def evaluate_stability(texts: DataFrame, model: Model, num_variants: int, mutation_rate: float,
                       seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """G5."""
    return stability_metrics(variant_similarity(texts, model, num_variants, mutation_rate,
                                                seed, id_col, text_col))
