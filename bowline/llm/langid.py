"""Language identification by a string kernel with Nystroem landmarks.

Kernel: blended-spectrum presence. A text is cut evenly into windows of at most
``WINDOW`` code points that together cover it (each with the ``MAX_N`` - 1 that
follow, so no n-gram is lost). A window is the set of its character n-grams of
lengths 1 to ``MAX_N`` (lower-cased code points), hashed into ``FEATURES``
positions of a 0/1 vector of at most ``MAX_N * WINDOW`` ones, and normalised; a
text is the mean x of its windows that have a letter, so a long text fills no
more positions at once than a short one and scores as its parts do. The kernel
is the product of two such vectors, for texts of one window the cosine.
Landmarks L are one window each (by a hash) of sampled training texts.
One-versus-rest kernel ridge regression on the Nystroem features solves
(K_NL' K_NL + ridge K_LL) a = K_NL' Y with targets -1 and 1. A text's scores
are K(x, L) a = x (L' a), so a batch of texts is scored by one matrix product
with the (FEATURES, languages) matrix L' a.

Every labelled row is trained on. The Nystroem basis is ``LANDMARKS`` landmarks
per language, chosen by a hash of id and text among ``PER_LANGUAGE`` rows so
chosen; the fit's sums K_NL' K_NL and K_NL' Y, and ``cuts``, are over all rows.
Landmark vectors are built and K_NL' K_NL is summed in the tasks; the driver gets bit vectors of
the landmarks and one sum per task, and solves the (landmarks x landmarks)
system. No text goes to the driver.

``cuts`` gives the least score of a text in a learned language, by length, from
labelled rows left out of the fit. A text unlike every landmark has f = 0, the
score ``NO_EVIDENCE``. All left-out rows are scored whole and as their first 16, 32, ... ``WINDOW`` code points, in
classes of doubling length. Where the ``LOW`` quantile of a class is over
``NO_EVIDENCE`` by ``CLEAR`` (unlike texts scatter less around it), its cut is
a quarter of the way from there to the quantile. A class of shorter texts
tells too little, and its clean ones shall stay: its cut is the ``LOWEST``
quantile. A class of fewer than ``LEAST_ROWS`` scored texts is judged together
with the next shorter ones, as far as there are any. Texts shorter than the
shortest class are not judged by their score.

Nulls: a null text, and a text without a letter, is ``und`` with score 0. A
null lang is no training row. With no training rows every text is ``und``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bowline.llm.bytetext import slices
from bowline.llm.tables import ROW, materialize, packed

MAX_N = 4
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
LANDMARKS = 64
PER_LANGUAGE = 1024
RIDGE = 0.1
WINDOW = 1024  # code points; their n-grams fill at most an eighth of the positions
ROWS = 128  # rows of one dense presence matrix
UNKNOWN = "und"
NO_EVIDENCE = 0.5
CLEAR = 0.05
LOW, LOWEST = 0.01, 0.001
LEAST_ROWS = 100
SHORTEST = 16

_LETTER_LIKE = re.compile(r"[^\W\d_]")  # letters, and numbers such as a half
_MUL = np.uint64(0x9E3779B97F4A7C15)


def presence(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 matrix of the rows' n-grams, whether a row has a letter)."""
    return grams(lowered(raw, offs))


def lowered(raw: np.ndarray, offs: np.ndarray) -> list[str]:
    return [raw[a:b].tobytes().decode().lower() for a, b in zip(offs, offs[1:])]


def has_letter(text: str) -> bool:
    """Whether a character is of the Unicode category L."""
    return any(m[0].isalpha() for m in _LETTER_LIKE.finditer(text))


def windows(low: str) -> list[str]:
    """The even windows of a text; a text of up to ``WINDOW`` code points is one."""
    n = max(1, -(-len(low) // WINDOW))
    return [low[len(low) * i // n:len(low) * (i + 1) // n + MAX_N - 1] for i in range(n)]


def grams(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 matrix of the n-grams of lower-cased texts, whether a text has a letter)."""
    n = len(low)
    letters = np.fromiter(map(has_letter, low), np.bool_, n)
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, low), np.int64, n)
    row = np.repeat(np.arange(n), sizes)
    out = np.zeros(n * FEATURES, np.bool_)
    h = np.zeros(len(points), np.uint64)
    for k in range(1, MAX_N + 1):
        last = len(points) - k + 1
        if last <= 0:
            break
        h = (h[:last] + points[k - 1:] + np.uint64(1)) * _MUL
        h ^= h >> np.uint64(29)
        inside = row[:last] == row[k - 1:]
        slot = (h * _MUL) >> np.uint64(64 - FEATURE_BITS)
        out[row[:last][inside] * FEATURES + slot[inside].astype(np.int64)] = True
    return out.reshape(n, FEATURES), letters


def pieces(column: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, last row, runs of windows) of runs of rows.

    A run of windows is (row of each from the first, 0/1 matrix); windows without a letter are left out.
    """
    def run(low: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cut = [windows(t) for t in low]
        row = np.repeat(np.arange(len(cut)), list(map(len, cut)))
        flat = [w for ws in cut for w in ws]
        for a in range(0, len(flat), ROWS):
            x, letters = grams(flat[a:a + ROWS])
            if letters.any():
                yield (row[a:a + ROWS], x) if letters.all() else (row[a:a + ROWS][letters], x[letters])

    for lo, hi, raw, offs in slices(column):
        for a in range(0, hi - lo, ROWS):
            b = min(a + ROWS, hi - lo)
            yield lo + a, lo + b, run(lowered(raw, offs[a:b + 1]))


def matrices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, mean of the normalised windows as float32, has a letter) of runs of rows."""
    for lo, hi, runs in pieces(column):
        out, voices = np.zeros((hi - lo, FEATURES), np.float32), np.zeros(hi - lo)
        for row, x in runs:
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] += np.add.reduceat(unit(x.astype(np.float32)), first, axis=0)
            voices += np.bincount(row, minlength=hi - lo)
        out /= np.maximum(voices, 1).astype(np.float32)[:, None]
        yield lo, hi, out, voices > 0


def products(column: pa.Array, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ``matrices`` @ weights, has a letter), from the windows' own products."""
    for lo, hi, runs in pieces(column):
        out, voices = np.zeros((hi - lo, weights.shape[1])), np.zeros(hi - lo)
        for row, x in runs:
            f = (x.astype(np.float32) @ weights) / np.sqrt(np.count_nonzero(x, axis=1))[:, None]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] += np.add.reduceat(f, first, axis=0)
            voices += np.bincount(row, minlength=hi - lo)
        yield lo, hi, out / np.maximum(voices, 1)[:, None], voices > 0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0))


def _landmark_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offs in slices(batch.column(0)):
            cut = [windows(t) for t in lowered(raw, offs)]
            one = [ws[zlib.crc32("".join(ws).encode()) % len(ws)] for ws in cut]
            bits = [r.tobytes() for a in range(0, len(one), ROWS)
                    for r in np.packbits(grams(one[a:a + ROWS])[0], axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary())], names=["bits"])


def landmark_matrix(bits: list[bytes]) -> np.ndarray:
    """The normalised landmark vectors of their packed bits."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)
    return unit(x.astype(np.float32)).astype(np.float32)


def _normal_sums(landmarks, languages: list[str]):
    """K_NL' K_NL and K_NL' Y of the task's rows, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = landmark_matrix(landmarks.value)
        gram = np.zeros((len(marks), len(marks)))
        right = np.zeros((len(marks), len(languages)))
        at = {v: i for i, v in enumerate(languages)}
        seen = 0
        for batch in batches:
            lang = np.array([at[v] for v in batch.column(1).to_pylist()], np.int64)
            for lo, hi, k, _ in products(batch.column(0), marks.T):
                y = np.full((hi - lo, len(languages)), -1.0)
                y[np.arange(hi - lo), lang[lo:hi]] = 1.0
                gram += k.T @ k
                right += k.T @ y
                seen += hi - lo
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()),
                                              pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])
    return run


def hashed(id_col: str, text_col: str, salt: str) -> Column:
    """A number in [0, 1) of a row's id and text."""
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(salt))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def sampled(labelled: DataFrame, per_language: int, by: str) -> DataFrame:
    """About ``per_language`` rows of every language, by the hash ``by`` in [0, 1).

    A sample of a sample needs a hash of its own: within it the first hash is not uniform.
    """
    size = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    # one row per language; each share keeps per_language rows in expectation
    shares = {r["lang"]: per_language / r["rows"] for r in size.collect()}
    if not shares:
        return labelled.limit(0)
    share = F.element_at(F.map_from_arrays(*[F.array(*map(F.lit, v)) for v in (shares.keys(), shares.values())]),
                         F.col("lang"))
    return labelled.filter(F.col(by) < share)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          use: Column | None = None, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """(languages, weights of shape (FEATURES, languages)) from rows with a language."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if use is not None:
        rows = rows.filter(use)
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       *[hashed(id_col, text_col, salt).alias(salt) for salt in ("in_sample", "in_landmarks")])
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((FEATURES, 0), np.float32)
    sample = materialize(sampled(rows, PER_LANGUAGE, "in_sample"), "landmark-rows")
    bits = sampled(sample, LANDMARKS, "in_landmarks").select("text").mapInArrow(_landmark_bits, "bits binary").collect()
    if not bits:  # a tiny sample may have no row under its share
        bits = rows.select("text").limit(LANDMARKS).mapInArrow(_landmark_bits, "bits binary").collect()
    held = [bytes(r[0]) for r in bits]
    marks = landmark_matrix(held)
    # the tasks get the landmarks as bits: a 32nd of the matrix
    # written by all tasks at once; read one by one
    parts = materialize(rows.select("text", "lang").mapInArrow(
        _normal_sums(spark.sparkContext.broadcast(held), languages), "gram binary, right binary"), "normal-sums")
    m = len(marks)
    gram, right = np.zeros((m, m)), np.zeros((m, len(languages)))
    for r in parts.toLocalIterator():
        gram += np.frombuffer(r[0]).reshape(m, m)
        right += np.frombuffer(r[1]).reshape(m, len(languages))
    k_ll = (marks @ marks.T).astype(np.float64)
    alpha = np.linalg.solve(gram + ridge * k_ll + 1e-6 * np.eye(m), right)
    return languages, (marks.T.astype(np.float64) @ alpha).astype(np.float32)


def _predict(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = model.value
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            held = batch.column(0)
            best = np.full(len(held), len(languages), np.int64)
            score = np.zeros(len(held))
            if languages:
                for lo, hi, f, letters in products(held.field(text_col), weights):
                    top = f.argmax(1)
                    best[lo:hi] = np.where(letters, top, len(languages))
                    s = np.clip((f[np.arange(hi - lo), top] + 1) / 2, 0, 1)
                    score[lo:hi] = np.where(letters, s, 0.0)
            yield pa.RecordBatch.from_arrays([held, pa.array(names[best], pa.string()), pa.array(score)],
                                             names=[ROW, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Every row as ``_row`` with lang_pred and score."""
    rows = docs.select(packed(docs))
    schema = f"{ROW} {rows.schema[0].dataType.simpleString()}, lang_pred string, score double"
    held = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(held, text_col), schema)


def left_out(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The quarter of the rows that ``cuts`` is to have and the fit is not."""
    return hashed(id_col, text_col, "left_out") < 0.25


def cuts(docs: DataFrame, model: tuple[list[str], np.ndarray], use: Column, id_col: str = "doc_id",
         text_col: str = "text", lang_col: str = "lang") -> list[tuple[int, float]]:
    """(least length, least score) of the length classes, ascending, from the labelled rows ``use``."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & use).select(F.col(text_col).alias("text"))
    lengths = [SHORTEST << i for i in range((WINDOW // SHORTEST).bit_length())]
    size = F.length("text")
    whole = F.array(F.when(size >= SHORTEST, F.col("text")))
    starts = F.array(*[F.when(size > n, F.substring("text", 1, n)) for n in lengths])
    texts = rows.select(
        F.explode(F.array_compact(F.concat(whole, starts))).alias("text"))
    bound = F.greatest(*[F.when(F.length(f"{ROW}.text") >= n, n) for n in lengths])
    # one row per class and score of four digits
    found = (identify(texts, model).filter(F.col("lang_pred") != UNKNOWN)
             .groupBy(bound.alias("bound"), F.round("score", 4).alias("score")).agg(F.count("*").alias("n")).collect())
    scores: list[np.ndarray] = []
    out = []
    for n in sorted({r["bound"] for r in found}):
        of = [(r["score"], r["n"]) for r in found if r["bound"] == n]
        scores.append(np.repeat([s for s, _ in of], [k for _, k in of]))
        pooled = scores[-1]
        for shorter in scores[-2::-1]:
            if len(pooled) < LEAST_ROWS:
                pooled = np.concatenate([pooled, shorter])
        low, lowest = np.quantile(pooled, [LOW, LOWEST], method="inverted_cdf")
        out.append((n, float(lowest if low < NO_EVIDENCE + CLEAR else NO_EVIDENCE + (low - NO_EVIDENCE) / 4)))
    return out


def least_score(found: list[tuple[int, float]], text: Column) -> Column:
    out = F.lit(0.0)
    for bound, cut in found:
        out = F.when(F.length(text) >= bound, cut).otherwise(out)
    return out


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % modulus


def learnable(id_col: str = "doc_id", modulus: int = 4, held: int = 2) -> Column:
    """Rows that may be learned from: those whose remainder is not the held-out one."""
    return F.coalesce(remainder(id_col, modulus) != held, F.lit(True))
