"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of order ``ORDER`` over normalised bytes
(ASCII letters in lower case, digits as one symbol, other ASCII as a blank,
UTF-8 bytes as they are), one per class. Only the highest order is
class-conditional; below it both classes share one backoff model built from
continuation counts (the number of distinct left extensions of a gram), so a
rare expression that one class happens to hold gets little weight:

    P_c(x|h) = (max(n_c(hx) - D, 0) + D t_c(h) P(x|h')) / n_c(h)

with n_c the counts (of training texts that hold the gram), t_c the distinct continuations of context h in class c and
P the shared model of the shorter context h'. The log-likelihood ratio of a
position depends on its gram only: seen grams get their ratio, an unseen gram
with a seen context the ratio of the backoff weights (P cancels), any other 0.
In training and scoring alike every text that is not empty has a blank at both
ends (two where it has under three bytes), so its first and last word are seen
as among other words and a text of one byte has a gram too.

Score. Log-likelihoods are normalised by length over a sliding window of
``WINDOW`` positions (a shorter text is one window); the document's figure is
its most toxic window's mean ratio. A non-decreasing curve (isotonic regression
over a histogram), fitted on training rows that the counts did not use, turns
it into a probability.

Scale. Grams are counted over all training rows: per slice in NumPy, then one
aggregation by gram. The tables hold distinct grams of five normalised bytes,
a number set by the writing systems and not by the corpus. They are sent in
blocks of about ``MAX_GRAMS`` rows, of which the driver reads one at a time;
with more than one block the scoring steps are chained and carry the ratios of
a text's positions along, so every gram is used at any size. Texts are shuffled only where the labels are too many to be
sent to them.

Nulls: a null text is empty; an empty text has ratio 0. Rows without a label or
with a null one are not learned from. Repeated labels of a document count once
(the largest). Repeated documents are scored row by row. Very long texts are
read whole. Without calibration rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bowline.llm.bytetext import mix, slices
from bowline.llm.tables import materialize

ORDER = 5
DISCOUNT = 0.75
WINDOW = 8
MAX_GRAMS = 1 << 22
LABEL_ROW = 32  # bytes of one label in a hashed relation
LABEL_BYTES = 64 * 1024 * 1024
BINS = 200  # bins per unit of the mean ratio in the calibration histogram

SYMBOL = np.full(256, 0x20, np.uint8)
SYMBOL[0x30:0x3A] = 0x30
SYMBOL[0x41:0x5B] = SYMBOL[0x61:0x7B] = np.arange(0x61, 0x7B, dtype=np.uint8)
SYMBOL[0x80:] = np.arange(0x80, 0x100, dtype=np.uint8)


def padded(column: pa.Array) -> pa.Array:
    """Texts with blanks at both ends; null and empty ones are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    size = pc.binary_length(column)
    once = pc.binary_join_element_wise(blank, column, blank, none)
    twice = pc.binary_join_element_wise(blank, once, blank, none)
    return pc.if_else(pc.equal(size, 0), column, pc.if_else(pc.less(size, ORDER - 2), twice, once))


def grams(raw: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each position from ORDER - 1, as one integer."""
    s = SYMBOL[raw].astype(np.int64)
    n = len(s) - ORDER + 1
    out = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER if n > 0 else 0):
        out = (out << 8) | s[k:k + n]
    return out


def _rows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each gram, whether it lies inside one row)."""
    n = int(offs[-1]) - ORDER + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.bool_)
    return row[:n], row[:n] == row[ORDER - 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, raw, offs in slices(padded(batch.column(0)), 1 << 21):
            row, inside = _rows(offs)
            # a gram counts once per text, so a text that repeats itself has no more say than others
            g = np.unique((row[inside] << (8 * ORDER)) | grams(raw)[inside])
            row, g = g >> (8 * ORDER), g & ((1 << (8 * ORDER)) - 1)
            g, n = np.unique((g << 1) | toxic[lo:hi][row], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g >> 1), pa.array(np.where(g & 1, 0, n)), pa.array(np.where(g & 1, n, 0))],
                names=["gram", "n0", "n1"])


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, n0, n1) over all texts of (text, toxic)."""
    return (labelled.select("text", F.col("toxic").cast("long"))
            .mapInArrow(_count, "gram long, n0 long, n1 long")
            .groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def shared_model(counts: DataFrame) -> DataFrame:
    """(gram, p): the shared Kneser-Ney probability of every gram one order below the highest.

    Order by order from single symbols up, each from the distinct left
    extensions of its grams; the tables are those of distinct short grams.
    """
    def suffixes(k: int) -> DataFrame:
        low = F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1)
        longer = counts.select("gram") if k + 1 == ORDER else counts.select(low.alias("gram")).distinct()
        return longer.groupBy(F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram")).agg(
            F.count("*").cast("double").alias("k"))

    first = suffixes(1)
    total = first.agg(F.sum("k")).first()[0]
    model = first.select("gram", (F.col("k") / F.lit(total)).alias("p"))
    for order in range(2, ORDER):
        w = Window.partitionBy("context")
        here = suffixes(order).withColumn("context", F.shiftright("gram", 8)).withColumns(
            {"all": F.sum("k").over(w), "kinds": F.count("*").over(w)})
        shorter = model.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        model = (here.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (order - 1))) - 1))
                 .join(shorter, "suffix")
                 .select("gram", ((F.greatest(F.col("k") - DISCOUNT, F.lit(0.0))
                                   + DISCOUNT * F.col("kinds") * F.col("q")) / F.col("all")).alias("p")))
    return model


def train(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) tables of seen grams and of contexts (ratio of backoff weights) from (text, toxic)."""
    counts = materialize(count_grams(labelled), "grams")
    if counts.isEmpty():
        none = counts.select(F.col("gram").alias("key"), F.lit(0.0).cast("float").alias("ratio"))
        return none, none
    context = materialize(counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(
        *[F.sum(f"n{c}").cast("double").alias(f"all{c}") for c in (0, 1)],
        *[F.sum((F.col(f"n{c}") > 0).cast("double")).alias(f"kinds{c}") for c in (0, 1)]), "contexts")
    backoff = materialize(shared_model(counts), "shared")

    def weight(c: int) -> Column:
        return F.when(F.col(f"all{c}") > 0, DISCOUNT * F.col(f"kinds{c}") / F.col(f"all{c}")).otherwise(1.0)

    def p(c: int) -> Column:
        own = F.when(F.col(f"all{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"all{c}"))
        return F.coalesce(own, F.lit(0.0)) + weight(c) * F.col("p")

    seen = (counts.withColumn("context", F.shiftright("gram", 8)).join(context, "context")
            .join(backoff.withColumnRenamed("gram", "suffix"),
                  F.col("suffix") == F.col("gram").bitwiseAND((1 << (8 * (ORDER - 1))) - 1))
            .select(F.col("gram").alias("key"), F.log(p(1) / p(0)).cast("float").alias("ratio")))
    unseen = context.select(F.col("context").alias("key"), F.log(weight(1) / weight(0)).cast("float").alias("ratio"))
    return materialize(seen, "seen"), materialize(unseen, "unseen")


def blocks_of(model: tuple[DataFrame, DataFrame], max_grams: int = MAX_GRAMS) -> list[tuple]:
    """(broadcast block, bits to drop from a gram for its key): the seen grams' blocks, then the contexts'."""
    out = []
    for table, shift in zip(model, (0, 8)):
        n = max(1, -(-table.count() // max_grams))
        for i in range(n):
            block = (table if n == 1 else table.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i)).toArrow()
            out.append((table.sparkSession.sparkContext.broadcast(block), shift))
    return out


class Table:
    """Exact vectorised lookup: open addressing over int64 keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several on one slot the last stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, positions of the keys that are not held)."""
        out = np.zeros(len(keys), np.float32)
        at, left, missing = self._slot(keys), np.arange(len(keys)), []
        while len(left):
            held = self.keys[at]
            hit, empty = held == keys[left], held < 0
            out[left[hit]] = self.values[at[hit]]
            missing.append(left[empty])
            on = ~(hit | empty)
            left, at = left[on], (at[on] + 1) & self.mask
        return out, np.concatenate(missing) if missing else np.zeros(0, np.int64)


def ratios(raw: np.ndarray, tables: list[tuple[Table, int]], held: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood ratio of every gram; NaN where no table so far holds it."""
    g, back = np.unique(grams(raw), return_inverse=True)
    out = np.full(len(g), np.nan, np.float32)
    if held is not None:
        out[back] = held
    for table, shift in tables:
        left = np.flatnonzero(np.isnan(out))
        got, miss = table.get(g[left] >> shift)
        got[miss] = np.nan
        out[left] = got
    return out[back]


def worst_window(r: np.ndarray, row: np.ndarray, rows: int, window: int = WINDOW) -> np.ndarray:
    """Largest mean of ``window`` consecutive ratios of each row; 0 for a row without grams."""
    out = np.zeros(rows)
    if not len(r):
        return out
    total = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
    first = np.searchsorted(row, np.arange(rows))
    end = np.searchsorted(row, np.arange(rows), "right")
    short = (end - first < window) & (end > first)
    out[short] = ((total[end] - total[first]) / np.maximum(end - first, 1))[short]
    if len(r) >= window:
        mean = (total[window:] - total[:-window]) / window
        whole = np.where(row[:len(mean)] == row[window - 1:], mean, -np.inf)
        long = np.flatnonzero(end - first >= window)
        if len(long):
            out[long] = np.maximum.reduceat(np.append(whole, -np.inf), first[long])
    return out


def _score(blocks: list[tuple], last: bool, curve: Curve | None):
    """Score rows (id, text) or, after an earlier step, (id, text, ratios so far)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(Table(b.value.column("key").to_numpy(), b.value.column("ratio").to_numpy()), shift)
                  for b, shift in blocks]
        for batch in batches:
            x, partial = np.zeros(batch.num_rows), []
            for lo, hi, raw, offs in slices(padded(batch.column(1))):
                row, inside = _rows(offs)
                held = None
                if batch.num_columns == 3:
                    held = np.full(len(row), np.nan, np.float32)
                    held[inside] = np.frombuffer(b"".join(batch.column(2).slice(lo, hi - lo).to_pylist()), np.float32)
                r, row = ratios(raw, tables, held)[inside], row[inside]
                if last:
                    x[lo:hi] = worst_window(np.nan_to_num(r), row, hi - lo)
                else:
                    cut = np.searchsorted(row, np.arange(hi - lo + 1))
                    partial += [r[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(partial, pa.binary())],
                                                 names=["doc_id", "text", "held"])
                continue
            if curve is not None:
                x = np.interp(x, *curve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x)], names=["doc_id", "x"])
    return run


def window_ratios(docs: DataFrame, blocks: list[tuple], id_col: str = "doc_id", text_col: str = "text",
                  curve: Curve | None = None) -> DataFrame:
    """(doc_id, x): the most toxic window's mean log-likelihood ratio of every row, or its probability."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    if len(blocks) > 2:
        for b in blocks[:-1]:
            out = out.mapInArrow(_score([b], False, None), f"doc_id {kind}, text string, held binary")
        blocks = blocks[-1:]
    return out.mapInArrow(_score(blocks, True, curve), f"doc_id {kind}, x double")


Curve = tuple[np.ndarray, np.ndarray]  # ratios, in order, and their probabilities


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: float = 1.0) -> Curve:
    """Non-decreasing curve through weighted labels; each level is smoothed towards the share of label 1."""
    share = float((n * y).sum() / n.sum())
    levels: list[list[float]] = []  # [rows, rows of label 1, sum of x]
    for v in np.unique(x):
        at = x == v
        levels.append([n[at].sum(), (n * y)[at].sum(), v * n[at].sum()])
        while len(levels) > 1 and levels[-2][1] * levels[-1][0] >= levels[-1][1] * levels[-2][0]:
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last)]
    rows, ones, total = np.array(levels).T
    return total / rows, np.maximum.accumulate((ones + prior * share) / (rows + prior))


def calibrate(x: DataFrame) -> Curve:
    """The curve over (x, toxic), from a histogram of x (a bounded number of bins)."""
    bin_ = F.round(F.greatest(F.least("x", F.lit(20.0)), F.lit(-20.0)) * BINS).cast("int")
    got = x.groupBy(bin_.alias("b"), "toxic").agg(F.count("*").alias("n")).collect()
    if not got:
        return np.zeros(1), np.zeros(1)
    b, y, n = (np.array([r[i] for r in got], np.float64) for i in range(3))
    return isotonic(b / BINS, y, n)


def with_labels(docs: DataFrame, labels: DataFrame, broadcast_bytes: int = LABEL_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents; 0 or 1, the largest of repeated labels.

    Labels whose counted size allows are sent to the texts; more of them meet
    the texts in a shuffle join.
    """
    per_doc = materialize(labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
                          .groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    small = per_doc.count() * LABEL_ROW <= broadcast_bytes
    return docs.select("doc_id", "text").join(F.broadcast(per_doc) if small else per_doc, "doc_id")


def score(docs: DataFrame, labels: DataFrame, learn: Column, calibration: Column) -> DataFrame:
    """(doc_id, score) of every row; counts come from ``learn`` rows, the curve from ``calibration`` rows."""
    rows = with_labels(docs, labels)
    model = blocks_of(train(rows.filter(learn)))
    held = rows.filter(calibration)
    known = held.select(F.struct("doc_id", "toxic").alias("of"), "text")
    curve = calibrate(window_ratios(known, model, "of").select("x", F.col("doc_id.toxic").alias("toxic")))
    return window_ratios(docs, model, curve=curve).withColumnRenamed("x", "score")
