"""Target-distribution importance resampling over hashed n-gram features.

Features of a text are its runs of ``min_n`` to ``max_n`` consecutive words,
repeats counted; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. A bucket's gain is the log-ratio of its smoothed share in the
target texts to its share in the raw ones, in thousandths; a row's weight is
the mean gain of its features. A Gumbel draw, keyed by ``seed`` and the row's
id, is added, so that the highest scores are a sample without replacement in
proportion to exp(weight).

Interning. Each run of rows is one UTF-8 buffer of words joined by single
spaces, in which a feature is a byte range. An open-addressed NumPy table
takes the features of the run: XXH64 keys, probed linearly, and every hit is
verified byte by byte, so two features share a slot only if they are equal.
A slot stores its feature's bucket and count. CRC-32 is taken once per slot;
counting adds slot counts by bucket; scoring gathers gains through the slot
ids of the occurrences.

Scale. A task sums its bucket counts over all its rows and emits them once, so
the shuffle gets at most ``buckets`` rows a task. Gains are ``buckets`` rows
and go to the tasks whole (their number is a parameter). Every text is read
twice and never shuffled. The cut score comes from a histogram of scores,
whose number of distinct values is bounded by the range of log-ratios and
Gumbel draws and not by the rows. Only rows at or above the cut are numbered,
by a range-partitioned sort with per-partition offsets; equal rows are one
counted row meanwhile, so no number of repeats lands in one task.

Nulls and edges: a null text has no words; a row without features has weight
0. A null id is drawn with the empty string for its id and comes after all
others among ties. Rows with equal ids and scores are ordered by weight, then
number of features; rows equal in all of these get consecutive ranks. An empty
table gives an empty result; without target texts all gains follow the
smoothing alone. Very long texts are one run of their own and are never cut.
Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bowline.llm.bytetext import LOWER, Words, slices, words
from bowline.llm.tables import materialize

MIN_N = 1
MAX_N = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
SHORT = 32  # XXH64 has one form under 32 bytes, another from there on
EXPAND = 1 << 16  # equal rows written out per row of the expansion

IS_WORD = np.zeros(256, np.bool_)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def compact(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, Words]:
    """(buffer, words): every word of the rows, lower-cased, followed by one space; words point into it."""
    low = LOWER[raw]
    w = words(low, offs, IS_WORD)
    length = w.end - w.start
    begin = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 0x20, np.uint8)
    at = np.flatnonzero(IS_WORD[low])
    out[at + np.repeat(begin - w.start, length)] = low[at]
    return out, Words(begin, begin + length, w.hash, w.first)


def features(w: Words, min_n: int, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of all runs of min_n to max_n words that lie inside a row."""
    row = w.row_of()
    parts = []
    for n in range(min_n, max_n + 1):
        count = max(len(row) - n + 1, 0)
        first = np.flatnonzero(row[:count] == row[n - 1:n - 1 + count])
        parts.append((row[first], w.start[first], w.end[first + n - 1] - w.start[first]))
    row, start, length = (np.concatenate(p) for p in zip(*parts))
    return row, start, length


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _words64(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one integer (zeros past the end)."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of byte ranges; ranges under 32 bytes in one vectorised pass."""
    eight = _words64(buf)
    h = P5 + length.astype(np.uint64)
    at, left = start.copy(), length.copy()
    for _ in range(SHORT // 8 - 1):
        on = left >= 8
        if not on.any():
            break
        lane = _rotl(eight[at[on]] * P2, 31) * P1
        h[on] = _rotl(h[on] ^ lane, 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = left >= 4
    h[on] = _rotl(h[on] ^ ((eight[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = left >= 1
        h[on] = _rotl(h[on] ^ ((eight[at[on]] & np.uint64(0xFF)) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= SHORT):
        h[i] = xxhash.xxh64_intdigest(buf[start[i]:start[i] + length[i]].tobytes())
    return h


def equal(buf: np.ndarray, eight: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether byte ranges (a, la) and (b, lb) hold the same bytes, pair by pair."""
    same = la == lb
    for k in range(0, SHORT, 8):
        on = np.flatnonzero(same & (la > k))
        if not len(on):
            return same
        tail = np.minimum(la[on] - k, 8).astype(np.uint64)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - tail * np.uint64(8))
        same[on] = ((eight[a[on] + k] ^ eight[b[on] + k]) & keep) == 0
    for i in np.flatnonzero(same & (la > SHORT) & (a != b)):
        same[i] = np.array_equal(buf[a[i] + SHORT:a[i] + la[i]], buf[b[i] + SHORT:b[i] + lb[i]])
    return same


class Interned:
    """The distinct features of one run of rows: ``slot`` of every occurrence, ``bucket`` and ``count`` of every slot."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int,
                 keys: np.ndarray | None = None):
        keys = xxh64(buf, start, length) if keys is None else keys
        eight = _words64(buf)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        mask = np.uint64(size - 1)
        held = np.full(size, -1, np.int64)  # occurrence that stands for a slot
        at, left = (keys & mask).astype(np.int64), np.arange(len(keys))
        self.slot = np.empty(len(keys), np.int64)
        while len(left):
            free = held[at] < 0
            held[at[free]] = left[free]  # of several on one slot the last stays
            other = held[at]
            same = keys[other] == keys[left]
            i, o = left[same], other[same]
            same[same] = equal(buf, eight, start[i], length[i], start[o], length[o])
            self.slot[left[same]] = at[same]
            left, at = left[~same], (at[~same] + 1) & (size - 1)
        used = np.flatnonzero(held >= 0)
        text = buf.tobytes()
        self.bucket = np.zeros(size, np.int64)
        self.bucket[used] = [zlib.crc32(text[s:e]) % buckets for s, e in
                             zip(start[held[used]].tolist(), (start + length)[held[used]].tolist())]
        self.count = np.bincount(self.slot, minlength=size)


def _bucket_counts(buckets: int, min_n: int, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offs in slices(batch.column(0)):
                buf, w = compact(raw, offs)
                _, start, length = features(w, min_n, max_n)
                table = Interned(buf, start, length, buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])
    return run


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, min_n: int = MIN_N,
                  max_n: int = MAX_N) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; buckets without any are left out."""
    return (rows.select(F.col(text_col).alias("text")).mapInArrow(_bucket_counts(buckets, min_n, max_n),
                                                                "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the two tables of bucket counts."""
    raw, target = materialize(raw, "raw_buckets"), materialize(target, "target_buckets")

    def total(counts: DataFrame) -> int:
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    ratio = ((t + 1).cast("double") * F.lit(float(total(raw) + buckets))
             / ((s + 1).cast("double") * F.lit(float(total(target) + buckets))))
    return (raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
            .select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")))


def _weights(bc, buckets: int, min_n: int, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = bc.value
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, raw, offs in slices(batch.column(1)):
                buf, w = compact(raw, offs)
                row, start, length = features(w, min_n, max_n)
                table = Interned(buf, start, length, buckets)
                n_words[lo:hi] = np.diff(w.first)
                n_features[lo:hi] = np.bincount(row, minlength=hi - lo)
                np.add.at(total[lo:hi], row, gain[table.bucket][table.slot])
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(id_col: Column, seed: str = SEED) -> Column:
    """A Gumbel draw in thousandths, fixed by the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          target_col: str = "text", buckets: int = BUCKETS, min_n: int = MIN_N, max_n: int = MAX_N,
          seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``."""
    table = gains(bucket_counts(docs, text_col, buckets, min_n, max_n),
                  bucket_counts(target, target_col, buckets, min_n, max_n), buckets).orderBy("bucket").toArrow()
    bc = docs.sparkSession.sparkContext.broadcast(table.column("gain").to_numpy())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_weights(bc, buckets, min_n, max_n),
                          f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add (part, before): the partition and the rows that stand before in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(batch.num_columns - 1).to_numpy()
        ends = np.cumsum(n) + before
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
            names=[*batch.schema.names, "part", "before"])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their 1-based place in ``order``; rows equal in every column share no place.

    Equal rows are counted first, the counted rows are sorted by ranges, and
    each range starts where the ones before it end.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", part int, before long"
    placed = materialize(counted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .mapInArrow(_numbered, schema), "ranked")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, _start long"))
    first = F.col("_start") + F.col("before")
    rows_of = placed.join(starts, "part").withColumn("_first", first)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EXPAND)))
    cut = rows_of.withColumn("_piece", piece)
    upto = F.least(F.col("n"), (F.col("_piece") + 1) * EXPAND)
    one = F.explode(F.sequence(F.col("_piece") * EXPAND, upto - 1))
    return cut.withColumn("_one", one).select(*rows.columns, (F.col("_first") + F.col("_one") + 1).alias(name))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every scored row; rank is null unless the row is drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn (rounded down).
    """
    scored = materialize(scored, "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    may = F.col("n_words") >= least_words
    counts = scored.filter(may).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    wanted = percent * sum(r["n"] for r in counts) // 100
    cut, held = None, 0
    for r in counts:
        if held >= wanted:
            break
        cut, held = r["score"], held + r["n"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*out, none)
    high = may & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    top = ranked(scored.filter(high).select(*out), order)
    return (top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
            .unionByName(scored.filter(~high).select(*out, none)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, **features_of) -> DataFrame:
    """Score every row of ``docs`` against the texts of ``target`` and draw the sample."""
    return draw(score(docs, target, id_col, text_col, **features_of), percent, least_words)
