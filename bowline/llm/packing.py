"""Conflict-constrained best-fit packing of documents into fixed-size bins.

A document of ``n`` words is cut into pieces of ``capacity`` words; full pieces
fill a bin each, the rest is packed best-fit in decreasing length. No bin holds
two pieces of one source or of one duplicate cluster. Open bins are kept in
order of their residual; each carries a bitmap of its sources and one of its
duplicate clusters. The search starts at the successor of the piece's length
and goes on until the tightest bin whose bitmaps are disjoint from the piece's.
If no bin is compatible a new one is opened.

Packing is sequential by nature, so documents are dealt by hash into shards of
about ``SHARD_ROWS`` rows, packed one by one as Arrow groups of a few numbers
per document; texts never move. The number of shards grows with the rows, and a
shard that a repeated id makes larger is packed in further runs of that size,
so a task's work is bounded. Hashing spreads hot sources and clusters evenly.

Nulls: a null or blank text has length 0 and takes no bin (a row with a null
bin). A null source or cluster conflicts with nothing. Rows with equal ids are
packed as documents of their own. Ties in length go by id, then cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 4096
BLANKS = " \t\n\r\x0b\x0c"


def words_of(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(BLANKS)), r"[ \t\n\r\x0B\f]+")


def word_count(text: Column) -> Column:
    blank = text.isNull() | (F.btrim(text, F.lit(BLANKS)) == "")
    return F.when(blank, 0).otherwise(F.size(words_of(text))).cast("long")


def copy_cluster(text: Column) -> Column:
    """Cluster of texts with equal lower-cased words."""
    return F.when(text.isNotNull(), F.xxhash64(words_of(text)))


def _bits(values: list) -> list[int]:
    """A bitmap with one bit per distinct value; values that occur once need none."""
    at: dict = {}
    for v in values:
        if v is not None:
            at[v] = at.get(v, 0) + 1
    bit = {v: 1 << i for i, v in enumerate(v for v, n in at.items() if n > 1)}
    return [bit.get(v, 0) for v in values]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin number of every piece, given in decreasing length (each at most ``capacity``)."""
    source_bits, cluster_bits = _bits(sources), _bits(clusters)
    held_sources: list[int] = []
    held_clusters: list[int] = []
    order: list[tuple[int, int]] = []  # (residual, bin)
    out = []
    for length, s, c in zip(lengths, source_bits, cluster_bits):
        at = bisect_left(order, (length, -1))
        while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            held_sources[b] |= s
            held_clusters[b] |= c
        else:
            residual, b = capacity, len(held_sources)
            held_sources.append(s)
            held_clusters.append(c)
        if residual > length:
            insort(order, (residual - length, b))
        out.append(b)
    return out


def _pack_shard(capacity: int, shard_rows: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "descending"), ("doc_id", "ascending"), ("cluster", "ascending")])
        rows, pieces, starts, sizes, bins = [], [], [], [], []
        opened = 0
        for lo in range(0, group.num_rows, shard_rows):
            part = group.slice(lo, shard_rows)
            n = part.column("n").to_numpy()
            full, rest = n // capacity, n % capacity
            for r in np.flatnonzero(full).tolist():
                k = int(full[r])
                rows += [lo + r] * k
                pieces += range(k)
                starts += range(0, k * capacity, capacity)
                sizes += [capacity] * k
                bins += range(opened, opened + k)
                opened += k
            of = np.flatnonzero(rest)
            of = of[np.argsort(-rest[of], kind="stable")]
            source, cluster = (part.column(c).take(pa.array(of)).to_pylist() for c in ("source", "cluster"))
            got = best_fit(rest[of].tolist(), source, cluster, capacity)
            rows += (lo + of).tolist()
            pieces += full[of].tolist()
            starts += (full[of] * capacity).tolist()
            sizes += rest[of].tolist()
            bins += [opened + b for b in got]
            opened += max(got, default=-1) + 1
            none = np.flatnonzero(n == 0)
            rows += (lo + none).tolist()
            pieces += [0] * len(none)
            starts += [0] * len(none)
            sizes += [0] * len(none)
            bins += [None] * len(none)
        shard = group.column("shard")[0].as_py()
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array(rows, pa.int64())),
            "piece": pa.array(pieces, pa.int64()), "first_word": pa.array(starts, pa.int64()),
            "n_words": pa.array(sizes, pa.int64()),
            "bin_id": pa.array([None if b is None else f"{shard}-{b}" for b in bins], pa.string())})
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         capacity: int = CAPACITY, length: Column | None = None, cluster: Column | None = None,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin_id): one row per piece of every document."""
    text = F.col(text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                      (word_count(text) if length is None else length).alias("n"),
                      (copy_cluster(text) if cluster is None else cluster).alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    src = src.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.groupBy("shard").applyInArrow(
        _pack_shard(capacity, shard_rows),
        f"doc_id {kind}, piece long, first_word long, n_words long, bin_id string")
