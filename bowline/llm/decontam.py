"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item
of fewer words is one window); a document word inside any occurrence of a
window is hit. Every window is the list of its word shingles. Shingles are
ordered by rarity over all documents; as a window must be contained whole, its
necessary prefix is its one rarest shingle. Documents are joined to the index
on that shingle, the shingle's offset gives the only possible start, length
and position bounds drop starts that do not fit the row, and the words of the
item-sized window are compared exactly.

The index is written once and sent to the tasks in blocks of at most
``BLOCK_ROWS`` windows, so its broadcast is bounded whatever the benchmark's
size; documents never move. Two narrow passes read the texts: one counts the
document frequency of the benchmark's shingles, one matches.

Nulls: a null or word-free text has no words and is never contaminated; a null
item text has no windows; a null item_id still hits words but is not listed.
Repeated documents are judged row by row, repeated items once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bowline.llm.bytetext import LOWER, gram_hashes, slices, words
from bowline.llm.tables import ROW, materialize, packed

WINDOW = 13
SHINGLE = 5
MIN_SHARE = 20  # contaminated: 20 * n_hit >= n_words
BLOCK_ROWS = 200_000

IS_WORD = np.zeros(256, np.bool_)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

WINDOW_SCHEMA = ("item string, n int, win long, words binary, "
                 "shingles array<long>, size int")


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offs in slices(batch.column(1)):
                low = LOWER[raw]
                w = words(low, offs, IS_WORD)
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                out: dict[str, list] = {k: [] for k in ("item", "n", "win", "words", "shingles", "size")}
                for r, item in enumerate(ids):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    if a == b:
                        continue
                    n = min(window, b - a)
                    size = min(shingle, n)
                    win, sh = (_signed(gram_hashes(w.hash[a:b], k)) for k in (n, size))
                    part = [low[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])]
                    for i in range(b - a - n + 1):
                        out["item"].append(item)
                        out["n"].append(n)
                        out["win"].append(int(win[i]))
                        out["words"].append(b" ".join(part[i:i + n]))
                        out["shingles"].append(sh[i:i + n - size + 1].tolist())
                        out["size"].append(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["item"], pa.string()), pa.array(out["n"], pa.int32()),
                     pa.array(out["win"], pa.int64()), pa.array(out["words"], pa.binary()),
                     pa.array(out["shingles"], pa.list_(pa.int64())), pa.array(out["size"], pa.int32())],
                    names=list(out))
    return run


class _Lookup:
    """Sorted shingle hashes of one length behind a bit filter."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(len(keys)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, np.bool_)
        self.seen[self._slot(keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return h & np.int64((1 << self.bits) - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions in h, first, last+1 in keys) of the hashes that are keys."""
        at = np.flatnonzero(self.seen[self._slot(h)])
        lo, hi = (np.searchsorted(self.keys, h[at], side) for side in ("left", "right"))
        ok = hi > lo
        return at[ok], lo[ok], hi[ok]


def _frequencies(shingles: dict[int, np.ndarray]):
    """Document frequency of the given shingles: one partial sum per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {size: _Lookup(keys) for size, keys in shingles.items()}
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in shingles.items()}
        for batch in batches:
            for _, _, raw, offs in slices(batch.column(0)):
                w = words(LOWER[raw], offs, IS_WORD)
                row = w.row_of()
                for size, look in lookups.items():
                    h = _signed(gram_hashes(w.hash, size))
                    at, lo, _ = look.find(h)
                    same = row[at] == row[at + size - 1]
                    pairs = np.unique(row[at[same]] * np.int64(len(look.keys)) + lo[same])
                    counts[size] += np.bincount(pairs % len(look.keys), minlength=len(look.keys))
        for size, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size, np.int32)), pa.array(shingles[size][at]), pa.array(c[at])],
                names=["size", "shingle", "df"])
    return run


def _blocks(df: DataFrame, rows: int) -> Iterator[DataFrame]:
    n = max(1, -(-df.count() // rows))
    block = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    for b in range(n):
        yield df if n == 1 else df.filter(block == b)


def rarity(docs: DataFrame, windows: DataFrame, text_col: str, block_rows: int) -> DataFrame:
    """(size, shingle, df) of the benchmark's shingles that documents hold."""
    distinct = materialize(windows.select("size", F.explode("shingles").alias("shingle")).distinct(),
                           "shingles")
    parts = []
    for block in _blocks(distinct, block_rows):
        t = block.toArrow().combine_chunks()
        size, key = t.column("size").to_numpy(), t.column("shingle").to_numpy()
        held = {int(s): np.sort(key[size == s]) for s in np.unique(size)}
        part = docs.select(F.col(text_col)).mapInArrow(
            _frequencies(held), "size int, shingle long, df long")
        parts.append(part.groupBy("size", "shingle").agg(F.sum("df").alias("df")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "rarity")


def build_index(docs: DataFrame, bench: DataFrame, item_col: str = "item_id", bench_text: str = "text",
                text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per benchmark window that documents may hold, keyed by its rarest shingle.

    A window with a shingle that no document holds cannot occur and is left out.
    """
    windows = materialize(
        bench.select(F.col(item_col).cast("string"), F.col(bench_text))
        .mapInArrow(_windows(window, shingle), WINDOW_SCHEMA).distinct(), "windows")
    df = rarity(docs, windows, text_col, block_rows)
    each = (windows.select("item", "n", "win", "words", "size", F.size("shingles").alias("wanted"),
                           F.posexplode("shingles").alias("off", "shingle"))
            .join(df, ["size", "shingle"]))
    best = each.groupBy("item", "n", "win", "words", "size", "wanted").agg(
        F.min(F.struct("df", "shingle", "off")).alias("rarest"),
        F.count("*").alias("found"))
    return materialize(best.filter("found = wanted").select(
        "item", "n", "win", "words", "size", F.col("rarest.shingle").alias("shingle"),
        F.col("rarest.off").alias("off")), "index")


def _match(index: pa.Table, text_col: str, spans_col: str, finish: bool):
    """Append the hit word ranges and items of one index block to every row."""
    order = np.argsort(index.column("shingle").to_numpy(), kind="stable")
    index = index.take(pa.array(order)).combine_chunks()
    ints = {k: index.column(k).to_numpy() for k in ("n", "win", "size", "shingle", "off")}
    item, text = index.column("item").to_pylist(), index.column("words").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = []
        for size in np.unique(ints["size"]):
            at = np.flatnonzero(ints["size"] == size)
            groups.append((int(size), at, _Lookup(ints["shingle"][at])))
        for batch in batches:
            held = batch.column(0)
            texts = held.field(text_col)
            if held.null_count:
                raise ValueError("a packed row is never null")
            n = len(texts)
            spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
            counts = np.zeros(n, np.int64)
            for lo, hi, raw, offs in slices(texts):
                low = LOWER[raw]
                w = words(low, offs, IS_WORD)
                counts[lo:hi] = np.diff(w.first)
                row = w.row_of()
                grams: dict[int, np.ndarray] = {}
                for size, at, look in groups:
                    h = _signed(gram_hashes(w.hash, size))
                    pos, a, b = look.find(h)
                    rep = b - a
                    pos = np.repeat(pos, rep)
                    entry = at[np.repeat(a, rep) + np.arange(len(pos)) - np.repeat(np.cumsum(rep) - rep, rep)]
                    start = pos - ints["off"][entry]
                    end = start + ints["n"][entry]
                    r = row[pos]
                    ok = (start >= w.first[r]) & (end <= w.first[r + 1])
                    start, end, entry, r = start[ok], end[ok], entry[ok], r[ok]
                    for k in np.unique(ints["n"][entry]):
                        k = int(k)
                        if k not in grams:
                            grams[k] = _signed(gram_hashes(w.hash, k))
                        of = np.flatnonzero(ints["n"][entry] == k)
                        of = of[grams[k][start[of]] == ints["win"][entry[of]]]
                        for s, e, i, d in zip(start[of].tolist(), end[of].tolist(),
                                              entry[of].tolist(), (r[of] + lo).tolist()):
                            got = b" ".join([low[x:y].tobytes() for x, y in
                                             zip(w.start[s:e].tolist(), w.end[s:e].tolist())])
                            if got == text[i]:
                                base = int(w.first[d - lo])
                                spans[d].append((s - base, e - base))
                                if item[i] is not None:
                                    items[d].add(item[i])
            if batch.num_columns > 1:
                for d, (s, i) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    spans[d] += [(x["start"], x["end"]) for x in s]
                    items[d].update(i)
            yield _out(held, spans, items, counts, finish)
    return run


def _merged(spans: list) -> list:
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


SPANS = "array<struct<start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _out(held, spans, items, counts, finish) -> pa.RecordBatch:
    spans = [_merged(s) for s in spans]
    items = [sorted(i) for i in items]
    cols = [held, pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], SPAN_TYPE),
            pa.array(items, pa.list_(pa.string()))]
    names = [ROW, "spans", "items"]
    if finish:
        hit = np.array([sum(e - s for s, e in x) for x in spans], np.int64)
        cols += [pa.array(counts), pa.array(hit),
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                 pa.array((hit > 0) & (MIN_SHARE * hit >= counts))]
        names += ["n_words", "n_hit", "items_sha256", "contaminated"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def match(docs: DataFrame, index: DataFrame, text_col: str = "text",
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` as the struct ``_row``, with its judgement beside it.

    Columns: spans (merged hit word ranges), items (sorted item ids with an
    occurring window), n_words, n_hit, items_sha256, contaminated.
    """
    row = T.StructField(ROW, docs.select(packed(docs)).schema[0].dataType, False)
    first = T.StructType([row] + T.StructType.fromDDL(f"spans {SPANS}, items array<string>").fields)
    last = T.StructType(first.fields + T.StructType.fromDDL(
        "n_words long, n_hit long, items_sha256 string, contaminated boolean").fields)
    out = docs.select(packed(docs))
    blocks = list(_blocks(index, block_rows))
    for i, block in enumerate(blocks):
        end = i == len(blocks) - 1
        out = out.mapInArrow(_match(block.toArrow(), text_col, "spans", end), last if end else first)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, bench: DataFrame, text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    return match(docs, build_index(docs, bench, text_col=text_col, window=window), text_col)
