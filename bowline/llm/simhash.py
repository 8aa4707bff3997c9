"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint bit is the strict majority of that bit over the XXH64 hashes
(seed 42) of a text's word shingles, repeats included. Fingerprints within
``max_bits`` differing bits link; a document's component is the smallest id it
reaches.

Search. 64 bits are cut into ``max_bits // 2 + 1`` segments, so two linked
fingerprints have one segment that differs by at most one bit. For each bit of
each segment a variant with that bit replaced by a wildcard is indexed; linked
fingerprints share at least one variant exactly, so an equality join on the
variant finds every link, and the distance is then verified.

Scale. Everything runs on distinct fingerprints (equal ones are one node with
its smallest id). A group of near copies would give all its pairs in every
variant, so the join runs in two exact steps:

1. in every variant group each member is compared with the group's smallest
   and largest fingerprint only; verified links are joined into components;
2. a link not yet known lies between two components, so only variant groups of
   four and more that still hold more than one component are looked at, and in
   those every member is compared with the members outside the group's largest
   component, each pair in the first group that it shares.

Step 2 sees every pair of fingerprints that share a variant and are not yet in
one component, so no link between components is lost. Components grow by
alternating large-star and small-star rounds, each round written to the shared
folder. Joins are equality joins on hashed keys, split by AQE where skewed.

Nulls: a null text has no words; a text without words has fingerprint zero and
is linked like any other. A null doc_id never names a component; a component
of null ids only has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bowline.llm.tables import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BITS = 64
POSITION = 57  # a segment of up to 57 bits leaves room for a wildcard's position in one BIGINT

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_OF = (np.arange(8) * 256).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as an unsigned integer."""
    n = len(hashes)
    if n == 0:
        return 0
    held = hashes.astype("<u8").view(np.uint8).reshape(n, 8) + _BYTE_OF
    set_in = np.bincount(held.ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int.from_bytes(np.packbits((2 * set_in > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return majority(np.array([h(joined, seed)], np.uint64))
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    return majority(np.fromiter((h(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1:])),
                                np.uint64, len(parts) - shingle + 1))


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)),
                             np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp BIGINT holding the 64 unsigned bits) for every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, fp long")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, length) of the segments: linked fingerprints have one that differs by <= 1 bit."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def _signed(v: int) -> Column:
    return F.lit(v - (1 << BITS) if v >> (BITS - 1) else v).cast("long")


def _segment(bits: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(bits, first).bitwiseAND(_signed((1 << length) - 1))


def variants(fp: Column, max_bits: int) -> Column:
    """One key per bit of each segment: the segment with that bit a wildcard.

    Key: the position of the wildcard (which names the segment) above the masked segment's bits.
    """
    out = []
    for first, length in segments(max_bits):
        part = _segment(fp, first, length)
        for bit in range(length):
            masked = part.bitwiseAND(_signed(((1 << length) - 1) ^ (1 << bit)))
            out.append(masked.bitwiseOR(F.shiftleft(F.lit(first + bit).cast("long"), POSITION))
                       if length <= POSITION else F.xxhash64(F.lit(first + bit), masked))
    return F.array(*out)


def first_shared(a: Column, b: Column, max_bits: int) -> Column | None:
    """Wildcard position of the first variant that two linked fingerprints share (None: they share only one)."""
    cut = segments(max_bits)
    if len(cut) == 1:
        return None
    out = F
    for first, length in cut:
        part = _segment(a.bitwiseXOR(b), first, length)
        out = out.when(part == 0, first).when(F.bit_count(part) == 1, F.bit_count(part - 1) + first)
    return out


def star_links(index: DataFrame, max_bits: int) -> DataFrame:
    """Links of every member with the smallest and the largest fingerprint of its variant group."""
    heads = index.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    near = F.filter(F.array("lo", "hi"), lambda h: (h != F.col("fp")) & (distance(h, F.col("fp")) <= max_bits))
    return (index.join(heads, "key").withColumn("near", near).filter(F.size("near") > 0)
            .select(F.col("fp").alias("a"), F.explode("near").alias("b")).distinct())


def cross_links(index: DataFrame, comp: DataFrame, max_bits: int) -> DataFrame:
    """Every link between two components: members against those outside the largest one.

    Groups of up to three members need no look: their pairs were all compared with the two heads. A
    pair is compared in the group of the first variant that it shares.
    """
    named = (index.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .select("key", "fp", F.coalesce("root", "fp").alias("root")))
    mixed = (named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
             .filter("lo <> hi and n > 3").select("key"))
    members = materialize(named.join(mixed, "key", "left_semi"), "members")
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select(
        "key", F.col("m.root").alias("largest"))
    outside = (members.join(largest, "key").filter("root <> largest")
               .select("key", "largest", F.col("fp").alias("b"), F.col("root").alias("root_b")))
    inside = members.select("key", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    a, b = F.col("a"), F.col("b")
    wanted = ((F.col("root_a") != F.col("root_b")) & ((F.col("root_a") == F.col("largest")) | (a < b))
              & (distance(a, b) <= max_bits))
    first = first_shared(a, b, max_bits)
    if first is not None:
        wanted = wanted & (F.shiftrightunsigned(F.col("key"), POSITION) == first)
    return inside.join(outside, "key").filter(wanted).select("a", "b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over undirected links (a, b).

    Alternating stars: in a large-star every node links its larger neighbours
    to its smallest one, in a small-star its smaller ones. Both keep the
    components, and they end with every node linked to its root.
    """
    edges = materialize(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below exchanges both sides and AQE can split a hot root
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        # done when every node has one link and no node is both linked and a root
        many = small.groupBy("u").count().filter("count > 1")
        chained = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        edges = small
        if many.isEmpty() and chained.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def link_components(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, root) over distinct fingerprints ``fp``; nodes without a link are left out."""
    index = materialize(nodes.select("fp", F.explode(variants(F.col("fp"), max_bits)).alias("key")), "variants")
    first = materialize(star_links(index, max_bits), "links")
    comp = materialize(components(first), "comp")
    more = cross_links(index, comp, max_bits)
    return components(first.union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    comp = materialize(link_components(nodes, max_bits), "components")
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")
