"""The prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt (``rebuild``), identical ones are grouped into one
weighted sequence with the list of its conversations, sequences that are proper
prefixes of others are told from leaves by an anti-join, and the prefixes of
the weighted sequences are aggregated into nodes (``prefix_trie``).

Turns are 16 bytes of the SHA-256 of (role, text), so texts are read once and
never shuffled. A prefix is named by a hash chained over its turns; equal
prefixes have equal names. The chain runs inside blocks of ``BLOCK`` turns, and
the block totals are chained in the same way one level up, so a conversation
of any length is spread over many tasks.

Node figures need no walk over the tree. With sequences s of weight w through a
node at depth d, and W_s(d) the words of s from depth d on:

- n_convs is the sum of w, n_leaves the number of leaf sequences;
- the words of all members below the node are the sum of w W_s(d); from these
  every distinct node's words are taken once. A node is owned by the smallest
  leaf through it, which is a stretch at the end of that leaf's path from some
  depth o, so the leaves through the node bring W_l(max(d, o_l)) each.

Scale. Sums by prefix are pre-aggregated in the tasks, so a first turn that a
third of all conversations share is one row a task. Rows of one conversation
meet its figures by (conversation, block). Children meet their parent in a
join whose hot keys AQE splits. The list of a group of copies is joined in
pieces by ranges, and only the pieces, streamed in order, meet in one task.

Nulls and edges: a null role or text is empty; a null turn comes first; equal
turns are ordered by the hash of (role, text), so repeated rows stay, one after
the other. Rows with a null conversation id belong to no conversation and are
left out. A turnless rebuilt conversation is a member of the root alone. An
empty table has no node, not even the root. Very long texts are hashed where
they are read. Only the four named columns are read, so others may have any
name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bowline.llm.tables import materialize

GROUP = 20    # conversations that share a base
SHARED = 4    # a conversation takes 0 .. SHARED - 1 turns of its base
BLOCK = 1024  # turns of a conversation that one chain runs over
PIECE = 1 << 16  # conversation ids joined into one piece of an end list
WORD = r"[^\x20\x09-\x0D]+"
KEY_BYTES = 16
ROOT = b""


# ---- rebuilding --------------------------------------------------------------

def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the role's length keeps role and text apart."""
    joined = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(joined, 256), 1, 2 * KEY_BYTES))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of every conversation within the partition, which is sorted by conversation."""
    part, held, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        n = len(conv)
        if not n:
            continue
        new = np.ones(n, np.bool_)
        new[1:] = conv[1:] != conv[:-1]
        starts = np.flatnonzero(new)
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        if conv[0] == held:
            at[:starts[1] if len(starts) > 1 else n] += count
        held, count = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(at), pa.array(np.full(n, part, np.int32))],
            names=["conv_id", "digest", "words", "at", "part"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, words): the turns of every conversation from 0.

    One range-partitioned sort; a conversation that runs over from earlier
    partitions goes on counting from their rows (one figure a partition).
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ["conv_id", "turn", "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(
        turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "digest", "words")
        .mapInArrow(_number, "conv_id long, digest binary, words long, at long, part int"), "turns")
    runs = local.groupBy("part").agg(F.min("conv_id").alias("first"),
                                     F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()
    carries, over, conv = [], 0, None
    for r in runs:
        carry = over if r["first"] == conv else 0
        if carry:
            carries.append((r["part"], r["first"], carry))
        conv = r["last"]["conv_id"]
        over = r["last"]["at"] + 1 + (carry if r["first"] == conv else 0)
    if not carries:
        return local.select("conv_id", F.col("at").alias("i"), "digest", "words")
    carried = F.broadcast(spark.createDataFrame(carries, "part int, conv_id long, carry long"))
    return local.join(carried, ["part", "conv_id"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("carry", F.lit(0))).alias("i"), "digest", "words")


def by_block(rows: DataFrame, length: str) -> DataFrame:
    """One row per block of ``length`` turns."""
    last = F.floor((F.col(length) - 1) / BLOCK).cast("long")
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def block_of(position: Column) -> Column:
    return F.floor(position / BLOCK).cast("long")


def rebuild(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation and (conv_id, depth, digest, words, last) of its rebuilt turns.

    A conversation c takes the first h = crc32(c) % shared turns of its base
    c - c % group, then its own turns after its first h.
    """
    counts = turns.groupBy("conv_id").agg((F.max("i") + 1).alias("n"))
    own = counts.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % shared).alias("h"),
                        (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"))
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = materialize(
        own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "n", "h", "taken", "length"), "conversations")
    rest = (turns.withColumn("block", block_of(F.col("i")))
            .join(by_block(convs.select("conv_id", "n", "h", "taken", "length"), "n"), ["conv_id", "block"])
            .filter("i >= h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"),
                                     "digest", "words", "length"))
    heads = turns.filter(F.col("i") < shared - 1).select(F.col("conv_id").alias("base"), "i", "digest", "words")
    first = (convs.filter("taken > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
             .join(heads, ["base", "i"])
             .select("conv_id", (F.col("i") + 1).alias("depth"), "digest", "words", "length"))
    rows = first.unionByName(rest).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return convs.select("conv_id", "length"), rows


# ---- prefix names ------------------------------------------------------------

def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chained hash, the hash before it and the words so far, anew in every block of a conversation."""
    held = None
    sha256 = hashlib.sha256
    for batch in batches:
        keys, parents, cums = [], [], []
        conv, depth, digest, words = (batch.column(k).to_pylist() for k in range(4))
        for c, d, t, w in zip(conv, depth, digest, words):
            block = (c, (d - 1) // BLOCK)
            if block != held:
                held, key, cum = block, ROOT, 0
            parents.append(key)
            key = sha256(key + t).digest()[:KEY_BYTES]
            cum += w
            keys.append(key)
            cums.append(cum)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(keys, pa.binary()),
             pa.array(parents, pa.binary()), pa.array(cums, pa.int64())],
            names=["conv_id", "depth", "words", "last", "key", "parent", "cum"])


PATHS = "conv_id long, depth long, words long, last boolean, key binary, parent binary, cum long"


def prefix_names(rows: DataFrame) -> DataFrame:
    """Rows of rebuilt conversations with the name of their prefix, that of the prefix before it and the words so far."""
    block = block_of(F.col("depth") - 1)
    paths = materialize(
        rows.select("conv_id", "depth", "digest", "words", "last").repartition("conv_id", block)
        .sortWithinPartitions("conv_id", "depth").mapInArrow(_chain, PATHS), "paths")
    deep = paths.filter(F.col("depth") > BLOCK)
    if deep.isEmpty():
        return paths
    full = paths.filter(F.col("depth") % BLOCK == 0).select(
        "conv_id", (F.col("depth") / BLOCK).cast("long").alias("depth"), F.col("key").alias("digest"),
        F.col("cum").alias("words"), F.lit(False).alias("last"))
    before = prefix_names(full).select("conv_id", F.col("depth").alias("block"), F.col("key").alias("head"),
                                       F.col("cum").alias("base"))

    def after(key: str) -> Column:
        return F.unhex(F.substring(F.sha2(F.concat("head", key), 256), 1, 2 * KEY_BYTES))

    deep = (deep.withColumn("block", block).join(before, ["conv_id", "block"])
            .withColumns({"key": after("key"), "parent": after("parent"), "cum": F.col("cum") + F.col("base")}))
    named = materialize(paths.filter(F.col("depth") <= BLOCK).unionByName(deep.drop("block", "head", "base")), "paths")
    # the first turn of a later block follows the last one of the block before
    first = (F.col("depth") > 1) & (F.col("depth") % BLOCK == 1)
    ends = named.filter(F.col("depth") % BLOCK == 0).select(
        "conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"))
    return materialize(named.filter(~first).unionByName(
        named.filter(first).drop("parent").join(ends, ["conv_id", "depth"])), "paths")


# ---- end lists ---------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([ids[0]], pa.int64()),
                                           pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        done = []
        for key, members in groupby(pairs, lambda p: p[0]):
            for _, conv in members:
                if key != held or len(ids) >= PIECE:
                    if ids:
                        done.append(piece())
                    held, ids = key, []
                ids.append(conv)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield piece()


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, state = None, None
    for batch in batches:
        keys, found = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != held:
                if held is not None:
                    keys.append(held)
                    found.append(state.hexdigest())
                held, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())],
                                         names=["key", "ends_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])],
                                         names=["key", "ends_sha256"])


def end_lists(ends: DataFrame) -> DataFrame:
    """(key, first, ids): the conversations that end at a prefix, in order, joined in pieces of up to ``PIECE``."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "conv_id"]
    return (ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .mapInArrow(_pieces, "key binary, first long, ids string"))


def end_hashes(lists: DataFrame) -> DataFrame:
    """(key, ends_sha256): the SHA-256 of every end list, its pieces streamed in order."""
    return (lists.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(_hash_lists, "key binary, ends_sha256 string"))


# ---- the trie ----------------------------------------------------------------

def weighted_sequences(convs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, conv_id) of every conversation's end, the distinct sequences).

    A sequence is (key, rep, n_convs, length, total, leaf): its smallest
    conversation, the number of them, turns, words, and whether it is no
    proper prefix of another.
    """
    turnless = convs.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv_id",
                                                 F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("cum"))
    ends = materialize(paths.filter("last").select("key", "conv_id", "depth", "cum").unionByName(turnless), "ends")
    seqs = materialize(ends.groupBy("key").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("depth").alias("length"),
        F.max("cum").alias("total")), "sequences")
    proper = paths.select(F.col("parent").alias("key")).distinct()
    leaves = materialize(seqs.join(proper, "key", "left_anti"), "leaves")
    inner = seqs.join(leaves.select("key"), "key", "left_anti")
    return ends, leaves.withColumn("leaf", F.lit(True)).unionByName(inner.withColumn("leaf", F.lit(False)))


def prefix_trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, length) and (conv_id, depth, digest, words, last).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key, parent)
    """
    spark = convs.sparkSession
    paths = prefix_names(rows)
    ends, seqs = weighted_sequences(convs, paths)
    seqs = materialize(seqs, "weighted")
    of = by_block(seqs.filter("length > 0").drop("key"), "length").withColumnRenamed("rep", "conv_id")
    kept = materialize(
        paths.withColumn("block", block_of(F.col("depth") - 1)).join(of, ["conv_id", "block"])
        .select("key", "parent", "depth", "words", "block", F.col("conv_id").alias("rep"), "n_convs", "leaf",
                (F.col("total") - F.col("cum") + F.col("words")).alias("from_here")), "weighted_paths")
    nodes = materialize(kept.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.min("rep").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner"),
        F.sum(F.col("n_convs") * F.col("from_here")).alias("all_words")), "nodes")
    owned = nodes.groupBy("owner").agg(F.min("depth").alias("owned_from"), F.max("depth").alias("length"),
                                       F.sum("words").alias("owned_words"))
    once = (kept.filter("leaf").join(by_block(owned.withColumnRenamed("owner", "rep"), "length"), ["rep", "block"])
            .groupBy("key").agg(F.sum(F.when(F.col("depth") >= F.col("owned_from"), F.col("from_here"))
                                      .otherwise(F.col("owned_words"))).alias("distinct_words")))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    hashes = materialize(end_hashes(end_lists(ends)), "end_hashes")
    empty = F.lit(hashlib.sha256().hexdigest())
    full = materialize(
        nodes.join(once, "key").join(children, "key", "left").join(hashes, "key", "left")
        .select("key", "parent", "conv_id", "depth", "n_convs", "n_leaves",
                F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                (F.col("all_words") - F.col("distinct_words")).alias("saved_tokens"),
                F.coalesce("ends_sha256", empty).alias("ends_sha256")), "trie")
    # the root is one row: figures over all sequences and all nodes
    top = seqs.agg(F.min("rep").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                   F.sum(F.col("leaf").cast("long")).alias("n_leaves")).first()
    if top["n_convs"] is None:
        return _columns(full.withColumn("parent_conv_id", F.lit(None).cast("long")))
    below = nodes.agg(F.sum(((F.col("n_convs") - 1) * F.col("words"))).alias("saved"),
                      F.sum((F.col("depth") == 1).cast("long")).alias("children")).first()
    at_root = hashes.filter(F.col("key") == F.lit(ROOT)).first()
    root = spark.range(1).select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(top["conv_id"]).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"), F.lit(top["n_convs"]).cast("long").alias("n_convs"),
        F.lit(top["n_leaves"]).cast("long").alias("n_leaves"), F.lit(below["children"] or 0).cast("long").alias("n_children"),
        F.lit(below["saved"] or 0).cast("long").alias("saved_tokens"),
        (F.lit(at_root["ends_sha256"]) if at_root else empty).alias("ends_sha256"),
        F.lit(None).cast("long").alias("parent_conv_id"))
    of_root = full.filter("depth = 1").withColumn("parent_conv_id", F.lit(top["conv_id"]).cast("long"))
    names = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rest = full.filter("depth > 1").join(names, "parent")
    return _columns(rest.unionByName(of_root).unionByName(root))


def _columns(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        "ends_sha256", "key", "parent")


def conversation_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """The prefix trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    return prefix_trie(*rebuild(numbered(conversations), group, shared))
