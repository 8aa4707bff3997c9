"""Retrieval evaluation (D1-D9) and passage relevance judgements.

``passage_qrels`` finds the documents that contain a passage without a cross
join. Passages are keyed by hashed n-grams; a bit filter over these keys is
sent to the scan, so a document emits only the keys that pass it, and what is
shuffled does not grow with the documents' text. The keys found are written
once; they give each passage its rarest key, the documents holding that key,
and only those are verified with an exact substring test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bowline.config import DEFAULT_LIMITS, Limits
from bowline.functions import grams
from bowline.functions.bitfilter import bit_filter, passes
from bowline.operators.search import nearest_neighbors
from bowline.operators.train import Model
from bowline.session import materialize

SHINGLE = 4
KEY_BYTES = 8


def _passage_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, h, chars, n): the keys of every passage and the n-grams they come from.

    Three words and more: the word n-grams of the interior, whose words are whole words of any text
    that holds the passage. Fewer: the character n-grams, which may start and end inside words.
    """
    for batch in batches:
        for run in grams.runs(batch.column(1)):
            w = grams.words(run)
            rows = len(run.offs) - 1
            n_words = np.diff(w.first)
            n_of = np.minimum(n_words - 2, SHINGLE)
            for n in range(1, SHINGLE + 1):
                at, h = grams.word_grams(w, n)
                row = w.row[at]
                inner = (n_of[row] == n) & (at > w.first[row]) & (at + n < w.first[row + 1])
                yield _keys(batch, run.row + row[inner], h[inner], False, n)
            chars = np.bincount(np.searchsorted(run.offs, np.flatnonzero((run.raw & 0xC0) != 0x80), "right") - 1,
                                minlength=rows)
            for n in range(1, SHINGLE + 1):
                row, h = grams.char_grams(run, n)
                short = (n_words[row] < 3) & (np.minimum(chars[row], SHINGLE) == n)
                yield _keys(batch, run.row + row[short], h[short], True, n)


def _keys(batch: pa.RecordBatch, row: np.ndarray, h: np.ndarray, chars: bool, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), chars)),
         pa.array(np.full(len(h), n, np.int32))], names=["query_id", "h", "chars", "n"])


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (keys >> np.uint64(33)) % np.uint64(blocks)


def _probable(bc, kinds: list[tuple[bool, int]], block: int, blocks: int):
    """(doc_id, h): a document's n-grams of the given kinds that pass the filter of one block of keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bc.value
        for batch in batches:
            for part in grams.runs(batch.column(1)):
                w = grams.words(part) if any(not chars for chars, _ in kinds) else None
                for chars, n in kinds:
                    if chars:
                        row, h = grams.char_grams(part, n)
                    else:
                        at, h = grams.word_grams(w, n)
                        row = w.row[at]
                    on = passes(bits, h)
                    if blocks > 1:
                        on &= _block(h, blocks) == block
                    row, h = row[on], h[on]
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), np.bool_)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(part.row + row[new])), pa.array(h[new].view(np.int64))],
                        names=["doc_id", "h"])
    return run


def passage_hits(documents: DataFrame, keys: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(doc_id, h): which of (doc_id, text) hold which of the passages' keys, plus a few keys of no passage.

    The filter's keys are counted; beyond the limit they go out in blocks, each with a pass over the documents.
    """
    spark = documents.sparkSession
    distinct = materialize(keys.select("h").distinct(), "passage_keys")
    kinds = sorted((r["chars"], r["n"]) for r in keys.select("chars", "n").distinct().collect())  # 2 * SHINGLE at most
    blocks = max(1, -(-distinct.count() * KEY_BYTES // limits.broadcast_bytes))
    parts = []
    kind = documents.schema["doc_id"].dataType.simpleString()
    for i in range(blocks):
        of = distinct if blocks == 1 else distinct.filter(F.shiftrightunsigned("h", 33) % blocks == i)
        held = of.toArrow().column("h").to_numpy().view(np.uint64)
        bc = spark.sparkContext.broadcast(bit_filter(held))
        parts.append(documents.select("doc_id", "text").mapInArrow(_probable(bc, kinds, i, blocks), f"doc_id {kind}, h long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def passage_qrels(passages: DataFrame, documents: DataFrame,
                  p_id: str = "item_id", d_id: str = "doc_id",
                  limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(query_id, doc_id) for every document whose text contains the passage.

    Passages of 3+ words are keyed by hashed word n-grams of their interior
    (n = 4, or the interior length when shorter); shorter non-empty passages
    by hashed character n-grams (n = 4, or the passage length). A hash
    collision only adds a candidate: every candidate is verified with an
    exact substring test. An empty passage is contained everywhere, so it is
    no judgement and raises; a NULL one matches nothing.
    """
    p = passages.select(F.col(p_id).alias("query_id"), F.col("text").alias("ptext"))
    if not p.filter(F.col("ptext") == "").isEmpty():
        raise ValueError("an empty passage is contained in every document")
    d = documents.select(F.col(d_id).alias("doc_id"), F.col("text").alias("text"))
    kind = p.schema["query_id"].dataType.simpleString()
    keys = materialize(p.filter(F.col("ptext").isNotNull()).mapInArrow(
        _passage_keys, f"query_id {kind}, h long, chars boolean, n int").distinct(), "keys")
    hits = materialize(passage_hits(d, keys, limits), "hits")
    df = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    anchor = (keys.join(df, "h").groupBy("query_id").agg(F.min(F.struct("df", "h")).alias("a"))
              .select("query_id", F.col("a.h").alias("h")))
    cand = anchor.join(hits, "h").select("query_id", "doc_id")
    # documents are filtered by the candidates before any of their text moves
    pairs = materialize(cand.distinct().join(p, "query_id"), "candidates")
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("ptext") + 32), F.lit(0))).first()[0]
    pairs = F.broadcast(pairs) if size <= limits.broadcast_bytes else pairs
    if size > limits.broadcast_bytes:
        d = d.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    return (d.join(pairs, "doc_id")
            .filter(F.instr(F.col("text"), F.col("ptext")) > 0)
            .select("query_id", "doc_id").distinct())


def retrieval_ranking(queries: DataFrame, qrels: DataFrame, documents: DataFrame,
                      model: Model, k: int, q_id: str = "query_id",
                      limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """D1 + D2: (query_id, rank, doc_id, similarity, is_rel)."""
    ranked = nearest_neighbors(queries, documents, model, k, q_id=q_id, limits=limits)
    rel = qrels.select("query_id", F.col("doc_id").alias("cand_id"),
                       F.lit(1).alias("is_rel")).distinct()
    return (ranked.join(rel, ["query_id", "cand_id"], "left")
            .select("query_id", "rank", F.col("cand_id").alias("doc_id"), "similarity",
                    F.coalesce("is_rel", F.lit(0)).alias("is_rel")))


def retrieval_per_query(ranking: DataFrame, queries: DataFrame, qrels: DataFrame, k: int,
                        q_id: str = "query_id") -> DataFrame:
    """D3-D6 per query: found, precision, recall, average precision, reciprocal rank.

    AP divides by the relevant documents found (not by all relevant ones),
    as in the reference. Queries without any hit count with zeros.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = ranking.withColumn("found_so_far", F.sum("is_rel").over(w))
    per = r.groupBy("query_id").agg(
        F.sum("is_rel").alias("found"),
        F.sum(F.when(F.col("is_rel") == 1, F.col("found_so_far") / F.col("rank"))).alias("ap_sum"),
        F.min(F.when(F.col("is_rel") == 1, F.col("rank"))).alias("first_hit"))
    n_rel = qrels.select("query_id", "doc_id").distinct().groupBy("query_id") \
        .agg(F.count(F.lit(1)).alias("n_rel"))
    q = queries.select(F.col(q_id).alias("query_id"))
    found = F.coalesce("found", F.lit(0)).cast("long")
    return (q.join(per, "query_id", "left").join(n_rel, "query_id", "left")
            .select("query_id", found.alias("found"),
                    (found / F.lit(k) if k > 0 else F.lit(0.0)).cast("double").alias("precision"),
                    F.when(F.col("n_rel") > 0, found / F.col("n_rel")).otherwise(0.0).alias("recall"),
                    F.when(found > 0, F.col("ap_sum") / found).otherwise(0.0).alias("ap"),
                    F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr")))


def retrieval_metrics(per_query: DataFrame) -> DataFrame:
    """D7 + D8: means over queries and F1 of the means (NULL when no queries)."""
    m = per_query.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"),
                      F.avg("ap").alias("map"), F.avg("rr").alias("mrr"))
    f1 = F.when(F.col("p") + F.col("r") > 0,
                2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(
        F.when(F.col("p").isNotNull(), F.lit(0.0)))
    return m.select(F.col("p").alias("precision_at_k"), F.col("r").alias("recall_at_k"),
                    f1.alias("f1_score"), F.col("map").alias("mean_average_precision"),
                    F.col("mrr").alias("mean_reciprocal_rank"))


def evaluate_document_retrieval(queries: DataFrame, qrels: DataFrame, documents: DataFrame,
                                model: Model, k: int, q_id: str = "query_id") -> DataFrame:
    """D9."""
    ranking = retrieval_ranking(queries, qrels, documents, model, k, q_id)
    return retrieval_metrics(retrieval_per_query(ranking, queries, qrels, k, q_id))
