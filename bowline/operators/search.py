"""Similarity search: top-k, nearest neighbours, analogies, pair bands, recall@k (K1-K6).

Top-k never materializes (query, candidate) pairs as rows. Candidates stay
where they are read; each task scores its Arrow batches against a broadcast
block of query vectors with matrix products and keeps a running top-k per
query (ties by candidate id), so a task emits at most k rows per query. A
window then picks the final k per query after a shuffle by query id. Queries
are sent in blocks that each fit the broadcast limit; with more than one
block the candidates are written once and scanned per block. The number of
blocks does not change the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from bowline.config import DEFAULT_LIMITS, Limits
from bowline.functions import draws
from bowline.functions.vectors import NORMALIZE_EPS, add, cosine, subtract, unit_normalize
from bowline.operators.embed import embed
from bowline.operators.train import Model
from bowline.session import materialize

BAND_RUN = 1024
SCORED_ROWS = 1024  # candidates that one step scores, whatever the size of a batch
RANK_DIGITS = 9  # similarities equal to 9 digits are ties, broken by candidate id


def _schema(q: DataFrame, c: DataFrame, *, ranked: bool) -> Ty.StructType:
    """Hits keep the types of the ids."""
    rank = [Ty.StructField("rank", Ty.IntegerType())] if ranked else []
    return Ty.StructType([Ty.StructField("query_id", q.schema["query_id"].dataType)] + rank
                         + [Ty.StructField("cand_id", c.schema["cand_id"].dataType),
                            Ty.StructField("similarity", Ty.DoubleType())])


_QUERY_BYTES = 128 * 1024 * 1024  # of one block on its way through the driver


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    out = np.zeros_like(m)
    ok = n > NORMALIZE_EPS
    out[ok] = m[ok] / n[ok, None]
    return out


def _best_k(qn, c_ids, cn, k, cell_budget=1 << 20):
    """(ids, similarities), each (queries, k'): the best of one candidate chunk; ties by candidate id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, cn = c_ids[order], cn[order]
    kk = min(k, len(c_ids))
    ids, sims = [], []
    step = max(1, cell_budget // max(1, len(c_ids)))
    for a in range(0, len(qn), step):
        s = qn[a:a + step] @ cn.T
        top = _top(np.round(s, RANK_DIGITS), kk)
        ids.append(c_ids[top])
        sims.append(np.take_along_axis(s, top, axis=1))
    return np.concatenate(ids), np.concatenate(sims)


def _top(r, k):
    """Columns of the k largest values of every row, largest first; of equal ones the first columns.

    Selects by the k-th value instead of sorting the rows; only the k chosen are sorted.
    """
    n = r.shape[1]
    if k < n:
        cut = np.partition(r, n - k, axis=1)[:, n - k, None]
        more, ties = r > cut, r == cut
        chosen = more | (ties & (np.cumsum(ties, axis=1) <= k - more.sum(axis=1, keepdims=True)))
        at = np.nonzero(chosen)[1].reshape(len(r), k)
    else:
        at = np.broadcast_to(np.arange(n), r.shape)
    order = np.argsort(-np.take_along_axis(r, at, axis=1), axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1)


def _merged_k(best, new, k):
    """The best k of two (ids, similarities) pairs per query."""
    ids, sims = (np.concatenate(x, axis=1) for x in zip(best, new))
    by_id = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, by_id, axis=1), np.take_along_axis(sims, by_id, axis=1)
    top = np.argsort(-np.round(sims, RANK_DIGITS), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, top, axis=1), np.take_along_axis(sims, top, axis=1)


def _make_scorer(bc, k: int, dim: int):
    def score(batches):
        q_ids, qn = bc.value
        best = kind = None
        for batch in (b.slice(a, SCORED_ROWS) for b in batches for a in range(0, b.num_rows, SCORED_ROWS)):
            if len(q_ids) == 0:
                continue
            if batch.column(0).null_count:
                raise ValueError("candidates need ids")
            kind = batch.column(0).type
            vecs = batch.column(1)
            lens = vecs.value_lengths().to_numpy(zero_copy_only=False)
            if (lens != dim).any():
                raise ValueError("cosine: different dimensions")
            c = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            c_ids = batch.column(0).to_numpy(zero_copy_only=False)
            new = _best_k(qn, c_ids, _unit_rows(c), k)
            best = new if best is None else _merged_k(best, new, k)
        if best is not None:
            ids, sims = best
            yield pa.RecordBatch.from_arrays(
                [q_ids.take(pa.array(np.repeat(np.arange(len(q_ids)), ids.shape[1]))),
                 pa.array(ids.ravel(), kind), pa.array(sims.ravel())],
                names=["query_id", "cand_id", "similarity"])
    return score


def _final_k(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("similarity", RANK_DIGITS)), F.asc("cand_id"))
    return (hits.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "cand_id", "similarity"))


def top_k_cosine(queries: DataFrame, candidates: DataFrame, k: int,
                 q_id: str = "query_id", q_vec: str = "embedding",
                 c_id: str = "cand_id", c_vec: str = "embedding",
                 limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """K1: (query_id, rank, cand_id, similarity) — the k most cosine-similar
    candidates per query, ranked by similarity desc then candidate id; k
    larger than the candidate count returns all candidates."""
    q = queries.select(F.col(q_id).alias("query_id"), F.col(q_vec).cast("array<double>").alias("v"))
    c = candidates.select(F.col(c_id).alias("cand_id"), F.col(c_vec).cast("array<double>").alias("v"))
    if k <= 0:
        return queries.sparkSession.createDataFrame([], _schema(q, c, ranked=True))
    # the queries' vectors are computed once; their size decides the number of blocks
    q = materialize(q, "queries")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells"),
                 F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim")).first()
    n_q, dim = int(size["n"]), int(size["dim"] or 0)
    if n_q and size["low"] != dim:
        raise ValueError("cosine: different dimensions")
    blocks = max(1, -(-(size["cells"] + n_q) * 8 // min(limits.broadcast_bytes, _QUERY_BYTES)))
    blocks = min(blocks, max(1, n_q))
    if blocks > 1:
        c = materialize(c, "candidates")
    parts = []
    for i in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        block = part.toArrow().combine_chunks()
        mat = (block.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
               if block.num_rows else np.zeros((0, dim)))
        bc = q.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), _unit_rows(mat)))
        parts.append(c.mapInArrow(_make_scorer(bc, k, dim), _schema(q, c, ranked=False)))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return _final_k(hits, k)


def nearest_neighbors(queries: DataFrame, candidates: DataFrame, model: Model, k: int,
                      q_id: str = "query_id", q_text: str = "text",
                      c_id: str = "doc_id", c_text: str = "text",
                      limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """K2: embed both sides with the model, then K1."""
    qe = embed(queries, model, q_id, q_text)
    ce = embed(candidates, model, c_id, c_text)
    return top_k_cosine(qe, ce, k, q_id, "embedding", c_id, "embedding", limits)


def analogy(triples: DataFrame, candidates: DataFrame, model: Model, k: int,
            c_id: str = "doc_id", c_text: str = "text",
            limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """K3: for each (analogy_id, a, b, c) the top-k candidates for
    normalize((b - a) + c); a, b and c stay eligible as candidates."""
    rows = triples.select("analogy_id", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c"))
    done: list[str] = []
    for r in ("a", "b", "c"):  # embedded in place, one after the other: no join on the id
        rest = [f"_{x}" for x in "abc" if f"_{x}" > f"_{r}"]
        rows = embed(rows, model, "analogy_id", f"_{r}", carry=done + rest).withColumnRenamed("embedding", r)
        done.append(r)
    target = rows.select("analogy_id",
                         unit_normalize(add(subtract("b", "a"), F.col("c"))).alias("embedding"))
    ce = embed(candidates, model, c_id, c_text)
    return top_k_cosine(target, ce, k, "analogy_id", "embedding", c_id, "embedding", limits)


def banded_pairs(items: DataFrame, model: Model, width: int = 4,
                 pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """K4: similarity of every item with each of the next ``width`` items.

    Positions are cut into runs; each vector goes to its run and, where it is
    among the first ``width`` of one, also to the end of the run before. A
    window inside the run pairs it with the following items, so a vector is
    sent at most twice and no pair of runs meets.
    """
    emb = embed(items, model, pos_col, text_col).select(F.col(pos_col).cast("long").alias("pos"), "embedding")
    run = F.floor(F.col("pos") / BAND_RUN)
    runs = F.when(F.pmod("pos", F.lit(BAND_RUN)) < width, F.array(run, run - 1)).otherwise(F.array(run))
    placed = emb.select("pos", "embedding", run.alias("own"), F.explode(runs).alias("run"))
    w = Window.partitionBy("run").orderBy("pos")
    after = [F.struct(F.lead("pos", d).over(w).alias("pos"), F.lead("embedding", d).over(w).alias("e"))
             for d in range(1, width + 1)]
    pairs = placed.withColumn("after", F.array(*after)).filter("own = run").select(
        F.col("pos").alias("a_pos"), "embedding", F.explode("after").alias("b"))
    return (pairs.filter((F.col("b.pos") > F.col("a_pos")) & (F.col("b.pos") <= F.col("a_pos") + width))
            .select("a_pos", F.col("b.pos").alias("b_pos"),
                    cosine(F.col("embedding"), F.col("b.e")).alias("similarity")))


def recall_candidates(n_items: int, positions: DataFrame, every: int = 10, tail: int = 5,
                      n_neg: int = 19, seed: int = 42) -> DataFrame:
    """K5: (query_pos, cand_pos, is_positive).

    Queries are every ``every``-th position below n - tail; the positive is
    the next position; negatives are ``n_neg`` positions drawn without
    replacement, from which the query and its positive are then dropped. The
    draws are seeded; the first ``n_neg`` distinct ones count. Should the
    draws hold fewer, positions 0, 1, ... fill up, so there are always
    ``n_neg`` (or all n) of them.
    """
    q = positions.filter((F.col("pos") % every == 0) & (F.col("pos") < n_items - tail)) \
        .select(F.col("pos").alias("query_pos"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(recall_draws(n_items, n_neg) - 1)), lambda r: F.floor(
        draws.uniform(draws.key(seed, "neg", F.col("query_pos"), r)) * n_items).cast("long"))
    fill = F.sequence(F.lit(0).cast("long"), F.lit(max(0, min(n_neg, n_items) - 1)).cast("long"))
    chosen = F.slice(F.array_distinct(F.concat(drawn, fill)), 1, n_neg)
    pos = F.col("query_pos") + 1
    cands = F.concat(F.array(F.struct(pos.alias("cand_pos"), F.lit(True).alias("is_positive"))), F.transform(
        F.filter(chosen, lambda p: (p != F.col("query_pos")) & (p != pos)),
        lambda p: F.struct(p.alias("cand_pos"), F.lit(False).alias("is_positive"))))
    return q.select("query_pos", F.inline(cands))


def recall_draws(n_items: int, n_neg: int) -> int:
    """Number of draws among which ``n_neg`` distinct positions are all but certain."""
    return n_neg * (20 if n_items < 4 * n_neg else 4)


def recall_at_k(items: DataFrame, model: Model, k: int = 5, every: int = 10,
                n_neg: int = 19, seed: int = 42, pos_col: str = "pos",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """K6: (per-query hits, one-row summary). A hit is a top-k candidate whose
    text equals the positive's text; recall = hits / queries, 0.0 when none."""
    items = items.select(F.col(pos_col).cast("long").alias("pos"), F.col(text_col).alias("text"))
    n_items = items.count()
    cands = recall_candidates(n_items, items.select("pos"), every, 5, n_neg, seed)
    emb = materialize(embed(items, model, "pos", "text", carry=["text"]), "recall")
    e_q = emb.select(F.col("pos").alias("query_pos"), F.col("embedding").alias("eq"))
    e_c = emb.select(F.col("pos").alias("cand_pos"), F.col("embedding").alias("ec"), F.col("text").alias("ctext"))
    scored = (cands.join(e_q, "query_pos").join(e_c, "cand_pos")
              .withColumn("similarity", cosine(F.col("eq"), F.col("ec"))))
    w = Window.partitionBy("query_pos").orderBy(
        F.desc(F.round("similarity", RANK_DIGITS)), F.asc("cand_pos"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    pos_text = items.select(F.col("pos").alias("p_pos"), F.col("text").alias("ptext"))
    per_q = (ranked.join(pos_text, F.col("p_pos") == F.col("query_pos") + 1)
             .groupBy("query_pos")
             .agg(F.max((F.col("ctext") == F.col("ptext")).cast("int")).alias("hit")))
    summary = per_q.agg(F.count(F.lit(1)).alias("n_queries"),
                        F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"),
                        F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"))
    return per_q, summary
