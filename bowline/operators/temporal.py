"""Temporal ordering evaluation (O1-O6) over (seq_id, pos, text) sequences.

* Consecutive pairs are an equi-join on (seq_id, pos + 1): keys are spread
  by position, so a very long sequence is not one task.
* The mean over non-consecutive pairs needs no pair rows: for unit (or zero)
  vectors u_i, the sum over all pairs i < j of u_i.u_j is
  (|sum u_i|^2 - sum |u_i|^2) / 2; subtracting the consecutive pairs leaves
  the non-consecutive sum. The vectors are summed per task before the shuffle.
* Kendall's tau compares every consecutive similarity with every
  non-consecutive one, so it needs all pair similarities; they are computed
  by matrix products, sorted in chunks and counted against the ranked
  consecutive similarities, never emitted as rows. A block of positions meets
  the half ring of blocks after it, so blocks have equal work, and the rows
  moved are n times half the number of blocks for vectors and n times the
  number of blocks for consecutive similarities.
  Similarities equal to 9 digits count as ties.
* Positions are numbered in the one range exchange that sorts the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.pandas.types import to_arrow_type

from bowline.config import DEFAULT_LIMITS, Limits
from bowline.functions.common import let
from bowline.functions.vectors import cosine_lenient, distance, norm
from bowline.operators.embed import embed
from bowline.operators.positions import numbered_in_groups
from bowline.operators.sums import vector_sums
from bowline.operators.train import Model
from bowline.session import materialize

TIE_DIGITS = 9


def sequence_embeddings(seqs: DataFrame, model: Model, seq_col: str = "seq_id",
                        pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """(seq_id, pos, embedding) with dense positions; embedded once, written for all that follows."""
    rows = seqs.select(F.col(seq_col).alias("seq_id"), F.col(pos_col).alias("pos"), F.col(text_col).alias("text"))
    e = embed(numbered_in_groups(rows, "seq_id", ["pos"]), model, "pos", "text", carry=["seq_id"])
    return materialize(e.select("seq_id", "pos", "embedding"), "sequences")


def consecutive(emb: DataFrame) -> DataFrame:
    """O1 (+ O5 input): (seq_id, pos, similarity, distance) of positions pos and pos + 1."""
    a = emb.select("seq_id", "pos", F.col("embedding").alias("ea"))
    b = emb.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("embedding").alias("eb"))
    return a.join(b, ["seq_id", "pos"]).select(
        "seq_id", "pos", cosine_lenient(F.col("ea"), F.col("eb")).alias("similarity"),
        distance(F.col("ea"), F.col("eb")).alias("distance"))


def _pair_sums(emb: DataFrame) -> DataFrame:
    """Per sequence: n, and the sum of cosines over all pairs i < j."""
    def unit(v):
        return let(norm(v), lambda m: F.transform(
            v, lambda x: F.when(m > 0.0, x / m).otherwise(F.lit(0.0))))
    u = emb.select("seq_id", unit(F.col("embedding")).alias("u"))
    own = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x)
    q = u.groupBy("seq_id").agg(F.sum(own).alias("q"))
    s = vector_sums(u, "seq_id", "u").groupBy("seq_id").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    return s.join(q, "seq_id").select("seq_id", ((F.col("s") - F.col("q")) / 2.0).alias("all_pairs_sum"))


# A sequence is cut into blocks of TAU_BLOCK positions. A task holds one block's vectors, the
# sequence's consecutive similarities (one float an item) and a chunk of the others' vectors.
TAU_BLOCK = 2048
_CELLS = 1 << 21  # similarities that one NumPy step holds


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    e = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    n = np.sqrt(np.einsum("ij,ij->i", e, e))
    return np.divide(e, n[:, None], out=np.zeros_like(e), where=n[:, None] > 0)


class _Block:
    """Concordant and discordant pairs of one block of positions, counted as the rows come in."""

    def __init__(self, key: tuple):
        self.key, self.ranks, self.own, self.counted, self.conc, self.disc = key, [], [], False, 0, 0

    def _count(self, pos: np.ndarray, u: np.ndarray, within: bool) -> None:
        own_pos, own = self.own[0]
        step = max(1, _CELLS // max(1, len(pos)))
        for a in range(0, len(own), step):
            apart = pos[None, :] - own_pos[a:a + step, None]
            apart = apart >= 2 if within else np.abs(apart) >= 2
            m = np.sort(np.round(own[a:a + step] @ u.T, TIE_DIGITS)[apart])
            self.conc += int(np.searchsorted(m, self.ranks[0], "left").sum())
            self.disc += int((len(m) - np.searchsorted(m, self.ranks[0], "right")).sum())

    def close(self) -> None:
        """All ranks and own vectors are in: join them, and count the pairs inside the block."""
        if not self.counted:
            self.counted = True
            self.ranks = [np.concatenate(self.ranks) if self.ranks else np.zeros(0)]
            if self.own and len(self.ranks[0]):
                self.own = [tuple(np.concatenate(x) for x in zip(*self.own))]
                self._count(*self.own[0], within=True)

    def add(self, kind: int, step: int, pos: np.ndarray, similarity: np.ndarray, vectors: pa.Array) -> None:
        if kind == 0:
            self.ranks.append(similarity)
        elif step == 0:
            self.own.append((pos, _unit_rows(vectors)))
        else:
            self.close()
            if len(self.ranks[0]):
                self._count(pos, _unit_rows(vectors), within=False)


def _tau_counts(kind_of: pa.DataType):
    def emitted(blocks: list[_Block]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([b.key[0] for b in blocks], kind_of), pa.array([b.conc for b in blocks], pa.int64()),
             pa.array([b.disc for b in blocks], pa.int64())], names=["seq_id", "conc", "disc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            seq = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            bi, kind, step, pos, similarity = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            keys = np.stack([seq.indices.to_numpy(), bi, kind, step])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                key = (seq.dictionary[int(keys[0, a])].as_py(), int(bi[a]))
                if block is None or block.key != key:
                    done += [block] if block else []
                    block = _Block(key)
                block.add(int(kind[a]), int(step[a]), pos[a:b], similarity[a:b], batch.column(6).slice(a, b - a))
            for d in done:
                d.close()
            if done:
                yield emitted(done)
                done = []
        if block:
            block.close()
            yield emitted([block])
    return run


def sequence_tau(emb: DataFrame, cons: DataFrame | None = None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """O3: (seq_id, kendall_tau) for sequences of 2+ items (0.0 below 3).

    ``cons`` may pass on what ``consecutive`` gives for ``emb``. Block bi of nb meets blocks bi to
    bi + nb // 2 round the ring; opposite blocks of an even ring meet in the lower one.
    """
    e = emb.select("seq_id", F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    cons = (consecutive(e) if cons is None else cons).select("seq_id", F.round("similarity", TIE_DIGITS).alias("c"))
    sizes = e.groupBy("seq_id").agg(F.floor((F.max("pos")) / TAU_BLOCK).cast("long").alias("top"))
    long = materialize(sizes.filter("top > 0").withColumn("nb", F.col("top") + 1).drop("top"), "long_sequences")
    if long.count() * 64 <= limits.broadcast_bytes:
        long = F.broadcast(long)
    nb = F.coalesce("nb", F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    ring = (e.join(long, "seq_id", "left").withColumns({"nb": nb, "b": F.floor(F.col("pos") / TAU_BLOCK).cast("long")})
            .withColumn("step", F.explode(F.sequence(zero, F.floor(F.col("nb") / 2).cast("long"))))
            .withColumn("bi", F.pmod(F.col("b") - F.col("step"), F.col("nb")))
            .filter("step = 0 or 2 * step < nb or bi < b"))
    vectors = ring.select("seq_id", "bi", F.lit(1).alias("kind"), "step", "pos", F.lit(None).cast("double").alias("c"), "embedding")
    ranks = cons.join(long, "seq_id", "left").withColumn("bi", F.explode(F.sequence(zero, nb - 1))).select(
        "seq_id", "bi", F.lit(0).alias("kind"), zero.alias("step"), zero.alias("pos"), "c",
        F.lit(None).cast("array<double>").alias("embedding"))
    rows = vectors.unionByName(ranks).repartition("seq_id", "bi").sortWithinPartitions("seq_id", "bi", "kind", "step", "c", "pos")
    counted = Ty.StructType([e.schema["seq_id"], Ty.StructField("conc", Ty.LongType()), Ty.StructField("disc", Ty.LongType())])
    counts = (rows.mapInArrow(_tau_counts(to_arrow_type(e.schema["seq_id"].dataType)), counted)
              .groupBy("seq_id").agg(F.sum("conc").alias("conc"), F.sum("disc").alias("disc")))
    both = F.col("conc") + F.col("disc")
    tau = F.when(both > 0, (F.col("conc") - F.col("disc")) / both).otherwise(0.0)
    return (counts.join(cons.select("seq_id").distinct(), "seq_id", "left_semi")
            .select("seq_id", tau.alias("kendall_tau")))


def nonconsecutive(emb: DataFrame) -> DataFrame:
    """O2 as an aggregate: (seq_id, n_pairs, mean_similarity) over pairs j >= i + 2.

    Computed from the vector sum identity, so no pair rows exist; 0.0 when a
    sequence has no such pair.
    """
    cons = consecutive(emb).groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_cons"), F.sum("similarity").alias("cons_sum"))
    n = F.col("n_cons") + 1
    n_non = ((n - 1) * (n - 2) / 2).cast("long")
    return cons.join(_pair_sums(emb), "seq_id").select(
        "seq_id", n_non.alias("n_pairs"),
        F.when(n_non > 0, (F.col("all_pairs_sum") - F.col("cons_sum")) / n_non)
        .otherwise(0.0).alias("mean_similarity"))


def sequence_metrics(emb: DataFrame) -> DataFrame:
    """O3-O5 per sequence with 2+ items: (seq_id, n, kendall_tau, correlation, average_distance)."""
    pairs = materialize(consecutive(emb), "consecutive")
    cons = pairs.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_cons"), F.sum("similarity").alias("cons_sum"),
        F.sum("distance").alias("dist_sum"))
    sums = _pair_sums(emb)
    n = F.col("n_cons") + 1
    n_non = (n - 1) * (n - 2) / 2
    non_mean = F.when(n_non > 0, (F.col("all_pairs_sum") - F.col("cons_sum")) / n_non).otherwise(0.0)
    return (cons.join(sums, "seq_id").join(sequence_tau(emb, pairs), "seq_id")
            .select("seq_id", n.cast("long").alias("n"),
                    "kendall_tau",
                    (F.col("cons_sum") / F.col("n_cons") - non_mean).alias("correlation"),
                    (F.col("dist_sum") / F.col("n_cons")).alias("average_distance")))


def temporal_metrics(per_seq: DataFrame, seqs: DataFrame, seq_col: str = "seq_id") -> DataFrame:
    """Sums over scored sequences divided by the number of all input
    sequences (sequences shorter than 2 count in the divisor only)."""
    every = seqs.select(F.col(seq_col).alias("seq_id")).distinct()
    s = every.join(per_seq, "seq_id", "left")

    def mean(c):
        return F.coalesce(F.sum(F.coalesce(c, F.lit(0.0))) / F.count(F.lit(1)), F.lit(0.0))
    return s.agg(mean(F.col("kendall_tau")).alias("kendall_tau"),
                 mean(F.col("correlation")).alias("correlation_coefficient"),
                 mean(F.col("average_distance")).alias("average_distance"))


def evaluate_temporal_ordering(seqs: DataFrame, model: Model, seq_col: str = "seq_id",
                               pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    emb = sequence_embeddings(seqs, model, seq_col, pos_col, text_col)
    return temporal_metrics(sequence_metrics(emb), seqs, seq_col)
