"""Clustering evaluation.

k-means (C1) starts from hash-drawn members (C2) and repeats assign (C3) and
update (C4) until no point moves or the rounds are used up, so its answer is
reproducible and checkable. Centroids are sent in blocks that each fit the
broadcast limit; each step scores its block in row chunks and keeps the
nearest centroid so far, so points are never paired with centroids as rows,
never joined on an id, and the number of blocks does not change the answer.
A round is one pass over the written points: every point is scored under the
centroids before and after the last update, and the shuffle gets one row per
cluster and task with the vector sum, the members and the moved points. What
a round leaves behind is its centroids, written, so no state of the points is
kept and a lost executor repeats a part of one round only.
The pair-counting metrics use the contingency table only (no pair join): the
Rand index follows from sums of C(n, 2) over its cells, rows and columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bowline.config import DEFAULT_LIMITS, Limits
from bowline.functions import draws
from bowline.operators.positions import dense_positions
from bowline.operators.sums import vector_sums
from bowline.session import materialize


def initial_centroids(points: DataFrame, k: int, seed: int = 42, id_col: str = "vec_id",
                      vec_col: str = "v") -> DataFrame:
    """K distinct members chosen by hash draw (fewer when n < k), as (cluster, v)."""
    u = draws.uniform(draws.key(seed, "init", F.col(id_col)))
    picked = points.select(id_col, vec_col, u.alias("u")).orderBy("u", id_col).limit(k)
    w = Window.orderBy("u", id_col)
    return picked.select((F.row_number().over(w) - 1).cast("int").alias("cluster"),
                         F.col(vec_col).cast("array<double>").alias("v"))


_CELLS = 1 << 21  # differences that one NumPy step holds


def _squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """|x - c|^2 by direct differences (the expanded form cancels far from the origin)."""
    out = np.empty((len(x), len(centers)))
    step = max(1, _CELLS // max(1, centers.size))
    for a in range(0, len(x), step):
        diff = x[a:a + step, None, :] - centers[None, :, :]
        out[a:a + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def _nearest(bc, vec: str, dim: int):
    """Update (cluster, d) of every row with a block of centroids; ties keep the lower index."""
    def run(batches):
        labels, centers = bc.value
        for b in batches:
            names = b.schema.names
            x = b.column(names.index(vec))
            if (x.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
                raise ValueError("k-means: different dimensions")
            x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            cluster = pc.fill_null(b.column(names.index("cluster")), -1).to_numpy(zero_copy_only=False).copy()
            best = b.column(names.index("d")).to_numpy(zero_copy_only=False).copy()
            step = max(1, _CELLS // max(1, len(centers)))
            for a in range(0, len(x) if len(centers) else 0, step):
                d = _squared_distances(x[a:a + step], centers)
                at = d.argmin(axis=1)
                low = d[np.arange(len(d)), at]
                nearer = low < best[a:a + step]
                best[a:a + step][nearer] = low[nearer]
                cluster[a:a + step][nearer] = labels[at[nearer]]
            held = {"cluster": pa.array(cluster, pa.int32(), mask=cluster < 0), "d": pa.array(best)}
            yield pa.RecordBatch.from_arrays([held[c] if c in held else b.column(i) for i, c in enumerate(names)],
                                             names=names)
    return run


def _centroid_blocks(centroids: DataFrame, limits: Limits) -> tuple[int, list]:
    """(dimension, broadcast blocks of (labels, centers) in the order of their labels)."""
    size = centroids.agg(F.count(F.lit(1)).alias("k"), F.max("cluster").alias("top"),
                         F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    per_block = max(1, limits.broadcast_bytes // max(1, (size["dim"] + 1) * 8))
    blocks = []
    for lo in range(0, (size["top"] + 1) if size["k"] else 0, per_block):
        block = (centroids.filter((F.col("cluster") >= lo) & (F.col("cluster") < lo + per_block))
                 .select("cluster", F.col("v").cast("array<double>").alias("v")).orderBy("cluster").toArrow())
        if block.num_rows:
            centers = block.column("v").combine_chunks().flatten().to_numpy().reshape(block.num_rows, -1)
            blocks.append(centroids.sparkSession.sparkContext.broadcast((block.column("cluster").to_numpy(), centers)))
    return size["dim"], blocks


def _with_nearest(rows: DataFrame, dim: int, blocks: list) -> DataFrame:
    """Rows (.., v) with ``cluster``, their nearest centroid of all blocks (null without any)."""
    rows = rows.withColumns({"cluster": F.lit(None).cast("int"), "d": F.lit(float("inf"))})
    schema = rows.schema
    for bc in blocks:
        rows = rows.mapInArrow(_nearest(bc, "v", dim), schema)
    return rows.drop("d")


def assign(points: DataFrame, centroids: DataFrame, id_col: str = "vec_id",
           vec_col: str = "v", limits: Limits = DEFAULT_LIMITS, keep_vector: bool = False) -> DataFrame:
    """Nearest centroid by squared distance; ties go to the lowest index.

    With ``keep_vector`` the rows carry their vector on, as ``update`` takes it.
    """
    rows = points.select(id_col, F.col(vec_col).cast("array<double>").alias("v"))
    rows = _with_nearest(rows, *_centroid_blocks(centroids, limits))
    return rows.select(id_col, "cluster", *(["v"] if keep_vector else []))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """C4: mean per cluster and dimension of (cluster, v); an empty cluster keeps its centroid."""
    of = assigned.filter(F.col("cluster").isNotNull())
    counts = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = vector_sums(of, "cluster", "v").groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("total"))
    return (centroids.join(sums.join(counts, "cluster"), "cluster", "left")
            .select("cluster", F.coalesce(F.transform("total", lambda x: x / F.col("n")), "v").alias("v")))


def lloyd(points: DataFrame, centroids: DataFrame, rounds: int, id_col: str = "vec_id", vec_col: str = "v",
          limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """C3 + C4 repeated: the centroids after ``rounds`` assign and update steps."""
    for _ in range(rounds):
        centroids = materialize(update(assign(points, centroids, id_col, vec_col, limits, True), centroids),
                                "centroids")
    return centroids


def _round(rows: DataFrame, before: list | None, dim: int, blocks: list, centroids: DataFrame) -> DataFrame:
    """The centroids (cluster, v, moved) after one assign and update step.

    ``moved`` counts the members that were elsewhere under the ``before`` centroids; without these all
    points stand in cluster 0, as the reference starts.
    """
    if before is None:
        rows = rows.withColumn("was", F.lit(0))
    else:
        rows = _with_nearest(rows, dim, before).withColumnRenamed("cluster", "was")
    moved = (F.col("cluster") != F.col("was")).cast("double")
    step = _with_nearest(rows, dim, blocks).select("cluster", F.concat("v", F.array(F.lit(1.0), moved)).alias("v"))
    total = vector_sums(step, "cluster", "v").groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("total"))
    n, mean = F.get("total", F.lit(dim)), F.slice("total", 1, dim)
    return (centroids.select("cluster", "v").join(total, "cluster", "left")
            .select("cluster", F.coalesce(F.transform(mean, lambda x: x / n), "v").alias("v"),
                    F.coalesce(F.get("total", F.lit(dim + 1)), F.lit(0.0)).cast("long").alias("moved")))


def kmeans_rounds(points: DataFrame, k: int, max_iter: int = 100, seed: int = 42, id_col: str = "vec_id",
                  vec_col: str = "v", limits: Limits = DEFAULT_LIMITS) -> tuple[DataFrame, list[int]]:
    """((id, cluster), points moved in every round).

    Starts are C2's. A round assigns every point and updates the centroids; the last round is the
    first in which no point moves, or the ``max_iter``-th. A cluster without points keeps its centroid.
    """
    rows = materialize(points.select(id_col, F.col(vec_col).cast("array<double>").alias("v")), "points")
    centroids = materialize(initial_centroids(rows, k, seed, id_col), "centroids")
    dim, blocks = _centroid_blocks(centroids, limits)
    before, moves = None, []
    while blocks and len(moves) < max_iter:
        centroids = materialize(_round(rows, before, dim, blocks, centroids), "centroids")
        moves.append(centroids.agg(F.sum("moved")).first()[0])
        if moves[-1] == 0 or len(moves) == max_iter:
            break
        for bc in before or []:
            bc.unpersist()
        before, blocks = blocks, _centroid_blocks(centroids, limits)[1]
    if not moves and blocks:  # no round: all points stand where they start
        return rows.select(id_col, F.lit(0).alias("cluster")), moves
    return _with_nearest(rows, dim, blocks).select(id_col, "cluster"), moves


def kmeans_fit(points: DataFrame, k: int, max_iter: int = 100, seed: int = 42, id_col: str = "vec_id",
               vec_col: str = "v", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(id, cluster) of Lloyd's k-means from C2's starts to the reference's stop rule."""
    return kmeans_rounds(points, k, max_iter, seed, id_col, vec_col, limits)[0]


def label_index(labels: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Labels numbered in order of first appearance (by id)."""
    first = materialize(labels.groupBy(label_col).agg(F.min(id_col).alias("first")), "labels")
    # labels that first appear at the same id share a number
    at = dense_positions(first.select("first").distinct(), ["first"], "label_idx")
    return first.join(at, "first").select(label_col, F.col("label_idx").cast("int").alias("label_idx"))


def contingency(assignment: DataFrame, labels: DataFrame, id_col: str = "vec_id",
                label_col: str = "label") -> DataFrame:
    """(cluster, label_idx, n)."""
    li = label_index(labels, id_col, label_col)
    return (assignment.join(labels.select(id_col, label_col), id_col)
            .join(li, label_col)
            .groupBy("cluster", "label_idx").agg(F.count(F.lit(1)).alias("n")))


def _c2(x):
    return x * (x - 1) / 2.0


def cluster_scores(cont: DataFrame) -> DataFrame:
    """C7-C10 from the contingency table: purity, Rand index, the reference's
    "NMI" ((purity + rand_index) / 2) and the documented NMI (nmi_true).

    Cells, cluster totals and label totals are stacked into one table and
    reduced by a single aggregation: every metric is a function of sums of
    x, C(x, 2) and x ln x over those three groups. NULL for fewer than two
    points (the reference divides 0 by 0).
    """
    cells = cont.select(F.lit(0).alias("kind"), F.col("n").cast("double").alias("x"),
                        F.lit(None).cast("double").alias("mx"))
    rows = cont.groupBy("cluster").agg(F.sum("n").cast("double").alias("x"),
                                       F.max("n").cast("double").alias("mx")) \
        .select(F.lit(1).alias("kind"), "x", "mx")
    cols = cont.groupBy("label_idx").agg(F.sum("n").cast("double").alias("x")) \
        .select(F.lit(2).alias("kind"), "x", F.lit(None).cast("double").alias("mx"))
    x = F.col("x")

    def total(kind, expr):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, expr)), F.lit(0.0))

    xlogx = F.when(x > 0, x * F.log(x)).otherwise(0.0)
    agg = cells.unionByName(rows).unionByName(cols).agg(
        total(0, x).alias("n"), total(0, _c2(x)).alias("sc"), total(0, xlogx).alias("snl"),
        total(1, F.col("mx")).alias("correct"), total(1, _c2(x)).alias("sa"),
        total(1, xlogx).alias("sal"), total(2, _c2(x)).alias("sb"), total(2, xlogx).alias("sbl"))
    n = F.col("n")
    pairs = _c2(n)
    purity = F.when(n > 0, F.col("correct") / n)
    rand = F.when(pairs > 0, (pairs + 2 * F.col("sc") - F.col("sa") - F.col("sb")) / pairs)
    logn = F.when(n > 0, F.log(n))
    mi = (F.col("snl") + n * logn - F.col("sal") - F.col("sbl")) / n
    ha = logn - F.col("sal") / n
    hb = logn - F.col("sbl") / n
    nmi_true = F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(F.when(n > 0, F.lit(0.0)))
    return agg.select(purity.alias("purity"), rand.alias("rand_index"), nmi_true.alias("nmi_true")) \
        .select("purity", ((F.col("purity") + F.col("rand_index")) / 2).alias("normalized_mutual_information"),
                "rand_index", "nmi_true")


def evaluate_clustering(labelled: DataFrame, model, id_col: str = "doc_id",
                        label_col: str = "label", text_col: str = "text",
                        max_iter: int = 100, seed: int = 42) -> DataFrame:
    """C11: embed labelled texts, k-means with k = number of labels, score."""
    from bowline.operators.embed import embed
    k = labelled.select(label_col).distinct().count()
    emb = embed(labelled, model, id_col, text_col).withColumnRenamed("embedding", "v")
    a = kmeans_fit(emb, k, max_iter, seed, id_col, "v")
    return cluster_scores(contingency(a, labelled, id_col, label_col)) \
        .select("purity", "normalized_mutual_information", "rand_index")
