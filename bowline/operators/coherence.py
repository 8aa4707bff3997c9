"""Semantic coherence (H1-H5): do related pairs score above unrelated ones?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bowline.functions.vectors import cosine
from bowline.operators.embed import embed
from bowline.operators.train import Model

# --- fixed value: a pair is predicted related above this similarity --------
RELATED_THRESHOLD = 0.5


def text_pair_similarity(pairs: DataFrame, model: Model, id_col: str = "pair_id",
                         a_col: str = "word1", b_col: str = "word2") -> DataFrame:
    """Cosine of the embeddings of two text columns, per pair row.

    Both columns are embedded in place, one after the other, and carry the
    row along: no join, so ids may have any type, repeat or be NULL.
    """
    rows = pairs.select(F.struct(*pairs.columns).alias("_pair"), F.col(a_col).alias("_a"), F.col(b_col).alias("_b"))
    rows = embed(rows, model, "_pair", "_a", carry=["_b"]).withColumnRenamed("embedding", "_ea")
    rows = embed(rows, model, "_pair", "_b", carry=["_ea"])
    return rows.select("_pair.*", cosine(F.col("_ea"), F.col("embedding")).alias("similarity"))


def coherence_metrics(scored: DataFrame, sim_col: str = "similarity",
                      related_col: str = "related") -> DataFrame:
    """H2-H4: accuracy of (sim > 0.5) == related, mean similarity of related and
    unrelated pairs (0.0 for an empty group) and their difference."""
    sim, rel = F.col(sim_col), F.col(related_col)
    m = scored.agg(
        F.coalesce(F.avg(((sim > RELATED_THRESHOLD) == rel).cast("double")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(rel, sim)), F.lit(0.0)).alias("average_related_similarity"),
        F.coalesce(F.avg(F.when(~rel, sim)), F.lit(0.0)).alias("average_unrelated_similarity"))
    return m.withColumn("contrast_score", F.col("average_related_similarity")
                        - F.col("average_unrelated_similarity"))


def evaluate_semantic_coherence(pairs: DataFrame, model: Model) -> DataFrame:
    """H5 on (pair_id, word1, word2, related)."""
    return coherence_metrics(text_pair_similarity(pairs, model))
