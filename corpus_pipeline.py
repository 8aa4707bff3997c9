"""The corpus pipeline: documents through five stages, each written and reread.

``STAGES`` lists (name, function) pairs. A function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and reread as the next
one's ``docs``. All but the last return the columns of ``documents``; only
those columns are read, so extra ones of the input are left behind.

1. language_id: documents whose language is ``und`` (no letter, or null) or
   whose score is under the cut of their length go; the model is learned from
   the stage's own input, the cuts from labelled rows left out of the fit
   (``langid.cuts``).
2. line_dedup: boilerplate lines of a source go; ``n_chars`` follows the text.
3. simhash_near_dedup: of every group of linked documents the one with the
   smallest doc_id stays (null ids first; of rows with equal ids the one whose
   columns hash lowest, of rows equal in every column one).
4. benchmark_decontamination: contaminated documents go.
5. best_fit_packing: the pieces of the remaining documents in their bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bowline.llm import decontam, langid, linededup, packing, simhash
from bowline.llm.tables import ROW, materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# packing is sequential and languages are predicted by a trained model; SQL expresses neither
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, use=langid.learnable() & ~langid.left_out())
    least = langid.least_score(langid.cuts(docs, model, langid.learnable() & langid.left_out()), F.col(f"{ROW}.text"))
    kept = langid.identify(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
    return kept.select(f"{ROW}.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.drop_lines(docs.select(*COLUMNS))
    return out.select(f"{ROW}.*", "kept_text", "n_dropped").select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    # ids may be null or repeated, so a row is named by its id and a hash of all its columns
    row = F.xxhash64(*COLUMNS)
    named = materialize(simhash.near_duplicates(
        docs.select(F.struct("doc_id", row.alias("row")).alias("id"), "text"), "id"), "near_duplicates")
    keep = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(
        F.count("*").alias("rows"))
    ids = keep.select(F.col("doc_id.doc_id").alias("keep_id"), F.col("doc_id.row").alias("keep_row"))
    kept = docs.withColumn("row", row).join(
        ids, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")),
        "left_semi").drop("row")
    # only rows that are equal in every column can still be together
    return kept if keep.filter("rows > 1").isEmpty() else kept.dropDuplicates(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontam.decontaminate(spark, docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(f"{ROW}.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
