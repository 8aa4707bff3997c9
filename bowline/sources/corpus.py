"""Corpus sources: the text scan (S1) and the seeded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bowline.functions import draws

# The Unicode White_Space property (what str::trim removes), listed in full.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_unicode(text: Column) -> Column:
    """Strip leading/trailing White_Space; only the two ends are scanned."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores when a scan yields fewer splits than cores.

    A single-row-group Parquet file is read by one task; the CPU-heavy text
    stages after it would then run on one core. On a cluster-sized input the
    scan already has more splits than cores and this is a no-op (no shuffle).
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with NULL texts dropped, text trimmed, empty texts dropped.

    Only the two columns are selected, so the Parquet scan reads nothing else
    and the NULL filter is pushed into the scan.
    """
    return (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .filter(F.col("text").isNotNull())
            .select("doc_id", trim_unicode(F.col("text")).alias("text"))
            .filter(F.col("text") != ""))


def read_corpus(spark: SparkSession, path: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    return spread(corpus(spark.read.parquet(path), id_col, text_col))


def sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """A seeded random sample of n rows (a shuffle-and-take).

    Each row gets a hash draw of its id; the n smallest draws win
    (TakeOrderedAndProject: every partition keeps n rows, one merge).
    The limit is the feature here.
    """
    u = draws.uniform(draws.key(seed, "sample", F.col(id_col)))
    return (df.withColumn("sample_key", u)
            .orderBy("sample_key", id_col).limit(n))
