"""Model sink and source (S2 / S3): a folder of two Parquet tables and a JSON config."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as Ty

from bowline.config import ModelConfig
from bowline.session import work_path

VOCAB_SCHEMA = Ty.StructType([
    Ty.StructField("idx", Ty.IntegerType(), False),
    Ty.StructField("token", Ty.StringType(), False),
    Ty.StructField("token_count", Ty.LongType(), False),
    Ty.StructField("doc_freq", Ty.LongType(), False),
    Ty.StructField("idf", Ty.DoubleType(), False),
])
PROJECTION_SCHEMA = Ty.StructType([
    Ty.StructField("idx", Ty.IntegerType(), False),
    Ty.StructField("vec", Ty.ArrayType(Ty.DoubleType(), False), False),
])


def write_model(spark: SparkSession, vocab: DataFrame, config: ModelConfig,
                n_docs: int, path: str | None = None):
    """Write vocabulary, projection and config under ``path`` and load them back."""
    from bowline.operators.train import projection_rows

    path = path or work_path(spark, "model")
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    vocab_back = spark.read.parquet(f"{path}/vocabulary")
    vocab_size = vocab_back.count()
    # the vocabulary is one partition after its global index; spread the
    # (at most max_vocabulary_size) index rows so matrix rows draw in parallel
    idx_rows = vocab_back.select("idx")
    want = spark.sparkContext.defaultParallelism
    if idx_rows.rdd.getNumPartitions() < want:
        idx_rows = idx_rows.repartition(want, "idx")
    projection_rows(idx_rows, vocab_size, config) \
        .write.mode("overwrite").parquet(f"{path}/projection")
    meta = dict(config.to_dict(), n_docs=n_docs, vocab_size=vocab_size)
    spark.createDataFrame([(json.dumps(meta),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return load(spark, path)


def save(model, path: str) -> None:
    """Write a model (possibly loaded from elsewhere) to ``path``."""
    spark = model.vocabulary.sparkSession
    model.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.projection.write.mode("overwrite").parquet(f"{path}/projection")
    meta = dict(model.config.to_dict(), n_docs=model.n_docs, vocab_size=model.vocab_size)
    spark.createDataFrame([(json.dumps(meta),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str):
    """S3: read a model folder with explicit schemas."""
    from bowline.operators.train import Model

    meta = json.loads(spark.read.text(f"{path}/config").first()[0])
    config = ModelConfig.from_dict(meta)
    vocab = spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocabulary")
    proj = spark.read.schema(PROJECTION_SCHEMA).parquet(f"{path}/projection")
    return Model(config=config, vocabulary=vocab, projection=proj,
                 n_docs=int(meta["n_docs"]), vocab_size=int(meta["vocab_size"]), path=path)
