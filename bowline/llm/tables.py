"""Reading inputs and writing intermediate tables for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bowline.session import materialize, work_path

__all__ = ["materialize", "work_path", "read", "packed"]

ROW = "_row"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so no name of an input column can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)
