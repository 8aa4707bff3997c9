"""Embed documents as they arrive: the batch ``embed`` operator on a stream.

Embedding is a narrow per-row map (tokenize in the JVM, one Arrow step with
the broadcast model), so it needs no state: new Parquet files under
``source`` are read incrementally and their embeddings appended to
``sink``. The checkpoint location (in the shared folder) makes the query
restartable with exactly-once file output.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from bowline.operators.embed import embed
from bowline.operators.train import Model
from bowline.session import work_path


def start_embedding_stream(spark: SparkSession, source: str, schema, model: Model, sink: str,
                           checkpoint: str | None = None, id_col: str = "doc_id",
                           text_col: str = "text", available_now: bool = False,
                           max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a query that appends (id, embedding) rows for every new document file."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source).select(id_col, text_col).filter(f"{text_col} IS NOT NULL")
    out = embed(docs, model, id_col, text_col)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or work_path(spark, "embed-stream")))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(sink)
