import tempfile

import numpy as np

from bowline.config import ModelConfig
from bowline.operators.embed import embed
from bowline.operators.train import train
from bowline.streaming.embed_stream import start_embedding_stream


def test_stream_embeddings_equal_batch(spark):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = train(src, ModelConfig(embedding_dim=16, max_vocabulary_size=2000))
    base = tempfile.mkdtemp(prefix="bowline-stream-")
    src.filter("doc_id % 2 = 0").write.parquet(f"{base}/in/part=0")
    src.filter("doc_id % 2 = 1").write.parquet(f"{base}/in/part=1")
    q = start_embedding_stream(spark, f"{base}/in/*", src.schema, model, f"{base}/out",
                               checkpoint=f"{base}/ckpt", available_now=True, max_files_per_trigger=1)
    q.awaitTermination(600)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{base}/out").collect()}
    want = {r["doc_id"]: np.array(r["embedding"]) for r in embed(src, model).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
