"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through a no-op sink (full execution, no
collect). ``train`` trains a fresh model; later queries reuse it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["embed_documents", "nearest_neighbors", "topk_cosine", "retrieval_metrics",
            "recall_at_k", "temporal_metrics", "cluster_metrics", "stability_metrics",
            "banded_pairs", "analogy"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from bowline.plans import catalog
    from bowline.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    spark.range(1).count()  # JVM warm-up outside the timings
    times: dict[str, float] = {}
    n_docs = catalog.docs(spark, sf_dir).count()

    t = time.time()
    m = catalog.model(spark, sf_dir)
    times["train"] = round(time.time() - t, 3)

    for key in HEADLINE:
        t = time.time()
        df = catalog.QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t, 3)

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "docs": n_docs, "vocab_size": m.vocab_size,
        "train_docs_per_sec": round(n_docs / times["train"], 1) if times["train"] else None,
        "embed_docs_per_sec": round(n_docs / times["embed_documents"], 1),
    }))


if __name__ == "__main__":
    main()
