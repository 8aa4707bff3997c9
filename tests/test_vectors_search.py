import numpy as np
import pytest
from pyspark.sql import functions as F

from bowline.config import Limits
from bowline.functions import vectors as V
from bowline.operators.positions import dense_positions
from bowline.operators.search import top_k_cosine


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 0.0])],
                               "a array<double>, b array<double>")
    r = df.select(V.unit_normalize(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c"),
                  V.distance(F.col("a"), F.col("b")).alias("d"), V.add(F.col("a"), F.col("b")).alias("s"),
                  V.subtract(F.col("a"), F.col("b")).alias("m"), V.scale(F.col("a"), 2.0).alias("x")).collect()
    m = np.sqrt(14.0)
    assert np.allclose(r[0]["n"], [1 / m, 2 / m, 3 / m])
    assert abs(r[0]["c"] - 1 / m) < 1e-12 and r[1]["c"] == 0.0
    assert abs(r[0]["d"] - np.sqrt(13.0)) < 1e-12
    assert r[0]["s"] == [2.0, 2.0, 3.0] and r[0]["m"] == [0.0, 2.0, 3.0] and r[0]["x"] == [2.0, 4.0, 6.0]
    assert r[1]["n"] == [0.0, 0.0, 0.0]


def test_cosine_orthogonal_and_dim_mismatch(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    bad = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        bad.select(V.cosine(F.col("a"), F.col("b"))).collect()
    assert abs(bad.select(V.cosine_lenient(F.col("a"), F.col("b"))).first()[0]) < 1e-12


def _brute_topk(q, c, k):
    out = {}
    for qi, qv in q.items():
        sims = []
        for ci, cv in c.items():
            nq, nc = np.linalg.norm(qv), np.linalg.norm(cv)
            s = float(qv @ cv / (nq * nc)) if nq > 1e-10 and nc > 1e-10 else 0.0
            sims.append((-round(s, 9), ci, s))
        out[qi] = [(ci, s) for _, ci, s in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=100)])
def test_top_k_matches_brute_force(spark, limits):
    rng = np.random.default_rng(3)
    cand = {i: rng.normal(size=5) for i in range(40)}
    cand[40] = cand[3].copy()          # exact tie, broken by id
    cand[41] = np.zeros(5)             # zero vector
    qs = {i: rng.normal(size=5) for i in range(7)}
    cdf = spark.createDataFrame([(k, v.tolist()) for k, v in cand.items()], "cand_id long, embedding array<double>")
    qdf = spark.createDataFrame([(k, v.tolist()) for k, v in qs.items()], "query_id long, embedding array<double>")
    for k in (1, 5, 100):
        got = {}
        for r in top_k_cosine(qdf, cdf.repartition(3), k, limits=limits).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["cand_id"], r["similarity"]))
        want = _brute_topk(qs, cand, k)
        for qi in qs:
            g = sorted(got[qi])
            assert [c for _, c, _ in g] == [c for c, _ in want[qi]]
            assert np.allclose([s for *_, s in g], [s for _, s in want[qi]])


def test_dense_positions(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "g long, v long").repartition(5)
    rows = dense_positions(df, ["g", "v"]).collect()
    got = sorted((r["pos"], r["g"], r["v"]) for r in rows)
    want = sorted((g, v) for g, v in [(i % 7, i) for i in range(200)])
    assert [p for p, _, _ in got] == list(range(200))
    assert [(g, v) for _, g, v in got] == want


def test_dense_positions_keeps_null_keys_and_spread_input(spark):
    rows = [(None if i == 5 else i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    got = sorted((r["pos"], r["k"]) for r in dense_positions(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(50))
    assert got[0][1] is None                         # NULL sorts first


def test_dense_positions_need_unique_keys(spark):
    with pytest.raises(ValueError, match="not unique"):
        dense_positions(spark.createDataFrame([(1, "a"), (1, "b")], "k long, t string"), ["k"])


@pytest.mark.parametrize("n", [1, 3, 1023, 1030, 2060])
def test_bands_across_runs(spark, n):
    from bowline.config import ModelConfig
    from bowline.operators.search import banded_pairs
    from bowline.operators.train import train
    items = spark.range(n).selectExpr("id as pos", "concat('word', id % 7) as text")
    m = train(items.selectExpr("pos as doc_id", "text").limit(50), ModelConfig(embedding_dim=4, min_token_frequency=1))
    got = sorted((r["a_pos"], r["b_pos"]) for r in banded_pairs(items, m, 4).collect())
    assert got == [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 5))]


def test_vector_sums(spark):
    from bowline.operators.sums import vector_sums
    rows = [("a", 2.0, [1.0, 2.0]), ("b", 1.0, [5.0, 5.0]), ("a", 1.0, [0.0, 1.0]), (None, 3.0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, w double, v array<double>").repartition(3)
    got = {(r["k"], r["dim"]): r["x"] for r in vector_sums(df, "k", "v", F.col("w")).collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 5.0, ("b", 0): 5.0, ("b", 1): 5.0, (None, 0): 3.0, (None, 1): 3.0}


def test_numbered_in_groups(spark):
    from bowline.operators.positions import numbered_in_groups
    r = np.random.default_rng(3)
    rows = [("hot", i, f"t{i}") for i in range(3000)] + [(f"g{k}", int(v), "x") for k in range(50) for v in r.permutation(200)[:k]]
    rows += [(None, 1, "n"), (None, None, "n"), ("hot", None, "null first")]
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "g string, o long, t string").repartition(7)
    got = numbered_in_groups(df, "g", ["o"], "at").collect()
    want = {}
    for g, o, t in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0)):
        want.setdefault(g, []).append((o, t))
    assert sorted((str(x["g"]), x["at"], x["o"] or -1, x["t"]) for x in got) == sorted(
        (str(g), i, o or -1, t) for g, xs in want.items() for i, (o, t) in enumerate(xs))
    with pytest.raises(ValueError):
        numbered_in_groups(df.union(df.limit(1)), "g", ["o"])
    assert numbered_in_groups(df.limit(0), "g", ["o"]).collect() == []


def test_numbering_moves_a_row_once(spark):
    """One exchange of whole rows; nothing is joined back but one figure a partition."""
    from bowline.operators.positions import numbered_in_groups
    df = spark.createDataFrame([(i // 100, i, "text") for i in range(1000)], "g long, o long, t string")
    plan = numbered_in_groups(df, "g", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_selection_equals_a_stable_sort():
    from bowline.operators.search import _top
    r = np.random.default_rng(5)
    for n, k in ((1, 1), (7, 3), (50, 5), (50, 50), (200, 17)):
        x = r.integers(0, 9, size=(40, n)) / 4.0
        assert (_top(x, k) == np.argsort(-x, axis=1, kind="stable")[:, :k]).all()


def test_scoring_holds_a_bounded_part_of_a_batch():
    """A large batch of candidates is scored in parts: the working memory is far below the batch's."""
    import tracemalloc
    from types import SimpleNamespace
    import pyarrow as pa
    from bowline.operators.search import _make_scorer, _unit_rows
    r = np.random.default_rng(2)
    x, q = r.normal(size=(20_000, 128)), r.normal(size=(200, 128))
    vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 128, dtype=np.int32)), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), vecs], names=["cand_id", "v"])
    score = _make_scorer(SimpleNamespace(value=(pa.array(np.arange(200)), _unit_rows(q))), 3, 128)
    tracemalloc.start()
    (out,) = score([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20, peak
    want = np.argsort(-np.round(_unit_rows(q) @ _unit_rows(x).T, 9), axis=1, kind="stable")[:, :3]
    assert (out.column(1).to_numpy().reshape(200, 3) == want).all()
