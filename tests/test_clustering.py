"""k-means to its stop rule against a plain NumPy loop."""

import hashlib

import numpy as np
import pytest

from bowline.config import Limits
from bowline.operators.clustering import assign, kmeans_fit, kmeans_rounds

POINTS = "vec_id long, v array<double>"


def draw(seed, i):
    return int(hashlib.md5(f"{seed}|init|{i}".encode()).hexdigest()[:8], 16)


def brute(points, k, max_iter, seed=42):
    order = sorted(range(len(points)), key=lambda i: (draw(seed, points[i][0]), points[i][0]))
    x = np.array([v for _, v in points])
    centers = x[order[:k]].copy()
    labels, moves = np.zeros(len(x), int), []
    for _ in range(max_iter):
        now = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moves.append(int((now != labels).sum()))
        labels = now
        for c in range(len(centers)):
            if (labels == c).any():
                centers[c] = x[labels == c].mean(axis=0)
        if moves[-1] == 0:
            break
    return {points[i][0]: int(labels[i]) for i in range(len(x))}, moves


def cloud(n=240, seed=5, dim=3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, dim)) * 4
    return [(i * 3 - 7, (centers[i % 5] + r.normal(size=dim) * 1.5).tolist()) for i in range(n)]


@pytest.mark.parametrize("max_iter", [0, 1, 2, 100])
def test_rounds_and_moves(spark, max_iter):
    points = cloud()
    got, moves = kmeans_rounds(spark.createDataFrame(points, POINTS).repartition(5), 5, max_iter)
    want, want_moves = brute(points, 5, max_iter)
    assert moves == want_moves and {r["vec_id"]: r["cluster"] for r in got.collect()} == want
    if max_iter == 100:
        assert moves[-1] == 0 and 2 < len(moves) < 100


def test_centroid_blocks_change_nothing(spark):
    points = cloud(100, 9)
    df = spark.createDataFrame(points, POINTS)
    a, b = (kmeans_rounds(df, 7, limits=limits) for limits in (Limits(), Limits(broadcast_bytes=70)))
    assert a[1] == b[1] and sorted(a[0].collect()) == sorted(b[0].collect())


def test_more_clusters_than_points_one_cluster_and_copies(spark):
    points = [(i, [float(i % 3), 0.0]) for i in range(9)]
    df = spark.createDataFrame(points, POINTS)
    for k in (1, 3, 9, 20):
        got, moves = kmeans_rounds(df, k)
        want, want_moves = brute(points, k, 100)
        assert {r["vec_id"]: r["cluster"] for r in got.collect()} == want and moves == want_moves
    assert kmeans_rounds(df, 1)[1] == [0]


def test_empty_and_repeated_ids(spark):
    assert kmeans_fit(spark.createDataFrame([], POINTS), 3).collect() == []
    rows = [(1, [0.0]), (1, [0.1]), (None, [9.0]), (2, [9.1])]
    got = kmeans_fit(spark.createDataFrame(rows, POINTS), 2).collect()
    assert len(got) == 4 and len({r["cluster"] for r in got}) == 2


def test_fit_is_a_fixed_point(spark):
    points = spark.createDataFrame(cloud(150, 2), POINTS)
    fitted = {r["vec_id"]: r["cluster"] for r in kmeans_fit(points, 4).collect()}
    by = {}
    for i, v in cloud(150, 2):
        by.setdefault(fitted[i], []).append(v)
    means = spark.createDataFrame([(c, np.mean(v, axis=0).tolist()) for c, v in by.items()], "cluster int, v array<double>")
    assert {r["vec_id"]: r["cluster"] for r in assign(points, means).collect()} == fitted
