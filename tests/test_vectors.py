"""Nearest vectors against all pairs."""

import numpy as np
import pytest

from fundloom.operators import vectors


@pytest.mark.parametrize("block,least", [(4096, -1.0), (37, 0.8)])
def test_top_k_against_all_pairs(spark, monkeypatch, block, least):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + 0.15 * rng.normal(size=(500, 16)), np.tile(centres[0], (200, 1)), rng.normal(size=(60, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "1 as u", "2 as cell", "3 as score")
    queries = df.where("vec_id % 3 = 0 or vec_id = 5001")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.vector_top_k(df, queries, 4, least, n_pivots=20).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for i in range(0, len(x), 3):
        s = np.round(u @ u[i], vectors.DIGITS)
        best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i and s[j] >= least][:4]
        want += [(i, k, int(j), round(float(s[j]), 4)) for k, j in enumerate(best, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


def test_cells_are_left_out(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    x = np.concatenate([c + 0.01 * rng.normal(size=(30, 8)) for c in centres])
    pivots = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    held = vectors.celled(vectors.unit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id"), "vec_id", pivots)
    radius = np.array([r["r"] for r in held.groupBy("cell").agg({"d": "max"}).withColumnRenamed("max(d)", "r").orderBy("cell").collect()])
    queries = held.selectExpr("vec_id as query_id", "u", "cell", "0.05D as tau")
    assert vectors.in_reach(queries, pivots, radius).count() < 0.02 * 900 * 30


def test_without_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.vector_top_k(none, none).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vectors.vector_top_k(one, one).count() == 0 and vectors.vector_top_k(one, none).count() == 0
