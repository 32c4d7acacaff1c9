"""The cosine join of two large sides against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import joins, pivots
from terrace.operators.windows import kept


def clustered(n, dims, seed, centres=12, spread=0.1):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} int, vector array<double>").repartition(3)


def unit(v):
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


@pytest.mark.parametrize("threshold", [0.97, 0.5, 0.0])
@pytest.mark.parametrize("kind", ["clustered", "even", "equal"])
def test_all_pairs_are_found(spark, monkeypatch, threshold, kind):
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 16)
    monkeypatch.setattr(pivots, "PIVOTS", 20)
    if kind == "clustered":
        a, b = clustered(150, 8, 1), clustered(170, 8, 2)
    elif kind == "even":
        a, b = np.random.default_rng(3).normal(size=(120, 3)), np.random.default_rng(4).normal(size=(130, 3))
    else:
        a, b = np.ones((90, 4)), np.concatenate([np.ones((80, 4)), -np.ones((5, 4))])
    a, b = np.concatenate([a, np.zeros((2, a.shape[1]))]), np.concatenate([b, np.zeros((2, b.shape[1]))])
    found = joins.similar_pairs(frame(spark, a, "i"), frame(spark, b, "j"), threshold, "i", "j")
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    sim = unit(a) @ unit(b).T
    got = {(r.i, r.j): r.similarity for r in found.collect()}
    want = {(i, j): sim[i, j] for i, j in zip(*np.nonzero(sim >= threshold - 1e-12))}
    assert got == pytest.approx(want)


def test_odd_vectors_and_best_ones(spark, monkeypatch):
    monkeypatch.setattr(joins, "is_small", lambda df: False)
    a = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0])], "i int, vector array<double>")
    b = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 5.0]), (2, [3.0, 6.0, 9.0]), (3, [1.0])], "j int, vector array<double>")
    got = {(r.i, r.j) for r in joins.similar_pairs(a, b, 0.7, "i", "j").collect()}
    assert got == {(0, 0), (4, 2), (5, 0), (5, 1), (6, 0), (6, 1)}
    best = joins.best_match(joins.similar_pairs(a.filter("i <> 5"), b, 0.7, "i", "j", best=True), "i", "j", "similarity")
    assert {(r.i, r.j) for r in best.collect()} == {(0, 0), (4, 2), (6, 0)}
    assert joins.similar_pairs(a.limit(0), b, 0.7, "i", "j").count() == 0
    assert joins.similar_pairs(a.filter("i = 4"), b.filter("j < 2"), 0.7, "i", "j").count() == 0


def test_few_blocks_meet_where_vectors_lie_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 32)
    sides = [frame(spark, clustered(2000, 16, s, centres=40, spread=0.05), "i").select("i", F.col("vector").alias("v")) for s in (1, 2)]
    centres = pivots.pivots(sides[1])
    a, b = (kept(pivots.blocks(df, centres, n)) for df, n in zip(sides, "ab"))
    met, every = pivots.near_blocks(a, b, centres, 0.9).count(), a.count() * b.count()
    assert 0 < met < 0.1 * every, (met, every)
