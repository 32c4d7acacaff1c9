"""Ridge models from sums against models fitted on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import linear, quality, synth


def data(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 0] + [0, 10, -3, 7]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n) * 0.5
    return x, y, np.arange(n) % 3


def frame(spark, x, y, f, kind="double"):
    rows = [(*map(float, a), b.item() if hasattr(b, "item") else b, int(c)) for a, b, c in zip(x, y, f)]
    return spark.createDataFrame(rows, f"a double, b double, c double, k double, y {kind}, fold int").repartition(4)


def fit(x, y, penalty=linear.PENALTY):
    c = x - x.mean(axis=0)
    w = np.zeros(x.shape[1])
    used = c.var(axis=0) > 1e-12
    s = c[:, used].T @ c[:, used]
    w[used] = np.linalg.solve(s + np.diag(np.diag(s)) * penalty, c[:, used].T @ (y - y.mean()))
    return y.mean() - x.mean(axis=0) @ w, w


def test_scores_of_every_subset(spark):
    x, y, f = data()
    folds, got = linear.fold_scores(frame(spark, x, y, f), ["a", "b", "c", "k"], "y", "fold")
    for i, k in enumerate(folds):
        for j, kept in enumerate([[0, 1, 2, 3], [1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]):
            b, w = fit(x[f != k][:, kept], y[f != k])
            error = y[f == k] - b - x[f == k][:, kept] @ w
            assert got[i, j] == pytest.approx(1 - (error**2).sum() / ((y[f == k] - y[f == k].mean()) ** 2).sum(), abs=1e-9)
    importance = linear.ablation(got, ["a", "b", "c", "k"])
    assert sum(importance.values()) == pytest.approx(1) and importance["a"] > 0.4 > importance["c"] and importance["k"] == 0


def test_accuracies(spark):
    x, y, f = data()
    names = np.where(y > 1, "high", np.where(y < -3, "low", "middle"))
    folds, got = linear.class_scores(frame(spark, x, names, f, "string"), ["a", "b", "c", "k"], "y", "fold")
    for i, k in enumerate(folds):
        for j, kept in enumerate([[0, 1, 2, 3], [1, 2, 3]]):
            models = [fit(x[f != k][:, kept], (names[f != k] == n).astype(float)) for n in ("high", "low", "middle")]
            said = np.argmax([b + x[f == k][:, kept] @ w for b, w in models], axis=0)
            assert got[i, j] == pytest.approx((np.array(["high", "low", "middle"])[said] == names[f == k]).mean())


def test_expected_loss_of_shuffled_columns(spark):
    x, y, f = data()
    got = linear.permutation(frame(spark, x, y, f), ["a", "b", "c", "k"], "y", "fold")
    lost = np.zeros(4)
    for k in range(3):
        b, w = fit(x[f != k], y[f != k])
        own, truth = x[f == k], y[f == k]
        error = lambda z: ((truth - b - z @ w) ** 2).sum() / ((truth - truth.mean()) ** 2).sum()
        for i in range(4):
            every = []  # over all shifts each value meets each row once: the mean is the expectation
            for shift in range(len(own)):
                z = own.copy()
                z[:, i] = np.roll(z[:, i], shift)
                every.append(error(z))
            lost[i] += np.mean(every) - error(own)
    lost = np.maximum(lost, 0)
    assert [got[c] for c in "abck"] == pytest.approx((lost / lost.max()).tolist(), abs=1e-9)


def test_one_shuffle_whatever_the_features(spark):
    """The sums of 3 and of 60 columns come from a plan of one pass."""
    for p in (3, 60):
        df = spark.range(500).select((F.col("id") % 3).alias("fold"), *[F.rand(i).alias(f"x{i}") for i in range(p)], F.rand(99).alias("y"))
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        folds, scores = linear.fold_scores(df, [f"x{i}" for i in range(p)], "y", "fold")
        jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
        assert scores.shape == (3, p + 1) and jobs <= 3  # adaptive execution counts its stages as jobs


def test_rows_that_do_not_count(spark):
    x, y, f = data(60)
    df = frame(spark, x, y, f)
    odd = spark.createDataFrame([(None, 1.0, 1.0, 7.0, 1.0, 0), (float("nan"), 1.0, 1.0, 7.0, 1.0, 1), (1.0, 1.0, 1.0, 7.0, 1.0, None)], df.schema)
    a, b = (linear.fold_scores(t, ["a", "b"], "y", "fold")[1] for t in (df, df.unionByName(odd)))
    assert np.allclose(a, b)
    assert linear.fold_scores(df.limit(0), ["a", "b"], "y", "fold")[1].size == 0
    assert quality.ablation_importance(df.limit(5), ["a", "b"], "y") == {"a": 0.5, "b": 0.5}


def test_benchmark_of_synthetic_rows(spark):
    """Models trained on synthetic rows come near those trained on real ones where the classes are far apart."""
    rng = np.random.default_rng(5)
    rows = [(i, "pq"[i % 2], float(rng.normal() + 4 * (i % 2)), float(rng.normal())) for i in range(300)]
    out = synth.benchmark(spark.createDataFrame(rows, "_rid int, label string, u double, v double"), "label", seeds=(42,)).collect()
    assert out and all(r.accuracy > 0.8 and abs(r.gap) < 0.2 for r in out), out


def test_transfer_between_real_and_made_rows(spark):
    x, y, f = data()
    names = np.where(y > 1, "high", np.where(y < -3, "low", "middle"))
    rng = np.random.default_rng(9)
    made_x = x + rng.normal(size=x.shape) * [0.3, 1, 0.1, 0]
    made_fold = np.where(names == "low", 0, (f + 1) % 3)  # folds 1 and 2 have no made row of the class low
    features = ["a", "b", "c", "k"]
    real = frame(spark, x, names, f, "string").unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, "high", 0), (1.0, 1.0, 1.0, 1.0, None, 1)], "a double, b double, c double, k double, y string, fold int"))
    got = {(r[0], r[1]): r[2:] for r in linear.transfer(real, frame(spark, made_x, names, made_fold, "string"), features, "y", "fold")}
    assert len(got) == 6
    for (k, side), (accuracy, f1) in got.items():
        own_x, own_y = (x[f != k], names[f != k]) if side == "real" else (made_x[made_fold == k], names[made_fold == k])
        classes = [n for n in ("high", "low", "middle") if (own_y == n).any()]
        models = [fit(own_x, (own_y == n).astype(float)) for n in classes]
        said, truth = np.array(classes)[np.argmax([b + x[f == k] @ w for b, w in models], axis=0)], names[f == k]
        assert accuracy == pytest.approx((said == truth).mean())
        per = {n: 2 * ((said == n) & (truth == n)).sum() / max((said == n).sum() + (truth == n).sum(), 1) for n in ("high", "low", "middle")}
        assert f1 == pytest.approx(sum(per[n] * (truth == n).mean() for n in per))
    assert linear.transfer(real.limit(0), real, features, "y", "fold") == []
    assert [r[:2] for r in linear.transfer(real, real.limit(0), features, "y", "fold")] == [(0, "real"), (1, "real"), (2, "real")]


def test_fold_benchmark(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal() + (2 if i % 2 else 0)), float(rng.normal()), "p|q" if i % 2 else "r", i // 2 % 3) for i in range(3000)]
    rows += [(9000 + i, 0.0, 0.0, "rare", i % 3) for i in range(6)] + [(9990, None, 0.0, "r", 0)]
    table = spark.createDataFrame(rows, "_k long, a double, b double, kind string, part int")
    got = synth.fold_benchmark(table.drop("_k"), "kind", "part").orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2]
    for r in got:
        assert 0.78 < r.accuracy < 0.9 and 0.78 < r.f1 < 0.9 and abs(r.gap) < 0.02 and r.gap == pytest.approx(r.accuracy - r.synthetic_accuracy)
    clashing = table.withColumnsRenamed({"a": "_n1", "b": "_t", "part": "_f"})
    assert [round(r.accuracy, 9) for r in synth.fold_benchmark(clashing, "kind", "_f", ["_n1", "_t"]).orderBy("fold").collect()] == [round(r.accuracy, 9) for r in got]
    assert synth.fold_benchmark(table.limit(0), "kind", "part").count() == 0
    assert synth.fold_benchmark(table.filter("part = 1"), "kind", "part").count() == 0
    few = synth.fold_benchmark(table.filter("kind = 'rare'"), "kind", "part", ["a", "b"]).collect()
    assert len(few) == 3 and all(r.accuracy == 1 and r.gap is None for r in few)
