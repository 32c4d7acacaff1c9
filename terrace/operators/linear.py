"""Linear models from sufficient statistics: one pass sums what every fold, every subset of features and every score needs.

The pass gives, for each fold, the sums of products of all pairs of columns (1, features, targets): a matrix that doesn't
grow with the rows. Training sums are all sums less those of the fold; ridge weights for any subset of features, the
error on the fold, and what a shuffled column would cost, follow from these without another look at the rows. Only
accuracies need a second pass, which counts the hits of all models at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ridge on standardised features, as a share of their variance.
PENALTY = 1e-3


def gram(table: DataFrame, columns: Sequence[str], fold: str) -> dict[int, np.ndarray]:
    """By fold, the sums of products of (1, columns...): rows with a null or a NaN in any of them are left out.

    Every task adds up its own rows; (columns + 1)**2 / 2 sums a fold and task are shuffled.
    """
    size = len(columns) + 1
    upper = np.triu_indices(size)
    rows = table.select(F.col(f"`{fold}`").cast("int").alias("f"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = pa.schema([("f", pa.int32()), ("at", pa.int32()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])])
            f = batch["f"].to_numpy(zero_copy_only=False)
            known = ~np.isnan(x).any(axis=1)
            for k in np.unique(f[known]).tolist():
                own = x[known & (f == k)]
                sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(m[upper])], schema=schema)

    known = rows.filter("f IS NOT NULL").mapInArrow(run, "f int, at int, s double").groupBy("f", "at").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for r in known.toLocalIterator():  # sizes follow the columns and folds alone
        m = out.setdefault(r.f, np.zeros((size, size)))
        i, j = upper[0][r.at], upper[1][r.at]
        m[i, j] = m[j, i] = r.s
    return out


def ridge(m: np.ndarray, features: Sequence[int], target: int, penalty: float = PENALTY) -> np.ndarray:
    """Weights of (1, all columns...), 0 but for the features: least squares with ridge on standardised features.

    m: sums of products, the first row and column of which are those of the constant 1; constant features get 0.
    """
    out, n = np.zeros(len(m)), m[0, 0]
    if not n:
        return out
    mean = m[0] / n
    c = m / n - np.outer(mean, mean)
    spread = np.diag(m) / n
    used = [i for i in features if c[i, i] > 1e-12 * max(spread[i], 1e-300)]
    if used:
        a = c[np.ix_(used, used)]
        out[used] = np.linalg.solve(a + np.diag(np.diag(a)) * penalty, c[used, target])
    out[0] = mean[target] - out[1:] @ mean[1:]
    return out


def r_squared(m: np.ndarray, weights: np.ndarray, target: int) -> float:
    """1 - error / spread of the target on the rows that m sums; 0 where the target doesn't vary."""
    step = weights.copy()
    step[target] -= 1
    spread = m[target, target] - m[0, target] ** 2 / m[0, 0] if m[0, 0] else 0.0
    return 1 - float(step @ m @ step) / spread if spread > 0 else 0.0


def _subsets(p: int) -> list[list[int]]:
    """All features, and all but each: as places in (1, features...)."""
    return [list(range(1, p + 1)), *[[i for i in range(1, p + 1) if i != left] for left in range(1, p + 1)]]


def fold_scores(table: DataFrame, features: Sequence[str], target: str, fold: str, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """(folds, scores): R² on each fold of ridge models of all features and of all but each, by one job."""
    sums = gram(table, [*features, target], fold)
    folds, at, total = sorted(sums), len(features) + 1, sum(sums.values())
    return folds, np.array([[r_squared(sums[f], ridge(total - sums[f], s, at, penalty), at) for s in _subsets(len(features))] for f in folds])


def class_scores(table: DataFrame, features: Sequence[str], target: str, fold: str, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """(folds, scores): accuracy on each fold of ridge models of each class, all features and all but each; two jobs.

    A row's class is that of the greatest value, of equals the first by name. Classes are as many as a table of their counts
    on the driver may have.
    """
    names = sorted(r[0] for r in table.filter(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string")).distinct().toLocalIterator())
    p = len(features)
    wide = table.select(F.col(f"`{fold}`").alias("_f"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)], *[(F.col(f"`{target}`").cast("string") == name).cast("double").alias(f"y{i}") for i, name in enumerate(names)])
    columns = [f"x{i}" for i in range(p)] + [f"y{i}" for i in range(len(names))]
    sums = gram(wide, columns, "_f")
    folds, total = sorted(sums), sum(sums.values()) if sums else 0
    if not folds:
        return [], np.zeros((0, p + 1))
    weights = {f: np.array([[ridge(total - sums[f], s, p + 1 + k, penalty)[: p + 1] for k in range(len(names))] for s in _subsets(p)]) for f in folds}
    schema = pa.schema([("f", pa.int32()), ("s", pa.int32()), ("hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])])
            f = batch["_f"].to_numpy(zero_copy_only=False)
            known = ~np.isnan(x).any(axis=1)
            for k in np.unique(f[known]).tolist():
                own = x[known & (f == k)]
                truth = own[:, p + 1 :].argmax(axis=1)
                hits = [int((np.argmax(own[:, : p + 1] @ w.T, axis=1) == truth).sum()) for w in weights[int(k)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hits), k, np.int32)), pa.array(np.arange(len(hits), dtype=np.int32)), pa.array(hits, pa.int64())], schema=schema)

    counted = wide.withColumn("_f", F.col("_f").cast("int")).filter("_f IS NOT NULL").mapInArrow(run, "f int, s int, hits long").groupBy("f", "s").agg(F.sum("hits").alias("hits"))
    out = np.zeros((len(folds), p + 1))
    for r in counted.collect():
        out[folds.index(r.f), r.s] = r.hits / sums[r.f][0, 0]
    return folds, out


def ablation(scores: np.ndarray, features: Sequence[str]) -> dict[str, float]:
    """What the mean score loses without each feature, at least 0, scaled to sum 1 (equal parts if none loses)."""
    mean = scores.mean(axis=0) if len(scores) else np.zeros(len(features) + 1)
    lost = np.maximum(mean[0] - mean[1:], 0)
    total = lost.sum()
    return {f: float(v / total) if total > 0 else 1 / len(features) for f, v in zip(features, lost)}


def permutation(table: DataFrame, features: Sequence[str], target: str, fold: str, penalty: float = PENALTY) -> dict[str, float]:
    """The mean R² that a ridge model of the other folds loses if a feature's values are dealt anew, in expectation over all ways to deal them.

    No shuffle is made: a value dealt at random is independent of the row, so the expected error follows from the sums.
    Scaled to a greatest value of 1.
    """
    sums = gram(table, [*features, target], fold)
    at, total, lost = len(features) + 1, sum(sums.values()) if sums else 0, np.zeros(len(features))
    for f in sorted(sums):
        m = sums[f]
        n = m[0, 0]
        w = ridge(total - m, range(1, at), at, penalty)
        spread = m[at, at] - m[0, at] ** 2 / n
        error = -w
        error[at] += 1  # target less prediction
        for i in range(1, at):
            own = error @ m[:, i] - (error @ m[:, 0]) * m[0, i] / n
            more = 2 * w[i] * own + 2 * w[i] ** 2 * (m[i, i] - m[0, i] ** 2 / n)
            lost[i - 1] += more / spread / len(sums) if spread > 0 else 0.0
    lost = np.maximum(lost, 0)
    top = lost.max(initial=0.0)
    return {f: float(v / top) if top > 0 else 0.0 for f, v in zip(features, lost)}


def transfer(real: DataFrame, made: DataFrame, features: Sequence[str], target: str, fold: str, penalty: float = PENALTY) -> list[tuple[int, str, float, float]]:
    """[(fold, 'real' or 'synthetic', accuracy, f1)]: models of each class tested on the real rows of a fold.

    The real model is trained on the real rows of the other folds, the synthetic one on the rows of ``made`` that carry
    this fold (those that were made from the other folds). f1 is weighted by the classes' real rows. Three jobs: sums of
    either side, and one count of (true, said) classes for all models. A row's class is that of the greatest value, of
    equals the first by name; classes that ``made`` lacks are never said by its model. Rows with a null are left out; a
    fold without made rows gets no synthetic result. The driver holds sums and counts, as many as folds and classes have.
    """
    names = sorted(r[0] for r in real.filter(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string")).distinct().toLocalIterator())
    p, k = len(features), len(names)
    if not k:
        return []

    def wide(table: DataFrame) -> DataFrame:
        said = F.col(f"`{target}`").cast("string")
        return table.select(F.col(f"`{fold}`").cast("int").alias("_f"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)], *[(said == name).cast("double").alias(f"y{i}") for i, name in enumerate(names)])

    columns = [f"x{i}" for i in range(p)] + [f"y{i}" for i in range(k)]
    rows = wide(real)
    sums, other = gram(rows, columns, "_f"), gram(wide(made), columns, "_f")
    total = sum(sums.values()) if sums else 0

    def models(m: np.ndarray) -> np.ndarray:
        weights = np.array([ridge(m, range(1, p + 1), p + 1 + c, penalty)[: p + 1] for c in range(k)])
        weights[m[0, p + 1 :] == 0, 0] = -np.inf  # a class without rows is never said
        return weights

    sides = {f: {"real": models(total - sums[f])} | ({"synthetic": models(other[f])} if f in other else {}) for f in sums}
    schema = pa.schema([("f", pa.int32()), ("side", pa.string()), ("truth", pa.int32()), ("said", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])])
            f = batch["_f"].to_numpy(zero_copy_only=False)
            known = ~np.isnan(x).any(axis=1)
            for one in np.unique(f[known]).tolist():
                own = x[known & (f == one)]
                truth = own[:, p + 1 :].argmax(axis=1)
                for side, w in sides[int(one)].items():
                    score = own[:, 1 : p + 1] @ w[:, 1:].T + w[:, 0]
                    cells, n = np.unique(truth * k + score.argmax(axis=1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), one, np.int32)), pa.array([side] * len(n)), pa.array((cells // k).astype(np.int32)), pa.array((cells % k).astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    seen = {(f, side): np.zeros((k, k)) for f in sides for side in sides[f]}
    for r in rows.filter("_f IS NOT NULL").mapInArrow(run, "f int, side string, truth int, said int, n long").groupBy("f", "side", "truth", "said").agg(F.sum("n").alias("n")).collect():
        seen[r.f, r.side][r.truth, r.said] = r.n
    out = []
    for (f, side), m in sorted(seen.items()):
        support, both = m.sum(axis=1), m.sum(axis=1) + m.sum(axis=0)
        f1 = np.divide(2 * np.diag(m), both, out=np.zeros(k), where=both > 0)
        out.append((f, side, float(np.trace(m) / m.sum()), float(support @ f1 / m.sum())))
    return out
