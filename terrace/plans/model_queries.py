"""Queries of models whose scores follow from sums: ablation and permutation importance, models of synthetic rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terrace.operators import linear, quality, synth

from .registry import query, read

#: Two features and a target; SQL solves the two equations of ridge by hand.
_DATA = "(SELECT l_quantity::DOUBLE AS a, (l_tax * 100 + l_quantity / 10)::DOUBLE AS b, {y} AS y, CAST(l_orderkey % 3 AS INTEGER) AS fold FROM lineitem)"
_PRICE = "(l_extendedprice::DOUBLE / 1000 + l_quantity * 2 + l_tax * 300)"
_HIGH = f"CASE WHEN {_PRICE} > 115 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _ridge_sql(y: str) -> str:
    sums = ", ".join(f"sum({x}) AS {n}" for n, x in (("n", "1.0::DOUBLE"), ("sa", "a"), ("sb", "b"), ("sy", "y"), ("saa", "a * a"), ("sab", "a * b"), ("sbb", "b * b"), ("say", "a * y"), ("sby", "b * y"), ("syy", "y * y")))
    names = ("n", "sa", "sb", "sy", "saa", "sab", "sbb", "say", "sby", "syy")
    return f"""
d AS {_DATA.format(y=y)},
f AS (SELECT fold, {sums} FROM d GROUP BY fold),
t AS (SELECT f.fold, {", ".join(f"(SELECT sum({x}) FROM f) - f.{x} AS {x}" for x in names)} FROM f),
c AS (SELECT fold, sa / n AS ma, sb / n AS mb, sy / n AS my, (saa / n - sa / n * sa / n) AS caa, (sbb / n - sb / n * sb / n) AS cbb, sab / n - sa / n * sb / n AS cab, say / n - sa / n * sy / n AS cay, sby / n - sb / n * sy / n AS cby FROM t),
s AS (SELECT c.*, u.a AS ua, u.b AS ub, caa * {1 + linear.PENALTY} AS va, cbb * {1 + linear.PENALTY} AS vb FROM c, (VALUES (1, 1), (0, 1), (1, 0)) AS u(a, b)),
w AS (SELECT *, CASE WHEN ua + ub = 2 THEN (cay * vb - cby * cab) / (va * vb - cab * cab) WHEN ua = 1 THEN cay / va ELSE 0 END AS wa,
  CASE WHEN ua + ub = 2 THEN (cby * va - cay * cab) / (va * vb - cab * cab) WHEN ub = 1 THEN cby / vb ELSE 0 END AS wb FROM s),
m AS (SELECT fold, ua, ub, wa, wb, my - wa * ma - wb * mb AS w0 FROM w)"""


_R2 = """
r AS (SELECT m.*, 1 - (syy - 2 * (w0 * sy + wa * say + wb * sby) + n * w0 * w0 + 2 * w0 * (wa * sa + wb * sb) + wa * wa * saa + 2 * wa * wb * sab + wb * wb * sbb) / (syy - sy * sy / n) AS score FROM m JOIN f ON m.fold = f.fold),
g AS (SELECT avg(score) FILTER (ua + ub = 2) AS whole, avg(score) FILTER (ua = 0) AS no_a, avg(score) FILTER (ub = 0) AS no_b FROM r),
l AS (SELECT greatest(whole - no_a, 0) AS a, greatest(whole - no_b, 0) AS b FROM g)
SELECT unnest([{'feature': 'a', 'importance': round(a / (a + b), 6)}, {'feature': 'b', 'importance': round(b / (a + b), 6)}], recursive := true) FROM l"""


def _rows(spark, d, target):
    line = read(spark, d, "lineitem")
    a = F.col("l_quantity").cast("double")
    return line.select(a.alias("a"), (F.col("l_tax") * 100 + F.col("l_quantity") / 10).cast("double").alias("b"), target.alias("y"), (F.col("l_orderkey") % 3).cast("int").alias("fold"))


def _price():
    return F.col("l_extendedprice").cast("double") / 1000 + F.col("l_quantity") * 2 + F.col("l_tax") * 300


def _named(spark, found):
    return spark.createDataFrame([(f, round(v, 6)) for f, v in found.items()], "feature string, importance double")


@query(f"WITH {_ridge_sql(_PRICE)}, {_R2}")
def ablation_importance(spark, d):
    rows = _rows(spark, d, _price())
    return _named(spark, quality.ablation_importance(rows, ["a", "b"], "y", fold="fold"))


@query(f"WITH {_ridge_sql(_PRICE)}, {_R2.split('g AS')[0].strip().rstrip(',')} SELECT fold, CASE WHEN ua + ub = 2 THEN 'all' WHEN ua = 0 THEN 'without a' ELSE 'without b' END AS features, round(score, 6) AS score FROM r")
def benchmark_r_squared(spark, d):
    rows = _rows(spark, d, _price())
    folds, scores = linear.fold_scores(rows, ["a", "b"], "y", "fold")
    names = ("all", "without a", "without b")
    return spark.createDataFrame([(f, n, round(float(s), 6)) for f, own in zip(folds, scores) for n, s in zip(names, own)], "fold int, features string, score double")


@query(f"""WITH {_ridge_sql(_HIGH)},
h AS (SELECT m.fold, ua, ub, avg(CASE WHEN (w0 + wa * a + wb * b >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS score FROM m JOIN d ON m.fold = d.fold GROUP BY m.fold, ua, ub)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN ua + ub = 2 THEN 'all' WHEN ua = 0 THEN 'without a' ELSE 'without b' END AS features, round(score, 6) AS score FROM h""")
def benchmark_accuracy(spark, d):
    rows = _rows(spark, d, F.when(_price() > 115, "high").otherwise("low"))
    folds, scores = linear.class_scores(rows, ["a", "b"], "y", "fold")
    names = ("all", "without a", "without b")
    return spark.createDataFrame([(f, n, round(float(s), 6)) for f, own in zip(folds, np.asarray(scores)) for n, s in zip(names, own)], "fold int, features string, score double")


@query(f"""WITH {_ridge_sql(_PRICE)},
e AS (SELECT f.*, w0, wa, wb, syy - sy * sy / n AS spread,
  (say - w0 * sa - wa * saa - wb * sab) - (sy - w0 * n - wa * sa - wb * sb) * sa / n AS ra, (sby - w0 * sb - wa * sab - wb * sbb) - (sy - w0 * n - wa * sa - wb * sb) * sb / n AS rb FROM m JOIN f ON m.fold = f.fold WHERE ua + ub = 2),
l AS (SELECT greatest(avg((2 * wa * ra + 2 * wa * wa * (saa - sa * sa / n)) / spread), 0) AS a, greatest(avg((2 * wb * rb + 2 * wb * wb * (sbb - sb * sb / n)) / spread), 0) AS b FROM e)
SELECT unnest([{{'feature': 'a', 'importance': round(a / greatest(a, b), 6)}}, {{'feature': 'b', 'importance': round(b / greatest(a, b), 6)}}], recursive := true) FROM l""")
def permutation_importance(spark, d):
    rows = _rows(spark, d, _price())
    return _named(spark, linear.permutation(rows, ["a", "b"], "y", "fold"))


@query(f"""WITH {_ridge_sql(_HIGH)},
h AS (SELECT d.fold, y = 1 AS truth, w0 + wa * a + wb * b >= 0.5 AS said FROM m JOIN d ON m.fold = d.fold WHERE ua + ub = 2),
k AS (SELECT fold, count(*) AS n, count(*) FILTER (truth AND said) AS hh, count(*) FILTER (NOT truth AND NOT said) AS ll, count(*) FILTER (truth) AS th, count(*) FILTER (said) AS sh FROM h GROUP BY fold)
SELECT CAST(fold AS INTEGER) AS fold, round((hh + ll)::DOUBLE / n, 6) AS accuracy,
  round((th * (2.0::DOUBLE * hh / (th + sh)) + (n - th) * (2.0::DOUBLE * ll / (2 * n - th - sh))) / n, 6) AS f1, TRUE AS close FROM k""")
def synthetic_benchmark(spark, d):
    rows = _rows(spark, d, F.when(_price() > 115, "high").otherwise("low"))
    found = synth.fold_benchmark(rows, "y", "fold", ["a", "b"])
    # a linear model needs means and correlations of the classes, which the draws keep
    return found.select("fold", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"), (F.abs("gap") < 0.02).alias("close"))
