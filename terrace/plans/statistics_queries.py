"""Queries of the column statistics: quantiles, preparation of wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from terrace.operators import metrics, quality, statistics

from .registry import query, read

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey")
_SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(unnest([{', '.join(map(str, _SHARES))}]) AS DOUBLE) AS p, round(unnest(quantile_cont(CAST({c} AS DOUBLE), [{', '.join(map(str, _SHARES))}])), 6) AS value FROM lineitem" for c in _NUMBERS
    )
)
def column_quantiles(spark, d):
    found = statistics.quantiles(read(spark, d, "lineitem"), {c: _SHARES for c in _NUMBERS})
    rows = [(c, p, q) for c, values in found.items() for p, q in zip(_SHARES, values)]
    return spark.createDataFrame(rows, "column string, p double, value double").withColumn("value", F.round("value", 6))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS q9 FROM lineitem GROUP BY l_suppkey")
def group_quantiles(spark, d):
    out = statistics.group_quantiles(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", [0.25, 0.5, 0.9])
    return out.select("l_suppkey", *[F.round(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("q1", "middle", "q9"))])


@query("SELECT o_orderpriority, median(o_totalprice) AS o_totalprice, max(o_custkey) AS o_custkey, count(*) AS group_size FROM orders GROUP BY o_orderpriority")
def dimension_medians(spark, d):
    return metrics.dimension_groups(read(spark, d, "orders"), ["o_orderpriority"], {"o_totalprice": "median", "o_custkey": "max"})


_TEXTS = ("o_orderstatus", "o_orderpriority", "customers", "months", "keys")
_WIDE_SQL = f"""
w AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS target,
  {", ".join(f"CASE WHEN (o_orderkey + {i}) % {i + 3} <> 0 THEN {('o_totalprice', 'o_custkey', 'o_orderkey')[i % 3]} * {i + 1} - {i} * o_custkey END AS n{i}" for i in range(20))},
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority, 'c' || (o_custkey % 150) AS customers, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS months, CASE WHEN o_orderkey % 5 <> 0 THEN 'k' || (o_orderkey % 120) END AS keys FROM orders),
r AS (SELECT * FROM w WHERE target IS NOT NULL)"""


def _wide(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    base = ("o_totalprice", "o_custkey", "o_orderkey")
    numbers = [F.when((F.col("o_orderkey") + i) % (i + 3) != 0, F.col(base[i % 3]) * (i + 1) - i * F.col("o_custkey")).alias(f"n{i}") for i in range(20)]
    texts = [
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey") % 150).alias("customers"),
        F.date_format("o_orderdate", "yyyy-MM").alias("months"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("k"), F.col("o_orderkey") % 120)).alias("keys"),
    ]
    return o.select(F.col("o_orderkey").alias("_rid"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("target"), *numbers, *texts)


def _binned_sql(c: str) -> str:
    return f"""b_{c} AS (SELECT v, CASE WHEN (SELECT count(DISTINCT {c}) FROM r) <= 100 OR n < 100 THEN v ELSE '_other_' END AS b FROM (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS n FROM r WHERE {c} IS NOT NULL GROUP BY {c})),
d_{c} AS (SELECT v, CAST(dense_rank() OVER (ORDER BY b) - 1 AS INTEGER) AS code FROM b_{c})"""


@query(
    f"WITH {_WIDE_SQL}, {', '.join(map(_binned_sql, _TEXTS))} SELECT _rid, target, "
    + ", ".join(f"round(coalesce(CAST(n{i} AS DOUBLE), (SELECT median(CAST(n{i} AS DOUBLE)) FROM r)), 4) AS n{i}" for i in range(20))
    + ", " + ", ".join(f"coalesce(d_{c}.code, -1) AS {c}" for c in _TEXTS)
    + " FROM r " + " ".join(f"LEFT JOIN d_{c} ON r.{c} = d_{c}.v" for c in _TEXTS)
)
def wide_preparation(spark, d):
    wide = _wide(spark, d)
    rows, _ = quality.prepare(wide, "target")
    # whole numbers and their medians have no digits to round
    return rows.withColumns({f"n{i}": F.round(f"n{i}", 4) for i in range(20) if isinstance(wide.schema[f"n{i}"].dataType, FractionalType)})
