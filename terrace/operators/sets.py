"""Unions and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_of_domains(tables: Mapping[str, DataFrame], name: str = "category") -> DataFrame:
    """One long table with the name of the part that each row comes from; missing columns are null."""
    parts = [df.withColumn(name, F.lit(key)) for key, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def augment(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    return real.unionByName(synthetic)


def shared_values(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct trimmed, lower-cased values that both columns have."""
    of = lambda df, c: df.select(F.lower(F.trim(F.col(c).cast("string"))).alias("value")).na.drop()
    return of(a, x).intersect(of(b, y))


def merge_results(lists: Sequence[DataFrame], key: str, size: int) -> DataFrame:
    """The first ``size`` rows of result lists put one after the other, each key once; lists carry ``_place``."""
    parts = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    order: Column = F.struct("_list", "_place")
    rest = [c for c in every.columns if c != key]
    first = every.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return first.orderBy("_list", "_place").limit(size).drop("_list", "_place")
