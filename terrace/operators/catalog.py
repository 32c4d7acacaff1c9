"""A table of data sets: search, filters, scores, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest_per_group


def filter_datasets(
    catalog: DataFrame, min_score: float | None = None, domains: Sequence[str] = (), min_rows: int | None = None, max_rows: int | None = None, query: str | None = None, sort_by: str = "score", descending: bool = True, limit: int = 50
) -> DataFrame:
    """Rows that pass every filter: any of the domains, a part of name or description; sorted by score (null as 0), name, created or rows."""
    out = catalog
    if min_score is not None:
        out = out.filter(F.col("usability_score") >= min_score)
    if domains:
        out = out.filter(F.arrays_overlap("domain_tags", F.array(*[F.lit(d) for d in domains])))
    if min_rows is not None:
        out = out.filter(F.col("row_count") >= min_rows)
    if max_rows is not None:
        out = out.filter(F.col("row_count") <= max_rows)
    if query:
        low = query.lower()
        out = out.filter(F.lower("name").contains(low) | F.coalesce(F.lower("description"), F.lit("")).contains(low))
    keys: dict[str, Column] = {"score": F.coalesce("usability_score", F.lit(0.0)), "name": F.lower("name"), "created": F.col("created_at"), "rows": F.col("row_count")}
    key = keys[sort_by]
    return out.orderBy(key.desc() if descending else key.asc(), "id").limit(limit)


def relevance(query: str, name: Column, tags: Column, description: Column) -> Column:
    """For each term of the query: 3 for the name, 2 for a tag, 1 for the description."""

    def of(term: str) -> Column:
        tag = F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(term)), F.lit(False)).cast("int")
        hit = lambda c: F.coalesce(F.lower(c).contains(term), F.lit(False)).cast("int")
        return 3 * hit(name) + 2 * tag + hit(description)

    return sum((of(term) for term in query.lower().split()), F.lit(0))


def search(catalog: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Rows of some relevance, the most relevant first."""
    scored = catalog.withColumn("relevance", relevance(query, F.col("name"), F.col("domain_tags"), F.col("description")))
    return scored.filter("relevance > 0").orderBy(F.desc("relevance"), "id").limit(limit)


def domain_list(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("domain_tags").alias("domain")).distinct().orderBy("domain")


def score_distribution(catalog: DataFrame, score: str = "usability_score") -> DataFrame:
    """(bucket, n) with a row for every bucket, also empty ones."""
    s = F.col(score)
    bucket = F.when(s.isNull(), "unassessed").when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").otherwise("poor")
    counts = catalog.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = catalog.sparkSession.createDataFrame([("excellent",), ("good",), ("fair",), ("poor",), ("unassessed",)], "bucket string")
    return every.join(counts, "bucket", "left").fillna(0, ["n"])


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The catalog with new rows in the place of those with their keys."""
    return catalog.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True).select(*catalog.columns)


def delete(catalog: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return catalog.join(keys.select(key), key, "left_anti")


def with_latest_score(catalog: DataFrame, reports: DataFrame) -> DataFrame:
    """The catalog with the score of each data set's newest report."""
    last = latest_per_group(reports.select("id", "created_at", F.col("score").alias("_s")), "id", "created_at").select("id", "_s")
    return catalog.join(last, "id", "left").withColumn("usability_score", F.coalesce("_s", "usability_score")).drop("_s").select(*catalog.columns)
