"""Sinks: tables, numbers and graphs as CSV, JSON and Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(table: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in table.dtypes]
    table.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def to_parquet(table: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = table.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def to_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "parquet") -> None:
    """nodes/ and edges/ below ``path``, split by type."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").partitionBy("type").format(kind).save(f"{path}/{name}")


def report_rows(report: DataFrame, suggestions: DataFrame | None = None, importance: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """(section, item, value) rows of a whole report; value is text, or JSON where a row has several fields.

    Sections: ``score`` from the numbers of a one-row report and ``profile`` from its array, a row a column;
    ``suggestion`` from what ``quality.suggest`` gives; ``top`` and ``low`` features from (feature, importance);
    ``anomaly`` and ``reason`` from what ``quality.anomalies`` gives, whose first column names the row, a row for each
    contributor. Parts that are left out or empty have no rows.
    """
    from terrace.operators import quality

    scores = [c for c, t in report.dtypes if t in ("double", "int", "bigint")]
    part = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))
    out = part(report.select(*[F.col(c).cast("string").alias(c) for c in scores]).unpivot([], scores, "item", "value"), "score", F.col("item"), F.col("value"))
    if "profile" in report.columns:
        out = out.union(part(report.select(F.explode("profile").alias("p")), "profile", F.col("p.column"), F.to_json("p")))
    if suggestions is not None:
        out = out.union(part(suggestions, "suggestion", F.concat_ws(",", "features"), F.to_json(F.struct("kind", "transform", "impact", "confidence"))))
    if importance is not None:
        for section, found in (("top", quality.top_features(importance)), ("low", quality.low_features(importance))):
            out = out.union(part(found, section, F.col("feature"), F.col("importance")))
    if anomalies is not None:
        row = F.col(anomalies.columns[0])
        out = out.union(part(anomalies, "anomaly", row, F.col("score")))
        each = anomalies.select(row.alias("row"), F.explode("contributors").alias("c"))
        out = out.union(part(each, "reason", F.col("row"), F.to_json("c")))
    return out
