"""Assess, fix, export: one call from a raw table to a repaired one with its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators import extract, metrics, quality
from terrace.sources import sinks


def assess_fix_export(table: DataFrame, target: str, folder: str, row_id: str = "_rid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired table, log, report); the table goes to ``folder``/table as Parquet, log and report as CSV and JSON.
    The report has scores, profile, suggestions, top and low features and anomalies with their reasons, as rows.

    Importance comes from ablation over the prepared features; columns that preparation drops have none.
    """
    report = quality.assess(table, target, row_id)
    rows, features = quality.prepare(table, target)
    found = quality.ablation_importance(rows, features, target, row_id=row_id) if features else {}
    importance = table.sparkSession.createDataFrame(list(found.items()), "column string, importance double")
    numbers = [c for c in extract.numeric_columns(table) if c not in (target, row_id)]
    said = quality.suggest(quality.profile(table.drop(row_id), [target]), metrics.correlations(table, numbers, 0.8), importance)
    fixed, log = quality.apply_all(table, said, target, row_id)
    sinks.to_parquet(fixed, f"{folder}/table")
    sinks.to_csv(log, f"{folder}/log")
    scored = report.withColumn("gain", F.lit(quality.improvement(said, 0.0).first()["gain"]))
    odd = quality.anomalies(table, numbers, row_id) if numbers else None
    sinks.to_json(sinks.report_rows(scored, said, importance.withColumnRenamed("column", "feature"), odd), f"{folder}/report")
    return fixed, log, report
