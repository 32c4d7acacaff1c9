"""A training corpus from raw documents, in five stages; each writes Parquet that the next one reads.

quality rules -> line dedup -> near-duplicate removal -> benchmark decontamination -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, near_dedup, packing, quality
from .tables import on_path, stage


#: Percent of Jaccard similarity of 5-word shingles from which the pipeline takes documents for copies.
NEAR_PERCENT = 80


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs, and n_chars after the change of text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; failing lines go from the others."""
    on_path(spark)
    return _as_documents(quality.keep_good(docs), docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them; documents left without a word go."""
    on_path(spark)
    return _as_documents(line_dedup.clean_lines(docs), docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = NEAR_PERCENT) -> DataFrame:
    """One document of each near-duplicate component stays."""
    on_path(spark)
    return near_dedup.keep_one(docs, percent)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    on_path(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    on_path(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("lines", shared_lines), ("near", near_duplicates), ("benchmark", benchmark_free), ("packing", packed)]
#: Packing and near-duplicate components by sketches can't be said in SQL; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = on_path(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
