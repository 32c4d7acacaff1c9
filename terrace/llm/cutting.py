"""Taking byte ranges out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bitmap_filter


def _without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """raw without the ranges, which may overlap, and the number of maximal runs taken out."""
    parts, at, runs, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            parts.append(raw[at:a])
        at = end = max(end, b)
    return b"".join([*parts, raw[at:]]), runs


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): version tells texts of one id, or of none, apart; rows equal in both are interchangeable."""
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _slots(df: DataFrame) -> DataFrame:
    return df.withColumn("__key", F.xxhash64("doc_id", "version"))


def _join(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs with the columns of found (doc_id, version, ...), null ids included; docs must have been cut down by a bitmap."""
    found = found.withColumnsRenamed({"doc_id": "__doc_id", "version": "__version"})
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("version") == F.col("__version"))
    return docs.join(found, on, how).drop("__doc_id", "__version")


def keep_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of keyed docs that found (doc_id, version, ...) has, with its columns: few are shuffled where few are wanted."""
    return _join(bitmap_filter(_slots(docs), _slots(found.select("doc_id", "version")), "__key").drop("__key"), found, "inner")


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): keyed docs as UTF-8 bytes without the ranges of spans (doc_id, version, spans).

    Only documents that may have ranges are shuffled; the others are told from these by a bitmap of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(batch["text"], batch["spans"]):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ranges = list(zip(*(found.values.field(k).to_pylist() for k in range(2)))) if found.is_valid else []
                rest, runs = _without(raw, ranges)
                kept.append(rest)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                n_spans.append(runs)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    slots, wanted = _slots(docs), _slots(spans.select("doc_id", "version"))
    near, far = bitmap_filter(slots, wanted, "__key"), bitmap_filter(slots, wanted, "__key", inside=False)
    cut = _join(near, spans, "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    raw, none = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(0).cast("long")
    return cut.unionByName(far.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), raw.alias("kept")))
