"""Line dedup: lines that many documents share are dropped, except in one document.

Lines are exploded as 128-bit hashes of their normalised form, counted by distinct document, and the drops of a
document are joined back to it. A bitmap of bounded size tells which documents may lose a line: only their texts are
shuffled (all texts, once the bitmap is full), the others are read and handed on where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import aside, bitmap_filter, stage

_SPACE = b" \t\n\x0b\x0c\r"
_LINES = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line, or None if it is too short to count."""
    key = line.strip(_SPACE).lower()  # bytes.lower changes A-Z alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, key): each distinct key of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                raw = text.as_buffer()
                if raw is None:
                    continue
                own = {_key(line, min_chars) for line in raw.to_pybytes().split(b"\n")} - {None}
                keys += own
                ids += [doc] * len(own)
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], schema=_LINES)
                    ids, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], schema=_LINES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary")


def drop_lists(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, drop): the keys that a document loses, for documents that lose any."""
    keys = line_keys(docs.filter("doc_id IS NOT NULL"), min_chars)
    # distinct (key, doc_id) first, then counts: rows of a hot key meet only after both have shrunk them
    shared = keys.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    shared = stage(shared.filter(F.col("n") >= min_docs).select("key", "keeper"))  # a plain side, so that Spark can split a hot key
    lost = keys.join(shared, "key").filter("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with ``text`` cleaned, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z as a-z. Keys of at least ``min_chars`` code
    points that occur in ``min_docs`` documents lose all their lines, except in the document of the largest id.
    Null or empty text is one empty line and becomes empty; rows with a null id keep all lines and count nowhere;
    rows of equal id are one document: they count once and keep or lose a line together.
    Other columns stay; columns of the result's names are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("__drop", "n_lines", "n_dropped")
    drops = stage(drop_lists(docs, min_docs, min_chars).withColumnRenamed("drop", "__drop"))
    # drops grow with the corpus: always a shuffle join, so that the plan is the same at every size
    near = bitmap_filter(docs, drops, "doc_id").join(drops.hint("merge"), "doc_id", "left")
    far = bitmap_filter(docs, drops, "doc_id", inside=False).withColumn("__drop", F.lit(None).cast("array<binary>"))
    return _rebuilt(near.unionByName(far), min_chars)


def clean_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with ``text`` cleaned as by ``dedup_lines``; the columns stay as they are, whatever their names."""
    own, back = aside(docs, ("n_lines", "n_dropped", "__drop"))
    return dedup_lines(own, min_docs, min_chars).select(*own.columns).withColumnsRenamed(back)


def _rebuilt(joined: DataFrame, min_chars: int) -> DataFrame:
    at = joined.columns.index("text")
    schema = joined.drop("__drop").schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch["text"], batch["__drop"].to_pylist()):
                raw = text.as_buffer()
                lines = (raw.to_pybytes() if raw is not None else b"").split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x in lines if _key(x, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines))
            columns = batch.drop_columns(["__drop"]).columns
            columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*batch.drop_columns(["__drop"]).schema.names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)
