"""Substring dedup by content-defined chunks: a gear rolling hash sets the cuts, digests find equal chunks.

The gear hash of a place depends on the 32 bytes before it alone, so chunks fall into step again soon after an
insertion. All but the first occurrence of a chunk are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, buffers, mix
from .cutting import cut_out, keyed
from .tables import stage

WINDOW = 32
#: 256 values of the gear, one for each byte.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR[byte] << age over the last 32 bytes, modulo 2**32."""
    out, span = GEAR[data], 1
    while span < WINDOW:
        more = out.copy()
        more[span:] += out[:-span] << np.uint32(span)
        out, span = more, span * 2
    return out


def cuts(places: list[int], end: int, least: int, most: int) -> list[int]:
    """Chunk ends of a text of ``end`` bytes: places where the hash allows a cut, ``least`` to ``most`` bytes apart."""
    out, last = [], 0
    for place in places:
        if place - last < least:
            continue
        while place - last > most:
            last += most
            out.append(last)
        if place - last >= least:
            out.append(place)
            last = place
    while end - last > most:
        last += most
        out.append(last)
    return [*out, end] if end > last else out


def chunks(docs: DataFrame, bits: int = 5, least: int = 48, most: int = 1024) -> DataFrame:
    """(doc_id, version, pos, size, digest): the chunks of every text of ``keyed`` docs, about ``least + 2**bits`` bytes each."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int64()), ("size", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch["text"])
            ids, versions = batch["doc_id"].to_pylist(), batch["version"].to_pylist()
            for i, j in blocks(off):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                raw = part.tobytes()
                free = np.flatnonzero(gear(part) >> np.uint32(32 - bits) == 0) + 1
                edge = np.searchsorted(free, cut, "right")
                doc, version, pos, size, digest = [], [], [], [], []
                for r in range(j - i):
                    base, end, a = int(cut[r]), int(cut[r + 1]), 0
                    places = free[edge[r] : edge[r + 1]]
                    places = places[places >= base + WINDOW] - base  # the hash has seen this text alone
                    for b in cuts(places.tolist(), end - base, least, most):
                        doc.append(ids[i + r])
                        version.append(versions[i + r])
                        pos.append(a)
                        size.append(b - a)
                        digest.append(xxhash.xxh3_128_digest(raw[base + a : base + b]))
                        a = b
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(pos, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, version long, pos long, size int, digest binary")


def remove_chunks(docs: DataFrame, bits: int = 5, least: int = 48, most: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text as UTF-8 bytes without chunks that occur earlier.

    Earlier is by (doc_id, place), and for texts of one id by a hash of the text first. Chunks shorter than ``least``
    (only the last of a text can be) always stay. Null and empty texts have no chunks; rows of equal id and text are
    one document and lose the same; rows with a null id take no part and keep all their bytes. Other columns are left
    out; an empty table gives an empty one.
    """
    docs = keyed(docs)
    place = F.struct("doc_id", "version", "pos")
    parts = chunks(docs.filter("doc_id IS NOT NULL"), bits, least, most).filter(F.col("size") >= least)
    shared = stage(parts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").select("digest", "first"))
    later = parts.join(shared, "digest").filter(place > F.col("first"))
    spans = later.groupBy("doc_id", "version").agg(F.collect_list(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("size")).alias("b"))).alias("spans"))
    return cut_out(docs, stage(spans))
