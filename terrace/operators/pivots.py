"""Exact cosine joins of two large sides by pivots: angles obey the triangle inequality, so most blocks needn't meet.

A bounded sample of vectors serves as pivots. A vector belongs to its nearest pivot, and consecutive vectors of a pivot,
by their angle to it, form a block; a block knows its least and greatest angle to every pivot. Vectors of two blocks
can't be as near as wanted if their angles to any pivot lie further apart than that. Pivots rule out most pairs of
pivots, and only blocks of the others are joined, on the pivot, and looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

#: Pivots at most: all pairs of them are known to the driver.
PIVOTS = 128
#: Vectors of a block at most.
BLOCK_ROWS = 256
#: Angles are computed to about this.
SLACK = 1e-6


def pivots(vectors: DataFrame, most: int | None = None) -> np.ndarray:
    """At most ``most`` vectors of length 1 from (i, v): those of the smallest hashes, without zeros and NaN."""
    some = vectors.orderBy(F.xxhash64("i"), "i").limit(2 * (most or PIVOTS)).collect()
    found = np.array([r.v for r in some], float)
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    good = np.isfinite(found).all(axis=1) & (length[:, 0] > 0)
    return np.unique(found[good] / length[good], axis=0)[: most or PIVOTS] if good.any() else np.zeros((0, found.shape[1] if found.ndim > 1 else 0))


def blocks(vectors: DataFrame, centres: np.ndarray, name: str) -> DataFrame:
    """(cell, block, ids, vectors, dims, low, high) of (i, v): low and high are the block's least and greatest angles to the pivots.

    Rows are dealt over ranges of (cell, angle, id), so a cell, or a group of equal vectors, that holds most rows is dealt
    too. Zero vectors and those with NaN lie in cells of their own, after the pivots'.
    """
    n, dims = centres.shape
    kind = vectors.schema["i"].dataType

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            length = np.sqrt((u * u).sum(axis=1, keepdims=True))
            u = np.divide(u, length, out=u.copy(), where=~(length <= 0))
            angle = np.arccos(np.clip(u @ centres.T, -1, 1))
            odd = np.isnan(u).any(axis=1)
            cell = np.where(odd, n, np.where(length[:, 0] <= 0, n + 1, np.where(odd[:, None], 0, angle).argmin(axis=1)))
            own = np.where(cell < n, angle[np.arange(len(u)), np.minimum(cell, n - 1)], 0.0)
            yield pa.RecordBatch.from_arrays([batch["i"], pa.array([x.tobytes() for x in u], pa.binary()), pa.array(cell, pa.int32()), pa.array(own)], names=["i", "u", "cell", "angle"])

    schema = StructType([StructField(f"ids_{name}", ArrayType(kind)), StructField(f"vectors_{name}", BinaryType()), StructField(f"dims_{name}", LongType()), StructField("cell", IntegerType()), StructField("low", BinaryType()), StructField("high", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, bytes]] = []
        cell = None

        def block() -> pa.RecordBatch:
            u = np.frombuffer(b"".join(x for _, x in held)).reshape(len(held), dims)
            angle = np.arccos(np.clip(u @ centres.T, -1, 1))
            low, high = (np.full(n, -1.0), np.full(n, 10.0)) if cell >= n else (angle.min(axis=0), angle.max(axis=0))
            ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array([i for i, _ in held], ids_type))
            return pa.RecordBatch.from_arrays([ids, pa.array([u.tobytes()], pa.binary()), pa.array([dims], pa.int64()), pa.array([cell], pa.int32()), pa.array([low.tobytes()], pa.binary()), pa.array([high.tobytes()], pa.binary())], names=[f"ids_{name}", f"vectors_{name}", f"dims_{name}", "cell", "low", "high"])

        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("i").type
            for i, u, c in zip(batch["i"].to_pylist(), batch["u"].to_pylist(), batch["cell"].to_pylist()):
                if held and (c != cell or len(held) >= BLOCK_ROWS):
                    yield block()
                    held = []
                cell = c
                held.append((i, u))
        if held:
            yield block()

    dealt = vectors.mapInArrow(placed, StructType([StructField("i", kind), StructField("u", BinaryType()), StructField("cell", IntegerType()), vectors.sparkSession.createDataFrame([], "angle double").schema["angle"]]))
    dealt = dealt.repartitionByRange("cell", "angle", F.xxhash64("i")).sortWithinPartitions("cell", "angle")
    return dealt.mapInArrow(cut, schema).withColumn("block", F.monotonically_increasing_id())


def near_blocks(a: DataFrame, b: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """(block_a, block_b): all pairs of blocks that may hold vectors of cosine ``threshold`` or more."""
    n, reach = len(centres), math.acos(min(max(threshold, -1.0), 1.0)) + SLACK
    spark = a.sparkSession

    def radii(side: DataFrame) -> dict[int, float]:
        def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = [float(np.frombuffer(h)[c]) if c < n else 10.0 for c, h in zip(batch["cell"].to_pylist(), batch["high"].to_pylist())]
                yield pa.RecordBatch.from_arrays([batch["cell"], pa.array(r, pa.float64())], names=["cell", "r"])

        return {r.cell: r.r for r in side.select("cell", "high").mapInArrow(widest, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect()}  # a row a pivot

    of_a, of_b = radii(a), radii(b)
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1))

    def may(p: int, q: int) -> bool:
        if p == n or q == n:  # NaN is like everything
            return True
        if p > n or q > n:  # zero vectors have similarity 0
            return threshold <= 0
        return apart[p, q] - of_a[p] - of_b[q] <= reach

    pairs = [(p, q) for p in sorted(of_a) for q in sorted(of_b) if may(p, q)]
    cells = F.broadcast(spark.createDataFrame(pairs, "cell_a int, cell_b int"))  # PIVOTS + 2 squared at most
    x = a.select(F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    y = b.select(F.col("cell").alias("cell_b"), F.col("block").alias("block_b"), F.col("low").alias("lb"), F.col("high").alias("hb"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, ha, lb, hb = (np.frombuffer(b"".join(batch[c].to_pylist())).reshape(batch.num_rows, n) for c in ("la", "ha", "lb", "hb"))
            keep = (np.maximum(la - hb, lb - ha) <= reach).all(axis=1)
            yield batch.select(["block_a", "block_b"]).filter(pa.array(keep))

    met = x.join(cells, "cell_a").join(y, "cell_b")
    return met.select("block_a", "block_b", "la", "ha", "lb", "hb").mapInArrow(overlap, "block_a long, block_b long")
