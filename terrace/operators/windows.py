"""Operators over ordered or grouped rows: duplicates, ranks, splits, encodings, latest rows, folds."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import statistics
from .joins import small

#: Up to so many rows a global order is one task's window; beyond, it is dealt over ranges of the key.
PLAIN_ROWS = 100_000
#: Ranges at most: one row of each goes to every task.
MOST_RANGES = 2000


def _ranged(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """keyed, computed once; and, True if it is no table that one task may order, with the number of the range of ``_key`` that a row lies in.

    The ranges follow the number of rows and are Spark's own, written once so that all who read them see the same ones:
    no row is compared with all cuts, and there are as many tasks as ranges however few bytes the rows have. Counting
    rows, finding cuts and dealing rows read what was written.
    """
    keyed = kept(keyed)
    n = keyed.count()
    if n <= PLAIN_ROWS:
        return keyed, False
    parts = min(max(n * 2 // max(PLAIN_ROWS, 1), 16), MOST_RANGES)
    return kept(keyed.repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id())), True


def running(table: DataFrame, key: Column, **sums: Column) -> DataFrame:
    """table with running sums, each up to and with the row itself, in the order of a unique key (nulls first).

    Large tables are cut into ranges of the key; a window goes over each range, and the totals of the ranges before
    (one row a range) are added.
    """
    placed, large = _ranged(table.withColumn("_key", key))
    if not large:
        w = Window.orderBy("_key")
        return placed.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).drop("_key")
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy("_key")
    out = placed.join(F.broadcast(before), "_part").withColumns({n: F.sum(c).over(within) + F.col(f"_b_{n}") for n, c in sums.items()})
    return out.drop("_key", "_part", *[f"_b_{n}" for n in sums])


def fill_down(table: DataFrame, key: Column, **values: Column) -> DataFrame:
    """table with, under each name, the last non-null value up to and with the row itself, in the order of a unique key.

    A segmented scan: large tables are cut into ranges of the key, a window fills inside each range, and what the ranges
    before had last (one row a range) is carried on to rows that nothing in their own range fills.
    """
    placed, large = _ranged(table.withColumn("_key", key))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    if not large:
        w = Window.orderBy("_key")
        return placed.withColumns({n: last(c, w) for n, c in values.items()}).drop("_key")
    ends = placed.groupBy("_part").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("_key"))).alias(f"_e_{n}") for n, c in values.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_part", *[last(F.col(f"_e_{n}"), earlier).alias(f"_b_{n}") for n in values])
    within = Window.partitionBy("_part").orderBy("_key")
    out = placed.join(F.broadcast(before), "_part").withColumns({n: F.coalesce(last(c, within), F.col(f"_b_{n}")) for n, c in values.items()})
    return out.drop("_key", "_part", *[f"_b_{n}" for n in values])


def find_duplicates(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    """table with is_potential_duplicate and duplicate_group: 1 for the most frequent key that occurs twice, 0 for unique keys.

    Keys are compared column by column and null equals null; groups of equal size are ordered by key. Numbering goes
    over duplicate keys only, not over rows.
    """
    counts = table.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"))
    numbered = running(counts.filter("_n > 1"), F.struct((-F.col("_n")).alias("n"), *dims), duplicate_group=F.lit(1))
    groups = numbered.withColumn("duplicate_group", F.col("duplicate_group").cast("int")).drop("_n")
    groups = groups.withColumnsRenamed({d: f"_key{i}" for i, d in enumerate(dims)})
    on = reduce(lambda x, y: x & y, [F.col(d).eqNullSafe(F.col(f"_key{i}")) for i, d in enumerate(dims)])
    joined = table.join(groups, on, "left").select(*table.columns, "duplicate_group")
    return joined.withColumn("is_potential_duplicate", F.col("duplicate_group").isNotNull()).withColumn("duplicate_group", F.coalesce("duplicate_group", F.lit(0)))


def group_ids(table: DataFrame, dims: Sequence[str], row_id: str = "_rid") -> DataFrame:
    """table with group_id: 0 for the key that appears first (by row id), then 1, ..."""
    first = table.groupBy(*dims).agg(F.min(row_id).alias("_f"))
    ids = running(first, F.col("_f"), group_id=F.lit(1)).withColumn("group_id", (F.col("group_id") - 1).cast("int")).drop("_f")
    return table.join(small(ids), list(dims))


def percentile_of(table: DataFrame, score: str) -> DataFrame:
    """table with percentile: the share of rows whose score is not higher, in percent."""
    counts = table.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    run = running(counts, F.col(score), _c=F.col("_n")).join(F.broadcast(total))
    return table.join(run.select(score, (100 * F.col("_c") / F.col("_t")).alias("percentile")), score)


def average_rank(table: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """table with the mean rank of equal values over n + 1; rows with a null value are left out."""
    counts = table.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    upto = running(counts, F.col(value), _c=F.col("_n"))
    ranks = upto.withColumn("_r", F.col("_c") - F.col("_n") + (F.col("_n") + 1) / 2).join(F.broadcast(total)).select(value, (F.col("_r") / (F.col("_t") + 1)).alias(name))
    return table.join(ranks, value)


def frequency_category(table: DataFrame, key: str, many: str = "multiple", one: str = "single", name: str = "frequency") -> DataFrame:
    """table with ``many`` for keys that occur more than once, else ``one``; null keys count as one key."""
    counts = table.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, many).otherwise(one).alias(name))
    return table.join(counts.withColumnRenamed(key, "_k"), table[key].eqNullSafe(F.col("_k"))).drop("_k")


def median_split(table: DataFrame, value: str, high: str = "high", low: str = "low", inclusive: bool = False, name: str = "split") -> DataFrame:
    """table with ``high`` for values above the median (or at it, with ``inclusive``), else ``low``; null is low."""
    middle = F.lit(statistics.quantiles(table, {value: [0.5]})[value][0]).cast("double")
    above = F.col(value) >= middle if inclusive else F.col(value) > middle
    return table.withColumn(name, F.when(above, high).otherwise(low))


def quantile_category(table: DataFrame, value: str, labels: Sequence[str], name: str = "quantile") -> DataFrame:
    """table with the label of the quantile bin: bins are closed on the right, the least value is in the first; null stays null."""
    cuts = [i / len(labels) for i in range(1, len(labels))]
    edges = statistics.quantiles(table, {value: cuts})[value]
    out = None
    for edge, label in zip(edges, labels):
        hit = F.col(value) <= F.lit(edge).cast("double")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    last = F.when(F.col(value).isNotNull(), labels[-1])
    return table.withColumn(name, last if out is None else out.otherwise(last))


def latest_per_group(table: DataFrame, group: Sequence[str] | str, order: str, tie: str | None = None) -> DataFrame:
    """The row of the greatest ``order`` of each group (nulls last; of equals the greatest ``tie``), by a partial aggregate."""
    group = [group] if isinstance(group, str) else list(group)
    rest = [c for c in table.columns if c not in group]
    # a null order comes last of all, so it is the least
    key = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("o"), *([F.col(tie).alias("t")] if tie else []))
    best = table.groupBy(*group).agg(F.max_by(F.struct(*rest), key).alias("_b"))
    return best.select(*group, "_b.*").select(*table.columns)


def first_key_wins(table: DataFrame, key: Sequence[str] | str, row_id: str = "_rid") -> DataFrame:
    """The row of the least row id of each key."""
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in table.columns if c not in key]
    return table.groupBy(*key).agg(F.min_by(F.struct(*rest), row_id).alias("_b")).select(*key, "_b.*").select(*table.columns)


def spaced_sample(table: DataFrame, value: str, n: int = 1000) -> DataFrame:
    """n distinct values at even distances in their order (all if there are fewer)."""
    distinct = table.select(value).na.drop().distinct()
    total = distinct.agg(F.count(F.lit(1)).alias("_t"))
    placed = running(distinct, F.col(value), _i=F.lit(1)).withColumn("_i", F.col("_i") - 1).join(F.broadcast(total))
    step = F.greatest((F.col("_t") - 1) / F.lit(max(n - 1, 1)), F.lit(1.0))
    slot = F.floor(F.col("_i") / step + 1e-9)
    return placed.withColumn("_s", slot).groupBy("_s").agg(F.min(value).alias(value)).drop("_s")


def folds(table: DataFrame, k: int, row_id: str = "_rid", label: str | None = None, seed: int = 42) -> DataFrame:
    """table with fold 0..k-1, dealt evenly within each label in an order that the seed sets."""
    mine = F.col(label) if label else F.lit(0)
    rows = table.withColumn("_label", mine)
    placed = running(rows, F.struct("_label", F.xxhash64(F.col(row_id), F.lit(seed)), F.col(row_id)), _at=F.lit(1))  # no task holds a whole label
    counts = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))  # one row a label
    before = running(counts, F.col("_label"), _to=F.col("_n")).select(F.col("_label").alias("_l"), (F.col("_to") - F.col("_n")).alias("_before"))
    joined = placed.join(small(before), F.col("_label").eqNullSafe(F.col("_l")))
    return joined.withColumn("fold", ((F.col("_at") - F.col("_before") - 1) % k).cast("int")).drop("_label", "_l", "_at", "_before")


def label_codes(table: DataFrame, column: str, order: str = "sorted", row_id: str = "_rid") -> DataFrame:
    """(value, code): codes from 0 by sorted value, or by first appearance."""
    values = table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    first = values.agg((F.min(row_id) if order == "first" else F.lit(0)).alias("_f"))
    return running(first, F.struct("_f", "value"), code=F.lit(1)).withColumn("code", (F.col("code") - 1).cast("int")).drop("_f")


def label_encode(table: DataFrame, column: str, codes: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """table with the code of a column; null, and values that ``codes`` doesn't have, get -1."""
    codes = label_codes(table, column) if codes is None else codes
    return table.join(small(codes), table[column] == codes["value"], "left").withColumn(name or f"{column}_code", F.coalesce("code", F.lit(-1))).drop("value", "code")


def rare_to_other(table: DataFrame, column: str, most: int = 100, other: str = "_other_") -> DataFrame:
    """table with all but the ``most`` - 1 most frequent values of a column turned into ``other``, if it has more than ``most``; null stays."""
    counts = table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), "_v").limit(most + 1).withColumn("_i", F.row_number().over(Window.orderBy(F.desc("_n"), "_v")))
    n = top.agg(F.count(F.lit(1)).alias("_c"))
    keep = top.join(F.broadcast(n)).filter((F.col("_c") <= most) | (F.col("_i") < most)).select("_v", F.lit(True).alias("_k"))
    joined = table.join(F.broadcast(keep), table[column] == F.col("_v"), "left")  # ``most`` rows at most
    return joined.withColumn(column, F.when(F.col(column).isNull() | F.col("_k"), F.col(column)).otherwise(F.lit(other))).drop("_v", "_k")


def score_changes(reports: DataFrame, group: str, order: str, score: str) -> DataFrame:
    """reports with the change against the one before, and against the first, of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return reports.withColumns({"change": F.col(score) - F.lag(score).over(w), "since_first": F.col(score) - F.first(score).over(w)})


#: Distinct points in a block of the exact neighbour search, at least.
BLOCK = 512


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to spark.checkpoint.dir; a folder of its own is set where that is unset and the master is local."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(top or tempfile.mkdtemp(prefix="terrace-"))
    return df.checkpoint()


def _near_boxes(boxes: DataFrame, dims: int) -> DataFrame:
    """(a, b): the blocks b whose boxes lie within the radius of block a, from (block, low, high, radius) in Z-order.

    A tree of two levels: n blocks in a row are put in boxes of about sqrt(n) each, so all pairs of the upper boxes are n;
    those that are near enough are joined with their blocks on the number of the upper box.
    """
    n = boxes.count()
    step = max(math.isqrt(n), 1)
    own = boxes.withColumn("up", F.floor(F.col("block") / step).cast("long"))

    def gap(la: str, ha: str, lb: str, hb: str) -> Column:
        apart = [F.greatest(F.col(lb)[d] - F.col(ha)[d], F.col(la)[d] - F.col(hb)[d], F.lit(0.0)) for d in range(dims)]
        return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in apart], F.lit(0.0)))

    ends = [F.array(*[f(F.col(c)[d]) for d in range(dims)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    upper = kept(own.groupBy("up").agg(*ends, F.max("radius").alias("radius")))
    a = upper.select(F.col("up").alias("ua"), F.col("low").alias("la"), F.col("high").alias("ha"), "radius", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // step) - 1 if n else 0).cast("long"))).alias("ub"))
    b = upper.select(F.col("up").alias("ub"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    near = F.col("radius") * (1 + 1e-9)
    ups = a.join(b, "ub").filter(gap("la", "ha", "lb", "hb") <= near).select("ua", "ub")
    x = own.select(F.col("up").alias("ua"), F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), "radius")
    y = own.select(F.col("up").alias("ub"), F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    return ups.join(x, "ua").join(y, "ub").filter(gap("la", "ha", "lb", "hb") <= near).select("a", "b")


def _exact(points: DataFrame, k: int) -> DataFrame:
    """(i, j, distance, n): the k nearest other points of each point (i, u), of equal distances the least j; null vectors are left out.

    Equal points are searched once, and only their k + 1 least ids can be neighbours. Distinct points go in Z-order into
    blocks of ``BLOCK`` or more; the k-th distance inside its own block bounds a point's search, and a block meets the
    blocks whose boxes lie within its greatest bound, which a tree of boxes finds. No task holds more than two blocks, whatever the input.
    """
    own = kept(points.filter("u IS NOT NULL"))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("u").orderBy("i"))).filter(F.col("_n") <= k + 1)
    groups = kept(first.groupBy("u").agg(F.sort_array(F.collect_list("i")).alias("ids")))
    total = groups.count()
    if not total:
        return own.select("i", F.col("i").alias("j"), F.lit(0.0).alias("distance"), F.lit(1).alias("n"))
    dims = groups.select(F.size("u")).first()[0]
    used = min(dims, 6)
    ends = groups.agg(*[f(F.col("u")[d]) for d in range(used) for f in (F.min, F.max)]).first()
    bits = min(60 // max(used, 1), 20)
    z = F.lit(0).cast("long")
    for d in range(used):
        low, high = ends[2 * d], ends[2 * d + 1]
        cell = F.floor((F.col("u")[d] - low) / ((high - low) or 1.0) * ((1 << bits) - 1)).cast("long")
        for b in range(bits):
            z = z + F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), b * used + d)
    numbered = kept(running(groups.withColumn("_z", z), F.struct("_z", "u"), at=F.lit(1)).drop("_z"))
    block = F.floor((F.col("at") - 1) * max(total // BLOCK, 1) / total)
    dealt = numbered.groupBy(block.alias("block")).agg(F.collect_list(F.struct("at", F.size("ids").alias("w"), "u")).alias("p"))

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for d in range(dims):
            out += (a[:, d][:, None] - b[:, d][None, :]) ** 2
        return np.sqrt(out)

    def reach(far: np.ndarray, w: np.ndarray) -> np.ndarray:
        order = far.argsort(axis=1)
        many = w[order].cumsum(axis=1) > k
        at = many.argmax(axis=1)[:, None]
        return np.where(many[:, -1], np.take_along_axis(far, np.take_along_axis(order, at, 1), 1)[:, 0], np.inf)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, p in zip(batch["block"].to_pylist(), batch["p"]):
                at, w = p.values.field(0).to_numpy(), p.values.field(1).to_numpy()
                u = p.values.field(2).flatten().to_numpy().reshape(len(at), dims)
                most = reach(apart(u, u), w)
                out.append({"block": name, "at": at, "w": w, "u": u.ravel(), "most": most, "low": u.min(axis=0), "high": u.max(axis=0), "radius": float(most.max())})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    real = pa.list_(pa.float64())
    shape = pa.schema([("block", pa.int64()), ("at", pa.list_(pa.int64())), ("w", pa.list_(pa.int32())), ("u", real), ("most", real), ("low", real), ("high", real), ("radius", pa.float64())])
    blocks = kept(dealt.mapInArrow(bounds, "block long, at array<long>, w array<int>, u array<double>, most array<double>, low array<double>, high array<double>, radius double"))
    met = _near_boxes(blocks.select("block", "low", "high", "radius"), dims)
    met = met.join(blocks.select(F.col("block").alias("a"), F.col("at").alias("at_a"), F.col("u").alias("u_a"), "most"), "a")
    met = met.join(blocks.select(F.col("block").alias("b"), F.col("at").alias("at_b"), "w", F.col("u").alias("u_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_a, u_a, most, at_b, w, u_b in zip(*[batch[c] for c in ("at_a", "u_a", "most", "at_b", "w", "u_b")]):
                at_a, u_a, most, at_b, w, u_b = (x.values.to_numpy() for x in (at_a, u_a, most, at_b, w, u_b))
                far = apart(u_a.reshape(-1, dims), u_b.reshape(-1, dims))
                x, y = np.nonzero(far <= np.minimum(most, reach(far, w))[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(at_a[x]), pa.array(at_b[y]), pa.array(far[x, y])], names=["x", "y", "distance"])

    close = met.select("at_a", "u_a", "most", "at_b", "w", "u_b").mapInArrow(compare, "x long, y long, distance double")
    each = close.join(numbered.select(F.col("at").alias("y"), F.explode("ids").alias("j")), "y")
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("distance", "j"))).filter(F.col("_n") <= k + 1)
    lists = ranked.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("distance", "j"))).alias("near"))
    named = numbered.select(F.col("at").alias("x"), "u").join(lists, "x").select("u", "near")
    others = F.slice(F.filter("near", lambda e: e["j"] != F.col("i")), 1, k)
    out = own.join(named, "u").select("i", F.posexplode(others).alias("_p", "e"))
    return out.select("i", F.col("e.j").alias("j"), F.col("e.distance").alias("distance"), (F.col("_p") + 1).alias("n"))


def nearest(points: DataFrame, row_id: str, vector: str, k: int, bands: int | None = None, width: float = 1.0, dims: int | None = None) -> DataFrame:
    """(row_id, neighbour, distance): the k nearest other points of each.

    Without ``bands`` exact, block by block, for any number of points. With ``bands`` points are compared inside buckets
    of random projections of that ``width``; recall grows with bands, and a point alone in its buckets has no row.
    """
    if bands is None:
        found = _exact(points.select(F.col(row_id).alias("i"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("u")), k)
        return found.select(F.col("i").alias(row_id), F.col("j").alias("neighbour"), "distance", "n")
    a = points.select(F.col(row_id).alias("i"), F.col(vector).alias("u"))
    b = points.select(F.col(row_id).alias("j"), F.col(vector).alias("v"))
    apart: Column = F.sqrt(F.aggregate(F.zip_with("u", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    from terrace.functions.numeric import dot

    from .joins import _planes

    def keys(vec: Column) -> Column:
        out = []
        for band in range(bands):
            cells = [F.floor(dot(vec, F.array(*[F.lit(x) for x in plane])) / width).cast("string") for plane in _planes(2, dims or 1, band)]
            out.append(F.concat_ws(":", F.lit(str(band)), *cells))
        return F.array(*out)

    pairs = a.withColumn("c", F.explode(keys(F.col("u")))).join(b.withColumn("c", F.explode(keys(F.col("v")))), "c").filter("i <> j").dropDuplicates(["i", "j"])
    ranked = pairs.withColumn("distance", apart).withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))).filter(F.col("n") <= k)
    return ranked.select(F.col("i").alias(row_id), F.col("j").alias("neighbour"), "distance", "n")
