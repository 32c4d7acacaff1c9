"""Statistics of many columns at once: exact quantiles by selection, most frequent values, and the projection made of them.

No aggregate buffer ever holds the values of a column. A quantile is narrowed down instead: a sketch of bounded size
gives two values around each wanted rank, exact counts say what lies below, and only the distinct values in between
are looked at; while these are too many for the driver, they are cut into ranges and the range with the rank is kept.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from terrace.functions.numeric import place_among

#: Distinct values that are looked at on the driver, for all columns together; beyond, ranges are narrowed on the cluster.
VALUES = 100_000
#: Accuracy of the sketch: its ranks are off by n / ACCURACY at most.
ACCURACY = 2000
#: Ranges into which values are cut in a round.
RANGES = 256


def _double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def quantiles(table: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """The exact quantiles of columns, for probabilities 0 to 1, between neighbours interpolated as ``percentile`` does.

    Nulls don't count; NaN is greater than all numbers; a column without values gives None. Three passes over the
    table for all columns and probabilities together.
    """
    names = [c for c, p in wanted.items() if len(p)]
    out: dict[str, list[float | None]] = {c: [None] * len(p) for c, p in wanted.items()}
    if not names:
        return out
    table = table.select(*[_double(c).alias(f"v{i}") for i, c in enumerate(names)])
    sketched = [c for i, name in enumerate(names) for c in _around(i, wanted[name])]
    first = table.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))], *sketched).first()
    ranks: dict[int, list[int]] = {}
    bounds: dict[int, list[tuple[float, float]]] = {}
    for i, name in enumerate(names):
        n = first[f"n{i}"]
        if n:
            ranks[i] = sorted({k for p in wanted[name] for k in _positions(p, n)})
            lows, highs = first[f"a{i}"], first[f"b{i}"]
            spans = [(lows[j], highs[j]) for j in range(len(lows))]
            bounds[i] = _disjoint(spans)
    found = _select(table, ranks, bounds)
    for i, name in enumerate(names):
        if i in ranks:
            out[name] = [_between(p, first[f"n{i}"], found[i]) for p in wanted[name]]
    return out


def _positions(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return math.floor(at), math.ceil(at)


def _between(p: float, n: int, values: Mapping[int, float]) -> float:
    low, high = _positions(p, n)
    at, a, b = p * (n - 1), values[low], values[high]
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def _around(i: int, wanted: Sequence[float]) -> list[Column]:
    """Sketched values below and above each probability, by twice the sketch's error; the ends are the column's own."""
    shares = [F.lit(x) for p in wanted for x in (max(p - 2 / ACCURACY, 0.0), min(p + 2 / ACCURACY, 1.0))]
    ends = F.percentile_approx(f"v{i}", F.array(*shares), ACCURACY)  # one sketch for both
    return [F.filter(ends, lambda _, j: j % 2 == 0).alias(f"a{i}"), F.filter(ends, lambda _, j: j % 2 == 1).alias(f"b{i}")]


def _key(x: float) -> tuple[bool, float]:
    """Order of doubles with NaN last."""
    return (x != x, 0.0 if x != x else x)


def _disjoint(spans: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans, key=lambda s: _key(s[0])):
        if out and _key(low) <= _key(out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], high, key=_key))
        else:
            out.append((low, high))
    return out


def _select(table: DataFrame, ranks: dict[int, list[int]], bounds: dict[int, list[tuple[float, float]]]) -> dict[int, dict[int, float]]:
    """The values of the wanted ranks (from 0) of columns v0, v1, ...: exact, whatever the bounds."""
    spans = [(i, s, low, high) for i, own in bounds.items() for s, (low, high) in enumerate(own)]
    if not spans:
        return {}
    counts = table.agg(*[f(F.col(f"v{i}")).alias(f"{k}_{i}_{s}") for i, s, low, high in spans for k, f in (("below", lambda c, x=low: F.count_if(c < x)), ("upto", lambda c, x=high: F.count_if(c <= x)))]).first()
    kept: dict[tuple[int, int], tuple[int, list[int]]] = {}
    edges: dict[int, list[tuple[int, float | None, float | None]]] = {}
    for i, own in ranks.items():
        left = set(own)
        for s, (low, high) in enumerate(bounds[i]):
            below, upto = counts[f"below_{i}_{s}"], counts[f"upto_{i}_{s}"]
            inside = [k for k in own if below <= k < upto]
            if inside:
                kept[i, s] = (below, inside)
                edges.setdefault(i, []).append((s, low, high))
                left -= set(inside)
        if left:  # the sketch was further off than it says: take the whole column
            for s in range(len(bounds[i])):
                kept.pop((i, s), None)
            kept[i, 0], edges[i] = (0, own), [(0, None, None)]
    cells = []
    for i, own in edges.items():
        v = F.col(f"v{i}")
        slot = None
        for s, low, high in own:
            hit = v.isNotNull() if low is None else (v >= low) & (v <= high)
            slot = F.when(hit, s) if slot is None else slot.when(hit, s)
        cells.append(F.when(slot.isNotNull(), F.struct(F.lit(i).alias("c"), slot.alias("s"), v.alias("v"))))
    inside = table.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    values = inside.groupBy("c", "s", "v").agg(F.count(F.lit(1)).alias("f"))
    return _narrowed(values, kept)


def _narrowed(values: DataFrame, kept: dict[tuple[int, int], tuple[int, list[int]]]) -> dict[int, dict[int, float]]:
    """The values of ranks from (c, s, v, f), distinct values with their counts; kept: what lies below each (c, s), and its ranks."""
    from .windows import kept as written

    spark = values.sparkSession
    values = written(values)
    least = 4 * sum(len(ranks) for _, ranks in kept.values())  # each rank keeps a value, and can't be left with less
    while values.count() > max(VALUES, least):
        # cuts come from the distinct values, so each round leaves about one in RANGES of them for each rank
        shares = [k / RANGES for k in range(1, RANGES)]
        # a sketch follows the order in which parts of it arrive, so the cuts are written: sums and values are told apart by the same ones
        cuts = written(values.groupBy("c", "s").agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in shares]), 4 * RANGES).alias("cuts")))
        at = place_among(F.col("cuts"), RANGES, lambda x: x < F.col("v"))
        placed = values.join(F.broadcast(cuts), ["c", "s"]).withColumn("r", at).drop("cuts")  # one row for each column and rank
        sums = {(x.c, x.s, x.r): x.f for x in placed.groupBy("c", "s", "r").agg(F.sum("f").alias("f")).collect()}
        after: dict[tuple[int, int], tuple[int, list[int]]] = {}
        where, numbers = [], {}
        for (c, s), (below, ranks) in sorted(kept.items()):
            for r in range(RANGES):
                f = sums.get((c, s, r), 0)
                inside = [k for k in ranks if below <= k < below + f]
                if inside:
                    numbers[c] = numbers.get(c, -1) + 1
                    after[c, numbers[c]] = (below, inside)
                    where.append((c, s, r, numbers[c]))
                below += f
        chosen = spark.createDataFrame(where, "c int, s int, r int, t int")
        values = written(placed.join(F.broadcast(chosen), ["c", "s", "r"]).select("c", F.col("t").alias("s"), "v", "f"))
        kept = after
    groups: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for x in values.collect():
        groups.setdefault((x.c, x.s), []).append((x.v, x.f))
    out: dict[int, dict[int, float]] = {}
    for (c, s), (below, ranks) in kept.items():
        upto, rest = below, list(ranks)
        for v, f in sorted(groups[c, s], key=lambda p: _key(p[0])):
            upto += f
            while rest and rest[0] < upto:
                out.setdefault(c, {})[rest.pop(0)] = v
    return out


def group_quantiles(table: DataFrame, by: Sequence[str], value: str, wanted: Sequence[float] = (0.5,), name: str = "quantiles") -> DataFrame:
    """(by..., name): the exact quantiles of a column in each group as an array; a group without values gives null.

    A group of up to ``windows.PLAIN_ROWS`` values is ordered by one task. Of larger ones the distinct values are counted
    and their running sums dealt over ranges of (group, value), so that such a group isn't one task's. A value finds the
    wanted ranks that it holds by halving; no value is joined with the ranks of its group.
    """
    from . import windows
    from .joins import small

    by, shares = list(by), sorted({float(p) for p in wanted})
    groups = table.groupBy(*by).agg(F.count(_double(value)).alias("_n")).withColumn("_g", F.struct(*by))
    if not shares:
        return groups.select(*by, F.lit(None).cast("array<double>").alias(name))
    values = table.select(F.struct(*by).alias("_g"), _double(value).alias("_v")).filter("_v IS NOT NULL")
    large = windows.kept(groups.filter(F.col("_n") > windows.PLAIN_ROWS).select("_g", "_n"))  # one in PLAIN_ROWS of the rows at most
    alone = large.isEmpty()
    own = Window.partitionBy("_g")
    placed = (values if alone else values.join(small(large.select("_g")), "_g", "left_anti")).withColumns({"_to": F.row_number().over(own.orderBy("_v")).cast("long"), "_n": F.count(F.lit(1)).over(own)})
    placed = placed.select("_g", "_v", "_n", (F.col("_to") - 1).alias("_from"), "_to")
    if not alone:
        starts = windows.kept(windows.running(large, F.col("_g"), _upto=F.col("_n")).select("_g", "_n", (F.col("_upto") - F.col("_n")).alias("_before")))
        counts = values.join(small(large.select("_g")), "_g", "left_semi").groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_f"))
        summed = windows.running(counts, F.struct("_g", "_v"), _upto=F.col("_f")).join(small(starts), "_g")
        placed = placed.unionByName(summed.select("_g", "_v", "_n", (F.col("_upto") - F.col("_f") - F.col("_before")).alias("_from"), (F.col("_upto") - F.col("_before")).alias("_to")))
    p = F.lit(np.array(shares))  # one constant
    place = lambda x: x * (F.col("_n") - 1)
    first = place_among(p, len(shares), lambda x: F.ceil(place(x)) < F.col("_from"))
    after = place_among(p, len(shares), lambda x: F.floor(place(x)) < F.col("_to"))
    hit = placed.withColumn("_first", first).filter(F.floor(place(F.get(p, F.col("_first")))) < F.col("_to")).withColumn("_after", after)
    hit = hit.select("_g", "_v", "_n", F.explode(F.sequence("_first", F.col("_after") - 1)).alias("_i"))
    each = hit.groupBy("_g", "_i").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max("_n").alias("_n"))
    each = each.withColumn("_at", place(F.get(p, F.col("_i"))))
    low, high = F.floor("_at"), F.ceil("_at")
    between = F.when((low == high) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((high - F.col("_at")) * F.col("_a") + (F.col("_at") - low) * F.col("_b"))
    lists = each.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", between.alias("q")))), lambda x: x["q"]).alias("_q"))  # as many as were asked for
    at = {x: i for i, x in enumerate(shares)}
    asked = F.lit(np.array([at[float(x)] for x in wanted]))
    lists = lists.select(F.col("_g").alias("_h"), F.transform(asked, lambda i: F.get("_q", i.cast("int"))).alias(name))
    return groups.join(lists, F.col("_g").eqNullSafe(F.col("_h")), "left").select(*by, name)


def value_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, v, f): how often each non-null value of the columns occurs; c is the column's number, v its value as text."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    return table.select(F.explode(cells).alias("x")).filter("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("f"))


def top_values(table: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[str]]:
    """The ``most`` most frequent values of each column, of equals the least first; ``most`` for each column come to the driver."""
    if not columns:
        return {}
    first = Window.partitionBy("c").orderBy(F.desc("f"), "v")
    # a part of a column first, so that no task ranks all distinct values of one
    parts = Window.partitionBy("c", F.pmod(F.xxhash64("v"), F.lit(256))).orderBy(F.desc("f"), "v")
    counts = value_counts(table, columns).withColumn("n", F.row_number().over(parts)).filter(F.col("n") <= most)
    best = counts.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in best.orderBy("c", "n").select("c", "v").collect():
        out[columns[r.c]].append(r.v)
    return out


@dataclass(frozen=True)
class Fitted:
    """What a table's columns were found to hold: fills for nulls, and for text the codes of its values, which are their places in byte order."""

    fills: dict[str, float] = field(default_factory=dict)
    codes: dict[str, dict[str, int]] = field(default_factory=dict)
    others: dict[str, int] = field(default_factory=dict)

    def applied(self, name: str) -> Column:
        """A column as a number, with the statistics as constants: nothing is joined."""
        c = F.col(f"`{name}`")
        if name in self.fills:
            return F.coalesce(c.cast("double"), F.lit(self.fills[name])).alias(name)
        known = self.codes[name]
        if not known:
            return F.lit(-1).alias(name)
        # looked up by halving, with a lambda: Spark runs that outside of whole-stage code, so the projection of a wide table is
        # split into methods that are compiled; in one method over 8000 bytes all its columns would be interpreted
        values = F.array(*[F.lit(v) for v in known])
        code = place_among(values, len(known), lambda x: x < c, lambda at: F.when(F.get(values, at) == c, at))
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.coalesce(code, F.lit(self.others.get(name, -1)))).alias(name)


def fit_columns(table: DataFrame, columns: Sequence[str], most_values: int = 100, other: str = "_other_") -> Fitted:
    """Medians of numeric columns (0 without values), codes of text columns: the same few jobs for any number of columns.

    A text column with more than ``most_values`` values keeps all but the least frequent of that many and takes the others for
    ``other``; codes go from 0 by value. Null is -1, and so are values that weren't seen when all were kept.
    """
    numbers = [c for c in columns if isinstance(table.schema[c].dataType, NumericType)]
    texts = [c for c in columns if isinstance(table.schema[c].dataType, StringType)]
    middle = quantiles(table, {c: [0.5] for c in numbers})
    codes, others = {}, {}
    for c, values in top_values(table, texts, most_values + 1).items():
        many = len(values) > most_values
        known = sorted({*values[: most_values - 1], other} if many else values, key=lambda v: v.encode())
        codes[c] = {v: i for i, v in enumerate(known)}
        if many:
            others[c] = codes[c][other]
    return Fitted({c: 0.0 if q[0] is None else q[0] for c, q in middle.items()}, codes, others)


#: Size of the distinct-value sketches: 2 ** 14 registers, a standard error of 0.8 %.
SKETCH = 14
#: Five standard errors: how far an estimate may lie from the count.
SPREAD = 0.045


def distinct_counts(table: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(name, n_distinct): the exact number of distinct known values of each expression.

    One aggregate for each expression, in one job: each reads its own column only and merges equal values before it
    shuffles, so no row is copied once a column. Where reading ``table`` means computing it, write it first.
    """
    parts = []
    for name, value in columns.items():
        known = table.select(value.alias("v")).filter("v IS NOT NULL").distinct()
        parts.append(known.agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(name).alias("name"), "n_distinct"))
    if not parts:
        return table.sparkSession.createDataFrame([], "name string, n_distinct long")
    return reduce(lambda a, b: a.union(b), parts)


def distinct_sketch(value: Column) -> Column:
    """An aggregate that estimates the number of distinct known values, in a buffer of bounded size. Few values are counted exactly."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(SKETCH)))


def distinct_bounds(table: DataFrame, columns: Mapping[str, Column]) -> tuple[int, dict[str, tuple[float, float]]]:
    """(rows, {name: (least, most)}): between what the distinct counts lie (five standard errors), from one pass over all columns."""
    names = list(columns)
    one = table.agg(F.count(F.lit(1)).alias("n"), *[distinct_sketch(columns[c]).alias(f"u{i}") for i, c in enumerate(names)]).first()
    found = [(c, one[f"u{i}"] or 0) for i, c in enumerate(names)]
    return one["n"], {c: (u * (1 - SPREAD) - 1, u * (1 + SPREAD) + 1) for c, u in found}
