"""Column statistics against plain computations, and the shape of the plans they lead to."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import metrics, quality, statistics, windows
from terrace.plans.queries import QUERIES


def brute(values, p):
    values = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    if not values:
        return None
    at = p * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if a == b or math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


def columns(seed, n):
    rng = random.Random(seed)
    return {
        "plain": [rng.random() for _ in range(n)],
        "skewed": [math.exp(rng.gauss(0, 9)) for _ in range(n)],
        "hot": [7.0 if rng.random() < 0.6 else rng.gauss(7, 3) for _ in range(n)],
        "few": [float(rng.randrange(3)) for _ in range(n)],
        "gaps": [None if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(n)],
        "nothing": [None] * n,
        "odd": [rng.choice([float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-300]) for _ in range(n)],
        "one": [3.5] + [None] * (n - 1),
    }


def frame(spark, data):
    return spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(3)


@pytest.mark.parametrize("n, limit", [(1, 100_000), (2, 100_000), (5000, 100_000), (5000, 40)])
def test_quantiles(spark, monkeypatch, n, limit):
    """With a small limit the ranges are narrowed down in rounds on the cluster."""
    monkeypatch.setattr(statistics, "VALUES", limit)
    monkeypatch.setattr(statistics, "RANGES", 256 if limit > 1000 else 16)
    data = columns(n, n)
    wanted = {c: [0.0, 0.1, 0.25, 0.5, 0.731, 1.0] for c in data}
    got = statistics.quantiles(frame(spark, data), wanted)
    for c, values in data.items():
        assert got[c] == pytest.approx([brute(values, p) for p in wanted[c]], nan_ok=True), c


def test_many_ranks_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(statistics, "VALUES", 1500)
    rng = np.random.default_rng(1)
    values = rng.normal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    grid = [i / 1000 for i in range(1001)]
    assert statistics.quantiles(df, {"v": grid})["v"] == pytest.approx(np.quantile(values, grid).tolist())


def test_bounds_of_a_sketch_that_is_off(spark, monkeypatch):
    monkeypatch.setattr(statistics, "_around", lambda i, wanted: [F.array(*[F.lit(5.0) for _ in wanted]).alias(f"{k}{i}") for k in "ab"])
    data = columns(3, 200)
    got = statistics.quantiles(frame(spark, data), {"plain": [0.5], "hot": [0.2, 0.9]})
    assert got == {c: pytest.approx([brute(data[c], p) for p in ps]) for c, ps in (("plain", [0.5]), ("hot", [0.2, 0.9]))}


def test_group_quantiles(spark, monkeypatch):
    monkeypatch.setattr(windows, "PLAIN_ROWS", 50)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), None if rng.random() < 0.2 else rng.gauss(0, 1)) for _ in range(900)] + [("c", "x", None)]
    got = statistics.group_quantiles(spark.createDataFrame(rows, "g string, h string, v double"), ["g", "h"], "v", [0.5, 0.9]).collect()
    assert len(got) == len({r[:2] for r in rows})
    for r in got:
        own = [v for g, h, v in rows if (g, h) == (r.g, r.h)]
        assert r.quantiles == (pytest.approx([brute(own, 0.5), brute(own, 0.9)]) if any(v is not None for v in own) else None)


def test_medians_by_group_everywhere(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("a", 2, None), ("b", 4, 3.0), (None, 9, 1.0)], "k string, n int, v double")
    assert {tuple(r) for r in metrics.datum_by_domain(rows, "median", "n", "k").collect()} == {("a", 2.0), ("b", 4.0), (None, 9.0)}
    assert {tuple(r) for r in metrics.grouped_vector(rows, "k", "v", "median").collect()} == {("a", 1.5), ("b", 3.0), (None, 1.0)}
    assert {tuple(r) for r in metrics.dimension_groups(rows, ["k"], {"n": "median", "v": "max"}).collect()} == {("a", 2.0, 2.0, 3), ("b", 4.0, 3.0, 1)}
    assert tuple(metrics.datum(rows, "median", "n").first()) == (4.0, "median of n", "median")
    assert tuple(metrics.datum(rows, "median", "v", nulls="fill").first())[0] == 1.0


def test_top_values_and_modes(spark):
    rows = spark.createDataFrame([(v, w, str(i)) for i, (v, w) in enumerate([("x", None)] * 3 + [("y", None)] * 3 + [("z", "q"), (None, None), ("é", None)])], "v string, w string, u string")
    assert statistics.top_values(rows, ["v", "w", "u"], 2) == {"v": ["x", "y"], "w": ["q"], "u": ["0", "1"]}
    assert tuple(metrics.categorical_datum(rows, "v").first()) == ("x", 9, 4)
    assert tuple(metrics.categorical_datum(rows.limit(0), "v").first()) == (None, 0, 0)
    assert [r.w for r in quality.impute(rows, "w").collect()] == ["q"] * 9


def test_preparation_codes_and_fills(spark):
    rows = [(i, "t", f"v{i % 7}", None if i % 3 else "w", i * 1.0 if i % 2 else None, None) for i in range(40)] + [(99, None, "gone", "gone", 1e9, 5)]
    df = spark.createDataFrame(rows, "_rid int, y string, a string, b string, n double, m int").withColumn("day", F.current_date())
    out, features = quality.prepare(df, "y", most_values=3)
    assert features == ["a", "b", "n", "m"] and out.columns == ["_rid", "y", *features]
    got = {r["_rid"]: r for r in out.collect()}
    assert len(got) == 40
    # v0 to v4 occur six times, the others five times: two are kept besides all others, which sort first
    assert [got[i].a for i in range(7)] == [1, 2, 0, 0, 0, 0, 0]
    assert got[0].b == 0 and got[1].b == -1 and got[1].n == 1.0 and got[2].n == 20.0 and got[5].m == 0.0


@pytest.mark.parametrize("k", [2, 20, 200])
def test_scans_of_the_preparation_do_not_grow(spark, k, tmp_path):
    wide = spark.range(300).select(F.col("id").alias("_rid"), (F.col("id") % 2).cast("string").alias("y"), *[(F.when(F.col("id") % (i + 2) != 0, F.xxhash64("id", F.lit(i)) % 50)).alias(f"c{i}") for i in range(k)], *[F.concat(F.lit("t"), F.col("id") % (i + 2)).alias(f"t{i}") for i in range(k // 10)])
    wide.write.parquet(str(tmp_path / "wide"))
    rows, features = quality.prepare(spark.read.parquet(str(tmp_path / "wide")), "y")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and len(features) == k + k // 10
    assert rows.count() == 300 and rows.filter(" OR ".join(f"{c} IS NULL" for c in features)).count() == 0


def largest_method(spark, df) -> int:
    """Bytes of the largest method that Spark makes for the stages of a plan; the JVM compiles none over 8000."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max((stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())), default=0)


def test_methods_of_the_preparation_are_compiled(spark):
    out = QUERIES["wide_preparation"](spark, "/root/testdata/sf0.001")
    assert largest_method(spark, out) < 8000


def test_one_sketch_gives_both_ends(spark):
    df = spark.range(2000).select((F.col("id") * 1.0).alias("v0"), (F.col("id") * -1.0).alias("v1"))
    out = df.agg(F.count("v0"), *statistics._around(0, [0.25, 0.5]), *statistics._around(1, [1.0]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_percentile_approx(") == 2
    r = out.first()
    assert len(r.a0) == len(r.b0) == 2 and r.a0[0] < 500 < r.b0[0] < r.a0[1] < 1000 < r.b0[1] and r.a1[0] <= r.b1[0] == 0


def test_codes_follow_the_order_of_bytes(spark):
    values = ["Z", "a", "é", "\uffff", "\U0001f600", "", "ab", "A"]
    df = spark.createDataFrame([(i, "t", v) for i, v in enumerate([*values, None])], "_rid int, y string, v string")
    rows, _ = quality.prepare(df, "y")
    got = {values[r["_rid"]]: r.v for r in rows.filter("_rid < 8").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=str.encode))} and rows.filter("_rid = 8").first().v == -1
    fitted = statistics.fit_columns(df, ["v"])
    other = spark.createDataFrame([("b",), ("A0",), ("\U0010ffff",), ("a",)], "v string").select(fitted.applied("v"))
    assert [r.v for r in other.collect()] == [-1, -1, -1, got["a"]]


@pytest.mark.parametrize("name", ["five_numbers", "ascend_median_split", "quantile_category", "impute_median", "numeric_datum", "categorical_datum", "prepared_features", "wide_preparation", "applied_suggestions", "dimension_medians"])
def test_no_aggregate_that_holds_all_values(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not any(f"{f}(" in plan for f in ("percentile", "median", "mode"))


@pytest.mark.parametrize("n, dims, block", [(400, 2, 8), (300, 5, 16), (50, 1, 512)])
def test_nearest_neighbours_by_boxes(spark, monkeypatch, n, dims, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = np.random.default_rng(n)
    points = np.concatenate([rng.normal(size=(n // 2, dims)), rng.normal(size=(n - n // 2, dims)) * 0.01 + 9, np.zeros((5, dims))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, v array<double>").repartition(3)
    found = windows.nearest(df, "i", "v", 4)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "CartesianProduct" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.i, []).append((r.n, r.neighbour))
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for i in range(len(points)):
        want = sorted((far[i, j], j) for j in range(len(points)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_pairs_of_boxes_grow_near_linearly(spark, monkeypatch):
    """Four times the points: the blocks that meet are about four times as many, not sixteen."""
    monkeypatch.setattr(windows, "BLOCK", 16)
    met = []
    near = windows._near_boxes
    monkeypatch.setattr(windows, "_near_boxes", lambda boxes, dims: met.append(near(boxes, dims).count()) or near(boxes, dims))
    for n in (1000, 4000):
        rng = np.random.default_rng(7)
        windows.nearest(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.random((n, 2)))], "i int, v array<double>"), "i", "v", 3)
    assert met[1] < 7 * met[0], met


def test_place_among(spark):
    """Halving finds the place that counting all known values finds, also among equal and null keys."""
    from terrace.functions.numeric import place_among

    for size in (0, 1, 2, 7, 8, 31):
        known = sorted(random.Random(size).choices(range(20), k=size))
        rows = spark.range(-2, 23).withColumn("known", F.lit(known).cast("array<long>"))
        got = rows.select("id", place_among(F.col("known"), max(size, 1), lambda x: x <= F.col("id")).alias("n")).collect()
        assert all(r.n == sum(k <= r.id for k in known) for r in got), size


@pytest.mark.parametrize("plain", [30, 100_000])
def test_group_quantiles_of_small_and_large_groups(spark, monkeypatch, plain):
    """A thousand ranks of each group; ranks are not joined to values, so no row of the plan meets them all."""
    monkeypatch.setattr(windows, "PLAIN_ROWS", plain)
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, rng.gauss(0, 5)])) for _ in range(900)] + [("c", 2.0), ("d", None)]
    grid = [i / 1000 for i in range(1001)][::-1]
    out = statistics.group_quantiles(spark.createDataFrame(data, "g string, v double").repartition(3), ["g"], "v", grid)
    got = {r.g: r.quantiles for r in out.collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["d"] is None
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx([brute([v for h, v in data if h == g], p) for p in grid])
    assert "_k#" not in out._jdf.queryExecution().analyzed().toString()


def test_quantiles_of_sketches_that_differ_when_computed_again(spark, monkeypatch):
    """On a cluster a sketch's parts are merged in the order of their arrival: a second computation may cut elsewhere."""
    known = statistics.F.percentile_approx

    def shifting(*args):
        import random

        moved = statistics.F.udf(lambda xs: sorted(x + random.SystemRandom().uniform(-30, 30) for x in xs), "array<double>")
        return moved(known(*args))

    monkeypatch.setattr(statistics, "VALUES", 20)
    monkeypatch.setattr(statistics, "RANGES", 4)
    monkeypatch.setattr(statistics.F, "percentile_approx", shifting)
    df = spark.range(500).select((F.col("id") * 1.0).alias("v"))
    assert statistics.quantiles(df, {"v": [0.0, 0.3, 0.5, 1.0]})["v"] == pytest.approx([0.0, 149.7, 249.5, 499.0])


def test_a_global_order_computes_its_rows_once(spark, monkeypatch):
    """Counting rows, finding cuts and dealing rows read what was written, whatever computing them costs."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(windows, "PLAIN_ROWS", 100)
    df = spark.range(1000).mapInArrow(each, "id long")
    out = windows.running(df, F.col("id"), s=F.lit(1))
    assert out.agg(F.max("s"), F.count("s")).first() == (1000, 1000) and seen.value == 1000


def test_one_column_is_drawn_without_ranks_of_its_values(spark, monkeypatch):
    """A single column has no correlations: no value is ranked for them, and draws keep the class's distribution."""
    from terrace.operators import synth

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("t"), (F.col("id") * 1.0).alias("v"))
    monkeypatch.setattr(synth.windows, "running", lambda *a, **k: pytest.fail("values were ranked"))
    made = synth.generate_classes(rows, "t", {"a": 2000, "b": 500}, ["v"])
    got = {r.t: (r.n, r.m) for r in made.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"a": 2000, "b": 500} and all(abs(m - 1500) < 120 for _, m in got.values())
