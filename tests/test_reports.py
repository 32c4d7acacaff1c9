import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import discovery, quality, statistics, synth
from terrace.sources import readers, sinks


def test_no_row_is_copied_once_a_column(spark):
    df = spark.range(1000).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(6)])
    for found in (quality.profile(df), quality.profile(df, exact=False), quality.scores(df), discovery.column_profile(df), statistics.distinct_counts(df, {c: F.col(c) for c in df.columns})):
        assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.name: r.n_distinct for r in statistics.distinct_counts(df, {c: F.col(c) for c in df.columns}).collect()} == {f"c{i}": i + 1 for i in range(6)}


def test_few_values_have_the_same_type_by_sketch_and_by_count(spark):
    df = spark.range(5000).select(*[(F.col("id") % n).cast("double").alias(f"c{n}") for n in (1, 9, 10, 11, 12, 40)], F.lit(None).cast("double").alias("none"))
    kinds = [{r.column: r.type for r in quality.profile(df, exact=e).collect()} for e in (True, False)]
    assert kinds[0] == kinds[1] and kinds[0]["c10"] == "categorical" and kinds[0]["c11"] == "numeric" and kinds[0]["none"] == "categorical"


def test_key_columns_near_their_limits(spark):
    def brute(rows, names):
        best = None
        for place, c in enumerate(names):
            u = len({r[place] for r in rows if r[place] is not None}) / len(rows) if rows else 0.0
            conf = discovery.key_confidence(discovery.is_id_name(c), u, place)
            if conf and (best is None or (conf, u if conf > 0.5 else 0.0) > best[0]):
                best = ((conf, u if conf > 0.5 else 0.0), c, conf, u)
        return best[1:]

    for shares in ((0.5, 0.52, 0.48), (0.9, 0.905, 0.89), (1.0, 1.0, 0.999), (0.1, 0.101, 0.09)):
        rows = [tuple(int(i % max(round(2000 * s), 1)) for s in shares) for i in range(2000)]
        names = ("amount", "code_x", "size")
        got = discovery.key_columns({"t": spark.createDataFrame(rows, list(names))}).first()
        assert (got.column, got.confidence, got.uniqueness) == pytest.approx(brute(rows, names))
    empty = discovery.key_columns({"t": spark.createDataFrame([], "a int, b int")}).first()
    assert (empty.column, empty.confidence, empty.uniqueness) == ("a", 0.5, 0.0)


def test_dialects_of_a_folder(spark, tmp_path):
    files = {
        "a.csv": ("id,name,price\n1,école,1.5\n2,b,-2.25\n3,c\n", "utf-8"), "b.csv": ("id;name;price\n4;musée;1 000,5\n5;d;x\n6;e;3,25\n", "cp1252"),
        "c.csv": ("id\tname\tprice\n7\tx,y\t0,5\n8\t\t\n", "utf-8"), "d.csv": ("id|name|price\n9|ü|4.0\n", "iso-8859-1"),
    }
    for name, (text, encoding) in files.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    said = {r.path.rsplit("/", 1)[1]: (r.encoding, r.sep, r.decimal) for r in readers.dialects(spark, str(tmp_path)).collect()}
    assert said == {"a.csv": ("utf-8", ",", "."), "b.csv": ("iso-8859-1", ";", ","), "c.csv": ("utf-8", "\t", ","), "d.csv": ("iso-8859-1", "|", ".")}
    out = readers.read_dialects(spark, str(tmp_path), "id int, name string, price double").cache()
    rows = {r.id: (r.name, r.price, r._bad is not None) for r in out.collect()}
    assert rows == {1: ("école", 1.5, False), 2: ("b", -2.25, False), 3: ("c", None, True), 4: ("musée", 1000.5, False), 5: ("d", None, True), 6: ("e", 3.25, False), 7: ("x,y", 0.5, False), 8: (None, None, False), 9: ("ü", 4.0, False)}
    assert out.filter("_bad IS NOT NULL").count() == 2 and out.select("_file").distinct().count() == 4


def test_classes_are_drawn_from_their_own_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, centre, rho in (("a", 0.0, 0.9), ("b", 100.0, -0.8), ("c", 50.0, 0.0)):
        x = rng.multivariate_normal([centre, -centre], [[4, 4 * rho], [4 * rho, 4]], 800)
        rows += [(name, float(u), float(v)) for u, v in x]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), ("d", 7.0, None), ("e", 3.0, 4.0)], "k string, u double, v double")
    made = synth.generate_classes(df, "k", {"a": 3000, "b": 1000, "d": 50, "e": 20, "absent": 10, None: 5}).cache()
    assert {r.k: r["count"] for r in made.groupBy("k").count().collect()} == {"a": 3000, "b": 1000, "e": 20}
    got = {r.k: r for r in made.groupBy("k").agg(F.avg("u").alias("m"), F.stddev("u").alias("s"), F.covar_pop("u", "v").alias("c"), F.stddev("v").alias("t")).collect()}
    assert abs(got["a"].m) < 0.2 and abs(got["b"].m - 100) < 0.4 and abs(got["a"].s - 2) < 0.2 and got["a"].c > 0.85 * got["a"].s * got["a"].t and got["b"].c < -0.7 * got["b"].s * got["b"].t
    assert (got["e"].m, got["e"].s) == (3.0, 0.0)
    again = synth.generate_classes(df.repartition(7), "k", {"a": 3000, "b": 1000, "d": 50, "e": 20})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made.collect()))
    assert synth.targeted(df, "k", "c", 12_345).count() == 12_345
    assert synth.generate_classes(df, "k", {}).count() == 0


def test_report_has_all_sections(spark):
    rows = [(i, float(i % 7), 50.0 if i == 3 else float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "_rid long, a double, b double")
    importance = spark.createDataFrame([("a", 0.5), ("b", 0.01)], "feature string, importance double")
    profile = quality.profile(df.drop("_rid"))
    said = quality.suggest(profile, spark.createDataFrame([], "a string, b string, correlation double"), importance.withColumnRenamed("feature", "column"))
    report = quality.quick_score(df).join(profile.agg(F.collect_list(F.struct("*")).alias("profile")))
    out = sinks.report_rows(report, said, importance, quality.anomalies(df, ["a", "b"], k=5, top_percent=1.0)).collect()
    by = {}
    for r in out:
        by.setdefault(r.section, []).append(r.item)
    assert set(by) == {"score", "profile", "suggestion", "top", "low", "anomaly", "reason"}
    assert by["top"] == ["a", "b"] and by["low"] == ["b"] and "3" in by["anomaly"] and sorted(by["profile"]) == ["a", "b"]
