"""Traps, edge cases and properties of the operators, on small hand-made tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import categories as C
from terrace.functions import numeric as N
from terrace.functions import text as T
from terrace.operators import catalog, categorize, discovery, extract, graph, joins, metrics, quality, sets, synth, windows
from terrace.plans import levels, lineage, queries


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_null_keys_match_nothing(spark):
    a, b = table(spark, [(None, 1), ("x", 2)], "k string, v int"), table(spark, [(None, 3), ("x", 4)], "k string, v int")
    got = joins.key_join(a, b, "k", "k").collect()
    assert len(got) == 3 and {(r.v, r.v_right) for r in got} == {(1, None), (2, 4), (None, 3)}
    assert joins.key_join(a, b, "k", "k", "inner").columns == ["k", "v", "k_right", "v_right"]


def test_numeric_keys(spark):
    a, b = table(spark, [("01",), ("x",), ("2.0",)], "k string"), table(spark, [("1",), ("2",), ("x",)], "j string")
    assert {(r.k, r.j) for r in joins.key_join(a, b, "k", "j", "inner", numeric_keys=True).collect()} == {("01", "1"), ("2.0", "2")}


def test_cross_join_is_guarded(spark):
    a = spark.range(100)
    with pytest.raises(ValueError):
        joins.cross_join(a, a.withColumnRenamed("id", "j"), 100)
    assert joins.cross_join(a, a.withColumnRenamed("id", "j"), 10_000).count() == 10_000


def test_semantic_join_ties_and_empty_results(spark):
    a = table(spark, [(1, "alpha beta"), (2, "zzzz"), (3, None)], "i int, name string")
    b = table(spark, [("alpha beta", 1), ("alpha betas", 2)], "name string, w int")
    best = joins.semantic_join(a, b, "name", "name", 0.6, best_only=True)
    assert [(r.i, r.name_right) for r in best.collect()] == [(1, "alpha beta")]
    left = joins.semantic_join(a, b, "name", "name", 0.6, best_only=True, how="left")
    assert {(r.i, r.name_right) for r in left.collect()} == {(1, "alpha beta"), (2, None), (3, None)}
    assert joins.semantic_join(a, b, "name", "name", 1.1).columns == best.columns
    assert joins.semantic_join(a, b, "name", "name", 1.1).count() == 0


def test_lsh_pairs_find_most(spark):
    rows = [(i, [math.cos(i / 7), math.sin(i / 7), math.cos(i / 3), math.sin(i / 3)]) for i in range(120)]
    a = table(spark, rows, "l long, vector array<double>")
    b = table(spark, rows, "r long, vector array<double>")
    exact = {(x.l, x.r) for x in joins.similar_pairs(a, b, 0.95, "l", "r").collect()}
    near = {(x.l, x.r) for x in joins.similar_pairs_lsh(a, b, 0.95, "l", "r", 4).collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact)


def test_duplicates_do_not_collide_on_separators(spark):
    df = table(spark, [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "x"), (4, None, "x")], "i int, x string, y string")
    got = {r.i: (r.is_potential_duplicate, r.duplicate_group) for r in windows.find_duplicates(df, ["x", "y"]).collect()}
    assert got == {1: (False, 0), 2: (False, 0), 3: (True, 1), 4: (True, 1)}


def test_transform_kind_is_typed(spark):
    df = table(spark, [(float(math.exp(i / 4)), i) for i in range(60)], "catalog double, y int")
    said = quality.suggest(quality.profile(df), metrics.correlations(df, ["catalog"]), table(spark, [("catalog", 0.5), ("y", 0.5)], "column string, importance double")).collect()
    assert {(r.kind, tuple(r.features), r["transform"]) for r in said} == {("transform", ("catalog",), "log")}
    squared = quality.transform_feature(table(spark, [(-2.0,), (3.0,)], "catalog double"), "catalog", "square")
    assert sorted(r.catalog for r in squared.collect()) == [4.0, 9.0]


def test_preview_uses_whole_column(spark):
    df = table(spark, [(float(i),) for i in range(100, 0, -1)], "v double").coalesce(1)
    got = extract.preview(df, lambda t: quality.impute(t, "v", indicator=False), ["v"], 3).collect()
    assert [r.v_before for r in got] == [100.0, 99.0, 98.0]
    shifted = extract.preview(df.selectExpr("v - 50 AS v"), lambda t: quality.transform_feature(t, "v", "sqrt"), ["v"], 1).first()
    assert shifted.v_after == pytest.approx(math.sqrt(99))


def test_sum_of_text(spark):
    df = table(spark, [("1.5",), ("x",), (None,)], "value string")
    assert metrics.datum(df, "sum").first().value == 1.5
    with pytest.raises(ValueError):
        metrics.datum(table(spark, [("x",)], "value string"), "mean")
    with pytest.raises(ValueError):
        metrics.datum(df, "sum", nulls="error")
    assert metrics.datum(table(spark, [(1.0,), (None,)], "value double"), "mean", nulls="fill", fill=3.0).first().value == 2.0
    assert metrics.datum(table(spark, [], "value double"), "count").first().value == 0


def test_anomalies_come_from_the_top(spark):
    rows = [(i, float(i % 10), float(i // 10)) for i in range(100)] + [(100, 80.0, 80.0), (101, -60.0, 70.0)]
    df = table(spark, rows, "_rid long, x double, y double")
    found = quality.anomalies(df, ["x", "y"], top_percent=2.0, k=10).collect()
    assert {r._rid for r in sorted(found, key=lambda r: -r.score)[:2]} == {100, 101}
    assert all(r.contributors[0].contribution > 3 for r in found if r._rid >= 100)
    assert quality.anomaly_summary(quality.anomalies(df, ["x", "y"], top_percent=2.0, k=10), 102).first().total == len(found)


def test_nearest_in_buckets_agrees(spark):
    rows = [(i, [float(i % 13), float(i % 7)]) for i in range(80)]
    df = table(spark, rows, "i long, vector array<double>")
    exact = windows.nearest(df, "i", "vector", 3).groupBy("i").agg(F.max("distance").alias("d"))
    near = windows.nearest(df, "i", "vector", 3, bands=12, width=8.0, dims=2).groupBy("i").agg(F.max("distance").alias("e"))
    assert exact.join(near, "i").filter("abs(d - e) < 1e-9").count() >= 72


def test_similar_pairs_of_large_sides(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_ROWS", 10)
    vector = lambda i: [math.cos(i), math.sin(i)]
    for n, m in ((5, 40), (40, 5), (30, 40)):
        a, b = table(spark, [(i, vector(i)) for i in range(n)], "a long, vector array<double>"), table(spark, [(i, vector(i + 0.3)) for i in range(m)], "b long, vector array<double>")
        pairs = joins.similar_pairs(a, b, 0.5, "a", "b")
        sims = {(i, j): math.cos(i - j - 0.3) for i in range(n) for j in range(m)}
        assert {(r.a, r.b) for r in pairs.collect()} == {k for k, s in sims.items() if s >= 0.5}
        best = {r.a: r.b for r in joins.best_match(pairs, "a", "b", "similarity").collect()}
        assert best == {i: max(range(m), key=lambda j: sims[i, j]) for i in range(n) if max(sims[i, j] for j in range(m)) >= 0.5}


def test_local_outliers_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 32)
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice").orderBy("p_partkey").collect()
    x = np.array([[r.p_size, r.p_retailprice] for r in rows], float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    x = np.concatenate([x, [x[0]] * 60, [[50.0, -40.0]]])  # a heap of equal points and an isolated one
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)

    def brute(far):
        near = np.argsort(far, axis=1, kind="stable")[:, :20]
        dist = np.take_along_axis(far, near, 1)
        density = 1 / (np.maximum(dist, dist[near, -1]).mean(axis=1) + 1e-10)
        return dist, density[near].mean(axis=1) / density

    dist, score = brute(far)
    points = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "_rid long, vector array<double>")
    got = {(r._rid, r.n): r.distance for r in windows.nearest(points, "_rid", "vector", 20).collect()}
    assert len(got) == 20 * len(x) and all(abs(got[i, n + 1] - dist[i, n]) < 1e-9 for i in range(len(x)) for n in range(20))
    found = {r._rid: r.score for r in quality.lof(points).collect()}
    assert set(found) == set(range(len(x))) and all(abs(found[i] / score[i] - 1) < 1e-6 for i in found)
    _, own = brute(far[: len(rows), : len(rows)])
    listed = {r._rid: r.score for r in queries.QUERIES["local_outliers"](spark, d).collect()}
    wanted = {r.p_partkey: s for r, s in zip(rows, own) if (own <= s).mean() >= 0.95}
    assert set(listed) == set(wanted) and all(abs(listed[i] / wanted[i] - 1) < 1e-6 for i in wanted)


def test_hierarchy_null_branch_and_json(spark):
    df = table(spark, [("a", "x"), ("a", "y"), ("a", "x"), (None, "x")], "p string, q string")
    assert {(r.p, r.q, r.n) for r in metrics.dimension_hierarchy(df, ["p", "q"]).collect()} == {("a", None, 3), ("a", "x", 2), ("a", "y", 1)}
    assert metrics.dimension_hierarchy(df, ["p", "q"], keep_null=True).filter("level = 1").count() == 2
    assert metrics.hierarchy_json(df, ["p", "q"]).first().tree == '{"x":2,"y":1}'


def test_expansion_of_a_datum_gives_it_back(spark):
    vector = table(spark, [(i, float(i)) for i in range(10)], "_rid long, value double")
    state = levels.State(1, vector).descend(method="mean")
    again = state.ascend()
    assert again.level == 1 and metrics.datum(again.data, "mean").first().value == state.data.first().value
    assert again.ascend(dimensions=["pattern_type"]).ascend().data.count() == 10
    with pytest.raises(ValueError):
        levels.State(3, vector).ascend()
    with pytest.raises(ValueError):
        levels.State(0, vector).descend()


def test_detect_level(spark):
    one = spark.range(1)
    assert [levels.detect_level(x) for x in (one, spark.range(5), table(spark, [(1, 2)], "a int, b int"), table(spark, [(1, 2), (3, 4)], "a int, b int"))] == [0, 1, 1, 2]
    a, b = table(spark, [(i, "x") for i in range(20)], "cust_id long, n string"), table(spark, [(i, 0.5) for i in range(20)], "cust_id long, v double")
    assert levels.detect_level({"a": a, "b": b}) == 3
    assert levels.detect_level({"a": a, "b": table(spark, [("q",)], "z string")}) == 4


def test_dimensions(spark):
    df = table(spark, [("Total_Revenue",), ("previous",), ("network",), (None,), ("avg_qty",), ("x_2024",)], "v string")
    got = df.select("v", C.business_object(F.col("v")).alias("b"), C.pattern_type(F.col("v")).alias("p"), C.financial_view(F.col("v")).alias("f"), C.first_keyword(F.col("v"), C.BUSINESS_OBJECT, "other", True).alias("w")).collect()
    assert {r.v: (r.b, r.p, r.f, r.w) for r in got} == {
        "Total_Revenue": ("revenue", "raw", "Revenue", "other"), "previous": ("revenue", "raw", "Unknown", "other"), "network": ("other", "raw", "Margin", "other"),
        None: ("other", "raw", "Unknown", "other"), "avg_qty": ("volume", "averaged", "Unknown", "other"), "x_2024": ("other", "temporal", "Unknown", "other"),
    }
    own = C.Dimensions.built_in()
    with pytest.raises(ValueError):
        own.add(own.get("pattern_type"))
    strict = C.Dimension("d", ("a",), "none", lambda c: F.substring(c, 1, 1))
    assert [r.x for r in df.limit(2).select(strict.classify(F.lower("v")).alias("x")).collect()] == ["none", "none"]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.friendly_name(F.lit("fr-en-lycee-resultats-niveau-gt.csv"))) == "Lycee Resultats Niveau"
    assert value(T.friendly_name(F.lit("data_253ecdc0.csv"))) == "253ecdc0"
    assert value(T.friendly_name(F.lit("ab.csv"))) == "Data"
    assert value(T.property_name(F.lit("9 lives -- x!"))) == "col_9_lives_x" and value(T.property_name(F.lit("--"))) == "unknown"
    assert value(T.french_number(F.lit("1 234,5"))) == 1234.5 and value(T.french_number(F.lit("x"))) is None
    assert value(T.truncated(F.lit("one two three four"), 12)) == "one two..." and value(T.truncated(F.lit(None).cast("string"), 5)) == ""
    assert [value(T.file_size(F.lit(n))) for n in (5, 2048, 3 * 1024**2, 5 * 1024**4)] == ["5 B", "2.0 KB", "3.0 MB", "5.0 TB"]
    assert [value(T.is_question(F.lit(s))) for s in ("prix?", "quels prix", "le prix est haut", "prix est haut", "a b c d e f", "prix")] == [True, True, True, False, True, False]
    assert value(T.keywords(F.lit("Quels sont les prix des écoles, prix publics?"))) == ["prix", "écoles", "publics"]
    assert value(T.filter_map(F.lit("a=1, b = x=y,c"))) == {"a": "1", "b": "x=y"}
    assert value(T.article_signature(F.lit("CA brut - B2B - FR"))).parts == 3
    assert str(value(T.iso_timestamp(F.lit("2024-05-06 rest")))) == "2024-05-06 00:00:00" and value(T.iso_timestamp(F.lit("nope"))) is None
    assert value(T.map_file_to_entity(F.lit("big_customer_list.csv"), ["Order", "Customer"])) == "Customer"


def test_normal_functions(spark):
    got = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.5, 0.9, 0.999)], "p double").select("p", N.normal_quantile(F.col("p")).alias("x")).collect()
    wanted = {0.001: -3.090232, 0.02: -2.053749, 0.5: 0.0, 0.9: 1.281552, 0.999: 3.090232}
    assert all(abs(r.x - wanted[r.p]) < 1e-5 for r in got)


def test_quality_edges(spark):
    nulls = table(spark, [(None, None)] * 3, "a double, b string")
    assert quality.completeness(nulls).first().completeness == 0.0
    assert {r.a for r in quality.impute(nulls, "a").collect()} == {0.0} and {r.b for r in quality.impute(nulls, "b").collect()} == {"missing"}
    assert quality.diversity(quality.profile(table(spark, [(1,)], "a int"))).first().diversity == 25.0
    assert quality.profile(table(spark, [], "a int, b string")).count() == 2
    said = {r.warning.split(":")[0] for r in quality.warnings(table(spark, [(i, str(i)) for i in range(120)], "t int, c string"), "t").collect()}
    assert said == {"only categorical features", "many categories in c"}
    assert extract.top_variance(table(spark, [(1.0, 5.0), (2.0, 90.0)], "a double, b double"), ["a", "b"], 1) == ["b"]


def test_models_and_importance(spark):
    rows = [(i, float(i % 2), float(i % 5), "yes" if i % 2 else "no") for i in range(120)]
    df = table(spark, rows, "_rid long, signal double, noise double, target string")
    ready, features = quality.prepare(df, "target")
    assert sorted(features) == ["noise", "signal"]
    assert quality.cross_score(ready, features, "target", trees=5) > 0.95
    assert quality.ablation_importance(ready, features, "target")["signal"] > 0.9
    assert quality.cross_score(df.limit(10), features, "target") == 0.5
    moved = quality.permuted(df, "signal")
    assert moved.count() == 120 and moved.agg(F.sum("signal")).first()[0] == 60.0


def test_synthetic_rows(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("a"), ((F.col("id") % 97) * 2 + F.rand(1)).alias("b"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("c"))
    made = synth.generate(df, 2000, categorical=["c"])
    assert made.count() == 2000 and {r.c for r in made.select("c").distinct().collect()} == {"x", "y"}
    checks = synth.validate(df, made, ["a", "b"]).collect()
    assert all(r.similarity > 0.9 and r.correlation_error < 0.1 for r in checks)
    assert synth.balanced(df.select("a", "b", F.when(F.col("a") > 80, 1).otherwise(0).alias("c")), "c").groupBy("c").count().agg(F.count_distinct("count")).first()[0] == 1


def test_graphs(spark):
    df = table(spark, [(1, "Ann", "X"), (2, None, "X"), (3, "Bob", None), (4, "Ann", "Y")], "_rid long, name string, team string")
    nodes, edges = graph.star_graph("people", df, "name")
    assert nodes.count() == 4 and edges.count() == 3
    entities, links = graph.extract_entity(df, "team", "Team")
    assert graph.orphans(entities, links).count() == 0 and links.count() == 3
    n, e = graph.relationship_graph(df, [("name", "team", "IN", True)])
    assert {(r.src, r.dst) for r in e.collect()} == {("Ann", "X"), ("X", "Ann"), ("Ann", "Y"), ("Y", "Ann")} and n.count() == 3
    flat, typed = graph.to_records(nodes, edges, ["Entity"])
    assert {r.label for r in flat.collect()} == {"Entity"} and typed.first().start_type == "Entity"
    assert {(r.kind, r.n) for r in graph.batches((flat, typed)).collect()} == {("node", 4), ("edge", 3)}
    assert graph.categorisable(nodes).count() == 3 and graph.nodes_of_type(nodes, "Entity", ["team"]).count() == 3
    assert graph.model_graph({"p": df}, [graph.Entity("P", "p", "name", ("team",))], [])[0].collect()[0].props.get("team") in ("X", None)


def test_discovery(spark):
    a = table(spark, [(i, f"n{i % 3}") for i in range(30)], "school_id long, town string")
    b = table(spark, [(i, i * 2.5) for i in range(10, 40)], "id_school long, score double")
    found = discovery.relationships({"a": a, "b": b}).first()
    assert (found.column_a, found.column_b) == ("school_id", "id_school") and found.name_score == 0.85
    keys = {r.table_name: (r.column, r.confidence) for r in discovery.key_columns({"a": a, "b": b}).collect()}
    assert keys == {"a": ("school_id", 0.95), "b": ("id_school", 0.95)}
    assert discovery.best_join_columns({"a": a}, {"b": b}, 1).first().score == 0.85
    names = spark.createDataFrame([("ville", "city"), ("Nom_", "nom"), ("abc", "xyz")], "x string, y string")
    assert [r.s for r in names.select(discovery.name_score(F.col("x"), F.col("y")).alias("s")).collect()] == [0.75, 0.95, 0.0]


def test_categories_and_memory(spark):
    items = table(spark, [(1, "Chiffre d'affaires"), (2, "margin rate"), (3, "qqqq"), (4, "custommer list")], "i int, name string")
    got = {r.i: (r.domain, r.score) for r in categorize.domain_tables(items, "name", ["revenue", "margin", "customer"], 0.35).collect()}
    assert got[1] == ("revenue", 1.0) and got[2] == ("margin", 1.0) and got[4][0] == "customer" and 3 not in got
    aside = joins.anti(items, table(spark, [(k,) for k in got], "i int"), "i")
    assert [r.i for r in aside.collect()] == [3]
    assert categorize.distinct_as_categories(items, "name", 3) is None
    assert {r.dimension for r in categorize.suggest_dimensions(table(spark, [("total_rev",)], "value string")).collect()} == {"business_object", "pattern_type"}


def test_tidy_fills_down(spark):
    df = table(spark, [(1, "A", "1", None), (2, "", "2", ""), (3, "B", None, "x")], "_rid int, e string, p string, q string")
    assert {(r.entity, r.attribute, r.value) for r in extract.tidy(df, "e", ["p", "q"]).collect()} == {("A", "p", "1"), ("A", "p", "2"), ("B", "q", "x")}


def test_lineage(spark, tmp_path):
    df = table(spark, [(1, "a"), (2, "b")], "_rid long, value string")
    folder = str(tmp_path)
    lineage.save(df, folder, "root", None, 4, "load")
    lineage.save(df.limit(1), folder, "a", "root", 3, "link", options={"k": 1})
    lineage.save(df, folder, "b", "root", 3, "link")
    log = lineage.load_log(spark, folder)
    assert {r.path for r in lineage.branches(log).collect()} == {"root>a", "root>b"}
    assert [r.children for r in lineage.branch_points(log).collect()] == [2]
    assert [(r.step, r.level, r.decision) for r in lineage.decisions(log, "a").collect()] == [(0, 4, "{}"), (1, 3, '{"k": 1}')]
    assert lineage.restore(spark, folder, "b").count() == 2
    assert {r.id for r in lineage.latest_by_level(log, "a").collect()} == {"root", "a"}
    assert '"children":[{"id":"a"' in lineage.nested_json(log).first().tree
    assert {(r.id, r.row_change) for r in lineage.steps(log).collect()} == {("root", None), ("a", -1), ("b", 0)}


def test_catalog_and_sets(spark):
    c = table(spark, [(1, "A", "d", ["x"], 10, 90.0, None), (2, "B", None, ["y"], 20, None, None)], "id int, name string, description string, domain_tags array<string>, row_count int, usability_score double, created_at timestamp")
    assert [r.id for r in catalog.filter_datasets(c, sort_by="rows").collect()] == [2, 1]
    assert [r.id for r in catalog.search(c, "y a").collect()] == [1, 2]
    merged = sets.merge_results([table(spark, [(1, 0), (2, 1)], "k int, _place int"), table(spark, [(2, 0), (3, 1)], "k int, _place int")], "k", 2)
    assert [r.k for r in merged.collect()] == [1, 2]
    assert windows.latest_per_group(table(spark, [(1, None, 5), (1, 2, 6)], "g int, t int, v int"), "g", "t").first().v == 6


def test_guards(spark):
    with pytest.raises(ValueError):
        extract.check_shape(None)
    with pytest.raises(ValueError):
        extract.check_shape(spark.range(0))
    with pytest.raises(ValueError, match="no column"):
        extract.vector(spark.range(3).withColumn("x", F.lit(1)), "y")
    assert extract.vector(spark.range(3)).columns == ["value"]
    assert extract.name_column(table(spark, [(1, "x", "y")], "a int, other string, title string")) == "title"
    rows = extract.linkage_markers(table(spark, [(1,)], "uid int")).first()
    assert (rows._l3_linked, rows._linkage_column) == (True, "uid")


def test_global_orders_are_dealt_over_ranges(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("i"), ((F.col("id") * 7919) % 1009).cast("double").alias("v"), F.concat(F.lit("k"), F.col("id") % 37).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))

    def every():
        return [
            sorted(map(tuple, windows.percentile_of(df, "v").select("i", "percentile").collect())), sorted(map(tuple, windows.average_rank(df, "v").select("i", "rank").collect())),
            sorted(map(tuple, windows.label_codes(df, "s").collect())), sorted(map(tuple, windows.group_ids(df, ["s"], "i").select("i", "group_id").collect())),
            sorted(map(tuple, windows.find_duplicates(df, ["v", "s"]).select("i", "duplicate_group").collect())), sorted(map(tuple, windows.spaced_sample(df, "v", 50).collect())),
            sorted(map(tuple, metrics.roc(df, "y", "v").collect())), [round(metrics.auc(df, "y", "v").first().auc, 12)],
        ]

    plain = every()
    monkeypatch.setattr(windows, "PLAIN_ROWS", 10)
    assert every() == plain


def test_hot_keys_are_dealt(spark, monkeypatch):
    """A key of many pairs is dealt over parts; nothing is lost or doubled, null keys and unmatched rows included."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 50)
    left = spark.createDataFrame([(i, [None, 1, 1, 1, 2, 3][i % 6]) for i in range(120)], "a long, k int")
    right = spark.createDataFrame([(i, [None, 1, 2, 4][i % 4]) for i in range(80)], "b long, k int")
    x, y = left.collect(), right.collect()
    both = sorted((p.a, q.b) for p in x for q in y if p.k is not None and p.k == q.k)
    alone = [(p.a, None) for p in x if p.k in (None, 3)] + [(None, q.b) for q in y if q.k in (None, 4)]
    out = joins.key_join(left, right, "k", "k")
    assert out.columns == ["a", "k", "b", "k_right"]
    assert sorted(map(str, ((r.a, r.b) for r in out.collect()))) == sorted(map(str, both + alone))
    a, b, on = joins.dealt(left, right, "k")
    assert on == ["k", "_part"] and a.filter("k = 1").select("_part").distinct().count() > 3
    assert sorted((r.a, r.b) for r in joins.common_key_join(left, right).collect()) == both


def test_pairs_of_a_hot_key_are_a_grid(spark, monkeypatch):
    """Rows of both sides are copied to the cells of their slice and not to all parts; a cell's right rows are few."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 1000)
    left = spark.range(900).select(F.col("id").alias("a"), F.lit("x").alias("k"))
    right = spark.range(800).select(F.col("id").alias("b"), F.lit("x").alias("k"))
    a, b, on = joins.dealt(left, right, "k")
    assert a.count() + b.count() < 60_000  # 720 cells
    met = a.join(b, on)
    assert "merge" in met._jdf.queryExecution().optimizedPlan().toString()  # copies are never broadcast
    assert met.count() == met.select("a", "b").distinct().count() == 720_000
    monkeypatch.setattr(joins, "SLICE_ROWS", 10)
    a, b, on = joins.dealt(left, right, "k")
    assert b.groupBy("_part").count().agg(F.max("count")).first()[0] < 30 and a.join(b, on).count() == 720_000
    monkeypatch.setattr(joins, "MOST_TASKS", 20)
    a, b, on = joins.dealt(left, right, "k")
    assert a.select("_part").distinct().count() <= 40 and a.join(b, on).count() == 720_000


def test_full_outer_pairs_of_hot_keys_are_an_inner_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 50)
    left = spark.createDataFrame([(i, [None, 1, 1, 2, 3][i % 5]) for i in range(100)], "a long, k int")
    right = spark.createDataFrame([(i, [None, 1, 2, 4][i % 4]) for i in range(60)], "b long, k int").union(spark.createDataFrame([(60, 5)], "b long, k int"))
    out = joins.key_join(left, right.union(right), "k", "k")
    assert re.search(r"Join Inner, .*_part", out._jdf.queryExecution().optimizedPlan().toString())
    both, alone = out.filter("a IS NOT NULL AND b IS NOT NULL"), out.filter("a IS NULL OR b IS NULL")
    assert both.count() == 40 * 30 + 20 * 30 and both.filter("k <> k_right").count() == 0
    assert sorted(map(str, ((r.a, r.k, r.b, r.k_right) for r in alone.collect()))) == sorted(map(str, [(r.a, r.k, None, None) for r in left.collect() if r.k in (None, 3)] + [(None, None, r.b, r.k) for r in right.collect() * 2 if r.k in (None, 4, 5)]))


@pytest.mark.parametrize("name", ["key_edges", "row_links"])
def test_pairs_of_ids_with_one_key_are_not_grouped(spark, name):
    left = spark.createDataFrame([(i, str(i % 3)) for i in range(30)], "i long, v string")
    several = left.union(left).union(spark.createDataFrame([(0, "2"), (None, "1")], "i long, v string"))
    for df, grouped in ((left, False), (several, True)):
        other = left.withColumnsRenamed({"i": "j", "v": "w"})
        out = joins.key_edges(df, other, "i", "j", "v", "w") if name == "key_edges" else discovery.row_links(df, other, "i", "j", [("v", "w", 0.5)])
        assert bool(re.search(r"Aggregate \[src#\d+L?, dst#\d+", out._jdf.queryExecution().optimizedPlan().toString())) == grouped
        assert sorted(str((r.src, r.dst)) for r in out.collect()) == sorted(map(str, {(p.i, q.j) for p in df.collect() for q in other.collect() if p.v == q.w}))


def test_links_of_repeated_ids_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 5)
    left = spark.createDataFrame([(i // 2 if i < 8 else i, f"v{i % 3}", "w" if i % 4 else None) for i in range(30)], "i long, v string, w string")
    right = spark.createDataFrame([(i // 3 if i < 9 else i, f"V{i % 4} ", "w" if i % 5 else "u") for i in range(20)], "j long, v string, w string")
    best = {}
    for p in left.collect():
        for q in right.collect():
            for same, score in ((p.v == q.v.strip().lower(), 0.5), (p.w is not None and p.w == q.w, 0.9)):
                if same:
                    best[p.i, q.j] = max(best.get((p.i, q.j), 0), score)
    got = [(r.src, r.dst, r.score) for r in discovery.row_links(left, right, "i", "j", [("v", "v", 0.5), ("w", "w", 0.9)]).collect()]
    assert sorted(got) == sorted((i, j, s) for (i, j), s in best.items())
    edges = [(r.src, r.dst) for r in joins.key_edges(left, right.withColumn("v", F.lower("v")), "i", "j", "v", "v").collect()]
    assert sorted(edges) == sorted({(p.i, q.j) for p in left.collect() for q in right.collect() if p.v == q.v.strip().lower()})


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Texts of the same letters are one class; rows of a class get the least of the most similar right texts."""
    met = []
    real = joins.similar_pairs
    monkeypatch.setattr(joins, "similar_pairs", lambda a, b, *args, **kw: met.append((a.count(), b.count())) or real(a, b, *args, **kw))
    left = spark.createDataFrame([(i, ["abc", "bca", "cab", "xy", None][i % 5]) for i in range(50)], "i long, t string")
    right = spark.createDataFrame([(1, "cba"), (2, "acb"), (3, "yx"), (4, None)], "j long, u string")
    got = joins.semantic_join(left, right, "t", "u", 0.9, best_only=True, embed=queries._letters).collect()
    assert sorted((r.i, r.j) for r in got) == sorted((i, 2 if i % 5 < 3 else 3) for i in range(50) if i % 5 < 4)
    edges = joins.similarity_edges(left, right, "i", "j", "t", "u", 0.9, embed=queries._letters).collect()
    assert sorted((r.src, r.dst) for r in edges) == sorted((i, j) for i in range(50) for j in (1, 2, 3) if i % 5 < 4 and (i % 5 == 3) == (j == 3))
    rows = joins.row_similarity_join(left.na.drop(), right.na.drop(), ["t"], ["u"], "i", "j", 0.9, embed=queries._letters).collect()
    assert {(r.left_id, r.right_id) for r in rows} == {(i, 1 if i % 5 < 3 else 3) for i in range(50) if i % 5 < 4}
    assert met == [(2, 2)] * 3
