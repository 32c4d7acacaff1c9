import os

from pyspark.sql import functions as F

from terrace.functions import categories as C
from terrace.operators import graph
from terrace.plans import workflow
from terrace.sources import readers, sinks
from terrace.streaming import sources


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_sniffing(spark, tmp_path):
    a = write(tmp_path / "a.csv", "nom;prix\nécole;1,5\nmusée;2,5\n", "cp1252")
    b = write(tmp_path / "b.csv", "x,y\n1,2\n3,4\n")
    assert readers.sniff(spark, a) == ("iso-8859-1", ";") and readers.sniff(spark, b) == ("utf-8", ",")
    assert [r.nom for r in readers.read_sniffed(spark, a).collect()] == ["école", "musée"]
    both = readers.read_folder(spark, {"a": a, "b": b})
    assert both["b"].agg(F.sum("y")).first()[0] == 6


def test_bad_lines_are_counted(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a,b\n1,2\n3,4,5\n6,7\n")
    assert readers.read_sniffed(spark, path).count() >= 2
    rows = readers.read_sniffed(spark, path, "count").cache()
    assert rows.filter("_bad IS NOT NULL").count() == 1


def test_payloads(spark, tmp_path):
    rows = [('[{"a": 1, "b": "x"}]',), ('{"data": [{"a": 2, "b": "y"}, {"a": 3, "b": null}]}',), ("a,b\n4,z\n",), ("",), (None,)]
    got = readers.parse_payload(spark.createDataFrame(rows, "p string"), "p", "a int, b string")
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x"), (2, "y"), (3, None), (4, "z")]
    write(tmp_path / "p.json", '{"data": [{"a": 1}, {"a": 2}, {"a": 3}]}')
    assert [r.a for r in readers.read_pages(spark, str(tmp_path / "p.json"), "a int", 1, 1, ["a"]).collect()] == [2]


def test_dates(spark):
    df = spark.createDataFrame([("31/12/2024", "n/a"), ("01/02/2023", "x"), (None, "y")], "d string, t string")
    got = readers.detect_dates(df)
    assert dict(got.dtypes) == {"d": "timestamp", "t": "string"} and str(got.first().d) == "2024-12-31 00:00:00"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "i int, xs array<string>")
    sinks.to_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    sinks.to_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    nodes, edges = graph.star_graph("s", spark.createDataFrame([(1, "x")], "_rid long, name string"), "name")
    sinks.graph(nodes, edges, f"{tmp_path}/graph")
    assert os.path.isdir(f"{tmp_path}/graph/nodes/type=Source") and spark.read.parquet(f"{tmp_path}/graph/edges").count() == 1


def test_demo_is_repeatable(spark):
    assert readers.demo(spark, 20).collect() == readers.demo(spark, 20).collect()


def test_operators_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"total_rev_{i}" if i % 2 else "x") for i in range(50)], "i int, name string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = sources.stream_parquet(spark, f"{tmp_path}/in", rows.schema)
    names = spark.createDataFrame([("revenue", 1)], "kind string, code int")
    steps = [lambda t: t.withColumn("kind", C.business_object(F.col("name"))), lambda t: t.filter("i >= 10"), lambda t: t.join(F.broadcast(names), "kind", "left")]
    sources.to_folder(stream, steps, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 40 and out.filter("code = 1").count() == 20


def test_assess_fix_export(spark, tmp_path):
    rows = [(i, float(i % 2), None if i % 3 == 0 else float(i % 7), 2.718 ** (i % 11), "yes" if i % 2 else "no") for i in range(80)]
    df = spark.createDataFrame(rows, "_rid long, signal double, gaps double, skewed double, target string")
    fixed, log, report = workflow.assess_fix_export(df, "target", str(tmp_path))
    assert fixed.count() == 80 and log.filter("status = 'applied'").count() >= 1
    assert 0 < report.first().usability <= 100
    assert spark.read.parquet(f"{tmp_path}/table").count() == 80
