import pytest
from pyspark.sql import functions as F

from terrace.operators import enrich, quality


def test_names_levels_and_defaults(spark):
    add = lambda name: lambda t: t.withColumn(name, F.lit(1))
    known = enrich.Enrichments([enrich.Enrichment("a", (0, 1), add("a")), enrich.Enrichment("b", (0, 1), add("b"), default=True), enrich.Enrichment("c", (1, 2), add("c"))])
    with pytest.raises(ValueError, match="exists"):
        known.add(enrich.Enrichment("a", (2, 3), add("a")))
    with pytest.raises(ValueError, match="goes up"):
        known.add(enrich.Enrichment("d", (3, 2), add("d")))
    with pytest.raises(KeyError, match="there are a, b, c"):
        known.get("x")
    with pytest.raises(ValueError, match="from 1 to 2"):
        known.applied(spark.range(1), 0, 1, ["c"])
    assert [e.name for e in known.between(0, 1)] == ["a", "b"] and known.between(3, 4) == []
    assert known.applied(spark.range(1), 0, 1).columns == ["id", "b"]
    assert known.applied(spark.range(1), 0, 1, ["b", "a"]).columns == ["id", "b", "a"]


def test_model_sees_known_texts_in_small_parts(spark):
    def load():
        def model(texts):
            assert 0 < len(texts) <= 3 and None not in texts
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = [(i, None if i % 4 == 0 else "é" * i, "old") for i in range(20)] + [(20, "", "old")]
    out = enrich.embed_with(spark.createDataFrame(rows, "i int, t string, vector string").repartition(2), "t", load, size=3)
    assert {r.i: r.vector for r in out.collect()} == {i: None if t is None else [float(len(t)), 1.0] for i, t, _ in rows}
    assert enrich.embed_with(spark.createDataFrame([], "t string"), "t", load).count() == 0


def test_top_and_low_features(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.01), ("d", None)], "feature string, importance double")
    assert [r.feature for r in quality.top_features(rows, 3).collect()] == ["a", "b", "c"]
    assert [r.feature for r in quality.low_features(rows).collect()] == ["c"]
