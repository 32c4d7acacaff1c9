"""Queries of enrichments by name, of embeddings by a model, and of features by importance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrace.operators import enrich, quality, windows
from terrace.sources import sinks

from .registry import query, read


@query("SELECT doc_id, " + ", ".join(f"CAST(length(text) - length(replace(text, '{v}', '')) AS DOUBLE) AS {v}" for v in "aeiou") + ", CAST(length(text) AS DOUBLE) AS size FROM documents")
def model_embedding(spark, d):
    def vowels():  # a stand-in for a model: how often each vowel occurs, and the length
        return lambda texts: [[float(t.count(v)) for v in "aeiou"] + [float(len(t))] for t in texts]

    out = enrich.embed_with(read(spark, d, "documents").select("doc_id", "text"), "text", vowels)
    return out.select("doc_id", *[F.col("vector")[i].alias(n) for i, n in enumerate((*"aeiou", "size"))])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT median(o_totalprice) FROM orders) THEN 'high' ELSE 'low' END AS split, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'multiple' ELSE 'single' END AS frequency FROM orders")
def named_enrichments(spark, d):
    known = enrich.Enrichments([
        enrich.Enrichment("price", (1, 2), lambda t: windows.median_split(t, "o_totalprice"), default=True),
        enrich.Enrichment("customers", (1, 2), lambda t: windows.frequency_category(t, "o_custkey"), default=True),
        enrich.Enrichment("unused", (2, 3), lambda t: t.limit(0)),
    ])
    return known.applied(read(spark, d, "orders"), 1, 2).select("o_orderkey", "split", "frequency")


@query("""
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, abs(corr(l_tax, l_extendedprice)) AS c FROM lineitem),
l AS (SELECT unnest([{'feature': 'l_quantity', 'importance': a}, {'feature': 'l_discount', 'importance': b}, {'feature': 'l_tax', 'importance': c}], recursive := true) FROM c)
SELECT feature, round(importance, 9) AS importance, 'top' AS part FROM (SELECT * FROM l ORDER BY importance DESC, feature LIMIT 2) UNION ALL SELECT feature, round(importance, 9), 'low' FROM l WHERE importance < 0.05""")
def features_by_importance(spark, d):
    names = ("l_quantity", "l_discount", "l_tax")
    one = read(spark, d, "lineitem").agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in names])
    importance = one.unpivot([], list(names), "feature", "importance")
    top, low = quality.top_features(importance, 2), quality.low_features(importance)
    return top.withColumn("part", F.lit("top")).unionByName(low.withColumn("part", F.lit("low"))).withColumn("importance", F.round("importance", 9))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_round_trip(spark, d):
    context = spark.sparkContext
    if not context.getCheckpointDir():
        windows.kept(spark.range(1))  # sets a folder where none is set
    path = f"{context.getCheckpointDir().rstrip('/')}/sink-{uuid.uuid4().hex}"
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.to_json(orders, path)
    return spark.read.schema(orders.schema).json(path)
