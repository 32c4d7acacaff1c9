"""The library's registered queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import categories as C
from terrace.functions import numeric as N
from terrace.functions import text as T
from terrace.operators import catalog, categorize, discovery, extract, graph, joins, metrics, quality, sets, synth, windows
from terrace.plans import levels, lineage
from terrace.sources import readers, sinks

from . import enrichment_queries, linking_queries, model_queries, report_queries, statistics_queries  # noqa: F401  (registers its queries)
from .registry import QUERIES, SQL, query, read  # noqa: F401  (QUERIES and SQL are for the callers)

# Levels: down to one number and up again

PRIORITIES = ("URGENT", "HIGH", "MEDIUM", "LOW")


def _linked_orders(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: read(spark, d, t) for t in ("orders", "customer", "nation")}
    links = (joins.Link("orders", "customer", "o_custkey", "c_custkey", "inner"), joins.Link("orders", "nation", "c_nationkey", "n_nationkey", "inner"))
    return joins.chain_join(tables, links)


@query("""
SELECT CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'URGENT' WHEN o_orderpriority LIKE '%HIGH%' THEN 'HIGH' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'MEDIUM'
  WHEN o_orderpriority LIKE '%LOW%' THEN 'LOW' ELSE 'Unmatched' END AS domain, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS sum, count(o_totalprice) AS count
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def descend_mean_by_domain(spark, d):
    linked = _linked_orders(spark, d)
    out = levels.full_descent({}, lambda _: linked, lambda t: t.withColumn("domain", C.contains_any(F.col("o_orderpriority"), PRIORITIES)), "o_totalprice", ("mean", "sum", "count"))
    return out.select("domain", F.round("mean", 4).alias("mean"), F.round("sum", 2).alias("sum"), "count")


@query("SELECT round(avg(o_totalprice), 4) AS value, 'mean of value' AS description, 'mean' AS aggregation_method FROM orders WHERE o_orderstatus = 'F'")
def level_chain(spark, d):
    state = levels.State(4, {"orders": read(spark, d, "orders")})
    state = state.descend(lambda t: t["orders"]).descend(lambda t: t).descend(column="o_totalprice", query="o_orderstatus = 'F'").descend(method="mean")
    return state.data.withColumn("value", F.round("value", 4))


@query("SELECT CASE WHEN o_totalprice > m THEN 'high' ELSE 'low' END AS split, count(*) AS n FROM orders, (SELECT median(o_totalprice) AS m FROM orders) GROUP BY 1")
def ascend_median_split(spark, d):
    return windows.median_split(read(spark, d, "orders"), "o_totalprice").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, o_orderpriority AS value, 'other' AS business_object, 'raw' AS pattern_type, 'Unknown' AS client_segment, 'Unknown' AS financial_view, 'to' AS _rel_value_client FROM orders""")
def ascend_dimensions(spark, d):
    vector = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("value"))
    return levels.State(1, vector).ascend().ascend(relations=[("value", "client", "to"), ("absent", "x", "y")]).data


@query("""
SELECT file, CAST(n AS BIGINT) AS rows, CAST(k AS INTEGER) AS columns FROM (SELECT 'region' AS file, (SELECT count(*) FROM region) AS n, 2 AS k UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 5 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6)""")
def level4_manifest(spark, d):
    return levels.manifest({t: read(spark, d, t) for t in ("region", "customer", "orders")})


@query("SELECT CAST(sum(o_totalprice) AS BIGINT) // 1 AS value FROM (SELECT round(o_totalprice) AS o_totalprice FROM orders)")
def callable_aggregate(spark, d):
    vector = read(spark, d, "orders").select(F.round("o_totalprice").alias("value"))
    return metrics.datum(vector, lambda c: F.sum(c)).select(F.col("value").cast("long").alias("value"))


@query("SELECT o_orderstatus AS domain, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def datum_by_domain(spark, d):
    out = metrics.datum_by_domain(read(spark, d, "orders").select(F.col("o_orderstatus").alias("domain"), F.col("o_totalprice").alias("value")))
    return out.withColumn("value", F.round("value", 4))


@query("SELECT round(sum(value), 2) AS sum, round(avg(value), 2) AS mean, min(value) AS min, max(value) AS max, median(value) AS median, count(value) AS count FROM events")
def numeric_datum(spark, d):
    return metrics.numeric_datum(read(spark, d, "events")).withColumn("sum", F.round("sum", 2))


@query("""
SELECT (SELECT event_type FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1)) AS mode, count(*) AS count, count(DISTINCT event_type) AS nunique FROM events""")
def categorical_datum(spark, d):
    return metrics.categorical_datum(read(spark, d, "events"), "event_type")


@query("SELECT count(*) AS count, count(DISTINCT text) AS nunique, CAST(sum(length(text)) AS BIGINT) AS total_length, round(avg(length(text)), 1) AS average_length FROM documents")
def text_datum(spark, d):
    return metrics.text_datum(read(spark, d, "documents"), "text")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def grouped_vector(spark, d):
    return metrics.grouped_vector(read(spark, d, "orders"), "o_custkey", "o_totalprice").withColumn("value", F.round("value", 2))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(avg(l_discount), 6) AS l_discount, count(*) AS group_size FROM lineitem GROUP BY 1, 2")
def dimension_groups(spark, d):
    out = metrics.dimension_groups(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": "sum", "l_discount": "mean"})
    return out.withColumns({"l_quantity": F.round("l_quantity", 2), "l_discount": F.round("l_discount", 6)})


@query("""
SELECT l_returnflag, l_linestatus, CASE WHEN grouping(l_linestatus) = 1 THEN 1 ELSE 2 END AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING grouping(l_returnflag) = 0""")
def dimension_hierarchy(spark, d):
    return metrics.dimension_hierarchy(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
SELECT l_returnflag, '{' || string_agg('"' || l_linestatus || '":' || n, ',' ORDER BY l_linestatus) || '}' AS tree FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def hierarchy_tree(spark, d):
    return metrics.hierarchy_json(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
SELECT value, n, round(share, 6) AS share, CASE WHEN share < 5 OR share > 95 THEN 'severe' WHEN share < 20 OR share > 80 THEN 'moderate' ELSE 'none' END AS imbalance
FROM (SELECT event_type AS value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1)""")
def value_distribution(spark, d):
    return metrics.distribution(read(spark, d, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 3 AS warning FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY toxic)")
def imbalance_ratio(spark, d):
    return metrics.imbalance_ratio(read(spark, d, "labels"), "toxic").withColumn("ratio", F.round("ratio", 6))


@query("""
SELECT min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max,
 round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem""")
def five_numbers(spark, d):
    out = metrics.five_numbers(read(spark, d, "lineitem"), "l_extendedprice")
    return out.select("min", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def histogram(spark, d):
    return metrics.histogram(read(spark, d, "lineitem"), "l_extendedprice").select("bin", "n")


@query("""
SELECT a, b, round(c, 6) AS correlation FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)""")
def correlation_pairs(spark, d):
    return metrics.correlations(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("correlation", F.round("correlation", 6))


@query("""
WITH v AS (SELECT o_totalprice AS v, 1 AS a, 0 AS b FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_totalprice, 0, 1 FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v),
r AS (SELECT abs(sum(a) OVER w / (SELECT CAST(sum(a) AS DOUBLE) FROM c) - sum(b) OVER w / (SELECT CAST(sum(b) AS DOUBLE) FROM c)) AS d FROM c WINDOW w AS (ORDER BY v))
SELECT 'o_totalprice' AS "column", round(1 - max(d), 8) AS similarity FROM r""")
def ks_similarity(spark, d):
    o = read(spark, d, "orders")
    return metrics.ks_similarity(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_totalprice"]).withColumn("similarity", F.round("similarity", 8))


def _judged(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("said"), (F.length("text") % 97).alias("score"))
    return read(spark, d, "labels").join(docs, "doc_id")


_JUDGED = "(SELECT quality, toxic, CAST(n_chars >= 1000 AS INTEGER) AS said, length(text) % 97 AS score FROM labels JOIN documents USING (doc_id))"


@query(f"SELECT quality AS truth, said AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 8) AS share FROM {_JUDGED} GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_judged(spark, d), "quality", "said").withColumn("share", F.round("share", 8))


@query(f"""
WITH j AS (SELECT * FROM {_JUDGED}), l AS (SELECT unnest([0, 1]) AS label),
n AS (SELECT label, sum(CASE WHEN quality = label THEN 1 ELSE 0 END) AS support, sum(CASE WHEN said = label THEN 1 ELSE 0 END) AS s, CAST(sum(CASE WHEN quality = label AND said = label THEN 1 ELSE 0 END) AS DOUBLE) AS h FROM j, l GROUP BY 1)
SELECT label, CAST(support AS BIGINT) AS support, round(h / s, 8) AS precision, round(h / support, 8) AS recall, round(2 * (h / s) * (h / support) / (h / s + h / support), 8) AS f1 FROM n""")
def class_scores(spark, d):
    out = metrics.class_scores(_judged(spark, d), "quality", "said")
    return out.select("label", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH j AS (SELECT * FROM {_JUDGED}), c AS (SELECT score, sum(toxic) AS p, sum(1 - toxic) AS n FROM j GROUP BY 1)
SELECT CAST(score AS INTEGER) AS score, round(sum(p) OVER w / CAST((SELECT sum(p) FROM c) AS DOUBLE), 8) AS tpr, round(sum(n) OVER w / CAST((SELECT sum(n) FROM c) AS DOUBLE), 8) AS fpr FROM c WINDOW w AS (ORDER BY score DESC)""")
def roc_curve(spark, d):
    return metrics.roc(_judged(spark, d), "toxic", "score").withColumns({"tpr": F.round("tpr", 8), "fpr": F.round("fpr", 8)})


@query(f"""
WITH j AS (SELECT * FROM {_JUDGED}), p AS (SELECT score, count(*) AS c FROM j WHERE toxic = 1 GROUP BY 1), n AS (SELECT score, count(*) AS c FROM j WHERE toxic = 0 GROUP BY 1)
SELECT round(sum(p.c * n.c * CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) / ((SELECT sum(c) FROM p) * (SELECT sum(c) FROM n)), 6) AS auc FROM p, n""")
def roc_auc(spark, d):
    return metrics.auc(_judged(spark, d), "toxic", "score").withColumn("auc", F.round("auc", 6))


@query("SELECT 3 AS level, CAST(count(*) * count(DISTINCT l_returnflag) + count(*) AS DOUBLE) AS log2_order FROM lineitem")
def complexity_order(spark, d):
    return metrics.complexity_order(read(spark, d, "lineitem"), "l_returnflag")


@query("""
SELECT event_type AS model, round(avg(value), 6) AS accuracy, round(avg(value / 2), 6) AS f1, round(avg(value / 1000), 8) AS mean_gap, round(min(value / 1000), 8) AS min_gap, round(max(value / 1000), 8) AS max_gap, round(1.96 * stddev_pop(value / 1000) / sqrt(count(*)), 8) AS half_width,
 CASE WHEN avg(value / 1000) < 0.10 THEN 'good' WHEN avg(value / 1000) < 0.15 THEN 'fair' ELSE 'poor' END AS verdict FROM events GROUP BY 1""")
def benchmark_rollup(spark, d):
    runs = read(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("accuracy"), (F.col("value") / 2).alias("f1"), (F.col("value") / 1000).alias("gap"))
    out = metrics.rollup_runs(runs)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1")} | {c: F.round(c, 8) for c in ("mean_gap", "min_gap", "max_gap", "half_width")})


@query("""
SELECT count(*) FILTER (event_type = 'click') AS applied, count(*) FILTER (event_type = 'error') AS failed, first(value ORDER BY event_id) AS initial, last(value ORDER BY event_id) AS final, round(last(value ORDER BY event_id) - first(value ORDER BY event_id), 6) AS improvement FROM events""")
def transformation_log(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "applied").when(F.col("event_type") == "error", "failed")
    return metrics.log_totals(e.select(F.col("event_id").alias("step"), status.alias("status"), F.col("value").alias("before"), F.col("value").alias("after"))).withColumn("improvement", F.round("improvement", 6))


# Windows


@query("""
WITH g AS (SELECT p_brand, p_type, p_size, row_number() OVER (ORDER BY count(*) DESC, p_brand, p_type, p_size) AS k FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT p_partkey, g.k IS NOT NULL AS is_potential_duplicate, CAST(coalesce(k, 0) AS INTEGER) AS duplicate_group FROM part LEFT JOIN g USING (p_brand, p_type, p_size)""")
def find_duplicates(spark, d):
    return windows.find_duplicates(read(spark, d, "part"), ["p_brand", "p_type", "p_size"]).select("p_partkey", "is_potential_duplicate", "duplicate_group")


@query("""
WITH g AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS group_id FROM orders GROUP BY 1, 2) SELECT o_orderkey, CAST(group_id AS INTEGER) AS group_id FROM orders JOIN g USING (o_orderstatus, o_orderpriority)""")
def group_ids(spark, d):
    return windows.group_ids(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey").select("o_orderkey", "group_id")


@query("SELECT o_orderkey, round(100 * cume_dist() OVER (ORDER BY o_totalprice), 6) AS percentile FROM orders")
def score_percentile(spark, d):
    return windows.percentile_of(read(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("percentile", 6).alias("percentile"))


@query("SELECT l_quantity, round(avg(r) / (n + 1), 8) AS rank FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r, count(*) OVER () AS n FROM lineitem) GROUP BY l_quantity, n")
def average_rank(spark, d):
    return windows.average_rank(read(spark, d, "lineitem").select("l_quantity"), "l_quantity").groupBy("l_quantity").agg(F.round(F.max("rank"), 8).alias("rank"))


@query("SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'multiple' ELSE 'single' END AS frequency FROM orders")
def frequency_category(spark, d):
    return windows.frequency_category(read(spark, d, "orders"), "o_custkey").select("o_orderkey", "frequency")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'Q1' WHEN o_totalprice <= b THEN 'Q2' WHEN o_totalprice <= c THEN 'Q3' ELSE 'Q4' END AS quantile
FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)""")
def quantile_category(spark, d):
    return windows.quantile_category(read(spark, d, "orders"), "o_totalprice", ["Q1", "Q2", "Q3", "Q4"]).select("o_orderkey", "quantile")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_group(spark, d):
    return windows.latest_per_group(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_key_wins(spark, d):
    return windows.first_key_wins(read(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey AS key, score FROM (SELECT l_orderkey, max(l_extendedprice) AS score FROM lineitem GROUP BY 1)")
def best_duplicate(spark, d):
    links = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit(0).alias("dst"), F.col("l_extendedprice").alias("score"))
    return joins.row_pair_best(links).select(F.col("src").alias("key"), "score")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type_code FROM events")
def label_encode(spark, d):
    return windows.label_encode(read(spark, d, "events"), "event_type").select("event_id", "event_type_code")


@query("""
WITH k AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 9), n AS (SELECT count(DISTINCT p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN n <= 10 OR p_name IN (SELECT p_name FROM k) THEN p_name ELSE '_other_' END AS p_name FROM part, n""")
def rare_to_other(spark, d):
    return windows.rare_to_other(read(spark, d, "part"), "p_name", 10).select("p_partkey", "p_name")


@query("""
SELECT event_id, round(value - lag(value) OVER w, 6) AS change, round(value - first(value) OVER w, 6) AS since_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def score_changes(spark, d):
    out = windows.score_changes(read(spark, d, "events"), "user_id", "event_id", "value")
    return out.select("event_id", F.round("change", 6).alias("change"), F.round("since_first", 6).alias("since_first"))


@query("""
WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT l_extendedprice FROM lineitem))
SELECT min(x) AS l_extendedprice FROM v GROUP BY floor(i / greatest((t - 1) / 99.0, 1.0) + 1e-9)""")
def spaced_sample(spark, d):
    return windows.spaced_sample(read(spark, d, "lineitem"), "l_extendedprice", 100)


@query("SELECT quality, CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS n FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1), (SELECT unnest(range(5)) AS f) WHERE n > f")
def stratified_folds(spark, d):
    return windows.folds(read(spark, d, "labels"), 5, "doc_id", "quality").groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


# Functions and filters


@query("""
SELECT p_partkey, CASE WHEN contains(t, 'revenue') OR contains(t, 'rev') OR contains(t, 'income') OR contains(t, 'sales') THEN 'revenue' WHEN contains(t, 'volume') OR contains(t, 'vol') OR contains(t, 'quantity') OR contains(t, 'qty') OR contains(t, 'count') THEN 'volume'
  WHEN contains(t, 'etp') OR contains(t, 'fte') OR contains(t, 'employee') OR contains(t, 'staff') OR contains(t, 'headcount') THEN 'ETP' ELSE 'other' END AS business_object,
 CASE WHEN regexp_matches(p_name, '^(total_|sum_|agg_)') THEN 'aggregated' WHEN regexp_matches(p_name, '^(avg_|mean_|median_)') THEN 'averaged' WHEN regexp_matches(p_name, '^(pct_|percent_|ratio_)') THEN 'ratio' WHEN regexp_matches(p_name, '_[0-9]{4}$') THEN 'temporal' ELSE 'raw' END AS pattern_type
FROM (SELECT p_partkey, p_name, lower(p_name) AS t FROM part)""")
def part_dimensions(spark, d):
    return read(spark, d, "part").select("p_partkey", C.business_object(F.col("p_name")).alias("business_object"), C.pattern_type(F.col("p_name")).alias("pattern_type"))


@query("""
SELECT event_id, CASE WHEN contains(event_type, 'click') OR contains(event_type, 'view') THEN 'attention' WHEN contains(event_type, 'purchase') THEN 'money' END AS domain,
 CASE WHEN value < 50 THEN 'small' WHEN value >= 50 THEN 'large' END AS size, CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'Unmatched' END AS exact, CASE WHEN contains(event_type, 'sign') THEN 'sign' WHEN contains('purchases', event_type) THEN 'purchases' ELSE 'Unmatched' END AS either FROM events""")
def event_categories(spark, d):
    kind = F.col("event_type")
    return read(spark, d, "events").select(
        "event_id", C.first_keyword(kind, (("attention", ("click", "view")), ("money", ("purchase",))), None).alias("domain"), C.threshold(F.col("value"), 50, "small", "large").alias("size"),
        C.exact(kind, ["click", "error"]).alias("exact"), C.contains_either(kind, ["sign", "purchases"]).alias("either"),
    )


@query("""
SELECT c_custkey, 'c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment AS row_text, regexp_replace(regexp_replace(regexp_replace(c_name, '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS property,
 CASE WHEN length(c_name) <= 12 THEN c_name ELSE substring(c_name, 1, 9) || '...' END AS short, substring(md5(c_name), 1, 16) AS hash FROM customer""")
def text_functions(spark, d):
    c = F.col("c_name")
    return read(spark, d, "customer").select("c_custkey", T.row_text(["c_name", "c_mktsegment"]).alias("row_text"), T.property_name(c).alias("property"), T.truncated(c, 12).alias("short"), T.short_hash(c).alias("hash"))


@query("""
SELECT p_partkey, p_name AS original, string_split(p_name, ' ')[1] AS first_word, len(string_split(p_name, ' ')) AS word_count, contains(p_name, '_') AS has_underscore, CAST(length(p_name) AS INTEGER) AS char_count FROM part""")
def naming_signatures(spark, d):
    out = read(spark, d, "part").select("p_partkey", T.naming_signature(F.col("p_name")).alias("s")).select("p_partkey", "s.*")
    return out.withColumn("word_count", F.col("word_count").cast("long"))


@query("SELECT p_partkey, p_retailprice AS value FROM part")
def french_numbers(spark, d):
    text = F.concat(F.lit(" "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
    return read(spark, d, "part").select("p_partkey", T.french_number(text).alias("value"))


_SPACE = r"[ \t\n\x0B\f\r]+"


def _quoted(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


@query(f"""
WITH t AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(replace(lower(trim(text)), '?', ''), '{_SPACE}'), lambda w: w <> '') AS w,
  list_filter(regexp_split_to_array(replace(replace(lower(text), '?', ''), ',', ' '), '{_SPACE}'), lambda w: length(w) > 2 AND NOT list_contains({_quoted(T.STOP_WORDS)}, w)) AS k FROM conversations)
SELECT conv_id, turn, coalesce(ends_with(rtrim(text), '?') OR list_has_any(w, {_quoted(T.QUESTION_WORDS)}) OR (list_has_any(w, {_quoted(T.QUESTION_VERBS)}) AND len(w) >= 4) OR len(w) >= 6, false) AS question,
 array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:5], ' ') AS keywords FROM t""")
def questions_and_keywords(spark, d):
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", T.is_question(t).alias("question"), F.array_join(T.keywords(t), " ").alias("keywords"))


@query("""
SELECT doc_id, CASE WHEN n_chars >= 5000 THEN 'green' WHEN n_chars >= 1000 THEN 'yellow' ELSE 'red' END AS light,
 CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' ELSE format('{:.1f}', round(n_chars / 1024.0, 1)) || ' KB' END AS size FROM documents""")
def scores_and_sizes(spark, d):
    n = F.col("n_chars")
    return read(spark, d, "documents").select("doc_id", C.score_bucket(n, ((5000, "green"), (1000, "yellow")), "red").alias("light"), T.file_size(n).alias("size"))


@query("SELECT c_custkey AS id, attribute, value FROM (SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer) UNPIVOT (value FOR attribute IN (c_name, c_nationkey, c_mktsegment))")
def tidy_unpivot(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("_rid"), F.col("c_custkey").cast("string").alias("e"), "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")
    return extract.tidy(c, "e", ["c_name", "c_nationkey", "c_mktsegment"], "_rid", F.col("_rid")).select(F.col("entity").cast("long").alias("id"), "attribute", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_orders(spark, d):
    return extract.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 3, 50, [F.desc("o_totalprice"), "o_orderkey"])[0]


@query("SELECT p_partkey AS _rid, p_retailprice AS value FROM part WHERE p_size > 10")
def extracted_vector(spark, d):
    return extract.vector(extract.with_row_id(read(spark, d, "part"), "p_partkey"), "p_retailprice", "p_size > 10", drop_null=True)


@query("SELECT attribute, value FROM (SELECT c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_mktsegment AS VARCHAR) AS c_mktsegment FROM customer WHERE c_custkey = 5) UNPIVOT (value FOR attribute IN (c_name, c_nationkey, c_mktsegment))")
def row_vector(spark, d):
    return extract.row_vector(read(spark, d, "customer").drop("c_acctbal"), "c_custkey", 5)


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3")
def sample_values(spark, d):
    return extract.sample_values(read(spark, d, "part"), "p_type", 3)


@query("SELECT o_orderkey, o_orderdate AS day FROM orders")
def iso_timestamps(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, d, "orders").select("o_orderkey", T.iso_timestamp(text).cast("timestamp_ntz").alias("day"))


@query("SELECT o_orderkey, 'x' AS _rel_o_custkey_customer, TRUE AS _l3_linked, 'o_custkey' AS _linkage_column FROM orders")
def marked_links(spark, d):
    o = extract.relation_markers(read(spark, d, "orders"), [("o_custkey", "customer", "x"), ("absent", "y", "z")])
    return extract.linkage_markers(o, "o_custkey").select("o_orderkey", "_rel_o_custkey_customer", "_l3_linked", "_linkage_column")


# Joins


@query("""
SELECT c_custkey, c_nationkey, s_suppkey, s_nationkey FROM customer FULL OUTER JOIN supplier ON CAST(c_nationkey AS VARCHAR) = CAST(s_nationkey AS VARCHAR)""")
def full_outer_key_join(spark, d):
    left, right = read(spark, d, "customer"), read(spark, d, "supplier")
    return joins.key_join(left, right, "c_nationkey", "s_nationkey").select("c_custkey", "c_nationkey", "s_suppkey", "s_nationkey")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON CAST(n_regionkey AS DOUBLE) = CAST(r_regionkey AS DOUBLE)")
def numeric_key_join(spark, d):
    return joins.key_join(read(spark, d, "nation"), read(spark, d, "region"), "n_regionkey", "r_regionkey", "inner", numeric_keys=True).select("n_nationkey", "r_name")


@query("SELECT n_nationkey, s_suppkey, score FROM nation JOIN (SELECT s_suppkey, s_nationkey, CAST(0.9 AS DOUBLE) AS score FROM supplier) ON n_nationkey = s_nationkey")
def match_table_join(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    table = n.select(F.col("n_nationkey").cast("string").alias("value1"), F.col("n_nationkey").cast("string").alias("value2"), F.lit(0.9).alias("score"))
    return joins.match_join(n, s, table, "n_nationkey", "s_nationkey").select("n_nationkey", "s_suppkey", "score")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, d):
    return joins.semi(read(spark, d, "customer"), read(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    return joins.anti(read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT 'c' || c_custkey AS src, 's' || s_suppkey AS dst, CAST(c_nationkey AS VARCHAR) AS matched_value FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def key_edges(spark, d):
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_nationkey")
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), "s_nationkey")
    return joins.key_edges(c, s, "id", "id", "c_nationkey", "s_nationkey", max_rows=None)


@query("SELECT l_orderkey AS src, o_custkey AS dst, 'SHARES_number' AS relationship, CAST(l_orderkey AS VARCHAR) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def shared_value_edges(spark, d):
    line = read(spark, d, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("number"))
    return joins.shared_value_edges(line, read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("number")), "l_orderkey", "o_custkey", ["number"], max_rows=None)


@query("""
SELECT m AS matches, a AS n_left, b AS n_right, round(m / (a + b - m), 8) AS jaccard FROM (SELECT (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)) AS m,
 (SELECT count(DISTINCT c_nationkey) FROM customer) AS a, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS b)""")
def column_overlap(spark, d):
    return joins.jaccard(read(spark, d, "customer"), read(spark, d, "supplier"), "c_nationkey", "s_nationkey").withColumn("jaccard", F.round("jaccard", 8))


@query("""
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity FROM embeddings a, embeddings b
WHERE a.vec_id % 50 = 0 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.5""")
def similarity_join(spark, d):
    e = read(spark, d, "embeddings")
    queries_ = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("vector"))
    out = joins.similar_pairs(queries_, e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("vector")), 0.5, "left_id", "right_id")
    return out.withColumn("similarity", F.round("similarity", 5))


@query("""
WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT left_id, right_id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS n FROM p) WHERE n = 1""")
def similarity_best_match(spark, d):
    e = read(spark, d, "embeddings")
    queries_ = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("vector"))
    pairs = joins.similar_pairs(queries_, e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("vector")), -1.0, "left_id", "right_id", best=True, others=True)
    return joins.best_match(pairs, "left_id", "right_id", "similarity").withColumn("similarity", F.round("similarity", 5))


@query("""
WITH c AS (SELECT label, [""" + ", ".join(f"avg(embedding[{i}])" for i in range(1, 65)) + """] AS v FROM embeddings GROUP BY 1),
s AS (SELECT vec_id, CAST(c.label AS VARCHAR) AS category, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, c)
SELECT vec_id, category, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, category) AS n FROM s) WHERE n = 1""")
def semantic_category(spark, d):
    e = read(spark, d, "embeddings")
    out = categorize.nearest_category(e, categorize.centroids(e, "label", "embedding", 64), "embedding", -1.0)
    return out.select("vec_id", "category", F.round("similarity", 5).alias("similarity"))


_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letters(text):
    """An embedding that SQL can say too: how often each letter and digit occurs, counted in one pass over the text's bytes."""

    @F.pandas_udf("array<double>")
    def counts(texts: pd.Series) -> pd.Series:
        at = [ord(c) for c in _SIGNS]
        return texts.map(lambda t: np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[at].astype(float))

    return counts(F.lower(F.coalesce(text, F.lit(""))))


def _sql_letters(text: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({text})) - length(replace(lower({text}), '{c}', '')) AS DOUBLE)" for c in _SIGNS) + "]"


_ITEMS = f"(SELECT DISTINCT text AS y, {_sql_letters('text')} AS w FROM benchmark WHERE regexp_matches(lower(text), '[a-z0-9]'))"
_TEXTS = f"(SELECT DISTINCT text AS x, {_sql_letters('text')} AS v FROM documents WHERE regexp_matches(lower(text), '[a-z0-9]'))"


@query(f"""
WITH p AS (SELECT x, y, round(list_cosine_similarity(v, w), 12) AS s FROM {_TEXTS}, {_ITEMS}), b AS (SELECT x, y, s FROM p WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) = 1)
SELECT doc_id, item_id, round(s, 6) AS similarity FROM documents JOIN b ON text = x JOIN benchmark ON benchmark.text = y""")
def semantic_text_join(spark, d):
    docs, items = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    out = joins.semantic_join(docs, items, "text", "item", 0.9, best_only=True, embed=_letters)
    return out.select("doc_id", "item_id", F.round("_semantic_similarity", 6).alias("similarity"))


@query(f"""
SELECT count(*) AS matches, round(avg(s), 6) AS mean_similarity FROM (SELECT x, max(s) AS s FROM (SELECT x, list_cosine_similarity(v, w) AS s FROM {_TEXTS}, {_ITEMS}) WHERE s >= 0.95 GROUP BY x)""")
def semantic_match_summary(spark, d):
    out = joins.semantic_match_summary(read(spark, d, "documents"), read(spark, d, "benchmark").select(F.col("text").alias("item")), "text", "item", 0.95, embed=_letters)
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def guarded_cross_join(spark, d):
    return joins.cross_join(read(spark, d, "region").select("r_regionkey"), read(spark, d, "nation").select("n_nationkey"), 1000)


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def common_key_join(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return joins.common_key_join(c, read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), max_rows=None).select("c_custkey", "s_suppkey")


@query("SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def positional_enrichment(spark, d):
    docs = read(spark, d, "documents").withColumn("_rid", F.col("doc_id"))
    return joins.by_row_id(docs, read(spark, d, "labels").withColumn("_rid", F.col("doc_id")), ["quality"]).select("doc_id", "source", "quality")


@query("SELECT o_orderkey, o_totalprice, 'large' AS flag FROM orders WHERE o_totalprice > 490000")
def flagged_rows(spark, d):
    o = read(spark, d, "orders").withColumn("_rid", F.col("o_orderkey"))
    flags = o.filter("o_totalprice > 490000").select("_rid", F.lit("large").alias("flag"))
    return joins.flagged_rows(o, flags).select("o_orderkey", "o_totalprice", "flag")


@query("SELECT src, dst, max(score) AS score FROM (SELECT c_custkey AS src, s_suppkey AS dst, 0.9 :: DOUBLE AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey UNION ALL SELECT c_custkey, s_suppkey, 0.5 :: DOUBLE FROM customer JOIN supplier ON c_custkey = s_suppkey) GROUP BY 1, 2")
def row_links(spark, d):
    return discovery.row_links(read(spark, d, "customer"), read(spark, d, "supplier"), "c_custkey", "s_suppkey", [("c_nationkey", "s_nationkey", 0.9), ("c_custkey", "s_suppkey", 0.5)], max_rows=None)


@query(f"""
WITH c AS (SELECT c_custkey, {_sql_letters("(c_name || ' ' || c_nationkey)")} AS v FROM customer), s AS (SELECT s_suppkey, {_sql_letters("(s_name || ' ' || s_nationkey)")} AS w FROM supplier),
p AS (SELECT c_custkey, s_suppkey, round(list_cosine_similarity(v, w), 12) AS x FROM c, s)
SELECT c_custkey AS left_id, s_suppkey AS right_id, round(x, 6) AS similarity FROM p WHERE x >= 0.5 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY x DESC, s_suppkey) = 1""")
def row_similarity_join(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    out = joins.row_similarity_join(c, s, ["c_name", "c_nationkey"], ["s_name", "s_nationkey"], "c_custkey", "s_suppkey", 0.5, embed=_letters)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""
SELECT doc_id AS src, item_id AS dst, round(s, 6) AS similarity FROM (SELECT x, y, list_cosine_similarity(v, w) AS s FROM {_TEXTS}, {_ITEMS}) JOIN documents ON text = x JOIN benchmark ON benchmark.text = y WHERE s >= 0.97""")
def similarity_edges(spark, d):
    out = joins.similarity_edges(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "item_id", "text", "text", 0.97, embed=_letters)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON CAST(o_custkey AS DOUBLE) = CAST(c_custkey AS DOUBLE)")
def numeric_full_outer_join(spark, d):
    out = joins.key_join(read(spark, d, "orders"), read(spark, d, "customer").withColumn("c_custkey", F.format_string("%d.0", "c_custkey")), "o_custkey", "c_custkey", numeric_keys=True)
    return out.select("o_orderkey", F.col("c_custkey").cast("double").cast("long").alias("c_custkey"))


# Sets


@query("SELECT 'customer' AS category, c_nationkey AS nation, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_of_domains(spark, d):
    of = lambda t, p: read(spark, d, t).select(F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("acctbal"))
    return sets.union_of_domains({"customer": of("customer", "c"), "supplier": of("supplier", "s")}).select("category", "nation", "acctbal")


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def shared_values(spark, d):
    return sets.shared_values(read(spark, d, "customer"), read(spark, d, "supplier"), "c_nationkey", "s_nationkey")


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, min(k) AS k FROM (SELECT o_orderkey, 0 * 1e9 + o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 1e9 + o_orderkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1) ORDER BY k LIMIT 1000""")
def merged_results(spark, d):
    o = read(spark, d, "orders").withColumn("_place", F.col("o_orderkey"))
    return sets.merge_results([o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 300000")], "o_orderkey", 1000).select("o_orderkey")


# Discovery


def _small_tables(spark, d):
    return {t: read(spark, d, t) for t in ("region", "nation", "customer", "supplier")}


_SMALL = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}


def _each_column(select):
    return " UNION ALL ".join(select.format(t=t, c=c, i=i) for t, columns in _SMALL.items() for i, c in enumerate(columns))


def _sql_name_score():
    """The score of two column names as SQL over x and y (lower case, without separators)."""
    either = lambda rows: "(" + " OR ".join(rows) + ")"
    shared = either(f"(contains(x, '{p}') AND contains(y, '{p}') AND (replace(x, '{p}', '') = replace(y, '{p}', '') OR '' IN (replace(x, '{p}', ''), replace(y, '{p}', ''))))" for p in discovery.ID_PATTERNS)
    ending = either(f"(suffix(x, '{e}') AND suffix(y, '{e}') AND x[:-{len(e) + 1}] = y[:-{len(e) + 1}])" for e in discovery.ID_SUFFIXES)
    said = {}
    for v in "xy":
        said[v] = v
        for word, english in discovery.TRANSLATIONS:
            said[v] = f"replace({said[v]}, '{word}', '{english}')"
    cases = ("x = y", 0.95), ("length(x) > 3 AND length(y) > 3 AND (contains(x, y) OR contains(y, x))", 0.8), (shared, 0.85), (ending, 0.8), (f"{said['x']} = {said['y']} AND {said['x']} <> x", 0.75)
    return "CAST(CASE " + " ".join(f"WHEN {test} THEN {score}" for test, score in cases) + " ELSE 0 END AS DOUBLE)"


_PAIRS = f"""
v AS (SELECT DISTINCT * FROM ({_each_column("SELECT '{t}' AS t, '{c}' AS c, lower(trim(CAST({c} AS VARCHAR))) AS v FROM {t} WHERE {c} IS NOT NULL")})),
z AS (SELECT t, c, count(*) AS n FROM v GROUP BY t, c),
j AS (SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, count(*) AS matches FROM v a JOIN v b ON a.v = b.v AND a.t < b.t GROUP BY ALL),
o AS (SELECT j.*, matches / (za.n + zb.n - matches) AS jaccard, regexp_replace(lower(column_a), '[_ -]', '', 'g') AS x, regexp_replace(lower(column_b), '[_ -]', '', 'g') AS y
  FROM j JOIN z za ON za.t = table_a AND za.c = column_a JOIN z zb ON zb.t = table_b AND zb.c = column_b),
named AS (SELECT * EXCLUDE (x, y), {_sql_name_score()} AS name_score FROM o)"""
_LINKED = f"""
WITH {_PAIRS},
k AS (SELECT *, CASE WHEN name_score > 0 THEN CAST(0.4 AS DOUBLE) * name_score + least(2 * jaccard, CAST(0.6 AS DOUBLE)) WHEN jaccard >= 0.05 THEN least(CAST(0.85 AS DOUBLE), CAST(0.3 AS DOUBLE) + jaccard) ELSE 0 END AS confidence FROM named)
SELECT * FROM k WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY table_a, table_b ORDER BY confidence DESC, column_a, column_b) = 1"""


@query(f"""
WITH u AS ({_each_column("SELECT '{t}' AS table_name, '{c}' AS c, {i} AS place, count(DISTINCT {c}) / count(*) AS uniqueness FROM {t}")}),
k AS (SELECT *, regexp_matches(lower(c), '{"|".join(discovery.ID_PATTERNS)}') AS named FROM u),
r AS (SELECT *, CAST(CASE WHEN named AND uniqueness > 0.5 THEN 0.95 WHEN uniqueness > 0.9 THEN 0.8 WHEN named AND uniqueness > 0.1 THEN 0.7 WHEN place = 0 THEN 0.5 END AS DOUBLE) AS confidence FROM k)
SELECT table_name, c AS "column", confidence, round(uniqueness, 8) AS uniqueness FROM r WHERE confidence IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY confidence DESC, CASE WHEN confidence > 0.5 THEN -uniqueness ELSE 0 END, place) = 1""")
def key_columns(spark, d):
    return discovery.key_columns(_small_tables(spark, d)).withColumn("uniqueness", F.round("uniqueness", 8))


@query("""
WITH v AS (SELECT DISTINCT 'c' AS t, CAST(c_nationkey AS VARCHAR) AS x, 'c_nationkey' AS c FROM customer UNION SELECT DISTINCT 'c', CAST(c_custkey AS VARCHAR), 'c_custkey' FROM customer UNION SELECT DISTINCT 'n', CAST(n_nationkey AS VARCHAR), 'n_nationkey' FROM nation UNION SELECT DISTINCT 'n', CAST(n_regionkey AS VARCHAR), 'n_regionkey' FROM nation),
s AS (SELECT t, c, count(*) AS n FROM v GROUP BY 1, 2)
SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, count(*) AS matches, round(count(*) / (any_value(sa.n) + any_value(sb.n) - count(*)), 8) AS jaccard
FROM v a JOIN v b ON a.x = b.x AND a.t < b.t JOIN s sa ON sa.c = a.c JOIN s sb ON sb.c = b.c GROUP BY 1, 2, 3, 4""")
def column_pair_overlaps(spark, d):
    tables = {"c": read(spark, d, "customer").select("c_nationkey", "c_custkey"), "n": read(spark, d, "nation").select("n_nationkey", "n_regionkey")}
    return discovery.overlaps(tables).select("table_a", "column_a", "table_b", "column_b", "matches", F.round("jaccard", 8).alias("jaccard"))


@query(f"SELECT table_a, column_a, table_b, column_b, matches, round(jaccard, 8) AS jaccard, name_score, round(confidence, 8) AS confidence FROM ({_LINKED})")
def discovered_relationships(spark, d):
    found = discovery.relationships(_small_tables(spark, d))
    return found.withColumns({c: F.round(c, 8) for c in ("jaccard", "confidence")})


@query(f"SELECT table_a AS src, table_b AS dst, column_a || '=' || column_b AS type, round(confidence, 8) AS confidence, CASE WHEN name_score > 0 THEN 'name' ELSE 'values' END AS method FROM ({_LINKED})")
def discovery_edges(spark, d):
    tables = _small_tables(spark, d)
    return discovery.discovery_graph(tables, discovery.relationships(tables))[1].withColumn("confidence", F.round("confidence", 8))


_KINDS = f"""
p AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN declared NOT LIKE 'VARCHAR%' THEN 'numeric' WHEN looks > 0.8 THEN 'numeric_string' ELSE 'string' END AS kind, CASE WHEN n > 0 THEN u / n ELSE 0 END AS ratio FROM (
 {_each_column("SELECT '{t}' AS t, '{c}' AS c, count({c}) AS n, count(DISTINCT lower(trim(CAST({c} AS VARCHAR)))) AS u, avg(CAST(regexp_matches(CAST({c} AS VARCHAR), '^-?[0-9]+[.]?[0-9]*$') AS INTEGER)) AS looks, any_value(typeof({c})) AS declared FROM {t}")}))"""


@query(f"WITH {_KINDS} SELECT t AS table_name, c AS \"column\", kind, round(ratio, 8) AS unique_ratio FROM p")
def column_kinds(spark, d):
    parts = [discovery.column_profile(df).withColumn("table_name", F.lit(t)) for t, df in _small_tables(spark, d).items()]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("table_name", "column", "kind", F.round("unique_ratio", 8).alias("unique_ratio"))


@query(f"""
WITH {_PAIRS}, {_KINDS},
k AS (SELECT named.*, CASE WHEN a.kind = b.kind AND a.kind <> 'empty' THEN 1.0 WHEN contains(a.kind, 'numeric') AND contains(b.kind, 'numeric') THEN 0.9 ELSE 0.3 END AS kind, CASE WHEN least(a.ratio, b.ratio) > 0 THEN least(a.ratio, b.ratio) / greatest(a.ratio, b.ratio) ELSE 0 END AS ratio
  FROM named JOIN p a ON a.t = table_a AND a.c = column_a JOIN p b ON b.t = table_b AND b.c = column_b)
SELECT table_a, column_a, table_b, column_b, round(CASE WHEN jaccard > 0.1 THEN 0.5 * jaccard + 0.2 * kind + 0.2 * name_score + 0.1 * ratio ELSE 0.4 * kind + 0.4 * name_score + 0.2 * ratio END, 6) AS score FROM k""")
def scored_column_pairs(spark, d):
    return discovery.column_pairs(_small_tables(spark, d)).select("table_a", "column_a", "table_b", "column_b", F.round("score", 6).alias("score"))


# Graphs


def _nation_graph(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sources = {"nation": n.withColumn("_rid", F.col("n_nationkey")), "supplier": read(spark, d, "supplier").withColumn("_rid", F.col("s_suppkey"))}
    entities = [graph.Entity("Nation", "nation", "n_nationkey", ("n_name", "r_name")), graph.Entity("Supplier", "supplier", "s_suppkey", ("s_name",))]
    return graph.model_graph(sources, entities, [graph.Relation("IN", "Supplier", "Nation", "s_nationkey", "n_nationkey")])


@query("""
SELECT 'Nation_' || n_nationkey AS id, 'Nation' AS type, CAST(n_nationkey AS VARCHAR) AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'Supplier_' || s_suppkey, 'Supplier', CAST(s_suppkey AS VARCHAR) FROM supplier""")
def graph_nodes(spark, d):
    return _nation_graph(spark, d)[0].select("id", "type", "name")


@query("SELECT 'Supplier_' || s_suppkey AS src, 'Nation_' || n_nationkey AS dst, 'IN' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def graph_edges(spark, d):
    return _nation_graph(spark, d)[1].select("src", "dst", "type")


@query("""
SELECT 'node' AS kind, 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'node', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'edge', 'Supplier IN Nation', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def graph_summary(spark, d):
    return graph.summary(*_nation_graph(spark, d))


@query("SELECT 'Nation_' || s_nationkey AS id, count(*) AS degree FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'Supplier_' || s_suppkey, 1 FROM supplier")
def graph_degree(spark, d):
    return graph.degree(_nation_graph(spark, d)[1])


@query("""
SELECT 'Supplier_' || s_suppkey AS from_id, 'Supplier' AS from_type, CAST(s_suppkey AS VARCHAR) AS from_name, 'IN' AS relationship, 'Nation_' || s_nationkey AS to_id, 'Nation' AS to_type, CAST(s_nationkey AS VARCHAR) AS to_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def linked_table(spark, d):
    return graph.linked_table(*_nation_graph(spark, d))


@query("""
WITH e AS (SELECT 'Supplier_' || s_suppkey AS s, CAST(s_suppkey AS VARCHAR) AS sn, 'Nation_' || s_nationkey AS t, CAST(s_nationkey AS VARCHAR) AS tn FROM supplier)
SELECT s AS id, sn AS name, 'IN' AS relationship, 'to' AS direction, count(*) AS n, array_to_string(list_sort(list(tn))[1:3], ', ') AS sample FROM e GROUP BY 1, 2
UNION ALL SELECT t, tn, 'IN', 'from', count(*), array_to_string(list_sort(list(sn))[1:3], ', ') FROM e GROUP BY 1, 2""")
def relationship_summary(spark, d):
    return graph.relationship_summary(*_nation_graph(spark, d))


@query("SELECT 'Segment_' || c_mktsegment AS id, count(*) AS n FROM customer GROUP BY c_mktsegment")
def entity_without_orphans(spark, d):
    nodes, edges = graph.extract_entity(read(spark, d, "customer").withColumn("_rid", F.col("c_custkey")), "c_mktsegment", "Segment")
    kept = nodes.join(graph.orphans(nodes, edges), "id", "left_anti")
    return kept.join(edges, kept["id"] == edges["dst"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT b || '|' || t) AS edges, (SELECT count(DISTINCT p_brand) + count(DISTINCT p_type) FROM part) AS nodes FROM (SELECT p_brand AS b, p_type AS t FROM part)")
def mapped_graph(spark, d):
    nodes, edges = graph.mapped_graph(read(spark, d, "part").withColumn("_rid", F.col("p_partkey")), "part", {"p_brand": "Brand", "p_type": "Type"})
    return edges.agg(F.count(F.lit(1)).alias("edges")).join(nodes.agg(F.count(F.lit(1)).alias("nodes")))


@query("""
WITH g AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT 'Supplier_' || s_suppkey AS src, 'Nation_' || s_nationkey AS dst FROM supplier WHERE s_nationkey IN (SELECT k FROM g ORDER BY n DESC, 'Nation_' || k LIMIT 10)""")
def seed_subgraph(spark, d):
    return graph.seed_subgraph(_nation_graph(spark, d)[1], 30).select("src", "dst")


@query("SELECT count(*) + 1 AS nodes, count(*) AS edges FROM customer")
def star_graph(spark, d):
    nodes, edges = graph.star_graph("customer", read(spark, d, "customer").withColumn("_rid", F.col("c_custkey")), "c_name")
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


@query("SELECT 'Nation_' || n_nationkey AS id, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def categorisable_nodes(spark, d):
    return graph.categorisable(_nation_graph(spark, d)[0], "Nation", "n_name")


@query("SELECT 'Nation_' || n_nationkey AS id, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def nodes_as_table(spark, d):
    return graph.nodes_of_type(_nation_graph(spark, d)[0], "Nation", ["n_name", "r_name"])


@query("SELECT 'node' AS kind, 'Nation' AS label, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'edge', 'IN', count(*) FROM supplier")
def ingest_batches(spark, d):
    return graph.batches(graph.to_records(*_nation_graph(spark, d), ["Nation"]))


# Quality


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS \"unique\", {s} AS skew FROM lineitem"
        for c, k, s in (
            *((c, "numeric", f"round((avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / pow(var_pop({c}), 1.5), 4)") for c in _PROFILED[:3]),
            ("l_returnflag", "categorical", "CAST(0 AS DOUBLE)"), ("l_shipdate", "datetime", "CAST(0 AS DOUBLE)"),
        )
    )
)
def column_profiles(spark, d):
    return quality.profile(read(spark, d, "lineitem").select(*_PROFILED)).select("column", "type", "n", "missing", "unique", F.round("skew", 4).alias("skew"))


@query("SELECT 100.0 * (1 - (count(*) FILTER (text IS NULL) + count(*) FILTER (lang IS NULL)) / (2.0 * count(*))) AS completeness FROM documents")
def completeness(spark, d):
    return quality.completeness(read(spark, d, "documents").select("text", "lang"))


@query("""
WITH p AS (SELECT unnest([3.0 / 5, 1.0 / 5, 1.0 / 5]) AS p), s AS (SELECT count(*) AS n FROM lineitem)
SELECT CAST(100.0 AS DOUBLE) AS completeness, round(100 * sum(-p * log2(p)) / log2(3), 6) AS diversity, round((SELECT CASE WHEN n < 50 THEN n / 50 * 50 WHEN n <= 10000 THEN 100 ELSE 100 - least(50, (n - 10000) / 2000) END FROM s), 6) AS size_score,
 round(0.3 * 100 + 0.2 * 100 * sum(-p * log2(p)) / log2(3) + 0.1 * (SELECT CASE WHEN n < 50 THEN n / 50 * 50 WHEN n <= 10000 THEN 100 ELSE 100 - least(50, (n - 10000) / 2000) END FROM s), 6) AS usability FROM p""")
def usability_scores(spark, d):
    out = quality.scores(read(spark, d, "lineitem").select(*_PROFILED))
    return out.select(*[F.round(c, 6).alias(c) if c != "completeness" else F.col(c) for c in ("completeness", "diversity", "size_score", "usability")])


@query("SELECT 50.0 + 0.3 * (CASE WHEN count(*) < 50 THEN 30 WHEN count(*) <= 10000 THEN 100 ELSE greatest(50, 100 - (count(*) - 10000) / 1000) END) + 15.0 AS score FROM part")
def quick_score(spark, d):
    return quality.quick_score(read(spark, d, "part"))


@query("SELECT event_id, coalesce(v, (SELECT median(v) FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events))) AS value, CAST(v IS NULL AS INTEGER) AS value_missing FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)")
def impute_median(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return quality.impute(e, "value")


@query("SELECT o_orderkey, round(CASE WHEN m > 0 THEN ln(o_totalprice) ELSE ln(1 + o_totalprice - m) END, 8) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS m FROM orders)")
def log_transform(spark, d):
    return quality.transform_feature(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "log").withColumn("o_totalprice", F.round("o_totalprice", 8))


@query("SELECT c_custkey, round(CASE WHEN m < 0 THEN sqrt(c_acctbal - m) ELSE sqrt(c_acctbal) END, 8) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS m FROM customer)")
def sqrt_transform(spark, d):
    return quality.transform_feature(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "sqrt").withColumn("c_acctbal", F.round("c_acctbal", 8))


@query("SELECT p_partkey, round(((p_size - a) / (s + 1e-8) + (p_retailprice - b) / (t + 1e-8)) / 2, 6) AS combined FROM part, (SELECT avg(p_size) AS a, stddev_samp(p_size) AS s, avg(p_retailprice) AS b, stddev_samp(p_retailprice) AS t FROM part)")
def combined_feature(spark, d):
    return quality.combine(read(spark, d, "part"), "p_size", "p_retailprice", "combined").select("p_partkey", F.round("combined", 6).alias("combined"))


@query("SELECT event_id, 'value' AS feature, round(abs(value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def z_reasons(spark, d):
    out = quality.z_reasons(read(spark, d, "events"), ["value"], "event_id").select("event_id", F.explode("contributors").alias("c"))
    return out.select("event_id", F.col("c.feature").alias("feature"), F.round("c.contribution", 6).alias("z"))


_OUTLIERS = """
WITH m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS s, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS t FROM part),
z AS (SELECT p_partkey AS i, (p_size - a) / s AS x, (p_retailprice - b) / t AS y FROM part, m),
n AS (SELECT p.i AS i, q.i AS j, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS far FROM z p JOIN z q ON p.i <> q.i QUALIFY row_number() OVER (PARTITION BY p.i ORDER BY far, q.i) <= 20),
k AS (SELECT i, max(far) AS kd FROM n GROUP BY i),
r AS (SELECT n.i AS i, 1 / (avg(greatest(far, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.i = n.j GROUP BY n.i),
f AS (SELECT n.i AS i, avg(b.lrd) / any_value(a.lrd) AS score FROM n JOIN r a ON a.i = n.i JOIN r b ON b.i = n.j GROUP BY n.i),
p AS (SELECT *, 100 * cume_dist() OVER (ORDER BY score) AS percentile FROM f)
SELECT i AS _rid, round(score, 6) AS score, round(percentile, 6) AS percentile FROM p WHERE percentile >= 95 ORDER BY p.score DESC, i LIMIT 100"""


@query(_OUTLIERS)
def local_outliers(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("_rid"), "p_size", "p_retailprice")
    return quality.anomalies(p, ["p_size", "p_retailprice"]).select("_rid", F.round("score", 6).alias("score"), F.round("percentile", 6).alias("percentile"))


_IMPORTANCE = (("p_size", 0.5), ("p_retailprice", 0.3), ("twice", 0.28), ("skewed", 0.2))
_SUGGESTED = f"""
v AS (SELECT p_size AS a, p_retailprice AS b, p_retailprice * 2 AS c, exp(p_size / 5) AS d FROM part),
l AS (SELECT unnest([{", ".join(f"{{'f': '{c}', 'i': {i}, 'v': CAST({x} AS DOUBLE)}}" for (c, i), x in zip(_IMPORTANCE, "abcd"))}], recursive := true) FROM v),
m AS (SELECT f, any_value(i) AS i, count(DISTINCT v) AS u, avg(v) AS m, var_pop(v) AS s2 FROM l GROUP BY f),
k AS (SELECT l.f, any_value(m.i) AS i, any_value(u) AS u, CASE WHEN any_value(s2) > 0 THEN avg(pow(v - m, 3)) / pow(any_value(s2), 1.5) ELSE 0 END AS skew FROM l JOIN m ON l.f = m.f GROUP BY l.f),
r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM v),
pairs AS (SELECT unnest([{{'x': 'p_size', 'y': 'p_retailprice', 'ix': 0.5, 'iy': 0.3, 'r': ab}}, {{'x': 'p_size', 'y': 'twice', 'ix': 0.5, 'iy': 0.28, 'r': ac}}, {{'x': 'p_retailprice', 'y': 'twice', 'ix': 0.3, 'iy': 0.28, 'r': bc}}], recursive := true) FROM r),
found AS (
 SELECT 'transform' AS kind, f AS features, CASE WHEN skew < 0 THEN 'square' WHEN abs(skew) > 2 THEN 'log' ELSE 'sqrt' END AS transform,
  CASE WHEN abs(skew) > 2 THEN least(5, abs(skew) * 0.5) ELSE least(3, abs(skew) * 0.3) END * i * 10 AS impact, CASE WHEN abs(skew) > 2 THEN 0.75 ELSE 0.6 END AS confidence FROM k WHERE u > 10 AND abs(skew) > 1
 UNION ALL SELECT CASE WHEN ix - iy > 0.1 THEN 'remove' ELSE 'combine' END, CASE WHEN ix - iy > 0.1 THEN y ELSE x || ',' || y END, NULL, CASE WHEN ix - iy > 0.1 THEN 2 ELSE 3 END, CASE WHEN ix - iy > 0.1 THEN 0.7 ELSE 0.65 END FROM pairs WHERE abs(r) > 0.8)"""


def _suggested(spark, d):
    part = read(spark, d, "part").select("p_size", "p_retailprice", (F.col("p_retailprice") * 2).alias("twice"), F.exp(F.col("p_size") / 5).alias("skewed"))
    importance = spark.createDataFrame(list(_IMPORTANCE), "column string, importance double")
    return quality.suggest(quality.profile(part), metrics.correlations(part, ["p_size", "p_retailprice", "twice"]), importance)


@query(f"WITH {_SUGGESTED} SELECT kind, features, transform, round(impact, 6) AS impact, CAST(confidence AS DOUBLE) AS confidence FROM found ORDER BY impact DESC, kind, features LIMIT 10")
def suggestions(spark, d):
    return _suggested(spark, d).select("kind", F.array_join("features", ",").alias("features"), "transform", F.round("impact", 6).alias("impact"), "confidence")


@query(f"WITH {_SUGGESTED} SELECT least(20, CAST(sum(CASE kind WHEN 'transform' THEN 5 WHEN 'combine' THEN 8 ELSE 3 END * 0.6) AS DOUBLE)) AS gain FROM (SELECT * FROM found ORDER BY impact DESC, kind, features LIMIT 10)")
def improvement_estimate(spark, d):
    return quality.improvement(_suggested(spark, d), 40.0).select(F.round("gain", 8).alias("gain"))


_GAPS = "(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size, p_retailprice FROM part)"


@query(f"""
WITH g AS {_GAPS}, f AS (SELECT p_partkey, coalesce(CAST(p_size AS DOUBLE), (SELECT median(p_size) FROM g)) AS p_size, CAST(p_size IS NULL AS INTEGER) AS p_size_missing,
  sqrt(CASE WHEN (SELECT min(p_retailprice) FROM g) < 0 THEN p_retailprice - (SELECT min(p_retailprice) FROM g) ELSE p_retailprice END) AS p_retailprice FROM g)
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, p_size_missing,
 round(((p_size - avg(p_size) OVER ()) / (stddev_samp(p_size) OVER () + 1e-8) + (p_retailprice - avg(p_retailprice) OVER ()) / (stddev_samp(p_retailprice) OVER () + 1e-8)) / 2, 6) AS combined FROM f""")
def applied_suggestions(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    for kind, features, transform in (("transform", ["p_size"], "impute"), ("transform", ["p_retailprice"], "sqrt"), ("combine", ["p_size", "p_retailprice"], None), ("remove", ["p_size"], None)):
        t = quality.apply_suggestion(t, kind, features, transform)
    return t.select("p_partkey", "p_size_missing", *[F.round(c, 6).alias(n) for c, n in (("p_retailprice", "p_retailprice"), ("p_size_p_retailprice_combined", "combined"))])


@query("""
WITH o AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0)
SELECT _rid, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM o)) AS o_totalprice, CASE WHEN o_orderstatus IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY o_orderstatus NULLS LAST) - 1 AS INTEGER) END AS code FROM o""")
def prepared_features(spark, d):
    o = read(spark, d, "orders")
    target = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))  # a row without a target goes
    t = o.select(F.col("o_orderkey").alias("_rid"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), target.alias("t"))
    return quality.prepare(t, "t")[0].select("_rid", "o_totalprice", F.col("o_orderstatus").alias("code"))


@query("SELECT o_orderstatus, o_totalprice, count(*) AS n FROM (SELECT 'all' AS o_orderstatus, o_totalprice FROM orders) GROUP BY 1, 2")
def permuted_values(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("_rid"), F.lit("all").alias("o_orderstatus"), "o_totalprice")
    return quality.permuted(o, "o_totalprice").groupBy("o_orderstatus", "o_totalprice").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT unnest(list_filter([CASE WHEN n < 50 THEN 'few rows: ' || n END, 'only categorical features', CASE WHEN u > 100 THEN 'many categories in c_name: ' || u END, CASE WHEN s > 100 THEN 'many categories in c_mktsegment: ' || s END], lambda x: x IS NOT NULL)) AS warning
FROM (SELECT count(*) AS n, count(DISTINCT c_name) AS u, count(DISTINCT c_mktsegment) AS s FROM customer)""")
def quality_warnings(spark, d):
    return quality.warnings(read(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal"), "c_acctbal")


@query("""
WITH p AS (SELECT 100 - 100 * cume_dist() OVER (ORDER BY o_totalprice) AS top, count(*) OVER () AS n FROM orders)
SELECT count(*) AS total, round(100.0 * count(*) / any_value(n), 6) AS percent, count(*) FILTER (top < 0.5) AS severe, count(*) FILTER (top >= 0.5 AND top < 1) AS moderate, count(*) FILTER (top >= 1) AS mild FROM p WHERE top <= 5""")
def anomaly_totals(spark, d):
    o = read(spark, d, "orders")
    found = windows.percentile_of(o, "o_totalprice").filter("percentile >= 95")
    return quality.anomaly_summary(found, o.count()).withColumn("percent", F.round("percent", 6))


@query("""
WITH m AS (SELECT avg(l_quantity) AS qa, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS ea, stddev_pop(l_extendedprice) AS es, avg(l_discount) AS da, stddev_pop(l_discount) AS ds FROM lineitem),
z AS (SELECT abs((l_quantity - qa) / qs) AS q, abs((l_extendedprice - ea) / es) AS e, abs((l_discount - da) / ds) AS d FROM lineitem, m)
SELECT CASE WHEN q > e AND q > d THEN 'l_quantity' WHEN e > d THEN 'l_extendedprice' ELSE 'l_discount' END AS feature, count(*) AS n FROM z GROUP BY 1""")
def anomaly_contributors(spark, d):
    lines = read(spark, d, "lineitem").withColumn("_rid", F.struct("l_orderkey", "l_linenumber"))
    return quality.top_contributors(quality.z_reasons(lines, ["l_quantity", "l_extendedprice", "l_discount"], top=1))


@query()
def dataset_assessment(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("_rid"), "p_size", "p_retailprice", "p_type")
    return quality.assess(p, "p_type").select("completeness", "diversity", "size_score", "usability", "prediction", "light.light")


@query()
def synthetic_copula(spark, d):
    made = synth.generate(read(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderstatus"), 2000, categorical=["o_orderstatus"])
    return synth.validate(read(spark, d, "orders"), made, ["o_totalprice", "o_custkey"])


@query("SELECT i, round(p, 6) AS p FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS i, (l_quantity / 51.0) AS p FROM lineitem)")
def normal_round_trip(spark, d):
    p = F.col("l_quantity") / 51.0
    clipped = F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001))
    out = read(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("i"), N.normal_cdf(N.normal_quantile(clipped)).alias("p")).distinct()
    return out.select("i", F.round("p", 6).alias("p"))


# Catalog


def _catalog(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("Set "), "source").alias("name"), F.col("lang").alias("description"), F.array("lang", "source").alias("domain_tags"), F.col("n_chars").alias("row_count"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 101).cast("double").alias("usability_score"), F.lit(None).cast("timestamp").alias("created_at"))


_CATALOG = "(SELECT doc_id AS id, 'Set ' || source AS name, lang AS description, [lang, source] AS domain_tags, n_chars AS row_count, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 101 AS DOUBLE) END AS usability_score FROM documents)"


@query(f"SELECT id, name, usability_score FROM {_CATALOG} WHERE usability_score >= 40 AND list_has_any(domain_tags, ['de', 'fr']) AND row_count >= 500 AND contains(lower(name), 'src1') ORDER BY usability_score DESC, id LIMIT 50")
def catalog_filter(spark, d):
    return catalog.filter_datasets(_catalog(spark, d), 40, ["de", "fr"], 500, query="SRC1").select("id", "name", "usability_score")


@query(f"""
SELECT id, CAST(3 * CAST(contains(lower(name), 'src1') AS INTEGER) + 2 * CAST(len(list_filter(domain_tags, lambda t: contains(t, 'src1'))) > 0 AS INTEGER) + CAST(contains(description, 'src1') AS INTEGER)
 + 3 * CAST(contains(lower(name), 'fr') AS INTEGER) + 2 * CAST(len(list_filter(domain_tags, lambda t: contains(t, 'fr'))) > 0 AS INTEGER) + CAST(contains(description, 'fr') AS INTEGER) AS INTEGER) AS relevance FROM {_CATALOG} QUALIFY relevance > 0 ORDER BY relevance DESC, id LIMIT 20""".replace("QUALIFY relevance > 0", "WHERE contains(lower(name), 'src1') OR description = 'fr'"))
def catalog_search(spark, d):
    return catalog.search(_catalog(spark, d), "src1 fr").select("id", "relevance")


@query(f"SELECT b AS bucket, count(c.id) AS n FROM (SELECT unnest(['excellent', 'good', 'fair', 'poor', 'unassessed']) AS b) LEFT JOIN (SELECT id, CASE WHEN usability_score IS NULL THEN 'unassessed' WHEN usability_score >= 80 THEN 'excellent' WHEN usability_score >= 60 THEN 'good' WHEN usability_score >= 40 THEN 'fair' ELSE 'poor' END AS k FROM {_CATALOG}) c ON b = k GROUP BY 1")
def catalog_distribution(spark, d):
    return catalog.score_distribution(_catalog(spark, d))


@query(f"SELECT DISTINCT unnest(domain_tags) AS domain FROM {_CATALOG}")
def catalog_domains(spark, d):
    return catalog.domain_list(_catalog(spark, d))


@query(f"SELECT id, CASE WHEN id % 10 = 3 THEN 99.0 ELSE usability_score END AS usability_score FROM {_CATALOG} WHERE id % 4 <> 0")
def catalog_upsert(spark, d):
    c = _catalog(spark, d)
    new = c.filter("id % 10 = 3").withColumn("usability_score", F.lit(99.0))
    return catalog.delete(catalog.upsert(c, new), c.filter("id % 4 = 0")).select("id", "usability_score")


@query("SELECT doc_id AS id, CASE WHEN q IS NOT NULL THEN q ELSE CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 101 AS DOUBLE) END END AS usability_score FROM documents LEFT JOIN (SELECT doc_id, CAST(10 * quality AS DOUBLE) AS q FROM labels) USING (doc_id)")
def catalog_latest_score(spark, d):
    reports = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("created_at"), "quality")
    reports = reports.select("id", "created_at", (F.col("quality") * 10 * (F.col("created_at") == 2).cast("int")).cast("double").alias("score"))
    return catalog.with_latest_score(_catalog(spark, d), reports).select("id", "usability_score")


# Sources and sinks: written to the shared folder and read back


def _folder(spark):
    context = spark.sparkContext
    if not context.getCheckpointDir():
        windows.kept(spark.range(1))  # sets a folder where none is set
    return f"{context.getCheckpointDir().rstrip('/')}/sink-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = _folder(spark)
    sinks.to_csv(read(spark, d, "customer"), path)
    return readers.read_sniffed(spark, path, schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_round_trip(spark, d):
    path = _folder(spark)
    sinks.to_parquet(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def json_pages(spark, d):
    path = _folder(spark)
    rows = read(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).alias("page")).agg(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("data"))
    rows.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    pages = spark.read.text(path)
    return readers.parse_payload(pages, "value", "s_suppkey long, s_name string, s_nationkey int")


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ordered FROM orders")
def detected_dates(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("ordered"))
    return readers.detect_dates(o).select("o_orderkey", F.col("ordered").cast("timestamp_ntz").alias("ordered"))


@query("SELECT 'Nation_' || s_nationkey AS dst, count(*) AS n FROM supplier GROUP BY 1")
def graph_sink(spark, d):
    path = _folder(spark)
    sinks.graph(*_nation_graph(spark, d), path)
    return spark.read.parquet(f"{path}/edges").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey, r_name FROM region")
def lineage_restore(spark, d):
    path = _folder(spark)
    lineage.save(read(spark, d, "nation"), path, "n1", None, 4, "load")
    lineage.save(read(spark, d, "region").select("r_regionkey", "r_name"), path, "n2", "n1", 3, "link")
    last = lineage.load_log(spark, path).filter("level = 3").first()["id"]
    return lineage.restore(spark, path, last)


# Lineage


def _log(spark, d):
    e = read(spark, d, "orders")
    parent = F.when(F.col("o_orderkey") > 0, F.floor((F.col("o_orderkey") - 1) / 3).cast("string"))
    return e.select(F.col("o_orderkey").cast("string").alias("id"), parent.alias("parent_id"), (F.col("o_orderkey") % 5).cast("int").alias("level"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("decision"), F.col("o_orderdate").alias("created_at"))


_PARENTS = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey > 0 THEN CAST((o_orderkey - 1) // 3 AS VARCHAR) END AS parent_id FROM orders)"


@query(f"""
WITH RECURSIVE n AS (SELECT * FROM {_PARENTS}), w AS (SELECT id, 0 AS depth, id AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.depth + 1, w.path || '>' || n.id FROM w JOIN n ON n.parent_id = w.id) SELECT id, depth, path FROM w""")
def lineage_paths(spark, d):
    return lineage.paths(_log(spark, d)).drop("way")


@query(f"SELECT parent_id AS id, count(*) AS children FROM {_PARENTS} WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def lineage_branch_points(spark, d):
    return lineage.branch_points(_log(spark, d))


@query(f"""
WITH RECURSIVE n AS (SELECT * FROM {_PARENTS}), up AS (SELECT id, parent_id FROM n WHERE id = '1234' UNION ALL SELECT n.id, n.parent_id FROM up JOIN n ON n.id = up.parent_id)
SELECT CAST(o_orderkey % 5 AS INTEGER) AS level, last(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS id FROM orders JOIN up ON CAST(o_orderkey AS VARCHAR) = up.id GROUP BY 1""")
def lineage_latest_by_level(spark, d):
    return lineage.latest_by_level(_log(spark, d), "1234").select("level", "id")


@query(f"""
WITH RECURSIVE n AS (SELECT * FROM {_PARENTS}), up AS (SELECT id, parent_id, 0 AS h FROM n WHERE id = '1234' UNION ALL SELECT n.id, n.parent_id, h + 1 FROM up JOIN n ON n.id = up.parent_id)
SELECT CAST(max(h) OVER () - h AS INTEGER) AS step, CAST(o_orderkey % 5 AS INTEGER) AS level, o_orderstatus AS action, o_orderpriority AS decision FROM up JOIN orders ON CAST(o_orderkey AS VARCHAR) = up.id""")
def lineage_decisions(spark, d):
    return lineage.decisions(_log(spark, d), "1234")


@query(f"""
WITH RECURSIVE n AS (SELECT * FROM {_PARENTS}), w AS (SELECT id, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.depth + 1 FROM w JOIN n ON n.parent_id = w.id)
SELECT depth, count(*) AS leaves FROM w WHERE id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL) GROUP BY 1""")
def lineage_leaves(spark, d):
    return lineage.branches(_log(spark, d)).groupBy("depth").agg(F.count(F.lit(1)).alias("leaves"))


# Guards, names and rows


@query("SELECT c_name AS name FROM customer")
def named_rows(spark, d):
    c = read(spark, d, "customer")
    return c.select(F.col(extract.name_column(c)).alias("name"))


@query("SELECT trim(CASE doc_id % 4 WHEN 0 THEN ' nan ' WHEN 1 THEN '  ' ELSE ' ' || source || ' ' END) AS source, count(*) AS n FROM documents WHERE doc_id % 4 > 1 AND trim(source) NOT IN ('', 'nan') GROUP BY 1")
def valid_key_rows(spark, d):
    of = F.col("doc_id") % 4
    keyed = read(spark, d, "documents").select(F.when(of == 0, " nan ").when(of == 1, "  ").otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("source"))
    return extract.check_shape(extract.valid_keys(keyed, "source"), 1, 1).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH v AS (SELECT unnest([{'c': 'l_quantity', 'v': CAST(l_quantity AS DOUBLE)}, {'c': 'l_extendedprice', 'v': CAST(l_extendedprice AS DOUBLE)}, {'c': 'l_discount', 'v': CAST(l_discount AS DOUBLE)}], recursive := true) FROM lineitem)
SELECT c AS "column", round(avg(v), 6) AS mean FROM v GROUP BY 1 ORDER BY var_samp(v) DESC LIMIT 2""")
def most_varied_columns(spark, d):
    rows = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    kept = extract.top_variance(rows, extract.numeric_columns(rows), 2)
    rows = extract.drop_features(rows, [c for c in rows.columns if c not in kept])
    return rows.select(*[F.col(c).cast("double") for c in kept]).unpivot([], kept, "column", "v").groupBy("column").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT kind, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 'real' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'synthetic', s_acctbal FROM supplier) GROUP BY 1")
def augmented_rows(spark, d):
    real = read(spark, d, "customer").select(F.lit("real").alias("kind"), F.col("c_acctbal").alias("balance"))
    made = read(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("synthetic").alias("kind"))
    return sets.augment(real, made).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'soon' WHEN o_orderpriority LIKE '5-%' THEN 'late' ELSE 'whenever' END AS haste FROM orders")
def custom_dimension(spark, d):
    known = C.Dimensions.built_in()
    rule = lambda v: F.when(v.startswith("1-"), "soon").when(v.startswith("5-"), "late").when(v.startswith("3-"), "not a legal value")
    known.add(C.Dimension("haste", ("soon", "late"), "whenever", rule))
    return read(spark, d, "orders").select("o_orderkey", known.get("haste").classify(F.col("o_orderpriority")).alias("haste"))


@query("""
WITH n AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: length(w) > 2 AND NOT list_contains(['fr', 'en', 'de', 'la', 'le', 'les', 'du', 'des', 'et'], lower(w))) AS w FROM part)
SELECT p_partkey, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:]))[1:3], ' ') ELSE 'Data' END AS friendly,
 CASE WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') LIKE '%widget%' THEN 'Widget' WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') LIKE '%bolt%' THEN 'Bolt'
  ELSE array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), '') END AS entity FROM part JOIN n USING (p_partkey)""")
def file_names(spark, d):
    file = F.concat(F.lit("export_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_0a1b2c3d.csv"))
    plain = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".csv"))
    return read(spark, d, "part").select("p_partkey", T.friendly_name(file).alias("friendly"), T.map_file_to_entity(plain, ["Widget", "Bolt"]).alias("entity"))


@query("SELECT p_partkey, unnest(['size', 'type']) AS key, unnest([CAST(p_size AS VARCHAR), p_type || '=x']) AS value FROM part")
def filter_maps(spark, d):
    said = F.concat(F.lit(" size = "), "p_size", F.lit(", nothing,type="), "p_type", F.lit("=x"))
    return read(spark, d, "part").select("p_partkey", F.explode(T.filter_map(said)))


@query(f"SELECT table_a || ' and ' || table_b || ' are linked through ' || column_a || ' and ' || column_b || ' by ' || matches || ' shared values' AS sentence FROM ({SQL['column_pair_overlaps']})")
def relationship_sentences(spark, d):
    found = QUERIES["column_pair_overlaps"](spark, d)
    return found.select(T.relationship_sentence(F.col("table_a"), F.col("table_b"), F.col("column_a"), F.col("column_b"), F.lit("values"), F.col("matches")).alias("sentence"))


@query("""
WITH e AS (SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders), c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS a, o_orderstatus AS b FROM orders)
SELECT a AS src, b AS dst, 'RANKED' AS type FROM e UNION SELECT b, a, 'RANKED' FROM e UNION SELECT a, b, 'PLACED' FROM c""")
def value_graph(spark, d):
    return graph.relationship_graph(read(spark, d, "orders"), [("o_orderstatus", "o_orderpriority", "RANKED", True), ("o_custkey", "o_orderstatus", "PLACED", False)])[1]


@query("""
WITH a AS (SELECT * FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT * FROM lineitem WHERE l_linenumber > 2)
SELECT round((abs(x.p - y.p) + abs(x.q - y.q) + abs(x.r - y.r)) / 3, 8) AS correlation_error
FROM (SELECT corr(l_quantity, l_extendedprice) AS p, corr(l_quantity, l_discount) AS q, corr(l_extendedprice, l_discount) AS r FROM a) x, (SELECT corr(l_quantity, l_extendedprice) AS p, corr(l_quantity, l_discount) AS q, corr(l_extendedprice, l_discount) AS r FROM b) y""")
def correlation_errors(spark, d):
    rows = read(spark, d, "lineitem")
    out = metrics.correlation_error(rows.filter("l_linenumber <= 2"), rows.filter("l_linenumber > 2"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("correlation_error", F.round("correlation_error", 8))


@query("""
SELECT name, score FROM (
 SELECT name, 0.5 * 100 + 0.3 * CASE WHEN n < 50 THEN 30 WHEN n <= 10000 THEN 100 ELSE greatest(50, 100 - (n - 10000) / 1000) END + 0.2 * 75 AS score
 FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders)) WHERE score >= 75""")
def tables_worth_using(spark, d):
    return quality.filter_tables({t: read(spark, d, t) for t in ("customer", "nation", "orders")}, 75.0).select("name", F.round("score", 6).alias("score"))


@query("SELECT o_orderstatus, CASE WHEN n >= 10 THEN max(n) OVER () ELSE n END AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def balanced_classes(spark, d):
    made = synth.balanced(read(spark, d, "orders").select("o_orderstatus", "o_totalprice"), "o_orderstatus")
    return made.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
