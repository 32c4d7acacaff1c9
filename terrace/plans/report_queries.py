"""Queries of distinct counts, folders of mixed dialects, whole reports, synthesis by class, and domains."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrace.operators import categorize, discovery, extract, quality, statistics, synth, windows
from terrace.plans import levels
from terrace.sources import readers, sinks

from .registry import query, read


def _folder(spark) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        windows.kept(spark.range(1))  # sets a folder where none is set
    return f"{context.getCheckpointDir().rstrip('/')}/folder-{uuid.uuid4().hex}"


_COUNTED = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in _COUNTED))
def distinct_values(spark, d):
    return statistics.distinct_counts(read(spark, d, "lineitem"), {c: F.col(c) for c in _COUNTED})


@query("SELECT c_custkey, c_name || ' é' AS c_name, c_acctbal, c_custkey % 4 AS dialect, false AS bad FROM customer")
def mixed_dialects(spark, d):
    folder = _folder(spark)
    rows = read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), "c_acctbal")
    shown = F.format_string("%.2f", "c_acctbal")
    for i, (encoding, sep, mark) in enumerate((("utf-8", ",", "."), ("iso-8859-1", ";", ","), ("utf-8", "\t", ","), ("iso-8859-1", "|", "."))):
        part = rows.filter(F.col("c_custkey") % 4 == i).withColumn("c_acctbal", F.replace(shown, F.lit("."), F.lit(mark)))
        part.write.mode("append").options(header=True, sep=sep, encoding=encoding).csv(folder)
    out = readers.read_dialects(spark, folder, "c_custkey long, c_name string, c_acctbal double")
    return out.select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 4).alias("dialect"), F.col("_bad").isNotNull().alias("bad"))


@query("""
WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS m, count(*) AS c FROM orders GROUP BY 1)
SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 3000 ELSE 2000 END AS n, true AS mean_close, true AS spread_close, true AS within FROM s WHERE c >= 10""")
def targeted_synthesis(spark, d):
    orders = read(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_custkey")
    stats = lambda df, p: df.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias(f"{p}m"), F.stddev("o_totalprice").alias(f"{p}s"), F.min("o_totalprice").alias(f"{p}a"), F.max("o_totalprice").alias(f"{p}b"), F.count(F.lit(1)).alias(f"{p}n"))
    real = stats(orders, "r").filter("rn >= 10")
    sizes = {r["o_orderstatus"]: 3000 if r["o_orderstatus"] == "F" else 2000 for r in real.select("o_orderstatus").collect()}  # one row a class
    made = stats(synth.generate_classes(orders, "o_orderstatus", sizes), "m")
    # means of n draws lie within five standard errors
    error = 5 * F.col("rs") / F.sqrt(F.col("mn"))
    return made.join(real, "o_orderstatus").select(
        "o_orderstatus", F.col("mn").cast("int").alias("n"), (F.abs(F.col("mm") - F.col("rm")) < error).alias("mean_close"), (F.abs(F.col("ms") / F.col("rs") - 1) < 0.1).alias("spread_close"),
        ((F.col("ma") >= F.col("ra")) & (F.col("mb") <= F.col("rb"))).alias("within"),
    )


_SCORED = ("l_quantity", "l_discount", "l_tax")


@query("""
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, abs(corr(l_tax, l_extendedprice)) AS c, count(*) AS n FROM lineitem),
l AS (SELECT unnest([{'item': 'l_quantity', 'value': a}, {'item': 'l_discount', 'value': b}, {'item': 'l_tax', 'value': c}], recursive := true) FROM c),
m AS (SELECT avg(l_quantity) AS qa, stddev(l_quantity) AS qs, avg(l_extendedprice) AS ea, stddev(l_extendedprice) AS es FROM lineitem)
SELECT 'score' AS section, 'score' AS item, round(80 + 0.3 * CASE WHEN n < 50 THEN 30 WHEN n <= 10000 THEN 100 ELSE greatest(50, 100 - (n - 10000) / 1000) END - 15, 6) AS value FROM c
UNION ALL SELECT 'top', item, round(value, 6) FROM l UNION ALL SELECT 'low', item, round(value, 6) FROM l WHERE value < 0.05
UNION ALL SELECT 'suggestion', item, NULL FROM l WHERE value < 0.05
UNION ALL SELECT 'profile', unnest(['l_quantity', 'l_discount', 'l_tax']), NULL""")
def report_sections(spark, d):
    lines = read(spark, d, "lineitem")
    importance = lines.agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in _SCORED]).unpivot([], list(_SCORED), "feature", "importance")
    profile = quality.profile(lines.select(*_SCORED))
    none = spark.createDataFrame([], "a string, b string, correlation double")
    said = quality.suggest(profile, none, importance.withColumnRenamed("feature", "column")).filter("kind = 'remove'")
    report = quality.quick_score(lines.select(*_SCORED, "l_returnflag")).join(F.broadcast(profile.agg(F.collect_list(F.struct("*")).alias("profile"))))
    out = sinks.report_rows(report, said, importance)
    return out.withColumn("value", F.round(F.col("value").try_cast("double"), 6))


_DOMAINS = ("Revenue", "Bolt", "widget")


@query("SELECT p_partkey, CASE WHEN regexp_matches(t, 'revenue|ca|chiffre|income|sales|recette') THEN 'Revenue' WHEN contains(t, 'bolt') THEN 'Bolt' ELSE 'widget' END AS domain, CAST(1 AS DOUBLE) AS score FROM (SELECT p_partkey, lower(p_name) AS t FROM part) WHERE regexp_matches(t, 'revenue|ca|chiffre|income|sales|recette|bolt|widget')")
def domain_items(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_name")
    return categorize.domain_tables(parts, "p_name", _DOMAINS, 1.01).select("p_partkey", "domain", "score")


@query("""
WITH v AS (SELECT (CASE event_type WHEN 'purchase' THEN 'total_sales_' WHEN 'click' THEN 'avg_' ELSE '' END) || event_type AS v FROM events),
s AS (SELECT avg(CAST(regexp_matches(v, 'revenue|rev|income|sales|volume|vol|quantity|qty|count|etp|fte|employee|staff|headcount') AS DOUBLE)) AS b, avg(CAST(regexp_matches(v, '^(total_|sum_|agg_|avg_|mean_|median_|pct_|percent_|ratio_)') AS DOUBLE)) AS p FROM v)
SELECT 'business_object' AS dimension, 'high' AS confidence, round(b, 9) AS share FROM s WHERE b > 0 UNION ALL SELECT 'pattern_type', 'medium', round(p, 9) FROM s WHERE p > 0""")
def suggested_dimensions(spark, d):
    prefix = F.when(F.col("event_type") == "purchase", "total_sales_").when(F.col("event_type") == "click", "avg_").otherwise("")
    vector = read(spark, d, "events").select(F.concat(prefix, "event_type").alias("value"))
    return categorize.suggest_dimensions(vector).withColumn("share", F.round("share", 9))


@query("SELECT unnest(['orders and customer', 'orders', 'keys', 'count']) AS data, unnest([3, 2, 1, 0]) AS level FROM (SELECT count(*) AS n FROM orders HAVING n > 1)")
def detected_levels(spark, d):
    orders = read(spark, d, "orders")
    found = {
        "orders and customer": levels.detect_level({"orders": orders.select(F.col("o_custkey").alias("custkey"), "o_totalprice"), "customer": read(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")}),
        "orders": levels.detect_level(orders), "keys": levels.detect_level(orders.select("o_orderkey")), "count": levels.detect_level(orders.agg(F.count(F.lit(1)).alias("n"))),
    }
    return spark.createDataFrame(list(found.items()), "data string, level int")


@query("SELECT o_orderkey, o_totalprice AS o_totalprice_before, round(sqrt(o_totalprice), 6) AS o_totalprice_after FROM orders ORDER BY o_orderkey LIMIT 20")
def transform_preview(spark, d):
    ordered = read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
    shown = extract.preview(ordered, lambda t: t.withColumn("o_totalprice", F.sqrt("o_totalprice")), ["o_orderkey", "o_totalprice"], 20)
    return shown.select(F.col("o_orderkey_before").alias("o_orderkey"), "o_totalprice_before", F.round("o_totalprice_after", 6).alias("o_totalprice_after"))


@query("SELECT 100 AS n, 100 AS distinct_ids, true AS again FROM (SELECT count(*) AS c FROM orders HAVING c >= 100)")
def sampled_rows(spark, d):
    orders = read(spark, d, "orders")
    a, b = (extract.exact_sample(orders.repartition(k), 100, "o_orderkey", 7).select("o_orderkey") for k in (2, 5))
    both = a.join(b.withColumn("again", F.lit(True)), "o_orderkey", "left")
    return both.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("distinct_ids"), F.coalesce(F.every("again"), F.lit(False)).alias("again"))


@query("SELECT 'customer' AS table_a, 'nation_key' AS column_a, 'nation' AS table_b, 'nationkey' AS column_b FROM (SELECT count(*) AS c FROM nation HAVING c > 0)")
def join_columns_found(spark, d):
    customer = read(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").alias("nation_key"))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    found = discovery.best_join_columns({"customer": customer}, {"nation": nation}, top=4)
    return found.filter("score > 0").select("table_a", "column_a", "table_b", "column_b")
