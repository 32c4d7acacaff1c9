"""Queries of links between rows by similar values, of filled sheets, and of trees as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.operators import discovery, extract, metrics
from terrace.plans import lineage

from .registry import query, read

_TYPED = "(SELECT c_custkey, substring(c_name, 1, 11) || substring(c_name, 13) || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS typed, c_mktsegment || c_nationkey AS segment FROM customer)"


@query(f"""
WITH t AS {_TYPED},
x AS (SELECT DISTINCT lower(trim(c_name)) AS v FROM customer), y AS (SELECT DISTINCT lower(trim(typed)) AS v FROM t),
gx AS (SELECT v, list_distinct(list_transform(range(1, length(v) + 3), lambda i: substring('##' || v || '$$', i, 3))) AS g FROM x),
gy AS (SELECT v, list_distinct(list_transform(range(1, length(v) + 3), lambda i: substring('##' || v || '$$', i, 3))) AS g FROM y),
p AS (SELECT gx.v AS a, gy.v AS b, len(list_intersect(gx.g, gy.g)) AS c, len(gx.g) + len(gy.g) AS n FROM gx, gy WHERE gx.v <> gy.v),
links AS (
 SELECT c.c_custkey AS src, t.c_custkey AS dst, 0.9 AS score, 'equal' AS kind FROM customer c JOIN t ON lower(trim(c.c_name)) = lower(trim(t.typed))
 UNION ALL SELECT c.c_custkey, t.c_custkey, 0.9 * p.c / (n - p.c), 'similar' FROM p JOIN customer c ON lower(trim(c.c_name)) = a JOIN t ON lower(trim(t.typed)) = b WHERE p.c >= 0.8 * (n - p.c))
SELECT src, dst, round(max(score), 6) AS score, arg_max(kind, score) AS kind FROM links GROUP BY src, dst""")
def row_links_similar(spark, d):
    c = read(spark, d, "customer")
    typed = F.concat(F.substring("c_name", 1, 11), F.substring("c_name", 13, 100), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""))
    t = c.select("c_custkey", typed.alias("typed"))
    out = discovery.similar_row_links(c, t, "c_custkey", "c_custkey", [("c_name", "typed", 0.9)], 0.8)
    return out.withColumn("score", F.round("score", 6))


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 37 = 1 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN ' ' END AS e, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS customer, o_orderstatus AS status FROM orders),
f AS (SELECT *, last_value(CASE WHEN trim(e) <> '' THEN e END IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entity FROM s)
SELECT entity, attribute, value, count(*) AS n FROM (SELECT entity, unnest([{'attribute': 'customer', 'value': customer}, {'attribute': 'status', 'value': status}], recursive := true) FROM f) WHERE entity IS NOT NULL AND trim(value) <> '' GROUP BY ALL""")
def tidy_sheet(spark, d):
    o = read(spark, d, "orders")
    entity = F.when(F.col("o_orderkey") % 37 == 1, F.col("o_orderpriority")).when(F.col("o_orderkey") % 5 == 0, " ")
    sheet = o.select("o_orderkey", entity.alias("e"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("customer"), F.col("o_orderstatus").alias("status"))
    return extract.tidy(sheet, "e", ["customer", "status"], "o_orderkey").groupBy("entity", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


_NODES = """(SELECT 'n"' || c_custkey || '\\' AS id, CASE WHEN c_custkey % 10 <> 0 THEN 'n"' || (c_custkey - c_custkey % 10 + (c_custkey % 10) // 3) || '\\' END AS parent_id,
  CASE WHEN c_custkey % 4 <> 0 THEN 'say "' || c_mktsegment || '" or \\ or ]:' END AS action FROM customer)"""


@query(f"""
WITH RECURSIVE n AS {_NODES},
w AS (SELECT id, action, id AS root, 0 AS depth, [id] AS way FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, n.action, w.root, w.depth + 1, list_append(w.way, n.id) FROM w JOIN n ON n.parent_id = w.id),
s AS (SELECT *, lead(depth) OVER (PARTITION BY root ORDER BY way) AS after FROM w),
p AS (SELECT *, CASE WHEN after IS NULL THEN depth + 1 ELSE greatest(depth - after + 1, 0) END AS up FROM s)
SELECT root AS id, string_agg('{{"id":' || to_json(id) || ',"action":' || to_json(coalesce(action, '')) || ',"children":[' || repeat(']}}', up) || CASE WHEN after IS NOT NULL AND up > 0 THEN ',' ELSE '' END, '' ORDER BY way) AS tree FROM p GROUP BY root""")
def lineage_tree(spark, d):
    """Trees of ten customers, their ids and actions full of quotes and backslashes."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit('n"'), k, F.lit("\\"))
    log = read(spark, d, "customer").select(
        name(key).alias("id"), F.when(key % 10 != 0, name(key - key % 10 + F.floor((key % 10) / 3))).alias("parent_id"),
        F.when(key % 4 != 0, F.concat(F.lit('say "'), "c_mktsegment", F.lit('" or \\ or ]:'))).alias("action"),
    )
    return lineage.nested_json(log)


@query("""
WITH o AS (SELECT o_orderstatus, 'q]:"' || o_orderpriority AS p, '\\' || CAST(o_custkey % 3 AS VARCHAR) || '[' AS r FROM orders),
a AS (SELECT o_orderstatus, p, r, count(*) AS n FROM o GROUP BY ALL),
b AS (SELECT o_orderstatus, p, '{' || string_agg(to_json(r) || ':' || n, ',' ORDER BY to_json(r) || ':' || n) || '}' AS j FROM a GROUP BY ALL)
SELECT o_orderstatus, '{' || string_agg(to_json(p) || ':' || j, ',' ORDER BY to_json(p) || ':' || j) || '}' AS tree FROM b GROUP BY o_orderstatus""")
def hierarchy_of_odd_names(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", F.concat(F.lit('q]:"'), "o_orderpriority").alias("p"), F.concat(F.lit("\\"), F.col("o_custkey") % 3, F.lit("[")).alias("r"))
    return metrics.hierarchy_json(o, ["o_orderstatus", "p", "r"])
