"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))  # a plain side, so that Spark can split a hub
    return both.filter("b > a").join(least, "a").filter("m <> b").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = stage(down.groupBy("b").agg(F.min("a").alias("m")))
    moved = down.join(least, "b").filter("a <> m").select(F.col("m"), F.col("a").alias("x"))
    return least.select(F.col("m").alias("a"), "b").union(moved.select(F.col("m").alias("a"), F.col("x").alias("b"))).distinct()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the least id that links reach.

    Self links and repeated links are allowed, rows with a null end are left out, and no links give no rows. Each round
    is written to the shared folder; the driver sees two numbers of it.
    """
    edges = stage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            roots = edges.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots.join(edges.select(F.col("b").alias("id")), "id", "left_anti"))
        seen = state
        edges = stage(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
