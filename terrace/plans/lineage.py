"""Lineage as a table (id, parent_id, level, action, decision, created_at): paths, branches, the latest state, snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.windows import kept, latest_per_group

SCHEMA = "id string, parent_id string, level int, action string, decision string, created_at timestamp, row_count long, columns array<string>, path string"


def paths(log: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, depth, path, way): for every node that a root reaches, the ids from its root to itself, as text and as an array.

    Pieces of paths double in length each round, so a log of depth d takes about log2(d) joins, whatever its rows.
    An error if a path is longer than ``max_depth``, or a cycle.
    """
    piece = kept(log.select("id", F.col("parent_id").alias("top"), F.array(F.col("id").cast("string")).alias("way"), F.lit(0).alias("depth")))
    length = 1
    while piece.filter("top IS NOT NULL").limit(1).count():
        if length > max_depth:
            raise ValueError(f"the log is deeper than {max_depth}, or has a cycle")
        above = piece.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("way").alias("_way"), F.col("depth").alias("_depth"))
        longer = piece.filter("top IS NOT NULL").join(above, "top")
        longer = longer.select("id", F.col("_top").alias("top"), F.concat("_way", "way").alias("way"), (F.col("depth") + F.col("_depth") + 1).alias("depth"))
        piece, length = kept(piece.filter("top IS NULL").unionByName(longer)), 2 * length
    return piece.select("id", "depth", F.array_join("way", ">").alias("path"), "way")


def branches(log: DataFrame) -> DataFrame:
    """Paths that end in a leaf."""
    return paths(log).join(log.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def branch_points(log: DataFrame) -> DataFrame:
    """(id, children): nodes with more than one child."""
    return log.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children")).filter("children > 1")


def on_path(log: DataFrame, node: str, max_depth: int = 1000) -> DataFrame:
    """The rows of the log from the root to a node, with their depth: a walk up from the node, one row a step."""
    name = f"lineage_{uuid.uuid4().hex}"
    log.select("id", "parent_id").createOrReplaceTempView(name)
    walk = log.sparkSession.sql(
        f"""WITH RECURSIVE up(id, parent_id, height) MAX RECURSION LEVEL {max_depth} AS (
            SELECT id, parent_id, 0 FROM {name} WHERE id = :node
            UNION ALL
            SELECT n.id, n.parent_id, up.height + 1 FROM up JOIN {name} n ON n.id = up.parent_id
        ) SELECT id, height FROM up""",
        args={"node": node},
    )
    mine = walk.agg(F.reverse(F.array_sort(F.collect_list(F.struct("height", "id")))).alias("way"))  # at most max_depth ids
    return log.join(F.broadcast(mine.select(F.posexplode("way").alias("depth", "w")).select("depth", F.col("w.id").alias("id"))), "id")


def latest_by_level(log: DataFrame, node: str) -> DataFrame:
    """The newest node of each level on the way to a node."""
    return latest_per_group(on_path(log, node).drop("depth"), "level", "created_at", "id")


def decisions(log: DataFrame, node: str) -> DataFrame:
    """(step, level, action, decision) on the way to a node."""
    return on_path(log, node).select(F.col("depth").alias("step"), "level", "action", "decision").orderBy("step")


def nested_json(log: DataFrame) -> DataFrame:
    """(id, tree): every root with its branches as nested JSON; children are in the order of their ids.

    The nodes of a root are put in preorder by their ways from the root; each writes its own opening and as many closings
    as the step to the next one asks for. A plan of a few joins for any depth that ``paths`` allows.
    """
    way = paths(log.select("id", "parent_id")).select("id", "depth", "way")
    rows = log.select("id", F.coalesce("action", F.lit("")).alias("action")).join(way, "id")
    own = F.to_json(F.struct("id", "action"))
    opened = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['))
    order = Window.partitionBy("root").orderBy("way")
    after = F.lead("depth").over(order)
    up = F.when(after.isNull(), F.col("depth") + 1).otherwise(F.greatest(F.col("depth") - after + 1, F.lit(0)))
    written = rows.withColumn("root", F.col("way")[0]).withColumn("piece", F.concat(opened, F.repeat(F.lit("]}"), up), F.when(after.isNotNull() & (up > 0), ",").otherwise("")))
    # a tree is one text, so one row has to hold it
    trees = written.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("way", "piece"))).alias("p"))
    return trees.select(F.col("root").alias("id"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("tree"))


def save(table: DataFrame, folder: str, node: str, parent: str | None, level: int, action: str, decision: str = "", options: Mapping[str, object] | None = None) -> DataFrame:
    """Writes a level's table as Parquet below ``folder`` and appends its row to the log; gives that row.

    The rows are counted from what was written, so the table itself is computed once.
    """
    path = f"{folder}/artifacts/{node}"
    table.write.mode("overwrite").parquet(path)
    rows = table.sparkSession.read.schema(table.schema).parquet(path).count()  # from the files' footers
    text = decision or json.dumps(options or {}, sort_keys=True)
    row = table.sparkSession.createDataFrame([(node, parent, level, action, text, rows, list(table.columns), path)], "id string, parent_id string, level int, action string, decision string, row_count long, columns array<string>, path string")
    row = row.withColumn("created_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{folder}/log")
    return row


def load_log(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/log")


def restore(spark, folder: str, node: str) -> DataFrame:
    """A node's table as it was saved."""
    return spark.read.parquet(f"{folder}/artifacts/{node}")


def steps(log: DataFrame) -> DataFrame:
    """The log with the change of row counts from parent to child."""
    w = Window.partitionBy("parent_id").orderBy("created_at", "id")
    parent = log.select(F.col("id").alias("parent_id"), F.col("row_count").alias("before"))
    return log.join(parent, "parent_id", "left").withColumns({"row_change": F.col("row_count") - F.col("before"), "child": F.row_number().over(w)})
