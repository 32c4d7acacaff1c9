"""Graphs as two tables: nodes (id, type, name, source, props) and edges (src, dst, type, props)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import key_edges
from .windows import first_key_wins

NODES = "id string, type string, name string, source string, props map<string,string>"
EDGES = "src string, dst string, type string, props map<string,string>"


def props(columns: Sequence[str]) -> Column:
    """A map of the columns' values as text, nulls left out."""
    entries = [F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
    if not entries:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def _no_props() -> Column:
    return props([])


def star_graph(source: str, table: DataFrame, name: str, columns: Sequence[str] | None = None, row_id: str = "_rid") -> tuple[DataFrame, DataFrame]:
    """One Source node, a node for each row with a name, and a FOUND_IN edge from each to the source."""
    kept = [c for c in (columns or table.columns[:5]) if c != row_id]
    own = F.concat(F.lit(f"{source}_"), F.col(row_id).cast("string"))
    rows = table.filter(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "").select(own.alias("id"), F.lit("Entity").alias("type"), F.col(name).cast("string").alias("name"), F.lit(source).alias("source"), props(kept).alias("props"))
    top = table.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit("Source").alias("type"), F.lit(source).alias("name"), F.lit(source).alias("source"), _no_props().alias("props"))
    return top.unionByName(rows), rows.select(F.col("id").alias("src"), F.lit(source).alias("dst"), F.lit("FOUND_IN").alias("type"), _no_props().alias("props"))


@dataclass(frozen=True)
class Entity:
    """How a source becomes nodes: a label, the key column and the property columns."""

    label: str
    source: str
    key: str
    properties: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    """An edge type between two entities, by a column of each."""

    type: str
    start: str
    end: str
    start_column: str
    end_column: str


def entity_nodes(entity: Entity, table: DataFrame, row_id: str = "_rid") -> DataFrame:
    """A node for each trimmed, non-empty key; the first row of a key gives the properties."""
    key = F.trim(F.col(entity.key).cast("string"))
    rows = table.withColumn("_key", key).filter(~F.col("_key").isin("", "nan"))
    first = first_key_wins(rows.select("_key", row_id, *dict.fromkeys([*entity.properties])), "_key", row_id)
    return first.select(F.concat(F.lit(f"{entity.label}_"), F.col("_key")).alias("id"), F.lit(entity.label).alias("type"), F.col("_key").alias("name"), F.lit(entity.source).alias("source"), props(entity.properties).alias("props"))


def model_graph(sources: Mapping[str, DataFrame], entities: Sequence[Entity], relations: Sequence[Relation], row_id: str = "_rid") -> tuple[DataFrame, DataFrame]:
    """Nodes of every entity, and edges where the trimmed join columns of two entities' rows are equal."""
    by = {e.label: e for e in entities}
    nodes = None
    for e in entities:
        own = entity_nodes(e, sources[e.source], row_id)
        nodes = own if nodes is None else nodes.unionByName(own)
    edges = None
    for r in relations:
        a, b = by[r.start], by[r.end]
        of = lambda e, column: sources[e.source].select(F.concat(F.lit(f"{e.label}_"), F.trim(F.col(e.key).cast("string"))).alias("id"), F.col(column).alias("k"))
        found = key_edges(of(a, r.start_column), of(b, r.end_column), "id", "id", "k", "k")
        found = found.select("src", "dst", F.lit(r.type).alias("type"), F.map_from_arrays(F.array(F.lit("matched_value")), F.array("matched_value")).alias("props"))
        edges = found if edges is None else edges.unionByName(found)
    return nodes, edges if edges is not None else nodes.sparkSession.createDataFrame([], EDGES)


def mapped_graph(table: DataFrame, source: str, mapping: Mapping[str, str], relation: str = "RELATED_TO", row_id: str = "_rid") -> tuple[DataFrame, DataFrame]:
    """Columns become entities: each row gives a node for every mapped column, and edges between those of one row."""
    cells = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(i).alias("place"), F.trim(F.col(f"`{c}`").cast("string")).alias("name")) for i, (c, kind) in enumerate(mapping.items())])
    long = table.select(F.col(row_id).alias("row"), F.explode(cells).alias("c")).select("row", "c.*").filter("name IS NOT NULL AND name <> ''")
    long = long.withColumn("id", F.concat_ws("_", "type", "name"))
    nodes = long.groupBy("id").agg(F.min("type").alias("type"), F.min("name").alias("name")).select("id", "type", "name", F.lit(source).alias("source"), _no_props().alias("props"))
    # entities of one row are few (one for each mapped column), so they are paired inside the row
    rows = long.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("ids"))
    pairs = rows.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('src', x.id, 'dst', y.id))))")).alias("p")).select("p.*").distinct()
    return nodes, pairs.select("src", "dst", F.lit(relation).alias("type"), _no_props().alias("props"))


def relationship_graph(table: DataFrame, relations: Sequence[tuple[str, str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Nodes are the values of the columns; for (column, column, type, both ways) an edge for each pair of values in a row."""
    edges = None
    for a, b, kind, both in relations:
        one = table.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")).na.drop().distinct()
        one = one.union(one.select("dst", "src")).distinct() if both else one
        one = one.withColumn("type", F.lit(kind))
        edges = one if edges is None else edges.unionByName(one)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes, edges


def extract_entity(table: DataFrame, column: str, label: str, relation: str = "HAS", row_id: str = "_rid") -> tuple[DataFrame, DataFrame]:
    """A node for each distinct value and an edge from every row that has it, so no node is without edge."""
    rows = table.filter(F.col(column).isNotNull()).select(F.col(row_id).cast("string").alias("src"), F.concat(F.lit(f"{label}_"), F.col(column).cast("string")).alias("dst"), F.col(column).cast("string").alias("name"))
    nodes = rows.groupBy("dst").agg(F.min("name").alias("name")).select(F.col("dst").alias("id"), F.lit(label).alias("type"), "name", F.lit(None).cast("string").alias("source"), _no_props().alias("props"))
    return nodes, rows.select("src", "dst", F.lit(relation).alias("type"), _no_props().alias("props"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): nodes of each type and edges of each (from type, type, to type)."""
    kinds = nodes.select("id", "type")
    a, b = kinds.withColumnsRenamed({"id": "src", "type": "ta"}), kinds.withColumnsRenamed({"id": "dst", "type": "tb"})
    e = edges.select("src", "dst", "type").join(a, "src").join(b, "dst").groupBy(F.concat_ws(" ", "ta", "type", "tb").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n = nodes.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit("node").alias("kind"), "label", "n").unionByName(e.select(F.lit("edge").alias("kind"), "label", "n"))


def degree(edges: DataFrame, without: Sequence[str] = ("FROM_SOURCE",)) -> DataFrame:
    """(id, degree): edges at each node, but for the types left out."""
    kept = edges.filter(~F.col("type").isin(*without)) if without else edges
    return kept.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def linked_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_id, from_type, from_name, relationship, to_id, to_type, to_name) of every edge."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("name").alias(f"{p}_name"))
    e = edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.col("type").alias("relationship"))
    return e.join(side("from"), "from_id").join(side("to"), "to_id").select("from_id", "from_type", "from_name", "relationship", "to_id", "to_type", "to_name")


def relationship_summary(nodes: DataFrame, edges: DataFrame, sample: int = 3) -> DataFrame:
    """(id, name, relationship, direction, n, sample): how many neighbours a node has by type and direction, and the first names.

    Names are kept as the ``sample`` least, so no list grows with a node's degree.
    """
    table = linked_table(nodes, edges)
    out = table.select(F.col("from_id").alias("id"), F.col("from_name").alias("name"), "relationship", F.lit("to").alias("direction"), F.col("to_name").alias("other"))
    out = out.unionByName(table.select(F.col("to_id").alias("id"), F.col("to_name").alias("name"), "relationship", F.lit("from").alias("direction"), F.col("from_name").alias("other")))
    by = ["id", "name", "relationship", "direction"]
    from pyspark.sql import Window

    counts = out.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(F.struct(*by).alias("_k"), "n")
    # filtered by place at once, so every task keeps ``sample`` names a node before they meet
    few = out.select(*by, "other").distinct().filter("other IS NOT NULL").withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy("other"))).filter(F.col("p") <= sample)
    names = few.groupBy(F.struct(*by).alias("_j")).agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("sample"))
    return counts.join(names, F.col("_k").eqNullSafe(F.col("_j")), "left").select("_k.*", "n", F.coalesce("sample", F.lit("")).alias("sample"))


def seed_subgraph(edges: DataFrame, limit: int = 50, without: Sequence[str] = ("FROM_SOURCE",)) -> DataFrame:
    """Edges at the nodes of highest degree: max(10, limit / 3) seeds (of equals the least id)."""
    kept = edges.filter(~F.col("type").isin(*without)) if without else edges
    seeds = degree(kept, ()).orderBy(F.desc("degree"), "id").limit(max(10, limit // 3)).select("id")
    at = lambda end: kept.join(F.broadcast(seeds.withColumnRenamed("id", end)), end, "left_semi").select(*kept.columns)  # noqa: E731  ``limit`` rows at most
    return at("src").unionByName(at("dst")).dropDuplicates(["src", "dst", "type"])


def nodes_of_type(nodes: DataFrame, kind: str, properties: Sequence[str]) -> DataFrame:
    """id and chosen properties of the nodes of one type."""
    return nodes.filter(F.col("type") == kind).select("id", *[F.col("props")[p].alias(p) for p in properties])


def categorisable(nodes: DataFrame, kind: str | None = None, column: str | None = None) -> DataFrame:
    """(id, value) of what can be sorted into categories: no Source nodes; the property, else the name, else the id."""
    kept = nodes.filter(F.col("type") != "Source")
    kept = kept.filter(F.col("type") == kind) if kind else kept
    return kept.select("id", F.coalesce(*([F.col("props")[column]] if column else []), "name", "id").alias("value"))


def to_records(nodes: DataFrame, edges: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (unknown types under the first label, values as text, null as empty) and edges with the types of both ends."""
    known = F.when(F.col("type").isin(*labels), F.col("type")).otherwise(labels[0])
    flat = nodes.select(known.alias("label"), "id", F.coalesce("name", F.lit("")).alias("name"), F.transform_values("props", lambda k, v: F.coalesce(v, F.lit(""))).alias("props"))
    kinds = flat.select("id", "label")
    e = edges.join(kinds.withColumnsRenamed({"id": "src", "label": "start_type"}), "src").join(kinds.withColumnsRenamed({"id": "dst", "label": "end_type"}), "dst")
    return flat, e.select(F.col("src").alias("start_id"), F.col("dst").alias("end_id"), "start_type", "end_type", F.coalesce("type", F.lit("RELATED_TO")).alias("type"))


def batches(records: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, label, n): one batch for each node label and each edge type."""
    n, e = records
    a = n.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return a.unionByName(e.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))
