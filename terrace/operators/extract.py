"""Projections and filters: columns, rows, previews, guards, tidying."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Column names that hold names.
NAME_HINTS = ("indicator", "name", "title", "label", "description", "id")


def with_row_id(table: DataFrame, key: str | None = None, name: str = "_rid") -> DataFrame:
    """table with an explicit row id: its key, else an id that is unique but not dense."""
    return table.withColumn(name, F.col(key) if key else F.monotonically_increasing_id())


def vector(table: DataFrame, column: str | None = None, query: str | None = None, row_id: str = "_rid", drop_null: bool = False) -> DataFrame:
    """(_rid, value): one column, after an optional SQL filter; a one-column table needs no name."""
    own = [c for c in table.columns if c != row_id]
    if column is None and len(own) == 1:
        column = own[0]
    if column not in own:
        raise ValueError(f"no column {column!r}; there are {', '.join(own[:10])}")
    out = (table.filter(query) if query else table).select(*([row_id] if row_id in table.columns else []), F.col(column).alias("value"))
    return out.na.drop(subset=["value"]) if drop_null else out


def row_vector(table: DataFrame, key: str, value: object) -> DataFrame:
    """(attribute, value) of one entity's row, as text; columns that begin with ``_`` are left out."""
    own = [c for c in table.columns if not c.startswith("_") and c != key]
    return table.filter(F.col(key) == F.lit(value)).select(*[F.col(c).cast("string").alias(c) for c in own]).unpivot([], own, "attribute", "value")


def name_column(table: DataFrame, max_mean_length: float = 200) -> str:
    """The column that names rows: a string column with a telling name and short values, else the first of these, else the first."""
    strings = [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]
    hinted = [c for c in strings if any(h in c.lower() for h in NAME_HINTS)]
    if hinted:
        lengths = table.agg(*[F.avg(F.length(c)).alias(c) for c in hinted]).first()
        for c in hinted:
            if lengths[c] is not None and lengths[c] < max_mean_length:
                return c
    return hinted[0] if hinted else (strings[0] if strings else table.columns[0])


def top_variance(table: DataFrame, columns: Sequence[str], most: int = 500) -> list[str]:
    """The numeric columns of highest sample variance, in the order of the table."""
    if len(columns) <= most:
        return list(columns)
    v = table.agg(*[F.var_samp(c).alias(c) for c in columns]).first().asDict()
    kept = set(sorted(columns, key=lambda c: -(v[c] or 0))[:most])
    return [c for c in columns if c in kept]


def preview(table: DataFrame, transform, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows, with the columns before and after a transform whose statistics see the whole table."""
    kept = transform(table.withColumns({f"_before_{c}": F.col(c) for c in columns}))
    after = [c for c in kept.columns if c in columns or c not in table.columns and not c.startswith("_before_")]
    return kept.select(*[F.col(f"_before_{c}").alias(f"{c}_before") for c in columns], *[F.col(c).alias(f"{c}_after") for c in after]).limit(n)


def relation_markers(table: DataFrame, relations: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A ``_rel_{source}_{target}`` column with the relationship's type, for each whose source column exists."""
    return table.withColumns({f"_rel_{a}_{b}": F.lit(kind) for a, b, kind in relations if a in table.columns})


def linkage_markers(table: DataFrame, column: str | None = None) -> DataFrame:
    """_l3_linked and _linkage_column: the given column, else the first whose name holds ``id``, else none."""
    found = column if column in table.columns else next((c for c in table.columns if "id" in c.lower()), None)
    return table.withColumns({"_l3_linked": F.lit(found is not None), "_linkage_column": F.lit(found)})


def valid_keys(table: DataFrame, key: str) -> DataFrame:
    """Rows whose trimmed key is neither empty nor ``nan``."""
    return table.withColumn(key, F.trim(F.col(key).cast("string"))).filter(~F.col(key).isin("", "nan"))


def tidy(table: DataFrame, entity: str, attributes: Sequence[str], order: str = "_rid", segment: Column | None = None) -> DataFrame:
    """(entity, attribute, value) from a sparse sheet: the entity is filled down, empty cells go.

    Filling down follows ``order``, a unique key: over the whole sheet, by a segmented scan that no single task holds, or
    inside each ``segment`` (sheet or file), whose rows one task orders.
    """
    from .windows import fill_down

    named = F.when(F.trim(F.col(entity)) != "", F.col(entity))
    if segment is None:
        filled = fill_down(table, F.col(order), _e=named)
    else:
        filled = table.withColumn("_e", F.last(named, ignorenulls=True).over(Window.partitionBy(segment).orderBy(order)))
    long = filled.select("_e", *[F.col(f"`{a}`").cast("string").alias(a) for a in attributes]).unpivot(["_e"], list(attributes), "attribute", "value")
    return long.filter("_e IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''").withColumnRenamed("_e", "entity")


def drop_features(table: DataFrame, names: Sequence[str]) -> DataFrame:
    return table.drop(*names)


def check_shape(table: DataFrame | None, min_rows: int = 1, min_columns: int = 1) -> DataFrame:
    """The table, or an error if it is None or too small; counts no further than it must."""
    if table is None:
        raise ValueError("no table")
    if len(table.columns) < min_columns:
        raise ValueError(f"{len(table.columns)} columns; at least {min_columns} are needed")
    if table.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    return table


def numeric_columns(table: DataFrame) -> list[str]:
    return [f.name for f in table.schema.fields if isinstance(f.dataType, NumericType)]


def page(table: DataFrame, number: int, size: int, order: Sequence[str]) -> tuple[DataFrame, int, bool]:
    """Rows of a page (size 1 to 20), the total, and whether there are more."""
    size = max(1, min(20, size))
    total = table.count()
    return table.orderBy(*order).offset((number - 1) * size).limit(size), total, number * size < total


def sample_values(table: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first n distinct values, in their order."""
    return table.select(column).na.drop().distinct().orderBy(column).limit(n)


def exact_sample(table: DataFrame, n: int, row_id: str = "_rid", seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed: those of the least hashes."""
    return table.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(n)


def vector_kind(vector: DataFrame, value: str = "value") -> str:
    """numeric, categorical (under 50 distinct values, or under 20 % of the rows) or text."""
    if isinstance(vector.schema[value].dataType, NumericType):
        return "numeric"
    r = vector.agg(F.count_distinct(value).alias("u"), F.count(value).alias("n")).first()
    return "categorical" if r["u"] < 50 or r["u"] < 0.2 * r["n"] else "text"
