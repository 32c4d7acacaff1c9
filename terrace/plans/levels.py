"""Levels: raw tables (4), linked tables (3), one table (2), one column (1), one number (0), over lazy plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.categories import Dimensions
from terrace.functions.text import naming_signature
from terrace.operators import extract, metrics


@dataclass(frozen=True)
class State:
    """A level and what it holds: a dict of tables (4), a table (3, 2, 1) or a one-row table (0); and the state above."""

    level: int
    data: DataFrame | Mapping[str, DataFrame]
    parent: State | None = field(default=None, repr=False)
    note: str = ""

    def descend(self, step: Callable | None = None, **options) -> State:
        """One level down.

        4 to 3: ``step`` links the tables. 3 to 2: ``step`` makes one table. 2 to 1: ``column``, ``query``. 1 to 0:
        ``method`` (a name or a function of a Column), ``nulls``.
        """
        if self.level in (4, 3):
            if step is None:
                raise ValueError(f"a step is needed below level {self.level}")
            out = step(self.data)
        elif self.level == 2:
            out = extract.vector(self.data, **options)
        elif self.level == 1:
            out = metrics.datum(self.data, **options)
        else:
            raise ValueError("there is nothing below level 0")
        return State(self.level - 1, out, self, str(options) if options else getattr(step, "__name__", ""))

    def ascend(self, **options) -> State:
        """One level up, never to raw tables.

        0 to 1: the vector that the number came from, or with ``signatures=True`` the signatures of its names. 1 to 2:
        ``dimensions``. 2 to 3: ``dimensions`` and ``relations``; rows are neither lost nor multiplied.
        """
        if self.level == 0:
            if self.parent is None:
                raise ValueError("the vector of this number isn't known")
            rows = self.parent.data
            if options.get("signatures"):
                rows = rows.withColumn("signature", naming_signature(F.col("value").cast("string")))
            return State(1, rows, self, "expand")
        if self.level == 1:
            names = options.get("dimensions") or [d.name for d in Dimensions.built_in().of_levels(1, 2)]
            return State(2, add_dimensions(self.data, names, options.get("value", "value"), options.get("registry")), self, ",".join(names))
        if self.level == 2:
            names = options.get("dimensions") or [d.name for d in Dimensions.built_in().of_levels(2, 3)]
            out = add_dimensions(self.data, names, options.get("value", "value"), options.get("registry"))
            return State(3, extract.relation_markers(out, options.get("relations", ())), self, ",".join(names))
        raise ValueError(f"nothing above level {self.level} can be reached")


def add_dimensions(table: DataFrame, names: Sequence[str], value: str = "value", registry: Dimensions | None = None) -> DataFrame:
    """table with a column for each dimension, classified from ``value``."""
    known = registry or Dimensions.built_in()
    return table.withColumns({n: known.get(n).classify(F.col(value).cast("string")) for n in names})


def full_descent(tables: Mapping[str, DataFrame], link: Callable, to_table: Callable, column: str, methods: Sequence[str], domain: str = "domain") -> DataFrame:
    """All numbers of all domains in one plan: (domain, one column for each method)."""
    table = to_table(link(tables))
    return table.groupBy(domain).agg(*[metrics.aggregate(m, F.col(column)).alias(m) for m in methods])


def detect_level(data: DataFrame | Mapping[str, DataFrame], linked: bool | None = None) -> int:
    """0 for one value, 1 for one column or one row, 2 for a table, 3 for tables with links (or nodes and edges), else 4."""
    if isinstance(data, DataFrame):
        few = data.limit(2).count()
        wide = len([c for c in data.columns if not c.startswith("_")])
        if few == 1 and wide == 1:
            return 0
        return 1 if wide == 1 or few == 1 else 2
    if set(data) == {"nodes", "edges"}:
        return 3
    if linked is None:
        from terrace.operators.discovery import relationships

        linked = len(data) > 1 and relationships(data).limit(1).count() > 0
    return 3 if linked else 4


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(file, rows, columns) of every source."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("file"), "rows", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def fingerprint(table: DataFrame) -> Column:
    """An aggregate that is equal for tables with the same rows in any order."""
    return F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))
