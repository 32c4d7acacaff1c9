"""Enrichments by name, and embeddings by a model that is loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


@dataclass(frozen=True)
class Enrichment:
    """What takes a table from one level up to another: a function of the table, and whether it is the level's default."""

    name: str
    levels: tuple[int, int]
    how: Callable[[DataFrame], DataFrame]
    default: bool = False


class Enrichments:
    """Enrichments by name; a name can be taken once."""

    def __init__(self, known: Sequence[Enrichment] = ()):
        self._known: dict[str, Enrichment] = {}
        for enrichment in known:
            self.add(enrichment)

    def add(self, enrichment: Enrichment) -> None:
        low, high = enrichment.levels
        if not 0 <= low < high <= 4:
            raise ValueError(f"an enrichment goes up, not from {low} to {high}")
        if enrichment.name in self._known:
            raise ValueError(f"enrichment {enrichment.name!r} exists")
        self._known[enrichment.name] = enrichment

    def get(self, name: str) -> Enrichment:
        if name not in self._known:
            raise KeyError(f"no enrichment {name!r}; there are {', '.join(self._known) or 'none'}")
        return self._known[name]

    def between(self, low: int, high: int, defaults_only: bool = False) -> list[Enrichment]:
        return [e for e in self._known.values() if e.levels == (low, high) and (e.default or not defaults_only)]

    def applied(self, table: DataFrame, low: int, high: int, names: Sequence[str] | None = None) -> DataFrame:
        """table after the named enrichments of this step, in their order, or after its defaults."""
        chosen = self.between(low, high, True) if names is None else [self.get(n) for n in names]
        for e in chosen:
            if e.levels != (low, high):
                raise ValueError(f"enrichment {e.name!r} goes from {e.levels[0]} to {e.levels[1]}")
            table = e.how(table)
        return table


def embed_with(table: DataFrame, column: str, load: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "vector", size: int = 256) -> DataFrame:
    """table with a column of vectors that a model gives for the texts of another: null text has no vector.

    ``load`` gives the model, a function from texts to rows of numbers; it is called once in every task, and the model sees at
    most ``size`` texts at a time. A column of the same name is replaced.
    """
    own = table.drop(name)
    schema = StructType([*own.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = part[column].to_pylist()
                known = [t for t in texts if t is not None]
                found = iter(np.asarray(model(known), float).tolist() if known else [])
                vectors = [None if t is None else next(found) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names, name])

    return own.mapInArrow(run, schema)
