"""Readers for messy tables: encodings and separators are found on a bounded sample, then Spark reads the file in parallel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, IntegralType, StringType, StructType

#: Spark reads these; ISO-8859-1 takes every byte, and letters of Windows texts are the same in it.
ENCODINGS = ("utf-8", "iso-8859-1")
SEPARATORS = (";", ",", "\t", "|")


def _sample(spark: SparkSession, path: str, lines: int = 20) -> list[bytes]:
    """The first lines of a file as bytes: text is read as Latin-1, in which every byte is a character."""
    rows = spark.read.option("encoding", "iso-8859-1").option("header", False).option("sep", "\x01").option("quote", "").csv(path).limit(lines).collect()
    return [(r[0] or "").encode("latin-1", "replace") for r in rows if len(r)]


def encoding_of(sample: Sequence[bytes]) -> str:
    """The first encoding in which the sample can be read."""
    for name in ENCODINGS:
        try:
            b"\n".join(sample).decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def separator_of(sample: Sequence[str]) -> str:
    """The separator that cuts the most lines alike into the most columns; a comma if none cuts."""
    best = (0, 0, ",")
    for place, sep in enumerate(SEPARATORS):
        counts = [line.count(sep) for line in sample if line.strip()]
        if counts and counts[0]:
            best = max(best, (sum(c == counts[0] for c in counts) * counts[0], -place, sep))
    return best[2]


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, separator) of a delimited file, from its first lines."""
    raw = _sample(spark, path)
    encoding = encoding_of(raw)
    return encoding, separator_of([line.decode(encoding, "replace") for line in raw])


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_sniffed(spark: SparkSession, path: str, bad_lines: str = "drop", schema: str | None = None) -> DataFrame:
    """A delimited file of unknown encoding and separator. bad_lines: ``drop``, ``keep`` (cut or filled) or ``count`` (in ``_bad``)."""
    encoding, sep = sniff(spark, path)
    options = {"header": True, "sep": sep, "encoding": encoding, "mode": "DROPMALFORMED" if bad_lines == "drop" else "PERMISSIVE"}
    if bad_lines == "count":
        columns = spark.read.options(**options).csv(path).limit(0).columns
        typed = ", ".join(f"`{c}` string" for c in columns) + ", `_bad` string"
        return spark.read.options(**options, columnNameOfCorruptRecord="_bad").schema(typed).csv(path)
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_folder(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Raw tables by name, one reader each."""
    return {name: read_sniffed(spark, path) for name, path in paths.items()}


@dataclass(frozen=True)
class Dialect:
    """How a delimited file is written: its encoding, separator and decimal mark."""

    encoding: str
    sep: str
    decimal: str


#: Lines from the head of each file by which its dialect is judged.
HEAD = 50


def _fit(lines: Sequence[bytes], dialect: Dialect) -> tuple[int, int, int]:
    """How well a dialect reads lines: cells of rows as wide as the first, then cells that are numbers; none if the encoding fails."""
    try:
        rows = [line.decode(dialect.encoding).split(dialect.sep) for line in lines if line.strip()]
    except UnicodeDecodeError:
        return (-1, -1, -1)
    width = len(rows[0]) if rows else 0
    alike = [r for r in rows if len(r) == width] if width > 1 else []
    cells = [c.strip().strip('"') for r in alike[1:] for c in r]
    parts = [c.removeprefix("-").split(dialect.decimal) for c in cells]
    marked = sum(len(p) == 2 and all(x.isdigit() for x in p) for p in parts)
    return (len(alike) * (width - 1), marked, sum(len(p) == 1 and p[0].isdigit() for p in parts))


def best_dialect(lines: Sequence[bytes]) -> Dialect:
    """The dialect that reads the lines best, of all combinations; of equals the first in the order of the constants, decimal points first."""
    every = [Dialect(e, s, m) for e in ENCODINGS for s in SEPARATORS for m in (".", ",") if s != m]
    return max(every, key=lambda d: (_fit(lines, d), -every.index(d)))


def dialects(spark: SparkSession, folder: str) -> DataFrame:
    """(path, encoding, sep, decimal): the dialect of every file of a folder, judged by its first lines on the cluster, a file at a time."""
    raw = spark.read.options(encoding="iso-8859-1", header=False, sep="\x01", quote="", maxCharsPerColumn=-1).schema("line string").csv(folder)
    at = F.col("_metadata.file_path")
    # the head of a file is the head of its first split; a split's lines come in order, and no more than HEAD of them are kept
    first = raw.select(at.alias("path"), "line", F.col("_metadata.file_block_start").alias("start")).filter("start = 0")

    def heads(batches):
        left: dict[str, int] = {}
        for rows in batches:
            place = rows.groupby("path").cumcount()
            taken = place + rows["path"].map(lambda p: left.get(p, 0)) < HEAD
            for path, n in rows["path"].value_counts().items():
                left[path] = left.get(path, 0) + int(n)
            yield rows.loc[taken, ["path", "line"]].assign(place=(place + rows["path"].map(lambda p: left[p]))[taken])

    def judge(rows):
        import pandas as pd

        lines = [(x or "").encode("latin-1", "replace") for x in rows.sort_values("place")["line"]]
        d = best_dialect(lines)
        return pd.DataFrame([(rows["path"].iloc[0], d.encoding, d.sep, d.decimal)], columns=["path", "encoding", "sep", "decimal"])

    return first.mapInPandas(heads, "path string, line string, place long").groupBy("path").applyInPandas(judge, "path string, encoding string, sep string, decimal string")


def read_dialects(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a folder of delimited files with header lines, each in its own dialect, as one table of ``schema``.

    Files of one dialect are one scan, so large files are split as usual. ``_file`` is the path; ``_bad`` is the row's
    text where it has too few or too many cells, or a cell that its type can't hold (then that cell is null), else
    null: bad rows are kept and can be counted. Columns are told by place; empty cells are null.
    """
    fields = StructType.fromDDL(schema).fields
    groups: dict[Dialect, list[str]] = {}
    for r in dialects(spark, folder).collect():  # a row a file
        groups.setdefault(Dialect(r["encoding"], r["sep"], r["decimal"]), []).append(r["path"])
    raw = StructType()
    for f in fields:
        raw = raw.add(f.name, "string")
    raw = raw.add("_bad", "string")
    parts = []
    for d, paths in sorted(groups.items(), key=lambda x: str(x[0])):
        rows = spark.read.options(header=True, sep=d.sep, encoding=d.encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True).schema(raw).csv(paths)
        cells = {f.name: _cell(F.col(f"`{f.name}`"), f.dataType, d.decimal) for f in fields}
        lost = reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNotNull() & c.isNull() for n, c in cells.items()], F.lit(False))
        shown = F.concat_ws(d.sep, *[F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in fields])
        parts.append(rows.select(*[c.alias(n) for n, c in cells.items()], F.col("_metadata.file_path").alias("_file"), F.coalesce("_bad", F.when(lost, shown)).alias("_bad")))
    if not parts:
        return spark.createDataFrame([], f"{schema}, _file string, _bad string")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _cell(text: Column, kind: DataType, decimal: str) -> Column:
    """A cell as its type; null if that can't hold it. Blanks between thousands don't count where commas are decimal marks."""
    if decimal == "," and isinstance(kind, (FractionalType, IntegralType)):
        text = F.replace(F.regexp_replace(text, r"[\s\u00a0\u202f]", ""), F.lit(","), F.lit("."))
    return text.try_cast(kind)


def read_pages(spark: SparkSession, path: str, schema: str, limit: int | None = None, offset: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """Rows of JSON documents that are ``{"data": [...]}`` or lists; limit and offset need an order, without which they would be arbitrary."""
    if (offset or limit is not None) and not order:
        raise ValueError("limit and offset need an order")
    text = spark.read.text(path, wholetext=True)
    rows = parse_payload(text, "value", schema)
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def parse_payload(table: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows in a text column: a JSON list, ``{"data": [...]}``, or CSV with a header line; what can't be read gives no rows."""
    c = F.trim(F.col(column))
    listed = F.from_json(c, f"array<struct<{_struct(schema)}>>")
    data = F.from_json(c, f"struct<data:array<struct<{_struct(schema)}>>>")["data"]
    lines = F.filter(F.split(c, "\r?\n"), lambda x: F.trim(x) != "")
    csv = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    read = F.when(c.startswith("["), listed).when(c.startswith("{"), data)
    json_rows = table.filter(c.startswith("[") | c.startswith("{")).select(F.explode(read).alias("r")).select("r.*")
    csv_rows = table.filter(~(c.startswith("[") | c.startswith("{"))).select(F.explode(csv).alias("l")).select(F.from_csv("l", schema).alias("r")).select("r.*")
    return json_rows.unionByName(csv_rows)


def _struct(schema: str) -> str:
    return DataType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def detect_dates(table: DataFrame, formats: Sequence[str] = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd"), share: float = 0.5) -> DataFrame:
    """Text columns of at most 20 characters with ``/`` or ``-`` become dates in the first format that reads over half of their values."""
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return table
    parsed = lambda c, f: F.try_to_timestamp(F.col(f"`{c}`"), F.lit(f)).isNotNull().cast("double")
    known = lambda c, x: F.avg(F.when(F.col(f"`{c}`").isNotNull(), x))
    aggs = [known(c, parsed(c, f)).alias(f"p{i}_{k}") for i, c in enumerate(texts) for k, f in enumerate(formats)]
    aggs += [F.max(F.length(c)).alias(f"l{i}") for i, c in enumerate(texts)]
    seen = table.agg(*aggs).first()
    changes: dict[str, Column] = {}
    for i, c in enumerate(texts):
        hit = next((f for k, f in enumerate(formats) if (seen[f"p{i}_{k}"] or 0) > share), None)
        if hit and (seen[f"l{i}"] or 0) <= 20:
            changes[c] = F.try_to_timestamp(F.col(f"`{c}`"), F.lit(hit))
    return table.withColumns(changes) if changes else table


def demo(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """n rows of made-up indicators (name, description, source) from fixed vocabularies."""
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(F.rand(seed + k) * len(words)) + 1).cast("int"))
    a, b, c = pick(("CA", "VOL", "ETP", "COUT", "MARGE"), 0), pick(("B2B", "B2C", "GOV"), 1), pick(("FR", "EU", "INT"), 2)
    return spark.range(n).select(F.col("id").alias("_rid"), F.concat_ws("_", a, b, c).alias("name"), F.concat_ws(" ", F.lit("Indicator"), a, b, c).alias("description"), pick(("ERP", "CRM", "HR"), 3).alias("source"))

