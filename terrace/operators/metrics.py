"""From a vector to a number, and what lies between: aggregates, distributions, hierarchies, group comparisons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import statistics
from .windows import running

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median}


def aggregate(method: str | Callable[[Column], Column], value: Column) -> Column:
    """An aggregate by name, or a user's own function from a Column to an aggregate Column."""
    if callable(method):
        return method(value)
    if method not in AGGREGATES:
        raise ValueError(f"unknown aggregation {method!r}; there are {', '.join(AGGREGATES)}")
    return AGGREGATES[method](value)


def datum(vector: DataFrame, method: str | Callable[[Column], Column] = "mean", value: str = "value", nulls: str = "skip", fill: float = 0.0) -> DataFrame:
    """One row (value, description, aggregation_method).

    nulls: ``skip``, ``fill`` (with ``fill``), or ``error``. Text is read as numbers for sum and mean, and it is an
    error if nothing can be read. An empty vector gives null, or 0 for count.
    """
    if nulls == "error" and vector.filter(F.col(value).isNull()).limit(1).count():
        raise ValueError(f"{value} has nulls")
    v = F.col(value)
    if dict(vector.dtypes)[value] == "string" and method in ("sum", "mean", "avg", "median"):
        v = v.try_cast("double")
        seen = vector.agg(F.count(F.col(value)).alias("n"), F.count(v).alias("m")).first()
        if seen["n"] and not seen["m"]:
            raise ValueError(f"{method} of {value}: nothing in it is a number")
    v = F.coalesce(v, F.lit(fill)) if nulls == "fill" else v
    name = method if isinstance(method, str) else getattr(method, "__name__", "custom")
    if method == "median":
        middle = statistics.quantiles(vector.select(v.alias("v")), {"v": [0.5]})["v"][0]
        return vector.sparkSession.createDataFrame([(middle, f"{name} of {value}", name)], "value double, description string, aggregation_method string")
    return vector.agg(aggregate(method, v).alias("value")).select("value", F.lit(f"{name} of {value}").alias("description"), F.lit(name).alias("aggregation_method"))


def datum_by_domain(vector: DataFrame, method: str = "mean", value: str = "value", domain: str = "domain") -> DataFrame:
    """One row for each domain; sum and mean of what isn't numeric are its number of rows."""
    kind = dict(vector.dtypes)[value]
    is_number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if method == "median" and is_number:
        return statistics.group_quantiles(vector, [domain], value).select(domain, F.col("quantiles")[0].alias("value"))
    out = aggregate(method, F.col(value)) if is_number or method not in ("sum", "mean", "avg", "median") else F.count(F.lit(1))
    return vector.groupBy(domain).agg(out.alias("value"))


def numeric_datum(vector: DataFrame, value: str = "value") -> DataFrame:
    """sum, mean (2 places), min, max, median and count of non-null numbers; zeros for an empty vector."""
    v = F.col(value).try_cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    middle = statistics.quantiles(vector.select(v.alias("v")), {"v": [0.5]})["v"][0] or 0.0
    return vector.agg(
        zero(F.sum(v)).alias("sum"), zero(F.round(F.avg(v), 2)).alias("mean"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"), F.lit(middle).alias("median"), F.count(v).alias("count")
    )


def categorical_datum(vector: DataFrame, value: str = "value") -> DataFrame:
    """mode (of equals the least), count with nulls, distinct values."""
    counts = vector.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mode = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), "v")))
    return counts.agg(mode.alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count("v").alias("nunique")).select(F.col("m.v").alias("mode"), "count", "nunique")


def text_datum(vector: DataFrame, value: str = "value") -> DataFrame:
    """count, distinct texts, total and mean length (1 place)."""
    n = F.length(value)
    return vector.agg(F.count(F.lit(1)).alias("count"), F.count_distinct(value).alias("nunique"), F.sum(n).alias("total_length"), F.round(F.avg(n), 1).alias("average_length"))


def grouped_vector(table: DataFrame, key: str, value: str, method: str = "sum") -> DataFrame:
    """(key, value): numbers of each key, aggregated; what isn't a number counts as null."""
    rows = table.select(key, F.col(value).try_cast("double").alias("value"))
    if method == "median":
        return statistics.group_quantiles(rows, [key], "value").select(key, F.col("quantiles")[0].alias("value"))
    return rows.groupBy(key).agg(aggregate(method, F.col("value")).alias("value"))


def dimension_groups(table: DataFrame, by: Sequence[str], aggregations: Mapping[str, str] | None = None) -> DataFrame:
    """Aggregates by existing dimension columns, with group_size; rows with a null dimension are left out."""
    known, wanted = table.na.drop(subset=list(by)), dict(aggregations or {})
    out = known.groupBy(*by).agg(*[aggregate(how, F.col(c)).alias(c) for c, how in wanted.items() if how != "median"], F.count(F.lit(1)).alias("group_size"))
    for c in [c for c, how in wanted.items() if how == "median"]:
        out = out.join(statistics.group_quantiles(known, by, c).withColumn(c, F.col("quantiles")[0]).drop("quantiles"), list(by))
    return out.select(*by, *wanted, "group_size")


def dimension_hierarchy(table: DataFrame, by: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Rows of every level of the hierarchy (level 1 is the first dimension alone) with their counts."""
    if len(by) < 2:
        raise ValueError("a hierarchy needs two dimensions or more")
    rows = table if keep_null else table.na.drop(subset=list(by))
    levels = rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*by).alias("_g"))
    level = F.lit(len(by)) - F.bit_count("_g")
    return levels.withColumn("level", level.cast("int")).filter("level > 0").select(*by, "level", "n")


def hierarchy_json(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each value of the first dimension: the counts below it as nested JSON."""
    out = table.na.drop(subset=list(by)).groupBy(*by).agg(F.count(F.lit(1)).cast("string").alias("_j"))
    for depth in range(len(by) - 1, 0, -1):
        name = F.to_json(F.array(F.col(by[depth]).cast("string")))  # ["..."], without its brackets a JSON text
        key = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.col("_j"))
        out = out.groupBy(*by[:depth]).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(key)), ","), F.lit("}")).alias("_j"))
    return out.withColumnRenamed("_j", "tree")


def distribution(table: DataFrame, value: str) -> DataFrame:
    """(value, n, share, imbalance): counts of each value, its part in percent, and whether that is extreme."""
    counts = table.groupBy(F.col(value).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = 100 * F.col("n") / F.col("total")
    kind = F.when((share < 5) | (share > 95), "severe").when((share < 20) | (share > 80), "moderate").otherwise("none")
    return counts.join(F.broadcast(total)).select("value", "n", share.alias("share"), kind.alias("imbalance"))


def imbalance_ratio(table: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """One row (ratio, warning): the largest class over the smallest."""
    n = table.filter(F.col(value).isNotNull()).groupBy(value).count()
    return n.agg((F.max("count") / F.min("count")).alias("ratio")).withColumn("warning", F.col("ratio") > limit)


def five_numbers(table: DataFrame, value: str) -> DataFrame:
    """min, quartiles, max, mean and sample standard deviation."""
    q = [F.lit(x).cast("double").alias(n) for n, x in zip(("q1", "median", "q3"), statistics.quantiles(table, {value: [0.25, 0.5, 0.75]})[value])]
    out = table.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select("min", *q, "max", "mean", "std")


def histogram(table: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal-width bins, 1 to ``bins``; the greatest value is in the last; empty bins are left out."""
    v = table.select(F.col(value).cast("double").alias("v")).na.drop()
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins))).otherwise(1)
    width = (F.col("hi") - F.col("lo")) / bins
    counted = v.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), "n")


def correlations(table: DataFrame, columns: Sequence[str], least: float | None = None) -> DataFrame:
    """(a, b, correlation): Pearson's coefficient of every pair, over rows where both are known, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return table.sparkSession.createDataFrame([], "a string, b string, correlation double")
    one = table.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.filter(F.abs("correlation") > least) if least is not None else out


def correlation_error(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean absolute difference of the pairwise correlations of two tables; unknown ones are 0."""
    a = correlations(first, columns).withColumnRenamed("correlation", "x")
    b = correlations(second, columns).withColumnRenamed("correlation", "y")
    known = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
    return a.join(b, ["a", "b"]).agg(F.avg(F.abs(known("x") - known("y"))).alias("correlation_error"))


def ks_similarity(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, similarity): one less the greatest distance between the two distribution functions of each column.

    Values are counted first; the running sums then go over distinct values, in ranges: a first sum for each range,
    and inside the ranges windows that no single task has to hold.
    """
    long = lambda df, side: df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v").na.drop().withColumn("side", F.lit(side))
    both = long(first, 0).unionByName(long(second, 1))
    counts = both.groupBy("column", "v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cut = counts.join(F.broadcast(totals), "column").withColumn("range", F.when(F.col("hi") > F.col("lo"), F.floor(255 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(0))
    base = cut.groupBy("column", "range").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("column", "range", F.coalesce(F.sum("ra").over(before), F.lit(0)).alias("ba"), F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("bb"))
    within = Window.partitionBy("column", "range").orderBy("v")
    run = cut.join(F.broadcast(base), ["column", "range"]).withColumn("d", F.abs((F.col("ba") + F.sum("a").over(within)) / F.col("na") - (F.col("bb") + F.sum("b").over(within)) / F.col("nb")))
    return run.groupBy("column").agg((1 - F.max("d")).alias("similarity"))


def confusion(table: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n, share): counts, and their part of the truth's rows."""
    n = table.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def class_scores(table: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each class; divisions by zero are 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sides = table.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    n = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("hit").alias("hits"))
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    return n.select("label", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def roc(table: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tpr, fpr): one row for each distinct score, from the highest."""
    counts = table.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    total = counts.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    run = running(counts, -F.col("score"), cp=F.col("p"), cn=F.col("n")).join(F.broadcast(total))
    return run.select("score", (F.col("cp") / F.col("tp")).alias("tpr"), (F.col("cn") / F.col("tn")).alias("fpr"))


def auc(table: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the curve, by mean ranks of the positives (equal scores share a rank)."""
    counts = table.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("n"))
    upto = running(counts, F.col("score"), upto=F.col("n"))
    return upto.withColumn("wins", F.col("p") * (F.col("upto") - F.col("n") / 2)).agg((F.sum("wins") / (F.sum("p") * F.sum("n"))).alias("auc"))


def complexity_order(table: DataFrame, groups: str | None = None) -> DataFrame:
    """One row (level, log2_order): 0 for one value, log2 n for a vector, n for a table, n*g + log2(2^n - 1) for a graph of g groups."""
    n = F.count(F.lit(1)).cast("double")
    if groups:
        g = F.count_distinct(groups).cast("double")
        return table.agg((n * g + n).alias("log2_order")).select(F.lit(3).alias("level"), "log2_order")
    return table.agg(n.alias("log2_order")).select(F.lit(2).alias("level"), "log2_order")


def reduction(before: Column, after: Column) -> Column:
    """Relative change of complexity, as (after - before) / before."""
    return (after - before) / before


def rollup_runs(runs: DataFrame) -> DataFrame:
    """From (model, gap, accuracy, f1): mean scores of each model; with gaps' mean, extremes, 95 % interval and verdict."""
    width = F.when(F.count("gap") > 1, 1.96 * F.stddev_pop("gap") / F.sqrt(F.count("gap"))).otherwise(0.0)
    out = runs.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"), F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), width.alias("half_width"))
    return out.withColumn("verdict", F.when(F.col("mean_gap") < 0.10, "good").when(F.col("mean_gap") < 0.15, "fair").otherwise("poor"))


def log_totals(log: DataFrame) -> DataFrame:
    """From (step, status, before, after): applied and failed steps, first and last accuracy, improvement."""
    first, last = F.min_by("before", "step"), F.max_by("after", "step")
    return log.agg(F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "failed").alias("failed"), first.alias("initial"), last.alias("final"), (last - first).alias("improvement"))
