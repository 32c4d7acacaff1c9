"""Data quality: profiles and scores from one pass over all columns, suggestions, fixes, models, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from terrace.functions import numeric

from . import linear, statistics, windows
from .extract import numeric_columns

#: Weights of the usability score.
WEIGHTS = {"prediction": 0.4, "completeness": 0.3, "diversity": 0.2, "size": 0.1}


def profile(table: DataFrame, exclude: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(column, type, n, missing, missing_ratio, unique, skew, transform) of every column.

    Distinct values are counted column by column, each from its own narrow scan, or without ``exact`` estimated in the
    same pass as the rest by sketches (to 0.8 %; up to a few dozen values they are counts). No row is copied once a column.

    type: boolean, datetime, numeric (over 10 distinct values), else categorical. skew is the population skewness;
    transform: log beyond 2, sqrt beyond 1 (square for negative skew).
    """
    fields = [f for f in table.schema.fields if f.name not in exclude]
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(fields):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NumericType)
        if not exact:
            aggs.append(statistics.distinct_sketch(c).alias(f"u{i}"))
        aggs += [F.count_if(c.isNull()).alias(f"m{i}"), (F.skewness(c.cast("double")) if number else F.lit(0.0)).alias(f"s{i}")]
        if isinstance(f.dataType, BooleanType):
            kind = F.lit("boolean")
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            kind = F.lit("datetime")
        else:
            kind = F.when(F.col(f"u{i}") > 10, "numeric").otherwise("categorical") if number else F.lit("categorical")
        skew = F.coalesce(F.nanvl(F.col(f"s{i}"), F.lit(0.0)), F.lit(0.0))
        hint = F.when(skew > 2, "log").when(skew > 1, "sqrt").when(skew < -1, "square")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"), kind.alias("type"), F.col("n"), F.col(f"m{i}").alias("missing"), F.when(F.col("n") > 0, F.col(f"m{i}") / F.col("n")).otherwise(0.0).alias("missing_ratio"),
                F.col(f"u{i}").alias("unique"), skew.alias("skew"), F.when(kind == "numeric", hint).alias("transform"),
            )
        )
    one = table.agg(*aggs)
    if exact and fields:
        counts = statistics.distinct_counts(table, {str(i): F.col(f"`{f.name}`") for i, f in enumerate(fields)})
        wide = counts.agg(*[F.max(F.when(F.col("name") == str(i), F.col("n_distinct"))).alias(f"u{i}") for i in range(len(fields))])
        one = one.join(F.broadcast(wide))  # one row and one row
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def completeness(table: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """One row: the share of cells that aren't null, in percent; 0 for no cells."""
    own = [c for c in table.columns if c not in exclude]
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in own), F.lit(0))
    n = F.count(F.lit(1)) * len(own)
    return table.agg(F.when(n > 0, 100 * (1 - missing / n)).otherwise(0.0).alias("completeness"))


def diversity(profiles: DataFrame) -> DataFrame:
    """One row: entropy of the feature types over its greatest value for so many types, in percent; one type is 25, none 0."""
    counts = profiles.groupBy("type").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
    p = F.col("c") / F.col("t")
    entropy = counts.join(F.broadcast(total)).agg(F.sum(-p * F.log2(p)).alias("e"), F.max("k").alias("k"))
    return entropy.select(F.when(F.col("k").isNull(), 0.0).when(F.col("k") == 1, 25.0).otherwise(100 * F.col("e") / F.log2("k")).alias("diversity"))


def size_score(n: Column) -> Column:
    """Under 50 rows in proportion, 100 up to 10,000, then falling by a point for 2,000 rows, to 50."""
    return F.when(n < 50, n / 50 * 50).when(n <= 10_000, F.lit(100.0)).otherwise(100 - F.least(F.lit(50.0), (n - 10_000) / 2000))


def usability(prediction: Column, complete: Column, diverse: Column, size: Column) -> Column:
    return WEIGHTS["prediction"] * prediction + WEIGHTS["completeness"] * complete + WEIGHTS["diversity"] * diverse + WEIGHTS["size"] * size


def scores(table: DataFrame, target: str | None = None, prediction: float = 0.0) -> DataFrame:
    """One row (completeness, diversity, size_score, usability)."""
    exclude = [target] if target else []
    c, d = completeness(table, ()), diversity(profile(table, exclude, exact=False))
    n = table.agg(size_score(F.count(F.lit(1))).alias("size_score"))
    one = c.join(F.broadcast(d)).join(F.broadcast(n))
    return one.withColumn("usability", usability(F.lit(prediction), F.col("completeness"), F.col("diversity"), F.col("size_score")))


def quick_score(table: DataFrame) -> DataFrame:
    """One row: half completeness, 30 % size (under 50 rows 30, to 10,000 rows 100, then falling to 50), 20 % variety of types."""
    kinds = {isinstance(f.dataType, NumericType) for f in table.schema.fields}
    variety = 75.0 if len(kinds) == 2 else 50.0 if kinds else 25.0
    n = F.count(F.lit(1))
    size = F.when(n < 50, 30.0).when(n <= 10_000, 100.0).otherwise(F.greatest(F.lit(50.0), 100 - (n - 10_000) / 1000))
    rows = table.agg(size.alias("size_score"))
    return completeness(table).join(F.broadcast(rows)).select((0.5 * F.col("completeness") + 0.3 * F.col("size_score") + 0.2 * F.lit(variety)).alias("score"))


def warnings(table: DataFrame, target: str) -> DataFrame:
    """(warning): too few rows, too many features, only categorical or only numeric features, very many categories."""
    p = profile(table, [target])
    texts = {f.name for f in table.schema.fields if not isinstance(f.dataType, NumericType)}
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    total = p.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.count_if(is_text).alias("t"))
    said = total.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n") < 50, F.concat(F.lit("few rows: "), F.col("n"))), F.when(F.col("k") > 500, F.concat(F.lit("many features: "), F.col("k"))),
                    F.when((F.col("t") == F.col("k")) & (F.col("k") > 0), F.lit("only categorical features")), F.when((F.col("t") == 0) & (F.col("k") > 0), F.lit("only numeric features")),
                )
            )
        ).alias("warning")
    )
    many = p.filter(is_text & (F.col("unique") > 100)).select(F.concat(F.lit("many categories in "), F.col("column"), F.lit(": "), F.col("unique")).alias("warning"))
    return said.unionByName(many)


def transform_feature(table: DataFrame, column: str, kind: str) -> DataFrame:
    """log, sqrt (both shifted where the column needs it) or square of a column, with the whole column's least value."""
    if kind == "square":
        return table.withColumn(column, F.col(column) * F.col(column))
    how = {"log": numeric.log_shifted, "sqrt": numeric.sqrt_shifted}[kind]
    least = table.agg(F.min(column).cast("double").alias("_least"))
    return table.join(F.broadcast(least)).withColumn(column, how(F.col(column).cast("double"), F.col("_least"))).drop("_least")


def impute(table: DataFrame, column: str, indicator: bool = True) -> DataFrame:
    """Nulls become the median (numbers) or the mode (of equals the least), or 0 / ``missing`` for a column of nulls; a flag says where.

    The fill is found first and is a constant of the plan.
    """
    number = isinstance(table.schema[column].dataType, NumericType)
    c = F.col(f"`{column}`")
    if number:
        fill = statistics.quantiles(table, {column: [0.5]})[column][0]
        filled = F.coalesce(c.cast("double"), F.lit(0.0 if fill is None else fill))
    else:
        most = statistics.top_values(table, [column], 1)[column]
        filled = F.coalesce(c.cast("string"), F.lit(most[0] if most else "missing"))
    out = table.withColumn(f"{column}_missing", c.isNull().cast("int")) if indicator else table
    return out.withColumn(column, filled)


def combine(table: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """A column with the mean of the z-scores (sample deviation) of two."""
    stats = table.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate((a, b)) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [numeric.z_score(F.col(c), F.col(f"_m{i}"), F.col(f"_s{i}")) for i, c in enumerate((a, b))]
    return table.join(F.broadcast(stats)).withColumn(name or f"{a}_{b}_combined", (z[0] + z[1]) / 2).drop("_m0", "_m1", "_s0", "_s1")


def suggest(profiles: DataFrame, correlated: DataFrame, importance: DataFrame, most: int = 10) -> DataFrame:
    """(kind, features, transform, impact, confidence): what to remove, transform, combine or impute, by expected impact.

    importance: (column, importance). The transform is a field of its own, never read from a description.
    """
    p = profiles.join(F.broadcast(importance), "column", "left").fillna(0.0, ["importance"])
    i, s = F.col("importance"), F.col("skew")
    row = lambda kind, features, transform, impact, confidence: F.struct(F.lit(kind).alias("kind"), features.alias("features"), transform.cast("string").alias("transform"), impact.cast("double").alias("impact"), confidence.cast("double").alias("confidence"))
    one, no = F.array("column"), F.lit(None)
    low = F.when(i < 0.05, row("remove", one, no, F.least(F.lit(3.0), (0.05 - i) * 20), 0.7 + (0.05 - i) * 3))
    up = lambda name: F.when(s > 0, name).otherwise("square")
    skewed = F.when((F.col("type") == "numeric") & (F.abs(s) > 2), row("transform", one, up("log"), F.least(F.lit(5.0), F.abs(s) * 0.5) * i * 10, F.lit(0.75))).when(
        (F.col("type") == "numeric") & (F.abs(s) > 1), row("transform", one, up("sqrt"), F.least(F.lit(3.0), F.abs(s) * 0.3) * i * 10, F.lit(0.6))
    )
    gaps = F.when(F.col("missing_ratio") > 0.3, F.when(i < 0.1, row("remove", one, no, F.lit(2.0), F.lit(0.8))).otherwise(row("transform", one, F.lit("impute"), F.lit(4.0), F.lit(0.6))))
    single = p.select(F.explode(F.array_compact(F.array(low, skewed, gaps))).alias("r")).select("r.*")
    imp = lambda side: importance.withColumnsRenamed({"column": side, "importance": f"i{side}"})
    pairs = correlated.filter(F.abs("correlation") > 0.8).join(F.broadcast(imp("a")), "a", "left").join(F.broadcast(imp("b")), "b", "left").fillna(0.0, ["ia", "ib"])
    both = pairs.select(
        F.when(F.abs(F.col("ia") - F.col("ib")) > 0.1, row("remove", F.array(F.when(F.col("ia") > F.col("ib"), F.col("b")).otherwise(F.col("a"))), no, F.lit(2.0), F.lit(0.7)))
        .otherwise(row("combine", F.array("a", "b"), no, F.lit(3.0), F.lit(0.65))).alias("r")
    ).select("r.*")
    return single.unionByName(both).orderBy(F.desc("impact"), "kind", "features").limit(most)


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    """The n rows (feature, importance) of highest importance, of equals the first by name; nulls come last."""
    return importance.orderBy(F.desc_nulls_last("importance"), "feature").limit(n)


def low_features(importance: DataFrame, least: float = 0.05) -> DataFrame:
    """The rows (feature, importance) below ``least``."""
    return importance.filter(F.col("importance") < least)


def apply_suggestion(table: DataFrame, kind: str, features: Sequence[str], transform: str | None) -> DataFrame:
    if kind == "remove":
        return table.drop(*features)
    if kind == "combine":
        return combine(table, *features)
    return impute(table, features[0]) if transform == "impute" else transform_feature(table, features[0], transform)


def improvement(suggestions: DataFrame, score: float) -> DataFrame:
    """One row: the estimated gain, 20 at most."""
    base = F.when(F.col("kind") == "transform", 5).when(F.col("kind") == "combine", 8).otherwise(3)
    return suggestions.agg(F.least(F.coalesce(F.sum(base * (100 - F.lit(score)) / 100), F.lit(0.0)), F.lit(20.0)).alias("gain"))


def prepare(table: DataFrame, target: str, most_features: int = 500, most_values: int = 100) -> tuple[DataFrame, list[str]]:
    """(table, features): rows with a target; numbers imputed, categories binned and coded, the most varied columns.

    The statistics of all columns come from a few jobs, and the result is one projection of the table with these as
    constants: the plan reads the table once, whatever the number of columns. Columns with a leading ``_`` stay.
    """
    rows = table.filter(F.col(f"`{target}`").isNotNull())
    used = [f.name for f in table.schema.fields if f.name != target and not f.name.startswith("_") and isinstance(f.dataType, (NumericType, StringType))]
    fitted = statistics.fit_columns(rows, used, most_values)
    kept = [c for c in table.columns if c in used or c == target or c.startswith("_")]
    rows = rows.select(*[fitted.applied(c) if c in used else F.col(f"`{c}`") for c in kept])
    from .extract import top_variance

    return rows, top_variance(rows, used, most_features)


def is_classification(table: DataFrame, target: str) -> bool:
    """Text, up to 20 distinct values, or under 5 % distinct ones make a target a class."""
    if not isinstance(table.schema[target].dataType, NumericType):
        return True
    r = table.agg(F.count_distinct(target).alias("u"), F.count(F.lit(1)).alias("n")).first()
    return r["u"] <= 20 or r["u"] < 0.05 * r["n"]


def cross_score(table: DataFrame, features: Sequence[str], target: str, k: int = 3, row_id: str = "_rid", trees: int = 20, seed: int = 42) -> float:
    """Mean accuracy (or, for numeric targets, R²) of a random forest over k folds; 0.5 with fewer than 20 rows."""
    n = table.count()
    if n < 20 or not features:
        return 0.5
    classes = is_classification(table, target)
    if classes:
        table = windows.label_encode(table.withColumn("_t", F.col(target).cast("string")), "_t", name="_y")
    else:
        table = table.withColumn("_y", F.col(target).cast("double"))
    data = windows.folds(table, k, row_id, "_y" if classes else None, seed)
    data = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(data).select("_x", F.col("_y").cast("double").alias("_y"), "fold").cache()
    model = RandomForestClassifier if classes else RandomForestRegressor
    out = []
    for i in range(k):
        fitted = model(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=6, seed=seed, maxBins=128).fit(data.filter(F.col("fold") != i))
        test = fitted.transform(data.filter(F.col("fold") == i))
        if classes:
            out.append(test.agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0])
        else:
            r = test.agg(F.sum(F.pow(F.col("_y") - F.col("prediction"), 2)).alias("e"), F.var_pop("_y").alias("v"), F.count(F.lit(1)).alias("n")).first()
            out.append(1 - r["e"] / (r["v"] * r["n"]) if r["v"] else 0.0)
    data.unpersist()
    return sum(x for x in out if x is not None) / k


def ablation_importance(table: DataFrame, features: Sequence[str], target: str, k: int = 3, row_id: str = "_rid", fold: str | None = None) -> dict[str, float]:
    """What the mean score over k folds loses without each feature, at least 0, scaled to sum 1.

    Scores are those of ridge models: R² for numeric targets, accuracy for classes. One pass sums what all features, folds
    and subsets need (and one counts hits, for classes), so no model is fitted for each feature. ``fold`` names a column
    with the folds; without it they are dealt by row id. Under 20 rows all features count alike.
    """
    if not features or table.limit(20).count() < 20:
        return {f: 1 / len(features) for f in features}
    classes = is_classification(table, target)
    if fold is None:
        table = windows.folds(table, k, row_id, target if classes else None)
    _, scores = (linear.class_scores if classes else linear.fold_scores)(table, features, target, fold or "fold")
    return linear.ablation(scores, features)


def permuted(table: DataFrame, column: str, row_id: str = "_rid", seed: int = 1, parts: int | None = None) -> DataFrame:
    """table with the values of a column moved between rows: two orders of the rows, joined place by place inside parts.

    Parts have some 50,000 rows each, unless their number is given.
    """
    parts = parts or max(table.count() // 50_000, 1)
    part = F.pmod(F.xxhash64(F.col(row_id), F.lit(-seed)), F.lit(parts))
    place = lambda salt: F.row_number().over(Window.partitionBy("_p").orderBy(F.xxhash64(F.col(row_id), F.lit(salt)), row_id))
    rows = table.withColumn("_p", part)
    left = rows.withColumn("_n", place(seed)).drop(column)
    right = rows.withColumn("_n", place(seed + 1)).select("_p", "_n", column)
    return left.join(right, ["_p", "_n"]).drop("_p", "_n").select(*table.columns)


def permutation_importance(model, table: DataFrame, features: Sequence[str], label: str, row_id: str = "_rid", rounds: int = 5) -> dict[str, float]:
    """How much accuracy a fitted model loses when a column is shuffled, mean of some rounds, scaled to a greatest value of 1."""
    score = lambda df: model.transform(df).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    base = score(table)
    lost = {f: max(0.0, sum(base - score(permuted(table, f, row_id, 100 * r + 1)) for r in range(rounds)) / rounds) for f in features}
    top = max(lost.values(), default=0.0)
    return {f: v / top if top else 0.0 for f, v in lost.items()}


def apply_all(table: DataFrame, suggestions: DataFrame, target: str, row_id: str = "_rid", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Suggestions in order of confidence (all, or the first ``most``), each kept with the score before and after; gives the table and the log.

    Suggestions are few: a fixed number for each column or pair of columns.
    """
    log, spark = [], table.sparkSession
    now = cross_score(*prepare(table, target), target, row_id=row_id)
    ordered = suggestions.orderBy(F.desc("confidence"), "kind", "features")
    for i, s in enumerate((ordered if most is None else ordered.limit(most)).collect()):
        if not set(s["features"]) <= set(table.columns):
            log.append((i, s["kind"], ",".join(s["features"]), "failed", now, now))
            continue
        table = apply_suggestion(table, s["kind"], s["features"], s["transform"])
        after = cross_score(*prepare(table, target), target, row_id=row_id)
        log.append((i, s["kind"], ",".join(s["features"]), "applied", now, after))
        now = after
    return table, spark.createDataFrame(log, "step int, kind string, features string, status string, before double, after double")


def standardised(table: DataFrame, columns: Sequence[str], row_id: str = "_rid") -> DataFrame:
    """(row_id, vector): medians for nulls, population z-scores; columns without spread are 0."""
    stats = table.agg(*[f(F.col(c).cast("double")).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    middle = statistics.quantiles(table, {c: [0.5] for c in columns})
    z = []
    for i, c in enumerate(columns):
        v = F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0] or 0.0))
        z.append(F.when(F.col(f"_s{i}") > 0, (v - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0))
    return table.join(F.broadcast(stats)).select(row_id, F.array(*z).alias("vector"))


def lof(points: DataFrame, row_id: str = "_rid", k: int = 20, bands: int | None = None, width: float = 1.0, dims: int | None = None) -> DataFrame:
    """(row_id, score): local outlier factor; higher is more anomalous."""
    near = windows.kept(windows.nearest(points, row_id, "vector", k, bands, width, dims).withColumnRenamed(row_id, "i"))
    reach = near.groupBy("i").agg(F.max("distance").alias("kd"))
    r = near.join(reach.withColumnsRenamed({"i": "neighbour", "kd": "nkd"}), "neighbour").withColumn("rd", F.greatest("distance", "nkd"))
    density = r.groupBy("i").agg((1 / (F.avg("rd") + 1e-10)).alias("lrd"))
    out = near.join(density.withColumnsRenamed({"i": "neighbour", "lrd": "nl"}), "neighbour").groupBy("i").agg(F.avg("nl").alias("nl"))
    return out.join(density, "i").select(F.col("i").alias(row_id), (F.col("nl") / F.col("lrd")).alias("score"))


def z_reasons(table: DataFrame, columns: Sequence[str], row_id: str = "_rid", top: int = 3) -> DataFrame:
    """(row_id, contributors): the columns of greatest population z-score, with a reason in words."""
    stats = table.agg(*[f(F.col(c).cast("double")).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    items = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        z = F.abs((v - F.col(f"_m{i}")) / F.col(f"_s{i}"))
        kind = F.when((z > 3) & (v > F.col(f"_m{i}")), "Unusually high value").when(z > 3, "Unusually low value").when(z > 2, "Outlier value").otherwise("Notable deviation")
        items.append(F.when(v.isNotNull() & (F.col(f"_s{i}") > 0), F.struct((-z).alias("order"), F.lit(c).alias("feature"), z.alias("contribution"), F.format_string("%s (%.2f, z=%.1f)", kind, v, z).alias("reason"))))
    found = F.slice(F.array_sort(F.array_compact(F.array(*items))), 1, top)
    return table.join(F.broadcast(stats)).select(row_id, F.transform(found, lambda x: x.dropFields("order")).alias("contributors"))


def anomalies(table: DataFrame, columns: Sequence[str] | None = None, row_id: str = "_rid", top_percent: float = 5.0, most: int = 100, k: int = 20, **search) -> DataFrame:
    """(row_id, score, percentile, contributors) of the rows of highest local outlier factor: percentiles count from the top."""
    columns = list(columns or [c for c in numeric_columns(table) if c != row_id])
    scored = windows.percentile_of(lof(standardised(table, columns, row_id), row_id, k, **search), "score")
    found = scored.filter(F.col("percentile") >= 100 - top_percent).orderBy(F.desc("score"), row_id).limit(most)
    return found.join(z_reasons(table, columns, row_id), row_id)


def anomaly_summary(found: DataFrame, rows: int) -> DataFrame:
    """One row (total, percent, severe, moderate, mild) of flagged rows: severe in the top 0.5 %, moderate in the top 1 %."""
    from_top = 100 - F.col("percentile")
    return found.agg(
        F.count(F.lit(1)).alias("total"), (100 * F.count(F.lit(1)) / F.lit(max(rows, 1))).alias("percent"),
        F.count_if(from_top < 0.5).alias("severe"), F.count_if((from_top >= 0.5) & (from_top < 1)).alias("moderate"), F.count_if(from_top >= 1).alias("mild"),
    )


def top_contributors(found: DataFrame, most: int = 5) -> DataFrame:
    """(feature, n): the features that contribute most often to flagged rows."""
    each = found.select(F.explode("contributors").alias("c")).groupBy(F.col("c.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return each.orderBy(F.desc("n"), "feature").limit(most)


def assess(table: DataFrame, target: str, row_id: str = "_rid") -> DataFrame:
    """One row: sub-scores, usability with the cross-validated score, light and export flag, and the profile as an array."""
    from terrace.functions.categories import traffic_light

    rows, features = prepare(table, target)
    prediction = 100 * max(0.0, cross_score(rows, features, target, row_id=row_id))
    own = table.drop(row_id)
    p = profile(own, [target]).agg(F.collect_list(F.struct("column", "type", "missing_ratio", "unique", "skew", "transform")).alias("profile"))
    s = scores(own, target, prediction).withColumn("prediction", F.lit(prediction))
    return s.join(F.broadcast(p)).withColumn("light", traffic_light(F.col("usability")))


def filter_tables(tables: dict[str, DataFrame], least: float = 60.0) -> DataFrame:
    """(name, score) of the tables that score ``least`` or more."""
    out = None
    for name, df in tables.items():
        one = quick_score(df).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("score") >= least).select("name", "score")

