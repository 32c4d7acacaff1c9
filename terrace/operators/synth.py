"""Synthetic rows by a Gaussian copula, their validation, and models trained on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from terrace.functions.numeric import normal_cdf, normal_quantile

from . import linear, metrics, quality, statistics, windows
from .joins import small
from .sets import augment


def normal_scores(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as normal scores of their mean ranks."""
    out = table
    for i, c in enumerate(columns):
        out = windows.average_rank(out, c, f"_r{i}")
    return out.select(*[normal_quantile(F.col(f"_r{i}")).alias(c) for i, c in enumerate(columns)])


def positive(correlation: np.ndarray) -> np.ndarray:
    """The matrix with negative eigenvalues lifted and ones on the diagonal."""
    values, vectors = np.linalg.eigh((correlation + correlation.T) / 2)
    fixed = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def correlation_matrix(table: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The d x d matrix, from one pass; only d² numbers come to the driver."""
    d = len(columns)
    out = np.eye(d)
    at = {c: i for i, c in enumerate(columns)}
    for r in metrics.correlations(table, columns).collect():
        v = r["correlation"]
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = 0.0 if v is None or np.isnan(v) else v
    return out


def generate(table: DataFrame, n: int, categorical: Sequence[str] = (), numbers: Sequence[str] | None = None, seed: int = 42, knots: int = 1000) -> DataFrame:
    """n rows with the marginal distributions of the table and its rank correlations.

    Ranks and correlations are computed on the whole table; the driver holds the d x d factor and ``knots`` quantiles
    of each column. Categories are coded by frequency order and come back as text. Rows with a null are left out.
    """
    numbers = list(numbers if numbers is not None else [c for c in quality.numeric_columns(table) if c not in categorical])
    columns, codes = [*numbers, *categorical], {}
    rows = table.select(*columns).na.drop()
    for c in categorical:
        codes[c] = windows.label_codes(rows.select(c), c)
        rows = windows.label_encode(rows, c, codes[c]).drop(c).withColumnRenamed(f"{c}_code", c)
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    lower = np.linalg.cholesky(positive(correlation_matrix(normal_scores(rows, columns), columns)))
    grid = [i / knots for i in range(knots + 1)]
    spark = table.sparkSession
    found = statistics.quantiles(rows, {c: grid for c in numbers})
    quantiles = spark.createDataFrame([tuple(found.values())], ", ".join(f"`{c}` array<double>" for c in found)) if found else spark.range(1).drop("id")
    if categorical:  # codes are as many as there are categories, and one of them is drawn, not a value between two
        quantiles = quantiles.join(F.broadcast(rows.agg(*[F.percentile_approx(c, grid, 100_000).alias(c) for c in categorical])))
    drawn = spark.range(n).select(*[F.randn(seed + i).alias(f"z{i}") for i in range(len(columns))])
    u = [normal_cdf(reduce(lambda a, b: a + b, [F.lit(float(lower[i, j])) * F.col(f"z{j}") for j in range(i + 1)])) for i in range(len(columns))]
    placed = drawn.select(*[x.alias(f"u{i}") for i, x in enumerate(u)]).join(F.broadcast(quantiles))

    def value(i: int, c: str) -> Column:
        at = F.col(f"u{i}") * knots
        low = F.least(F.floor(at), F.lit(knots - 1)).cast("int")
        a, b = F.element_at(F.col(c), low + 1), F.element_at(F.col(c), low + 2)
        return F.element_at(F.col(c), F.round(at).cast("int") + 1) if c in categorical else a + (b - a) * (at - low)

    out = placed.select(*[value(i, c).alias(c) for i, c in enumerate(columns)])
    for c in categorical:
        names = codes[c].withColumnsRenamed({"value": f"_{c}", "code": "_code"})
        out = out.join(small(names), out[c].cast("long") == F.col("_code")).drop("_code", c).withColumnRenamed(f"_{c}", c)
    return out.select(*columns)


def validate(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, similarity, mean_difference, std_difference, correlation_error) of each numeric column."""
    ks = metrics.ks_similarity(real, synthetic, columns)
    stats = lambda df, p: df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v").groupBy("column").agg(F.avg("v").alias(f"{p}m"), F.stddev_samp("v").alias(f"{p}s"))
    both = stats(real, "r").join(stats(synthetic, "s"), "column")
    error = metrics.correlation_error(real, synthetic, columns)
    return ks.join(both, "column").join(F.broadcast(error)).select("column", "similarity", F.abs(F.col("rm") - F.col("sm")).alias("mean_difference"), F.abs(F.col("rs") - F.col("ss")).alias("std_difference"), "correlation_error")


#: Most rows that one row of the plan of draws is exploded into.
DRAWS = 10_000
#: Steps of all classes' distributions of a column up to which they are broadcast, if their bytes are few too.
STEPS = 1_000_000


def class_factors(rows: DataFrame, label: str, numbers: Sequence[str]) -> dict[object, np.ndarray]:
    """{class: lower factor of the correlations of its columns' normal scores}; a class is a few d x d numbers on the driver."""
    scored, d = rows, len(numbers)
    for i, c in enumerate(numbers if d > 1 else ()):  # a single column has no correlations
        counts = rows.groupBy(label, c).agg(F.count(F.lit(1)).alias("_f"))
        summed = windows.kept(windows.running(counts, F.struct(label, c), _upto=F.col("_f")))
        sizes = summed.groupBy(label).agg(F.min(F.col("_upto") - F.col("_f")).alias("_before"), F.sum("_f").alias("_n"))  # one row a class
        rank = F.col("_upto") - F.col("_before") - F.col("_f") + (F.col("_f") + 1) / 2
        ranks = summed.join(small(sizes), label).select(F.col(label).alias("_l"), F.col(c).alias("_v"), normal_quantile(rank / (F.col("_n") + 1)).alias(f"_z{i}"))
        scored = scored.join(small(windows.kept(ranks)), (F.col(label) == F.col("_l")) & (F.col(c) == F.col("_v"))).drop("_l", "_v")
    pairs = [(i, j) for i in range(d) for j in range(i)]
    spread = lambda i, j: F.stddev_pop(f"_z{i}") * F.stddev_pop(f"_z{j}")
    together = lambda i, j: F.when(spread(i, j) > 1e-12, F.covar_pop(f"_z{i}", f"_z{j}") / spread(i, j))  # noqa: E731  (null for a column of one value)
    found = scored.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[together(i, j).alias(f"r{i}_{j}") for i, j in pairs])
    out = {}
    for r in found.collect():  # one row a class
        m = np.eye(d)
        for i, j in pairs:
            v = r[f"r{i}_{j}"]
            m[i, j] = m[j, i] = 0.0 if v is None or np.isnan(v) else round(v, 9)  # the last bits follow the order of the sum
        out[r[label]] = np.linalg.cholesky(positive(m))
    return out


def generate_classes(table: DataFrame, label: str, sizes: Mapping[object, int], numbers: Sequence[str] | None = None, seed: int = 42, knots: int = 1000) -> DataFrame:
    """(label, numbers...): so many new rows of each class, drawn from that class's own distributions and rank correlations.

    All classes are one plan, whatever their number. A draw is a hash of (class, number of the row, column, seed), so a
    lost executor's rows come again as they were. Rows with a null are left out of the fit; a class without others
    gives no rows, and one of a single value gives that value. The driver holds a d x d factor a class.
    """
    numbers = list(numbers if numbers is not None else [c for c in quality.numeric_columns(table) if c != label])
    spark, kind = table.sparkSession, table.schema[label].dataType
    wanted = {k: n for k, n in sizes.items() if n > 0 and k is not None}
    empty = table.select(label, *[F.col(c).cast("double").alias(c) for c in numbers]).limit(0)
    if not wanted:
        return empty
    rows = windows.kept(table.select(label, *[F.col(c).cast("double").alias(c) for c in numbers]).na.drop().filter(F.col(label).isin(list(wanted))))
    factors = class_factors(rows, label, numbers)
    if not factors:
        return empty
    plan = spark.createDataFrame([(k, wanted[k], [float(x) for x in f.ravel()]) for k, f in factors.items()], StructType().add(label, kind).add("_n", "long").add("_l", ArrayType(DoubleType())))
    parts = plan.select(label, "_l", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(DRAWS).cast("long"))).alias("_from"))
    plan = parts.withColumn("_to", F.least(F.col("_from") + DRAWS, F.col("_n")) - 1)
    drawn = plan.repartition(label, "_from").select(label, "_l", F.explode(F.sequence("_from", "_to")).alias("_i"))
    grid = [i / knots for i in range(knots + 1)]
    even = lambda i: (F.pmod(F.xxhash64(F.col(label), "_i", F.lit(i), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    d = len(numbers)
    drawn = drawn.select("*", *[normal_quantile(even(i)).alias(f"_e{i}") for i in range(d)])
    z = [reduce(lambda a, b: a + b, [F.col("_l")[i * d + j] * F.col(f"_e{j}") for j in range(i + 1)]) for i in range(d)]
    out = drawn.select(label, *[(normal_cdf(x) * knots).alias(f"_u{i}") for i, x in enumerate(z)])
    for i, c in enumerate(numbers):
        # a row for each class and step of its distribution, so that no draw carries a whole distribution
        marginal = statistics.group_quantiles(rows, [label], c, grid, "_q")
        steps = marginal.select(F.col(label).alias("_m"), "_q", F.posexplode(F.slice("_q", 1, knots)).alias("_p", "_a")).select("_m", "_p", "_a", F.get("_q", F.col("_p") + 1).alias("_b"))
        at = F.col(f"_u{i}")
        low = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(knots - 1))).cast("int")
        out = out.join(small(windows.kept(steps), STEPS), (F.col(label) == F.col("_m")) & (low == F.col("_p")))
        out = out.withColumn(f"_v{i}", F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.col("_p"))).drop("_m", "_p", "_a", "_b")
    return out.select(label, *[F.col(f"_v{i}").alias(c) for i, c in enumerate(numbers)])


def targeted(table: DataFrame, label: str, of: object, n: int, numbers: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """n new rows of one class, as its own rows are distributed."""
    return generate_classes(table, label, {of: n}, numbers, seed)


def balanced(table: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """table with synthetic rows of the smaller classes, up to the largest; classes under 10 rows stay as they are."""
    counts = table.groupBy(label).count().collect()  # one row a class
    top = max((r["count"] for r in counts), default=0)
    numbers = [c for c in quality.numeric_columns(table) if c != label]
    rows = table.select(label, *[F.col(c).cast("double").alias(c) for c in numbers])
    made = generate_classes(rows, label, {r[label]: top - r["count"] for r in counts if 10 <= r["count"] < top}, numbers, seed)
    return augment(rows, made)


def benchmark(table: DataFrame, label: str, seeds: Sequence[int] = (42, 43, 44), row_id: str = "_rid") -> DataFrame:
    """(model, seed, accuracy, f1, gap): models trained on real and on synthetic rows, both tested on held-out real rows."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    numbers = [c for c in quality.numeric_columns(table) if c not in (label, row_id)]
    coded = windows.label_encode(table.select(row_id, *numbers, F.col(label).cast("string").alias("_t")).na.drop(), "_t", name="_y")
    names = [r["_t"] for r in coded.select("_t").distinct().collect()]  # one row a class
    models = {"logistic": LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50), "forest": RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=20, seed=1)}
    out, assemble = [], VectorAssembler(inputCols=numbers, outputCol="_x")
    for seed in seeds:
        split = windows.folds(coded, 5, row_id, "_y", seed)
        train, test = split.filter("fold <> 0").cache(), assemble.transform(split.filter("fold = 0")).select("_x", F.col("_y").cast("double").alias("_y")).cache()
        made = None
        for name in names:
            own = train.filter(F.col("_t") == name)
            code = own.select("_y").first()
            if code is not None and (size := own.count()) >= 10:
                part = generate(own, size, numbers=numbers, seed=seed).withColumn("_y", F.lit(code[0]))
                made = part if made is None else made.unionByName(part)
        for kind, model in models.items():
            got = {}
            for side, rows in (("real", train), ("synthetic", made)):
                said = model.fit(assemble.transform(rows).select("_x", F.col("_y").cast("double").alias("_y"))).transform(test)
                score = metrics.class_scores(said, "_y", "prediction").agg(F.sum(F.col("support") * F.col("recall")).alias("hit"), F.sum("support").alias("n"), F.sum(F.col("support") * F.col("f1")).alias("f")).first()
                got[side] = (score["hit"] / score["n"], score["f"] / score["n"])
            out.append((kind, seed, float(got["real"][0]), float(got["real"][1]), float(got["real"][0] - got["synthetic"][0])))
        train.unpersist()
        test.unpersist()
    return table.sparkSession.createDataFrame(out, "model string, seed int, accuracy double, f1 double, gap double")


def fold_benchmark(table: DataFrame, label: str, fold: str, numbers: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """(fold, accuracy, f1, synthetic_accuracy, synthetic_f1, gap): linear models trained on the other folds' real rows, and on as many synthetic ones.

    Both are tested on the fold's real rows; gap is real less synthetic accuracy. The synthetic rows of all folds and
    classes come from one plan: a row takes part in the training set of every other fold, and (fold, class) is the
    class that is drawn. Classes of under 10 rows in a training set are not drawn. Rows with a null in any column are left
    out; a table of one fold has nothing to train on and gives no rows, nor does an empty one.
    """
    numbers = list(numbers if numbers is not None else [c for c in quality.numeric_columns(table) if c not in (label, fold)])
    rows = table.select(F.col(f"`{fold}`").cast("int").alias("_fold"), F.col(f"`{label}`").cast("string").alias("_t"), *[F.col(f"`{c}`").cast("double").alias(f"_n{i}") for i, c in enumerate(numbers)]).na.drop()
    columns = [f"_n{i}" for i in range(len(numbers))]
    folds = sorted(r[0] for r in rows.select("_fold").distinct().collect())  # a handful
    schema = "fold int, accuracy double, f1 double, synthetic_accuracy double, synthetic_f1 double, gap double"
    if len(folds) < 2:
        return table.sparkSession.createDataFrame([], schema)
    others = rows.select(F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("_fold"))).alias("_f"), "_t", *columns)
    train = others.select(F.concat_ws("|", "_f", "_t").alias("_k"), *columns)
    sizes = {r["_k"]: r["count"] for r in train.groupBy("_k").count().collect() if r["count"] >= 10}  # one row a fold and class
    drawn = generate_classes(train, "_k", sizes, columns, seed)
    made = drawn.select(F.substring_index("_k", "|", 1).cast("int").alias("_fold"), F.expr("substring(_k, locate('|', _k) + 1)").alias("_t"), *columns)
    found: dict[int, dict[str, tuple[float, float]]] = {}
    for f, side, accuracy, f1 in linear.transfer(rows, made, columns, "_t", "_fold"):
        found.setdefault(f, {})[side] = (accuracy, f1)
    out = [(f, *s["real"], *s.get("synthetic", (None, None)), s["real"][0] - s["synthetic"][0] if "synthetic" in s else None) for f, s in found.items()]
    return table.sparkSession.createDataFrame(out, schema)
