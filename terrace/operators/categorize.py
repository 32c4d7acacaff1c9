"""From linked items to domains: keywords first, similarity for the rest, as one long table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import categories as C
from terrace.functions import numeric

from .joins import best_match, hashed_ngrams, similar_pairs
from .windows import kept

#: Categories that are held in one row beside every item; more are joined.
MOST_CATEGORIES = 1000


def nearest_category(items: DataFrame, vectors: DataFrame, item_vector: str, threshold: float, default: str | None = None) -> DataFrame:
    """items with category and similarity: the most similar of ``vectors`` (category, vector), if ``threshold`` is reached; else the default."""
    if vectors.limit(MOST_CATEGORIES + 1).count() > MOST_CATEGORIES:
        return _nearest_of_many(items, vectors, item_vector, threshold, default)
    table = vectors.select(F.col("category").alias("_c"), numeric.unit(F.col("vector")).alias("_v"))
    best = table.agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_all"))  # one row of categories
    sims = F.transform("_all", lambda x: F.struct(numeric.dot(F.col("_u"), x["_v"]).alias("s"), x["_c"].alias("c")))
    top = F.aggregate(sims, F.struct(F.lit(-2.0).alias("s"), F.lit(None).cast("string").alias("c")), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    out = items.withColumn("_u", numeric.unit(F.col(item_vector))).join(F.broadcast(best)).withColumn("_t", top)
    found = F.col("_t.s") >= threshold
    return out.withColumns({"category": F.when(found, F.col("_t.c")).otherwise(F.lit(default)), "similarity": F.col("_t.s")}).drop("_u", "_t", "_all")


def _nearest_of_many(items: DataFrame, vectors: DataFrame, item_vector: str, threshold: float, default: str | None) -> DataFrame:
    """As ``nearest_category`` by a similarity join; similarity below the threshold is null."""
    rows = kept(items.withColumn("_i", F.monotonically_increasing_id()))
    pairs = best_match(similar_pairs(rows.select("_i", F.col(item_vector).alias("vector")), vectors, threshold, "_i", "category", best=True), "_i", "category", "similarity")
    return rows.join(pairs, "_i", "left").withColumn("category", F.coalesce("category", F.lit(default))).drop("_i")


def centroids(points: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """(category, vector): the mean vector of each label."""
    mean = points.groupBy(F.col(label).cast("string").alias("category")).agg(*[F.avg(F.col(vector)[i]).alias(f"v{i}") for i in range(dims)])
    return mean.select("category", F.array(*[F.col(f"v{i}") for i in range(dims)]).alias("vector"))


def domain_tables(items: DataFrame, value: str, domains: Sequence[str], threshold: float = 0.4, embed: Callable[[Column], Column] = hashed_ngrams) -> DataFrame:
    """items with domain and score: a keyword hit scores 1, the rest go to the most similar domain; items without one are left out."""
    named = items.withColumn("domain", C.domain(F.col(value), domains))
    by_word = named.filter("domain IS NOT NULL").withColumn("score", F.lit(1.0))
    spark = items.sparkSession
    vectors = spark.createDataFrame([(d,) for d in domains], "category string").withColumn("vector", embed(F.col("category")))
    others = named.filter("domain IS NULL").drop("domain")
    values = kept(others.select(F.col(value).alias("_value")).distinct().withColumn("_e", embed(F.col("_value"))))  # each text is embedded once
    near = kept(nearest_category(values, vectors, "_e", threshold).filter("category IS NOT NULL").select("_value", F.col("category").alias("domain"), F.col("similarity").alias("score")))
    return by_word.unionByName(others.join(near, F.col(value).eqNullSafe(F.col("_value"))).drop("_value"))


def distinct_as_categories(table: DataFrame, column: str, most: int = 20) -> list[str] | None:
    """The distinct values, sorted, if there are no more than ``most``; else None."""
    rows = table.select(F.col(column).cast("string")).na.drop().distinct().limit(most + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= most else None


def suggest_dimensions(vector: DataFrame, value: str = "value") -> DataFrame:
    """(dimension, confidence, share): which dimensions fit, by the share of all values that their rules hit."""
    v = F.col(value).cast("string")
    hits = {"business_object": (C.business_object(v) != "other", "high"), "pattern_type": (C.pattern_type(F.lower(v)).isin("aggregated", "averaged", "ratio"), "medium")}
    one = vector.agg(*[F.avg(h.cast("double")).alias(d) for d, (h, _) in hits.items()])
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("confidence"), F.coalesce(F.col(d), F.lit(0.0)).alias("share")) for d, (_, c) in hits.items()])
    none = F.size(F.filter(rows, lambda r: r["share"] > 0)) == 0
    shown = F.when(none, F.transform(rows, lambda r: F.struct(r["dimension"].alias("dimension"), F.lit("low").alias("confidence"), r["share"].alias("share")))).otherwise(F.filter(rows, lambda r: r["share"] > 0))
    return one.select(F.explode(shown).alias("r")).select("r.*")
