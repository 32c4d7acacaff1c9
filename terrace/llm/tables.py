"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the fixed-size bitmap: 1 MB, whatever the input.
SLOTS = 1 << 23
#: Rows up to which a side is broadcast; the count is taken first, and beyond it Spark joins by shuffle.
SMALL_ROWS = 200_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; a local one only where that is unset."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", top := tempfile.mkdtemp(prefix="terrace-"))
    return f"{top.rstrip('/')}/stage-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: computed once, and lost executors cost nothing of it."""
    path = shared_dir(session(df))
    df.write.option("compression", "zstd").parquet(path)
    return session(df).read.schema(df.schema).parquet(path)


def known_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if a count says that it has few rows; otherwise left to Spark's shuffle joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def on_path(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    import os

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    own = spark.sparkContext.environment
    if top not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [top, own.get("PYTHONPATH", "")]))
    return spark


def aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names (in any case) renamed, and the way back: an operator's own columns don't meet them."""
    back = {f"__own_{i}": c for i, c in enumerate(df.columns) if c.lower() in {n.lower() for n in names}}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def bitmap(keys: DataFrame, slots: Column) -> DataFrame:
    """(bucket, bits) of the slots in use: 256 rows of 4 KB at most, whatever the number of keys."""
    at = keys.select((slots + 1).alias("slot"))  # Spark counts these from 1
    return at.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def bitmap_filter(df: DataFrame, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """The rows of df whose key may be among keys, by a bitmap of bounded size; or with ``inside=False`` all others.

    Null keys are among the others.
    """
    bits = bitmap(keys.select(key).distinct(), slot(F.col(key))).withColumnsRenamed({"bucket": "__bucket", "bits": "__bits"})
    at = slot(F.col(key)) + 1
    place = F.bitmap_bit_position(at)
    byte = F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))
    on = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    joined = df.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("__bucket"), "left")
    return joined.filter(on if inside else ~on).drop("__bucket", "__bits")


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among keys: first by a bitmap of bounded size, so that few rows are shuffled, then exactly."""
    return bitmap_filter(df, keys, key).join(keys.select(key).distinct(), key, "left_semi")
