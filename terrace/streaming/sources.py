"""The stateless operators on a stream: classification, filters and joins with a static side run unchanged."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_parquet(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def to_folder(stream: DataFrame, transforms: Sequence[Callable[[DataFrame], DataFrame]], path: str, checkpoint: str):
    """Applies operators and appends to a Parquet folder until the source has no more; restarts go on from the checkpoint."""
    for step in transforms:
        stream = step(stream)
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
