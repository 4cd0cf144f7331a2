"""An append-only log as a stream: an extension, the batch readers' counterpart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """New files of JSON lines as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_writes(log: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first record of each key; state is dropped once the watermark has passed."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def progress(log: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Records and successes (column ``correct``) by window of time and keys."""
    seen = log.withWatermark(time, late).groupBy(F.window(time, window), *by)
    return seen.agg(F.count("*").alias("n"), F.count_if(F.col("correct")).alias("correct_n"))


def append_to(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows as JSON lines once all that is there has been read; a rerun goes on where it stopped."""
    return log.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
