"""Continuous intake of import files: a file stream whose micro-batches run the batch import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, columns: list[str], files_per_batch: int = 100) -> DataFrame:
    """Text columns of all files that arrive in a folder, with their source_file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    stream = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(path)
    return stream.withColumn("source_file", F.col("_metadata.file_name"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch goes to ``handle`` with its number. A number may come again after a failure; the handler must
    write by number, as it is by that number that a repeated batch is recognised."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per key and time window; rows later than the watermark are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """The first event of each key within the watermark; the state of older keys is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
