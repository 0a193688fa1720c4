"""Streaming intake: new files through the batch transforms, deduplicated within a watermark, counted by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """path, content, length, modificationTime of arriving files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def dedupe(stream: DataFrame, at: str = "modificationTime", lateness: str = "1 day") -> DataFrame:
    """One row for each content hash within the watermark; state is dropped behind it."""
    return stream.withColumn("file_hash", F.sha2("content", 256)).withWatermark(at, lateness).dropDuplicatesWithinWatermark(["file_hash"])


def counts(stream: DataFrame, at: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Tumbling counts."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def start(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Runs a batch transform on every micro-batch and appends to Parquet."""

    def write(batch: DataFrame, _: int) -> None:
        transform(batch).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
