"""Incremental processing of record files: Structured Streaming over folders, and a manifest for batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New line files of a folder as they arrive, each read once (the checkpoint remembers them)."""
    t = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return t.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("file_mtime"), F.col("value").alias("raw")).filter(F.trim("raw") != "")


def process_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run what is there now through ``each`` batch by batch, resuming after the last finished batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_of_key(stream: DataFrame, key: str, time: str, within: str = "7 days") -> DataFrame:
    """Streaming duplicate removal whose state is bounded by a watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def pending(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Batch form: sources not in the manifest of processed paths."""
    return sources.join(manifest.select("source_path").distinct(), "source_path", "left_anti")
