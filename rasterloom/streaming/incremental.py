"""Picks up new image files as they arrive and carries on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.png", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they arrive: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def run_incremental(spark: SparkSession, folder: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, pattern: str = "*.png") -> StreamingQuery:
    """Runs a batch pipeline over every new file once and appends its rows; what is done is kept in the checkpoint.

    The stream ends when all files there are done.  A batch that is run again after a failure replaces its own part.
    """

    def batch(df: DataFrame, number: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return image_stream(spark, folder, pattern).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
