"""Judging that survives interruption.

A run reads candidate files as a stream, a few files per batch, and appends
judged rows. The stream's checkpoint records finished files, so a run that was
stopped carries on where it was; ``availableNow`` ends it when the input is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def run_incrementally(spark: SparkSession, source: str, schema: StructType | str, target: str,
                      checkpoint: str, step: Callable[[DataFrame], DataFrame],
                      files_per_batch: int = 100) -> None:
    """Apply a row-wise step to every candidate file not handled before."""
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    query = (
        step(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
