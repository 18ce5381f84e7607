"""Scans. Every reader takes a declared schema; nothing is inferred by a second pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillspark.operators.filters import union_all

PROMPT_STRUCT = "prompt struct<text: string>, continuation struct<text: string>"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
             sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Headered delimited text with quoted newlines.

    A file with quoted newlines is read by one task; pass ``multi_line=False``
    for a corpus of large files without them, which is then split.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", multi_line).option("enforceSchema", False)
        .option("sep", sep).option("quote", '"').option("escape", '"')
        .csv(path)
    )


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str | Sequence[str], name: str = "prompt") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", name)


def read_many(spark: SparkSession, paths: Sequence[str], schemas: Sequence[StructType | str],
              columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Several files or folders with differing columns, a common subset kept."""
    frames = [read_csv(spark, path, schema, sep) for path, schema in zip(paths, schemas)]
    return union_all([frame.select(*columns) for frame in frames])


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small scan over all task slots, for work that costs far more than reading.

    A table of few splits would leave most slots idle while its texts are
    tokenized. A scan with at least as many splits as slots comes back as it is,
    so large tables are never shuffled for this.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
