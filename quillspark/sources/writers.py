"""Sinks. A run's parameters are key columns and partition folders, never parts of a name to parse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def run_key(**params) -> Column:
    """One readable key of a run's parameters, in the order given."""
    parts: list[Column] = []
    for name, value in params.items():
        shown = value if isinstance(value, Column) else F.lit(str(value))
        parts.append(F.concat(F.lit(f"{name}="), shown.cast("string")))
    return F.concat_ws("/", *parts)


def with_run(df: DataFrame, params: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in params.items()})


def write_splits(df: DataFrame, path: str, format: str = "csv", overwrite: bool = False,
                 partition_by: Sequence[str] = ("split",)) -> None:
    """One folder per split; an existing target is an error unless told otherwise."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by)
    if format == "csv":
        # An empty string stays an empty string; null is an unquoted nothing.
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(format).save(path)


def write_predictions(df: DataFrame, path: str, index: str, prediction: str) -> None:
    """``index<TAB>prediction`` rows."""
    (
        df.select(F.col(index).alias("index"), F.col(prediction).alias("prediction"))
        .write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)
    )


def append_finished(df: DataFrame, path: str, keys: Sequence[str], required: Sequence[str]) -> None:
    """Append the finished rows of a run; rows that failed stay pending for the next one."""
    df.dropna(subset=[*keys, *required]).write.mode("append").parquet(path)
