"""Row filters that also report what they dropped, and set operations."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F


def standardize(df: DataFrame, mapping: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Rename columns to text/label/prompt/target and keep a subset."""
    renamed = df.withColumnsRenamed(mapping)
    return renamed.select(*keep) if keep is not None else renamed


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """Rows without nulls; the observation holds rows before and kept after one action.

    The counts ride along with the job that consumes the result.
    """
    cols = list(subset) if subset else df.columns
    complete = F.lit(True)
    for name in cols:
        complete = complete & F.col(name).isNotNull()
    counts = Observation()
    observed = df.observe(
        counts, F.count(F.lit(1)).alias("before"), F.count_if(complete).alias("kept")
    )
    return observed.dropna(subset=cols), counts


def row_report(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per named stage."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    return union_all(counted)


def partition_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose flag is set, and the others; a null flag is not set."""
    on = F.coalesce(F.col(flag), F.lit(False))
    return df.filter(on), df.filter(~on)


def target_class(df: DataFrame, label: str, cls: int = 1) -> tuple[DataFrame, Observation]:
    """One class, and rows before and kept: counted by the job that consumes the result (see ``warn_if_few``)."""
    counts = Observation()
    chosen = F.col(label) == cls
    observed = df.observe(counts, F.count(F.lit(1)).alias("before"), F.count_if(chosen).alias("kept"))
    return observed.filter(chosen), counts


def warn_if_few(counts: Observation, share: float = 0.2) -> None:
    """Warn when fewer than this share of the rows were kept; call it after the action."""
    found = counts.get
    if found["kept"] < share * found["before"]:
        warnings.warn(f"{found['kept']} of {found['before']} rows kept")


def nonnull(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_prompts(df: DataFrame, col: str = "prompt") -> DataFrame:
    return df.select(col).distinct()


def pending_metric(df: DataFrame, done: DataFrame, keys: Sequence[str], metric: str,
                   overwrite: bool = False) -> DataFrame:
    """Rows that still need a metric, from the long table of computed metrics."""
    if overwrite:
        return df
    have = done.filter(F.col("metric") == metric).select(*keys).distinct()
    return df.join(have, list(keys), "left_anti")
