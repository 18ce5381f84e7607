"""Registered queries: a Spark job and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import configure

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(oracle: Optional[str] = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a function under its own name."""

    def add(fn: QueryFunction) -> QueryFunction:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle.strip()
        return fn

    return add
