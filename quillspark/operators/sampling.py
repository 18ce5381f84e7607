"""Seeded samples, exact splits, heads and per-group ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.operators.filters import partition_by_flag
from quillspark.operators.ranking import dealt, hash_cuts, parted

# Defaults of the operators.
SEED = 42
SPLIT_RATIOS = (0.7, 0.15, 0.15)
HARD_EASY_RATIO = 10
RERANK_WEIGHT = 0.2
SPLITS = ("train", "validation", "test")


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def seeded_sample(df: DataFrame, ids: str | Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the first ones of the seeded order. Rows that share ``ids`` are ordered by their hash."""
    (cut,) = hash_cuts(df, _names(ids), seed, [n])
    if not cut.parts_equal_rows:
        return df.filter(cut.upto())
    return dealt(df, [cut], "_part").filter(F.col("_part") == 0).drop("_part")


def split_sizes(total: int, ratios: Sequence[float]) -> list[int]:
    whole = sum(ratios)
    return [int(total * r / whole) for r in ratios]


def split_exact(df: DataFrame, ids: str | Sequence[str], ratios: Sequence[float] = SPLIT_RATIOS,
                seed: int = SEED, legacy_bounds: bool = False) -> DataFrame:
    """Add ``split``: exact sizes by ratio over the seeded order.

    Parts are disjoint and cover the table; rows left over by rounding go to
    test. Rows that share ``ids`` are ordered by their hash, and equal rows may go to several parts. ``legacy_bounds`` gives the overlapping parts of an inclusive slice:
    one row more in train, validation starting at that row, and all rows in test.
    """
    keys = _names(ids)

    def bounds(total: int) -> list[int]:
        train, validation, _ = split_sizes(total, ratios)
        if legacy_bounds:
            return [train, train + 1, train + validation + 1]
        return [train, train + validation]

    numbered = dealt(df, hash_cuts(df, keys, seed, bounds), "split")
    if not legacy_bounds:
        return numbered.withColumn("split", F.element_at(F.array(*map(F.lit, SPLITS)), F.col("split") + 1))
    train, validation, test = SPLITS
    parts = [(train, test), (train, validation, test), (validation, test), (test,)]
    listed = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    return numbered.withColumn("split", F.explode(F.element_at(listed, F.col("split") + 1)))


def head(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first n rows of an explicit order of any sortable columns; ties and nulls (first) may occur."""
    return parted(df, _names(order_by), n)[0]


def hard_easy_mix(df: DataFrame, flag: str, order_by: str | Sequence[str],
                  ratio: int = HARD_EASY_RATIO) -> DataFrame:
    """All flagged rows plus the first ``ratio`` times as many unflagged ones; a null flag is not set."""
    hard, easy = partition_by_flag(df, flag)
    return hard.unionByName(parted(easy, _names(order_by), ratio * hard.count())[0])


def carve_validation(df: DataFrame, order_by: str | Sequence[str], keep: int = 2,
                     split: str = "split") -> DataFrame:
    """Move all but the last ``keep`` validation rows into train."""
    inside = F.coalesce(F.col(split) == SPLITS[1], F.lit(False))
    moved, kept = parted(df.filter(inside), _names(order_by), lambda rows: rows - keep)
    return df.filter(~inside).unionByName(moved.withColumn(split, F.lit(SPLITS[0]))).unionByName(kept)


def reranked(df: DataFrame, group: str, base: Column, constraint: Column, tie_break: str,
             weight: float = RERANK_WEIGHT, k: int = 1) -> DataFrame:
    """The k best rows of each group by ``base + weight * constraint``.

    Scores are compared at six digits, then by ``tie_break``. One best row is an
    aggregate with map-side combining; k rows use a per-group limit that Spark
    applies before the shuffle as well, so a hot group ships k rows per task.
    """
    scored = df.withColumn("score", F.round(base + F.lit(weight) * constraint, 6))
    if k == 1:
        best = F.max_by(F.struct(*scored.columns), F.struct(F.col("score"), -F.col(tie_break)))
        return scored.groupBy(group).agg(best.alias("_best")).select("_best.*")
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.col(tie_break))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
