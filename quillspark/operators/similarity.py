"""Greedy-match similarity of two token-vector sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quillspark.operators.ranking import numbered
from quillspark.session import materialize, shuffle_width

_MAXIMA = T.ArrayType(T.DoubleType())
_BEST = T.StructType([T.StructField("pred", _MAXIMA), T.StructField("ref", _MAXIMA)])

# Vectors per block: two blocks meet in one matrix product.
BLOCK = 256


@F.pandas_udf(_BEST)
def _best_matches(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Row and column maxima of the cosine matrix of two blocks of vectors."""

    def unit(vectors) -> np.ndarray:
        stacked = np.stack(list(vectors)).astype(np.float64)
        length = np.linalg.norm(stacked, axis=1, keepdims=True)
        return stacked / np.where(length == 0.0, 1.0, length)  # a zero vector is similar to nothing

    rows, cols = [], []
    for p, r in zip(pred, ref):
        cosine = unit(p) @ unit(r).T
        rows.append(cosine.max(axis=1))
        cols.append(cosine.max(axis=0))
    return pd.DataFrame({"pred": rows, "ref": cols})


def greedy_match(df: DataFrame, pair: str, side: str, position: str, vector: str,
                 block: int = BLOCK) -> DataFrame:
    """Precision, recall and F1 per pair; side 0 is the prediction, side 1 the reference.

    Vectors are cut into blocks by position, and blocks of the two sides meet on
    (pair, block), so that a pair of any length is a grid of small products
    spread over tasks, and only one maximum per vector leaves each product.
    """
    placed = _placed(df, pair, side, position, vector, block)
    blocks = _blocks(placed, pair, side)
    pred = blocks.filter(F.col(side) == 0).select(
        pair, F.col("_block").alias("_p"), F.col("_items").alias("_pred"))
    ref = blocks.filter(F.col(side) == 1).select(
        pair, F.col("_block").alias("_r"), F.col("_items").alias("_ref"))
    # Each prediction block visits every reference block of its pair that holds a vector.
    held = placed.filter(F.col(side) == 1).select(pair, F.col("_block").alias("_r")).distinct()
    grid = (
        pred.join(held, pair)
        .join(ref, [pair, "_r"])
        .withColumn("_m", _best_matches(F.col("_pred.v"), F.col("_ref.v")))
    )
    return _scored(placed, _maxima(grid, pair), pair)


def _placed(df: DataFrame, pair: str, side: str, position: str, vector: str, block: int) -> DataFrame:
    return df.select(
        pair, side, (F.col(position) / block).cast("bigint").alias("_block"),
        F.struct(F.col(position).alias("at"), F.col(vector).alias("v")).alias("_item"),
    )


def _blocks(placed: DataFrame, pair: str, side: str) -> DataFrame:
    return placed.groupBy(pair, side, "_block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))


def _maxima(grid: DataFrame, pair: str) -> DataFrame:
    """``pair, side, at, m``: each vector's best cosine in each product."""
    return grid.select(pair, "_p", "_r", F.explode(F.concat(
        F.transform(F.arrays_zip(F.col("_pred.at").alias("at"), F.col("_m.pred").alias("m")),
                    lambda x: F.struct(F.lit(0).alias("side"), x["at"].alias("at"), x["m"].alias("m"))),
        F.transform(F.arrays_zip(F.col("_ref.at").alias("at"), F.col("_m.ref").alias("m")),
                    lambda x: F.struct(F.lit(1).alias("side"), x["at"].alias("at"), x["m"].alias("m"))),
    )).alias("_x")).select(pair, "_p", "_r", "_x.*")


def _scored(placed: DataFrame, matches: DataFrame, pair: str) -> DataFrame:
    best = matches.groupBy(pair, "side", "at").agg(F.max("m").alias("m"))
    scored = best.groupBy(pair).agg(
        F.avg(F.when(F.col("side") == 0, F.col("m"))).alias("precision"),
        F.avg(F.when(F.col("side") == 1, F.col("m"))).alias("recall"),
    )
    # A pair with one side only has no match.
    scored = placed.select(pair).distinct().join(scored, pair, "left").fillna(0.0, ["precision", "recall"])
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both)
    return scored.withColumn("f1", f1)


# Components that name a vector's cell.
CELL = 4


def _near_together(df: DataFrame, pair: str, side: str, position: str, vector: str, block: int) -> DataFrame:
    """As ``_placed``, with blocks of vectors that point in like directions."""
    ranked = F.array_sort(F.transform("_v", lambda x, i: F.struct(
        (-F.abs(x)).cast("double").alias("size"), i.alias("i"), F.signum(x).cast("int").alias("sign"))))
    cell = F.transform(F.slice(ranked, 1, CELL), lambda x: F.struct(x["i"].alias("i"), x["sign"].alias("sign")))
    rows = df.select(F.col(pair).alias("_pair"), F.col(side).alias("_side"), F.col(position).alias("_place"), F.col(vector).alias("_v"))
    rows = numbered(rows.withColumn("_cell", cell), ["_pair", "_side", "_cell", "_place"])
    return rows.select(
        F.col("_pair").alias(pair), F.col("_side").alias(side), F.floor(F.col("rank") / block).alias("_block"),
        F.struct(F.col("_place").alias("at"), F.col("_v").alias("v")).alias("_item"))


_BALL = T.StructType([T.StructField("centre", _MAXIMA), T.StructField("radius", T.DoubleType())])

# Block pairs that one task bounds.
BOUNDED = 1 << 20

# Rounding of cosines near a bound; a block pair is left out only if it is worse by more.
SLACK = 1e-9


@F.pandas_udf(_BALL)
def _balls(blocks: pd.Series) -> pd.DataFrame:
    """A direction and the largest angle between it and a vector of the block; pi if one has no direction."""
    centres, radii = [], []
    for vectors in blocks:
        stacked = np.stack(list(vectors)).astype(np.float64)
        length = np.linalg.norm(stacked, axis=1, keepdims=True)
        unit = stacked / np.where(length == 0.0, 1.0, length)
        mean = unit.mean(axis=0)
        size = np.linalg.norm(mean)
        centre = mean / size if size > 0 else unit[0]
        # A zero vector has cosine 0 with everything, which no angle of its own bounds.
        wide = (length == 0.0).any() or np.linalg.norm(centre) == 0
        centres.append(centre)
        radii.append(np.pi if wide else float(np.arccos(np.clip(unit @ centre, -1.0, 1.0)).max()))
    return pd.DataFrame({"centre": centres, "radius": radii})


def greedy_match_pruned(df: DataFrame, pair: str, side: str, position: str, vector: str,
                        block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """As ``greedy_match``, without the block pairs that cannot hold a best match; also ``pair, visited, blocks``.

    A block is bounded by a ball on the sphere: two vectors of blocks whose centres are a apart
    have a cosine of at most cos(a - r - s), with the balls' radii r and s. First each block meets the block
    of the other side that promises most, which gives each of its vectors a match to beat. Then only those
    block pairs meet whose bound is not below the worst match so far on one of their sides, so results
    are the full grid's. Bounds are worked out on centres alone, by blocks and not by vectors; how many products are saved
    depends on how close together the vectors of a block are, none at worst. So blocks are cut from vectors
    in the order of their cells: the signs and places of the largest components.
    """
    placed = _near_together(df, pair, side, position, vector, block)
    blocks = materialize(_blocks(placed, pair, side), "match-blocks")
    balls = materialize(blocks.select(pair, side, "_block", _balls(F.col("_items.v")).alias("_ball")).select(
        pair, side, "_block", "_ball.*"), "match-balls")
    mine = balls.filter(F.col(side) == 0).select(pair, F.col("_block").alias("_p"), F.col("centre").alias("_pc"), F.col("radius").alias("_pr"))
    other = balls.filter(F.col(side) == 1).select(pair, F.col("_block").alias("_r"), F.col("centre").alias("_rc"), F.col("radius").alias("_rr"))
    cosine = F.aggregate(F.zip_with("_pc", "_rc", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    apart = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) - F.col("_pr") - F.col("_rr")
    # A pair's blocks meet in parts: few bytes make many block pairs, so the number of tasks follows the block pairs.
    met = F.count_if(F.col(side) == 0) * F.count_if(F.col(side) == 1)
    total = balls.groupBy(pair).agg(met.alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // BOUNDED))
    mine = mine.withColumn("_part", F.pmod(F.xxhash64("_p"), F.lit(parts))).repartition(
        max(shuffle_width(df.sparkSession), parts), pair, "_part")
    other = other.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    bounded = materialize(mine.join(other, [pair, "_part"]).select(
        pair, "_p", "_r", F.cos(F.greatest(apart, F.lit(0.0))).alias("bound")), "match-bounds")

    pred = blocks.filter(F.col(side) == 0).select(pair, F.col("_block").alias("_p"), F.col("_items").alias("_pred"))
    ref = blocks.filter(F.col(side) == 1).select(pair, F.col("_block").alias("_r"), F.col("_items").alias("_ref"))

    def products(chosen: DataFrame) -> DataFrame:
        grid = pred.join(chosen, [pair, "_p"]).join(ref, [pair, "_r"])
        return _maxima(grid.withColumn("_m", _best_matches(F.col("_pred.v"), F.col("_ref.v"))), pair)

    by_pred = bounded.groupBy(pair, "_p").agg(F.max_by("_r", F.struct("bound", -F.col("_r"))).alias("_r"))
    by_ref = bounded.groupBy(pair, "_r").agg(F.max_by("_p", F.struct("bound", -F.col("_p"))).alias("_p"))
    first = materialize(by_pred.select(pair, "_p", "_r").union(by_ref.select(pair, "_p", "_r")).distinct(), "match-first")
    met = materialize(products(first), "match-maxima")
    # The worst of a block's vectors so far, of those a product has given a match; each block has met one other.
    own = F.when(F.col("side") == 0, F.col("_p")).otherwise(F.col("_r"))
    sofar = met.groupBy(pair, "side", "at", own.alias("_block")).agg(F.max("m").alias("m"))
    worst = materialize(sofar.groupBy(pair, "side", "_block").agg(F.min("m").alias("worst")), "match-worst")
    of_pred = worst.filter("side = 0").select(pair, F.col("_block").alias("_p"), F.col("worst").alias("_pw"))
    of_ref = worst.filter("side = 1").select(pair, F.col("_block").alias("_r"), F.col("worst").alias("_rw"))
    open_pairs = bounded.join(of_pred, [pair, "_p"]).join(of_ref, [pair, "_r"]).filter(
        F.col("bound") + SLACK >= F.least("_pw", "_rw"))
    second = materialize(open_pairs.select(pair, "_p", "_r").join(first, [pair, "_p", "_r"], "left_anti"), "match-second")
    matches = met.unionByName(products(second))
    seen = first.unionByName(second).groupBy(pair).agg(F.count("*").alias("visited"))
    visits = bounded.groupBy(pair).agg(F.count("*").alias("blocks")).join(seen, pair).select(pair, "visited", "blocks")
    return _scored(placed, matches, pair), visits
