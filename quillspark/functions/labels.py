"""Label derivation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The six toxicity attributes under their two naming schemes.
CHALLENGE_ATTRIBUTES = {
    "toxicity": "toxic",
    "severe_toxicity": "severe_toxic",
    "obscene": "obscene",
    "threat": "threat",
    "insult": "insult",
    "identity_attack": "identity_hate",
}
BIAS_ATTRIBUTES = {
    "toxicity": "toxicity",
    "severe_toxicity": "severe_toxicity",
    "obscene": "obscene",
    "threat": "threat",
    "insult": "insult",
    "identity_attack": "identity_attack",
}

DEMO_CUT = 6


def binarize(value: Column, threshold: float = 0.0) -> Column:
    return (value > threshold).cast("int")


def label_equals(value: Column, target: str) -> Column:
    return (value == target).cast("int")


def one_vs_rest(value: Column, cls: int | str) -> Column:
    return (value == cls).cast("int")


def invert(value: Column) -> Column:
    return (value == 0).cast("int")


def two_class(df: DataFrame, col: str, negative, positive, out: str = "label") -> DataFrame:
    """Keep two classes and map them to 0 and 1."""
    kept = df.filter(F.col(col).isin(negative, positive))
    return kept.withColumn(out, (F.col(col) == positive).cast("int"))


def margin_label(df: DataFrame, col: str, margin: float = 1.0, out: str = "label") -> DataFrame:
    """Drop the ambiguous middle; the label is the sign of the score."""
    kept = df.filter((F.col(col) <= -margin) | (F.col(col) >= margin))
    return kept.withColumn(out, (F.col(col) >= margin).cast("int"))


def zero_or_high(df: DataFrame, col: str, high: float = 0.5) -> DataFrame:
    """Keep clear negatives (exactly zero) and clear positives."""
    return df.filter((F.col(col) == 0) | (F.col(col) >= high))


def attribute_label(attribute: str, scheme: Mapping[str, str]) -> Column:
    if attribute not in scheme:
        raise ValueError(f"unknown attribute {attribute!r}; known: {sorted(scheme)}")
    return F.col(scheme[attribute])


def drop_sentinel(df: DataFrame, cols: Sequence[str], sentinel: int = -1) -> DataFrame:
    nulled = df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})
    return nulled.dropna(subset=list(cols))


def severity_label(df: DataFrame, col: str, negative: str, positives: Sequence[str],
                   out: str = "label") -> DataFrame:
    """Several severity levels become 1, one level becomes 0, others are dropped."""
    kept = df.filter(F.col(col).isin(negative, *positives))
    return kept.withColumn(out, F.col(col).isin(*positives).cast("int"))


def demo_target(score: Column, cut: int = DEMO_CUT) -> Column:
    return F.when(score > cut, F.lit("True")).otherwise(F.lit("False"))


def verdict_label(verdict: Column) -> Column:
    return verdict.cast("int")
