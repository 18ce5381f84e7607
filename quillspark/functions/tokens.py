"""Token definitions shared by constraints, metrics and models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The token patterns, valid both as Java and as RE2 patterns.
WORD = r"[\p{L}\p{N}]+"
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE = r"[^.!?]+[.!?]*"

WHITESPACE = " \t\n\r\x0b\x0c"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row.

    An expression that occurs several times, above all in branches of a ``when``,
    may be evaluated each time; a lambda's variable is not.
    """
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def pieces(text: Column) -> Column:
    """Split on single spaces; empty pieces stay."""
    return F.split(text, " ")


def words(text: Column) -> Column:
    """Letters and digits; punctuation is left out."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def words_and_marks(text: Column) -> Column:
    """Words plus every punctuation mark as a token of its own."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip)
    return F.filter(found, lambda s: s != "")


def gram_rows(df: DataFrame, keys: Sequence[str], tokens: Column, orders: Sequence[int],
              count_texts: bool = False) -> DataFrame:
    """One row per n-gram: keys, ``n``, ``gram`` (its tokens joined by spaces; no token holds one).

    The token array is zipped with itself shifted, so every position yields its
    n-grams by plain concatenation in generated code. A lambda over positions
    would evaluate the tokenizer once per position. ``count_texts`` adds one row
    of order 0 per text, from a null in front of its tokens; its ``gram`` is the
    number of tokens.
    """
    span = max(orders)
    front = F.array(F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    listed = df.select(*keys, (F.concat(front, F.coalesce(tokens, none)) if count_texts else tokens).alias("_t"))
    shifted = [F.slice("_t", k + 1, F.size("_t")).alias(f"_w{k}") for k in range(span)]
    size = [(F.size("_t") - 1).cast("string").alias("_size")] if count_texts else []
    placed = listed.select(*keys, *size, F.inline(F.arrays_zip(*shifted)))

    def gram(n: int) -> Column:
        parts: list[Column] = [F.col("_w0")]
        for k in range(1, n):
            parts += [F.lit(" "), F.col(f"_w{k}")]
        return F.concat(*parts)  # null past the end

    rows = [F.struct(F.lit(n).alias("n"), gram(n).alias("gram")) for n in orders]
    if count_texts:
        text_row = F.when(F.col("_w0").isNull(), F.col("_size"))
        rows.append(F.struct(F.lit(0).alias("n"), text_row.alias("gram")))
    rows = F.array(*rows)
    return placed.select(*keys, F.inline(rows)).filter(F.col("gram").isNotNull())
