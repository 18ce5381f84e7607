"""A bigram language model held in count tables: fluency, perplexity, continuation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.tokens import words
from quillspark.operators.joins import answered, hot_and_cold, fits, lookup
from quillspark.session import materialize

START = "<s>"
# Sampling steps between two written tables.
STEPS_PER_WRITE = 5


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def bigrams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per token: the token before it (or the start mark) and itself; ``w`` is null for a text without tokens."""
    listed = df.select(*keep, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_t"))
    before = F.concat(F.array(F.lit(START)), F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))))
    return listed.select(*keep, F.inline(F.arrays_zip(before.alias("v"), F.col("_t").alias("w"))))


class LanguageModel(Protocol):
    """What a text's words are scored by."""

    def fluency(self, df: DataFrame, ids: str, text: str) -> DataFrame:
        """``ids, fluency``: the mean log probability of a row's words; null for a row without words."""


@dataclass(frozen=True)
class BigramModel:
    pairs: DataFrame  # v, w, n: count of w after v
    contexts: DataFrame  # v, n_v: count of v as a left side
    n_words: int  # distinct trained words
    total: int  # trained tokens

    @staticmethod
    def fit(df: DataFrame, text: str) -> BigramModel:
        # Testing the size instead would run the tokenizer a second time, in the pushed filter.
        seen = bigrams(df, text).filter(F.col("w").isNotNull())
        counted = materialize(seen.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")), "bigrams")
        contexts = materialize(counted.groupBy("v").agg(F.sum("n").alias("n_v")), "contexts")
        facts = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("w")).first()
        return BigramModel(counted, contexts, facts[1], facts[0])

    def fluency(self, df: DataFrame, ids: str, text: str) -> DataFrame:
        """Mean log probability per row, with add-one smoothing; null for a row without words.

        The logarithm of a smoothed share is a sum: log(n + 1) of the pair, nothing for one never seen, less
        the log of its context's room, that of an empty one for a context never seen. So pairs and
        contexts are keys of one table of terms, unseen ones are no question, and a row's terms need not meet before their sum.
        """
        empty = math.log(self.n_words + 1)
        terms = self.pairs.select(F.concat_ws(" ", "v", "w").alias("key"), F.log1p("n").alias("term"), "n").unionByName(
            self.contexts.select(F.col("v").alias("key"), (empty - F.log(F.col("n_v") + F.lit(self.n_words + 1))).alias("term"),
                                 F.col("n_v").alias("n")))
        placed = bigrams(df, text, ids)
        # A row of a text without words has a start mark alone: no pair, and a context that doesn't count.
        pair = F.when(F.col("w").isNotNull(), F.concat("v", F.lit(" "), "w"))
        context = F.when(F.col("w").isNotNull(), F.col("v"))
        asked = placed.select(ids, F.inline(F.array(
            F.struct(pair.alias("key"), F.col("w").isNotNull().cast("int").alias("word")), F.struct(context.alias("key"), F.lit(0).alias("word")))))
        found = answered(asked, terms, "key", "n", 2 * self.total, [ids]).groupBy(ids).agg(
            F.coalesce(F.sum("term"), F.lit(0.0)).alias("_sum"), F.sum("word").alias("_all"))
        return found.select(ids, (F.col("_sum") / F.nullif("_all", F.lit(0)) - F.lit(empty)).alias("fluency"))

    def perplexity(self, df: DataFrame, ids: str, text: str) -> DataFrame:
        scored = self.fluency(df, ids, text)
        return scored.select(ids, F.exp(-F.col("fluency")).alias("perplexity"))

    def continuations(self, steps: int) -> DataFrame:
        """The greedy continuation of every known word: ``v, n_v, gen``.

        A greedy continuation depends on the last word only, so it is worked out
        once per word of the vocabulary and not once per prompt.
        """
        best = self.pairs.groupBy("v").agg(F.min_by("w", F.struct(-F.col("n"), F.col("w"))).alias("w"))
        best = materialize(best, "successors")
        chain = best.select("v", F.col("w").alias("gen"), F.col("w").alias("last"))
        # Many words share a successor; its weight is how often it occurs.
        step = materialize(
            best.join(self.contexts, "v").select(F.col("v").alias("last"), "w", F.col("n_v").alias("_n")), "steps")
        for _ in range(steps - 1):
            longer = lookup(chain, step, "last", "_n", self.total)
            chain = longer.select("v", F.concat_ws(" ", "gen", "w").alias("gen"), F.col("w").alias("last"))
        return materialize(chain.join(self.contexts, "v").select("v", "n_v", "gen"), "continuations")

    def continue_greedy(self, df: DataFrame, ids: str, prompt: str, steps: int = 5) -> DataFrame:
        """The most frequent next word, ``steps`` times, ties to the smaller word."""
        last = F.element_at(F.concat(F.array(F.lit(START)), tokens(F.col(prompt))), -1)
        asked = df.select(ids, last.alias("v"))
        found = lookup(asked, self.continuations(steps), "v", "n_v", self.total)
        return found.select(ids, F.coalesce("gen", F.lit("")).alias("gen"))

    def sampler(self) -> DataFrame:
        """Successors laid out for drawing: ``v, block, low, high, w, n_v, width``.

        The draws 0..n_v-1 of a word are divided among its successors in
        proportion to their counts, and into blocks about as many as it has
        successors, so a draw reads its block and finds a few rows there. The
        running sum goes over hash buckets first, so a word that precedes very
        many others is summed in many tasks.
        """
        keyed = self.pairs.select("v", "w", "n").withColumn("_b", F.substring(F.md5("w"), 1, 2))
        inner = Window.partitionBy("v", "_b").orderBy("w")
        buckets = keyed.groupBy("v", "_b").agg(F.sum("n").alias("_s"), F.count(F.lit(1)).alias("_c"))
        outer = Window.partitionBy("v").orderBy("_b")
        of_word = Window.partitionBy("v")
        offsets = buckets.select(
            "v", "_b", (F.sum("_s").over(outer) - F.col("_s")).alias("_offset"),
            F.sum("_s").over(of_word).alias("n_v"), F.sum("_c").over(of_word).alias("_n_w"),
        )
        laid = keyed.withColumn("_run", F.sum("n").over(inner)).join(offsets, ["v", "_b"])
        width = F.greatest(F.expr("n_v div _n_w"), F.lit(1)).cast("bigint")
        laid = laid.select(
            "v", "w", "n_v", width.alias("width"),
            (F.col("_offset") + F.col("_run") - F.col("n")).alias("low"),
            (F.col("_offset") + F.col("_run")).alias("high"),
        )
        blocks = F.sequence(F.expr("low div width"), F.expr("(high - 1) div width"))
        return laid.withColumn("block", F.explode(blocks))

    def continue_sampled(self, df: DataFrame, ids: str, prompt: str, n_gens: int = 3, steps: int = 5,
                         seed: int = 42) -> DataFrame:
        """Candidates drawn from the successor counts; a draw depends on row, candidate, step and seed."""
        laid = materialize(self.sampler(), "sampler")
        facts = materialize(laid.groupBy("v").agg(F.first("n_v").alias("n_v"), F.first("width").alias("width")),
                            "sampler-widths")
        rows = laid.select(F.col("v").alias("_last"), F.col("block").alias("_block"), "low", "high",
                           F.col("w").alias("_next"), (F.col("high") - F.col("low")).alias("_weight"))
        # A word with one or two successors has one or two blocks, and all its draws ask for them: heavy
        # successors are broadcast, within the bytes allowed, and only other draws are shuffled.
        whole = fits(rows)
        hot, cold = (rows, None) if whole else hot_and_cold(rows, "_weight", rows.agg(F.sum("_weight")).first()[0] or 0)
        asked = ((F.col("last") == F.col("_last")) & (F.col("block") == F.col("_block"))
                 & (F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high")))
        last = F.element_at(F.concat(F.array(F.lit(START)), tokens(F.col(prompt))), -1)
        state = df.select(ids, F.explode(F.array(*map(F.lit, range(n_gens)))).alias("cand_idx"),
                          F.lit("").alias("gen"), last.alias("v"))
        for step in range(steps):
            sized = lookup(state, facts, "v", "n_v", self.total)
            draw = F.md5(F.concat_ws(":", F.col(ids).cast("string"), "cand_idx", F.lit(str(step)), F.lit(str(seed))))
            number = F.conv(F.substring(draw, 1, 15), 16, 10).cast("bigint")
            drawn = sized.withColumn("_u", number % F.col("n_v"))
            drawn = drawn.withColumn("block", F.expr("_u div width")).withColumnRenamed("v", "last")
            # A finished candidate finds nothing; its stand-in words keep such rows apart.
            drawn = drawn.withColumn("last", F.when(F.col("n_v").isNotNull(), F.col("last")).otherwise(draw))
            drawn = drawn.withColumn("block", F.coalesce("block", F.lit(-1)))
            joined = drawn.join(F.broadcast(hot), asked, "left")
            if cold is not None:
                found = joined.select(*drawn.columns, F.col("_next").alias("_found")).withColumn(
                    "last", F.when(F.col("_found").isNull(), F.col("last")).otherwise(draw))
                joined = found.join(cold, asked, "left").withColumn("_next", F.coalesce("_found", "_next"))
            state = joined.select(
                ids, "cand_idx", F.concat_ws(" ", F.nullif("gen", F.lit("")), "_next").alias("gen"),
                F.col("_next").alias("v"),
            )
            if (step + 1) % STEPS_PER_WRITE == 0 and step + 1 < steps:
                state = materialize(state, "draws")
        return state.select(ids, "cand_idx", "gen")
