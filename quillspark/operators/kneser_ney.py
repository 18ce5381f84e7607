"""A trigram language model with interpolated absolute discounts and continuation counts, held in count tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType, DoubleType

from quillspark.operators import gram_blocks as gb
from quillspark.operators.language_model import START, tokens
from quillspark.session import fresh_path, materialize, remove, shuffle_width, shuffles_removed

# Words of a block, which may have up to twice as many.
BLOCK_WORDS = 1 << 19
# Words whose grams meet in one bucket, about, and the bytes that a word of a text takes.
BUCKET_WORDS, WORD_BYTES = 1 << 20, 6
# Texts of more bytes are scored in several waves, one after the other, and in so many at most.
WAVE_BYTES, WAVES = 32 << 20, 4

# Numbers that the model has of each order's grams; the first is the order's own count.
_WIDTHS = {1: 3, 2: 3, 3: 1}


def trigrams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word: the two before it (start marks in front of the text) and itself; ``u, v, w``.

    A text without words has one row whose ``w`` is null.
    """
    listed = df.select(*keep, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_t"))
    size = F.size("_t")
    second = F.concat(F.array(F.lit(START)), F.slice("_t", 1, F.greatest(size - 1, F.lit(0))))
    first = F.concat(F.array(F.lit(START), F.lit(START)), F.slice("_t", 1, F.greatest(size - 2, F.lit(0))))
    first = F.slice(first, 1, F.greatest(size, F.lit(1)))
    return listed.select(*keep, F.inline(F.arrays_zip(first.alias("u"), second.alias("v"), F.col("_t").alias("w"))))


def _discount(once: int, twice: int) -> float:
    """n1 / (n1 + 2 n2) of the grams that occur once and twice; a half where none occurs once, as nothing would be freed."""
    return once / (once + 2 * twice) if once else 0.5


def _buckets(words: int) -> int:
    return 1 << max(0, -(-words // BUCKET_WORDS) - 1).bit_length()


def _listed(df: DataFrame, text: str, ids: str | None = None) -> DataFrame:
    """``_id, _t``: the words of each text behind two start marks."""
    words = F.concat(F.array(F.lit(START), F.lit(START)), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    return df.select((F.lit(None).cast("bigint") if ids is None else F.col(ids)).alias("_id"), words.alias("_t"))


def _ask_triples(buckets: int) -> Callable[[gb.Block, list[dict]], list[dict]]:
    def ask(block: gb.Block, rows: list[dict]) -> list[dict]:
        triples = gb.Counted(block).triples()
        times = np.bincount(triples.places, minlength=len(triples.heads))
        return gb.cut_rows(triples, [times], buckets, kind=3)

    return ask


def _ends(places: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Where in the block one of each distinct gram ends."""
    found = np.empty(size, dtype=np.int64)
    found[places] = at
    return found


def _ask_pairs(buckets: int) -> Callable[[gb.Block, list[dict]], list[dict]]:
    def ask(block: gb.Block, rows: list[dict]) -> list[dict]:
        here = gb.Counted(block)
        triples, pairs = here.triples(), here.pairs()
        size = len(pairs.heads)
        own = _ends(triples.places, here.at, len(triples.heads))[gb.answer_of(rows, 3, 1)[0] > 0]
        in_front = np.bincount(pairs.places[own], minlength=size)
        times = np.bincount(pairs.places[here.at - 1], minlength=size)
        onward = np.bincount(pairs.places[own - 1], minlength=size)
        return gb.cut_rows(pairs, [in_front, times, onward], buckets, kind=2)

    return ask


def _ask_words(buckets: int) -> Callable[[gb.Block, list[dict]], list[dict]]:
    def ask(block: gb.Block, rows: list[dict]) -> list[dict]:
        here = gb.Counted(block)
        triples, pairs, words = here.triples(), here.pairs(), here.words()
        own_3 = _ends(triples.places, here.at, len(triples.heads))[gb.answer_of(rows, 3, 1)[0] > 0]
        own_2 = _ends(pairs.places[here.pair_at], here.pair_at, len(pairs.heads))[gb.answer_of(rows, 2, 1)[0] > 0]
        counts = [np.bincount(words.places[block.codes[at]], minlength=len(words.heads)) for at in (own_2, own_3 - 1, own_2 - 1)]
        return gb.cut_rows(words, counts, buckets, kind=1)

    return ask


def _ask_all(buckets: int) -> Callable[[gb.Block, list[dict]], list[dict]]:
    def ask(block: gb.Block, rows: list[dict]) -> list[dict]:
        here = gb.Counted(block)
        return [row for kind, grams in ((1, here.words()), (2, here.pairs()), (3, here.triples()))
                for row in gb.cut_rows(grams, [], buckets, kind=kind)]

    return ask


def _shared(count: np.ndarray, kinds: np.ndarray, total: np.ndarray, discount: float, below: np.ndarray) -> np.ndarray:
    """The discounted share of a count, and the freed share times the order below; a context never seen leaves all to it."""
    room = np.maximum(total, 1)
    return np.where(total > 0, np.maximum(count - discount, 0.0) / room + discount * kinds / room * below, below)


def _scores(discounts: tuple[float, float, float], n_words: int, n_pairs: int) -> Callable[[pa.Table], pa.Table]:
    """For a block and the counts of its grams: the sum of log probabilities and the words of each piece of a text."""
    d3, d2, d1 = discounts

    def run(group: pa.Table) -> pa.Table:
        home = group.filter(pc.equal(group["kind"], 0))
        block = gb.block_of(home.select(gb.SCHEMA.names).to_pylist()[0])
        here, rows = gb.Counted(block), group.filter(pc.greater(group["kind"], 0)).select(gb.SCHEMA.names).to_pylist()
        at = here.at
        of_words, of_pairs, of_triples = (gb.answer_of(rows, kind, width).astype(np.float64) for kind, width in _WIDTHS.items())
        words, pairs = here.words().places[block.codes], here.pairs().places
        equal = 1.0 / (n_words + 1)
        lowest = _shared(of_words[0][words[at]], n_words, np.float64(n_pairs), d1, equal)
        middle = _shared(of_pairs[0][pairs[at]], of_words[2][words[at - 1]], of_words[1][words[at - 1]], d2, lowest)
        top = _shared(of_triples[0][here.triples().places], of_pairs[2][pairs[at - 1]], of_pairs[1][pairs[at - 1]], d3, middle)
        sums = np.bincount(here.piece, np.log(top), len(block.lengths))
        return pa.table({"_id": home["ids"].combine_chunks().flatten(), "_sum": pa.array(sums, pa.float64()),
                         "_all": pa.array(block.lengths - 2, pa.int64())})

    return run


@dataclass(frozen=True)
class KneserNey:
    """Order 3: seen trigrams are discounted, and what is taken from them goes to the order below.

    The lower orders count in how many different contexts a word occurs, not how often: a
    bigram's count is the number of words seen in front of it, a word's that of words in front of it.
    Each order's discount comes from how many of its grams occur once and twice. The lowest order is
    interpolated with equal shares for all trained words and one unknown word.

    Counts are held by fingerprints of 80 bits in sorted blocks, see ``gram_blocks``: of 2.5 billion grams of an order two are taken
    for one with a chance of 3 in a million.
    """

    triples: DataFrame  # (u, v, w): how often it occurs
    pairs: DataFrame  # (v, w): words in front of it; how often it is a context; different words after it
    words: DataFrame  # w: words in front of it; as a context the sum of its pairs' counts, and different words after it
    discounts: tuple[float, float, float]
    n_words: int
    n_pairs: int
    total: int
    buckets: int

    @staticmethod
    def fit(df: DataFrame, text: str) -> KneserNey:
        """Blocks of the texts send their trigrams, then pairs, then words to be counted.

        Each order's buckets tell a block which grams it owns; so it can add up what it owns for the order below.
        """
        spark = df.sparkSession
        slots, path = shuffle_width(spark), fresh_path(spark, "kn-blocks")
        coded = _listed(df, text).mapInArrow(gb.write_blocks(BLOCK_WORDS, slots, 1, lambda block, rows: [], False), gb.ROWS)
        with shuffles_removed(spark):
            coded.write.parquet(path)
            blocks = spark.read.schema(coded.schema).parquet(path)
            total = blocks.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
            buckets = _buckets(total)
            asked = blocks.mapInArrow(gb.ask_each(_ask_triples(buckets)), gb.ROWS)
            found = [materialize(gb.by_bucket(asked, buckets, gb.merged(True)), "kn-triples")]
            for name, ask, owned in (("kn-pairs", _ask_pairs, True), ("kn-words", _ask_words, False)):
                answers = [table.filter(F.col("block") != gb.MODEL) for table in found]
                asked = gb.by_block(reduce(DataFrame.unionByName, answers, blocks), slots, gb.each_block(ask(buckets)))
                found.append(materialize(gb.by_bucket(asked, buckets, gb.merged(owned)), name))
        remove(spark, path)
        models = [table.filter(F.col("block") == gb.MODEL) for table in found]
        facts = [model.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("once", "twice", "kinds", "total")]).first() for model in models]
        discounts = tuple(_discount(fact[0], fact[1]) for fact in facts)
        return KneserNey(*models, discounts, facts[2][2], facts[2][3], total, buckets)

    def _pieces(self, df: DataFrame, ids: str, text: str, buckets: int) -> DataFrame:
        """``_id, _sum, _all`` of pieces of texts; blocks ask all their grams at once and wait where the answers go."""
        slots, kind = shuffle_width(df.sparkSession), df.schema[ids].dataType
        travelling = gb.rows_type(kind)
        asked = _listed(df, text, ids).mapInArrow(gb.write_blocks(BLOCK_WORDS, slots, buckets, _ask_all(buckets), True), travelling)
        model = reduce(DataFrame.unionByName, (self.triples, self.pairs, self.words))
        if buckets != self.buckets:
            model = model.mapInArrow(gb.recut(buckets, _WIDTHS), gb.ROWS)
        met = gb.by_bucket(asked.unionByName(model, allowMissingColumns=True), buckets, gb.answered(_WIDTHS), travelling)
        scored = StructType([StructField("_id", kind), StructField("_sum", DoubleType()), StructField("_all", LongType())])
        return gb.by_block(met, slots, _scores(self.discounts, self.n_words, self.n_pairs), scored)

    def fluency(self, df: DataFrame, ids: str, text: str) -> DataFrame:
        """Mean log probability per row; null for a row without words.

        Large tables are scored in waves of texts, dealt by a hash of ``ids``. Of a wave only sums per text are written, and
        its shuffles are removed before the next, so they never fill more than a wave's share of the disk. The table is read once for its size and
        once a wave.
        """
        spark = df.sparkSession
        size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
        waves = max(1, min(WAVES, -(-size // WAVE_BYTES)))
        buckets = _buckets(max(size // WORD_BYTES // waves, self.total))
        if waves == 1:
            pieces = self._pieces(df, ids, text, buckets)
        else:
            dealt = [df.filter(F.pmod(F.xxhash64(ids), F.lit(waves)) == wave) for wave in range(waves)]
            with shuffles_removed(spark):
                pieces = reduce(DataFrame.unionByName, [
                    materialize(self._pieces(part, ids, text, buckets), "kn-scored") for part in dealt])
        found = pieces.groupBy(F.col("_id").alias(ids)).agg(F.sum("_sum").alias("_sum"), F.sum("_all").alias("_all"))
        return found.select(ids, (F.col("_sum") / F.nullif("_all", F.lit(0))).alias("fluency"))

    def perplexity(self, df: DataFrame, ids: str, text: str) -> DataFrame:
        return self.fluency(df, ids, text).select(ids, F.exp(-F.col("fluency")).alias("perplexity"))
