"""Tags of words in their sentence: the cheapest sequence of tags by a lexicon and a table of transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.tokens import sentences, words
from quillspark.operators.joins import fits, split_hot
from quillspark.session import materialize

# Stands before the first word of a sentence.
START = ""
# Cost of a transition that the table does not name.
OTHER_TRANSITION = 8
# Pairs of options that are weighed at once.
STEP_PAIRS = 1 << 20


class _Steps:
    """Costs of one tag behind another, by the numbers of the tags that the table names; other tags share the last."""

    def __init__(self, transitions: Mapping[tuple[str, str], int], other: int):
        self.tags = pa.array(sorted({tag for pair in transitions for tag in pair} | {START}), pa.string())
        place = {tag: k for k, tag in enumerate(self.tags.to_pylist())}
        self.costs = np.full((len(place) + 1, len(place) + 1), other, dtype=np.int64)
        for (before, tag), cost in transitions.items():
            self.costs[place[before], place[tag]] = cost

    def numbers(self, tags: pa.Array) -> np.ndarray:
        found = pc.index_in(tags, value_set=self.tags)
        return pc.fill_null(found, len(self.tags)).to_numpy(zero_copy_only=False).astype(np.intp)

    @property
    def start(self) -> int:
        return self.tags.index(START).as_py()


def _cheapest(lengths: np.ndarray, tags: np.ndarray, costs: np.ndarray, steps: _Steps) -> np.ndarray:
    """For each word the place of its option on the cheapest way through its sentence.

    ``tags`` and ``costs`` have a row per word, sentence after sentence, and a column per option; a column that
    a word lacks costs ``_never``. A Viterbi pass over all sentences together, word by word: for each option of the last word there
    is the cheapest way there. Of equal ways the one whose option before comes first counts, and at the end the first option.
    Costs are whole numbers, so sums are exact.
    """
    width = tags.shape[1]
    bits = width.bit_length()
    first = np.cumsum(lengths) - lengths
    chosen = np.zeros(len(tags), dtype=np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    rows = max(1, STEP_PAIRS // (width * width))
    never = _never(width)
    for at in range(0, len(by_length), rows):
        part = by_length[at:at + rows]
        starts, sizes = first[part], lengths[part]
        # Sentences with a word at each place; they are sorted by length.
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        ways = np.minimum(costs[starts] + steps.costs[steps.start, tags[starts]], never).T
        behind = []
        for place in range(1, sizes[0]):
            here = starts[:active[place]] + place
            moves = steps.costs[tags[here - 1].T[:, None, :], tags[here].T[None, :, :]]
            # The option before stands in the lowest bits: the least number has the least cost and then the first option.
            ranked = ((ways[:, None, :len(here)] + moves) << bits) + np.arange(width)[:, None, None]
            least = ranked.min(axis=0)
            behind.append((least & ((1 << bits) - 1)).astype(np.int16))
            ways = _over(ways, np.minimum((least >> bits) + costs[here].T, never))
        last = ways.argmin(axis=0)
        for place in range(sizes[0] - 1, -1, -1):
            n = active[place]
            chosen[starts[:n] + place] = last[:n]
            if place:
                last[:n] = behind[place - 1][last[:n], np.arange(n)]
    return chosen


def _over(ways: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The ways with the sentences that went on, which come first, in place of what they had."""
    if made.shape[1] == ways.shape[1]:
        return made
    ways[:, :made.shape[1]] = made
    return ways


def _never(width: int) -> int:
    """More than any way costs; with the bits of an option behind it, still a number of 64 bits."""
    return 1 << (61 - width.bit_length())


def _padded(sizes: np.ndarray, tags: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of options, one behind the other, as rows of one width."""
    width = int(sizes.max(initial=1))
    there = np.arange(width) < sizes[:, None]
    rows, prices = np.zeros(there.shape, dtype=np.intp), np.full(there.shape, _never(width), dtype=np.int64)
    rows[there], prices[there] = tags, costs
    return rows, prices


def _listed(lists: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """Lists of the same lengths with other values."""
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _tagged_words(lexicon: list[tuple[str, list[tuple[str, int]]]], unknown: list[tuple[str, int]], steps: _Steps) -> Callable:
    """Lists of lower-cased words to lists of tags, by a lexicon that every task holds."""
    words_known = pa.array([word for word, _ in lexicon], pa.string())
    options = [*(found for _, found in lexicon), unknown]
    sizes = np.array([len(found) for found in options])
    names = pa.array([tag for found in options for tag, _ in found], pa.string())
    ends = np.cumsum(sizes) - sizes
    tags, costs = _padded(sizes, steps.numbers(names), np.array([cost for found in options for _, cost in found], dtype=np.int64))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            coded = lists.flatten().dictionary_encode()
            rows = pc.fill_null(pc.index_in(coded.dictionary, value_set=words_known), len(lexicon))
            row = rows.to_numpy(zero_copy_only=False).astype(np.intp)[coded.indices.to_numpy()]
            chosen = _cheapest(lists.value_lengths().to_numpy().astype(np.int64), tags[row], costs[row], steps)
            yield _listed(lists, names.take(pa.array(ends[row] + chosen)))

    return run


def _tagged_options(steps: _Steps) -> Callable:
    """Lists of words, each the list of its options, to lists of tags."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            options = lists.flatten()
            names, prices = options.flatten().flatten()
            sizes = options.value_lengths().to_numpy().astype(np.int64)
            tags, costs = _padded(sizes, steps.numbers(names), prices.to_numpy().astype(np.int64))
            chosen = _cheapest(lists.value_lengths().to_numpy().astype(np.int64), tags, costs, steps)
            yield _listed(lists, names.take(pa.array(np.cumsum(sizes) - sizes + chosen)))

    return run


def _udf(run: Callable) -> Callable:
    def tagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    # Spark reads the kind of function from the types themselves, which this module's annotations only name.
    tagged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tagged, "array<string>")


def _sentences(df: DataFrame, ids: str, text: str) -> DataFrame:
    """Sentences with a word as lists of words; rows with one id are one text, whose words stand place by place.

    Only rows of repeated ids are shuffled.
    """
    listed = [part.select(ids, F.posexplode(sentences(F.col(text))).alias("sentence", "_text"))
              .select(ids, "sentence", words("_text").alias("tokens")).filter(F.size("tokens") > 0)
              for part in split_hot(df.select(ids, text), ids, 2)]
    single, several = listed
    placed = several.select(ids, "sentence", F.posexplode("tokens").alias("at", "word"))
    merged = placed.groupBy(ids, "sentence").agg(F.sort_array(F.collect_list(F.struct("at", "word")))["word"].alias("tokens"))
    return single.unionByName(merged)


def tag_tokens(df: DataFrame, ids: str, text: str, lexicon: DataFrame, transitions: Mapping[tuple[str, str], int],
               unknown: Sequence[tuple[str, int]], other: int = OTHER_TRANSITION) -> DataFrame:
    """``ids, sentence, tokens, tags``: one row per sentence with words, numbered from 0.

    ``lexicon`` (token, tag, cost) may hold several tags for a lower-cased word; the least cost of a
    repeated one counts. Words it lacks have the tags ``unknown``. ``ids`` is a key. Every task looks words up in
    a lexicon that may be broadcast, and no word is shuffled;
    with a larger one words meet by shuffle, and adaptive execution splits frequent ones. A sentence is tagged
    in one row, in steps that many sentences take together.
    """
    if not unknown:
        raise ValueError("unknown words need a tag")
    least = {tag: min(int(cost) for name, cost in unknown if name == tag) for tag, _ in unknown}
    open_class, steps = sorted(least.items()), _Steps({k: int(v) for k, v in transitions.items()}, int(other))
    tokenized = _sentences(df, ids, text)
    # A word has as many options as there are tags.
    known = lexicon.dropna(subset=["token", "tag", "cost"]).groupBy("token", "tag").agg(F.min("cost").cast("long").alias("cost"))
    options = materialize(known.groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("tag", "cost"))).alias("options")), "lexicon")
    if fits(options):
        held = [(r["token"], [tuple(option) for option in r["options"]]) for r in options.collect()]
        tags = _udf(_tagged_words(held, open_class, steps))(F.transform("tokens", F.lower))
        return tokenized.select(ids, "sentence", "tokens", tags.alias("tags"))
    spelled = tokenized.select(ids, "sentence", F.posexplode("tokens").alias("_at", "_word"))
    found = spelled.withColumn("token", F.lower("_word")).join(options, "token", "left")
    unlisted = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(cost).cast("long").alias("cost")) for tag, cost in open_class])
    item = F.struct(F.col("_at").alias("at"), F.col("_word").alias("word"), F.coalesce("options", unlisted).alias("options"))
    rows = found.groupBy(ids, "sentence").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return rows.select(ids, "sentence", F.col("_items.word").alias("tokens"),
                       _udf(_tagged_options(steps))(F.col("_items.options")).alias("tags"))
