"""Constraints on a text: each gives a Column, higher is better, weight applied by ``score``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import tokens as tk
from quillspark.functions.text import scored_text, strip_ends
from quillspark.operators.joins import fits
from quillspark.operators.language_model import LanguageModel
from quillspark.operators.similarity import greedy_match

# The tags a word count may be restricted to, with their English names.
TAG_NAMES = {
    "ADJ": "adjective",
    "ADP": "adposition",
    "ADV": "adverb",
    "CONJ": "conjunction",
    "DET": "determiner",
    "NOUN": "noun",
    "NUM": "numeral",
    "PRT": "particle",
    "PRON": "pronoun",
    "VERB": "verb",
}


@dataclass(frozen=True)
class Constraint:
    weight: float = 1.0

    def evaluate(self, text: Column) -> Column:
        raise NotImplementedError

    def score(self, text: Column) -> Column:
        return F.lit(float(self.weight)) * self.evaluate(text)


def range_score(count: Column, lower: int, upper: int, zero_to_one: bool = True) -> Column:
    """1 inside the range and ``1/(distance+1)`` outside, or 0 and minus the distance."""
    outside = F.greatest(count - F.lit(upper), F.lit(lower) - count, F.lit(0)).cast("double")
    distance = F.when(count.isNotNull(), outside)  # greatest skips nulls
    return 1.0 / (distance + 1.0) if zero_to_one else -distance


def range_instruction(kind: Column, pos: Column, lower: Column, upper: Column) -> Column:
    """The English instruction of a count range, for a table of specifications."""
    names = F.create_map(*[F.lit(part) for pair in TAG_NAMES.items() for part in pair])
    amount = F.when(lower == upper, F.concat(F.lit("exactly "), lower.cast("string"))).otherwise(
        F.concat(F.lit("from "), lower.cast("string"), F.lit(" to "), upper.cast("string")))
    use = F.when(pos.isNull(), F.lit("words")).otherwise(
        F.concat(F.lit("words used as "), F.try_element_at(names, pos), F.lit("s")))
    unit = F.when(kind == "sentence", F.lit("sentences")).otherwise(use)
    return F.concat(F.lit(". Write "), amount, F.lit(" "), unit)


def range_key(kind: Column, pos: Column, lower: Column, upper: Column) -> Column:
    """The compact key of a count range."""
    # Fixed value: the key's format.
    parts = [F.lit("SR"), kind, F.coalesce(pos, F.lit("None")), lower.cast("string"), upper.cast("string")]
    return F.concat_ws("_", *parts)


@dataclass(frozen=True)
class StructRange(Constraint):
    """The number of words or sentences lies between two bounds.

    ``pos`` counts only words with that tag; ``lexicon`` then maps lower-cased
    words to tags. A small lexicon stays inside the row; see ``tagged_counts``
    for one held in a table.
    """

    kind: str = "word"
    pos: str | None = None
    lower: int = 2
    upper: int = 3
    zero_to_one: bool = True
    lexicon: Mapping[str, str] | None = None

    def __post_init__(self):
        if self.kind not in ("word", "sentence"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.pos is not None and self.pos not in TAG_NAMES:
            raise ValueError(f"unknown tag {self.pos!r}")
        if self.pos is not None and not self.lexicon:
            raise ValueError("a tag needs a lexicon")

    def count(self, text: Column) -> Column:
        if self.kind == "sentence":
            return F.size(tk.sentences(text))
        words = tk.words(text)
        if self.pos is not None:
            tagged = sorted(w for w, tag in self.lexicon.items() if tag == self.pos)
            words = F.filter(words, lambda w: F.lower(w).isin(*tagged))
        return F.size(words)

    def evaluate(self, text: Column) -> Column:
        return tk.bind(
            self.count(text), lambda count: range_score(count, self.lower, self.upper, self.zero_to_one))

    def success(self, text: Column) -> Column:
        return self.count(text).between(self.lower, self.upper).cast("int")

    def instruction(self) -> str:
        if self.lower == self.upper:
            amount = f"exactly {self.lower}"
        else:
            amount = f"from {self.lower} to {self.upper}"
        unit = "sentences" if self.kind == "sentence" else "words"
        if self.kind == "word" and self.pos is not None:
            unit = f"words used as {TAG_NAMES[self.pos]}s"
        return f". Write {amount} {unit}"

    def key(self) -> str:
        # Fixed value: the key's format.
        return f"SR_{self.kind}_{self.pos}_{self.lower}_{self.upper}"


@dataclass(frozen=True)
class StartEnd(Constraint):
    """The text starts and ends with given words: 1 both, 0.5 one, 0 none."""

    start: str | None = None
    end: str | None = None

    def evaluate(self, text: Column) -> Column:
        def met(core: Column) -> Column:
            starts = F.lit(True) if self.start is None else core.startswith(self.start)
            ends = F.lit(True) if self.end is None else core.endswith(self.end)
            return (starts.cast("double") + ends.cast("double")) / 2.0

        return tk.bind(strip_ends(text), met)

    def success(self, text: Column) -> Column:
        return (self.evaluate(text) == 1.0).cast("int")

    def instruction(self) -> str:
        asks = []
        if self.start is not None:
            asks.append(f"Begin with the word '{self.start}'.")
        if self.end is not None:
            asks.append(f"Finish with the word '{self.end}'.")
        return ". " + " ".join(asks)

    def key(self) -> str:
        # Fixed value: the key's format.
        return f"SE_{self.start}_{self.end}"


@dataclass(frozen=True)
class ScoreColumn(Constraint):
    """A value already computed for the row: a class score, fluency, similarity or verdict."""

    column: str = ""

    def evaluate(self, text: Column) -> Column:
        return F.col(self.column).cast("double")


@dataclass(frozen=True)
class Relational(Constraint):
    """A constraint whose value is no expression of the row: it comes as a plan of (key, value) rows.

    A row without a value, or with a null one, counts as ``missing``.
    """

    missing: float = 0.0

    def relation(self, df: DataFrame, key: str, text: Column) -> DataFrame:
        """``key, value``, at most one row per key, of the texts of ``df``."""
        raise NotImplementedError

    def evaluate(self, text: Column) -> Column:
        raise TypeError(f"{type(self).__name__} is scored by Merged.scored")


@dataclass(frozen=True)
class Fluency(Relational):
    """The mean log probability of the text's words under a fitted language model."""

    model: LanguageModel | None = None

    def relation(self, df: DataFrame, key: str, text: Column) -> DataFrame:
        scored = self.model.fluency(df.select(F.col(key), text.alias("_text")), key, "_text")
        return scored.select(key, F.col("fluency").alias("value"))


@dataclass(frozen=True)
class PairMatch(Relational):
    """Greedy-match similarity of a row's two vector sequences, such as candidate and prompt.

    ``vectors`` has the columns key, ``side`` (0 the candidate, 1 the prompt), ``at`` and ``vector``.
    """

    vectors: DataFrame | None = None
    measure: str = "f1"

    def relation(self, df: DataFrame, key: str, text: Column) -> DataFrame:
        asked = self.vectors.join(df.select(key).distinct(), key, "left_semi")
        scored = greedy_match(asked, key, "side", "at", "vector")
        return scored.select(key, F.col(self.measure).alias("value"))


@dataclass(frozen=True)
class Joined(Relational):
    """A value per key that another job has written."""

    table: DataFrame | None = None
    column: str = "value"

    def relation(self, df: DataFrame, key: str, text: Column) -> DataFrame:
        return self.table.select(key, F.col(self.column).cast("double").alias("value"))


@dataclass(frozen=True)
class Merged:
    """The weighted sum of several constraints, over the text alone or prompt and text."""

    constraints: Sequence[Constraint]
    use_prompt: bool = False

    def _text(self, text: Column, prompt: Column | None) -> Column:
        with_prompt = self.use_prompt and prompt is not None
        return scored_text(prompt, text, with_prompt) if with_prompt else text

    def score(self, text: Column, prompt: Column | None = None) -> Column:
        """One expression; ``scored`` also takes relational constraints."""
        scored = self._text(text, prompt)
        total = F.lit(0.0)
        for constraint in self.constraints:
            total = total + constraint.score(scored)
        return total

    def scored(self, df: DataFrame, key: str, text: Column, prompt: Column | None = None, out: str = "score") -> DataFrame:
        """``df`` with the score. ``key`` is unique and not null.

        All relations are gathered by key in one aggregate and joined once, however many there
        are; the other constraints stay expressions of the row.
        """
        whole = self._text(text, prompt)
        asked = [c for c in self.constraints if isinstance(c, Relational)]
        parts = [
            c.relation(df, key, whole).select(F.col(key).alias("_key"), F.lit(i).alias("_c"), F.col("value").cast("double").alias("_v"))
            for i, c in enumerate(asked)
        ]
        total = F.lit(0.0)
        for constraint in self.constraints:
            if not isinstance(constraint, Relational):
                total = total + constraint.score(whole)
        if not parts:
            return df.withColumn(out, total)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        values = rows.groupBy("_key").agg(*[
            F.max(F.when(F.col("_c") == i, F.col("_v"))).alias(f"_v{i}") for i in range(len(asked))])
        for i, constraint in enumerate(asked):
            total = total + F.lit(float(constraint.weight)) * F.coalesce(f"_v{i}", F.lit(float(constraint.missing)))
        joined = df.join(values, F.col(key) == F.col("_key"), "left")
        return joined.withColumn(out, total).drop("_key", *[f"_v{i}" for i in range(len(asked))])


def tagged_counts(df: DataFrame, ids: str, text: str, lexicon: DataFrame, pos: str) -> DataFrame:
    """``ids, n_tagged``: words with a tag per row, from a lexicon table ``(token, tag)``; 0 for a row without any.

    Words are counted per row before the join. A lexicon that fits is broadcast,
    so that a word of every row meets in no task; texts leave the scan as words only.
    """
    tagged = lexicon.filter(F.col("tag") == pos).select("token", F.lit(1).alias("_hit")).distinct()
    counted = (
        df.select(ids, F.explode_outer(F.transform(tk.words(F.col(text)), F.lower)).alias("token"))
        .groupBy(ids, "token").agg(F.count(F.lit(1)).alias("tf"))
        .join(F.broadcast(tagged) if fits(tagged) else tagged, "token", "left")
    )
    return counted.groupBy(ids).agg(F.coalesce(F.sum(F.col("tf") * F.col("_hit")), F.lit(0)).cast("int").alias("n_tagged"))


def class_score(logits: Column, desired: Column | int, selection: str = "softmax") -> Column:
    """One class of a logit array (0-based class): raw value, softmax share, or margin."""
    cls = desired if isinstance(desired, Column) else F.lit(desired)
    value = F.get(logits, cls)
    if selection == "value":
        return value
    top = F.array_max(logits)
    if selection == "softmax":
        # The largest value rides in the accumulator, so it is found once and not per element.
        start = F.struct(top.alias("top"), F.lit(0.0).alias("total"))
        total = F.aggregate(
            logits, start,
            lambda acc, x: F.struct(acc["top"].alias("top"), (acc["total"] + F.exp(x - acc["top"])).alias("total")),
            lambda acc: acc["total"],
        )
        return F.exp(value - top) / total
    if selection == "diff":
        # The first of equal logits counts as the top one.
        wins = F.array_position(logits, top).cast("int") == cls + 1
        return F.when(wins, value - top2(logits)).otherwise(value - top)
    raise ValueError(f"unknown selection {selection!r}")


def top2(logits: Column) -> Column:
    """The second largest value."""
    return F.element_at(F.sort_array(logits, asc=False), 2)


def top2_margin(logits: Column) -> Column:
    return F.array_max(logits) - top2(logits)
