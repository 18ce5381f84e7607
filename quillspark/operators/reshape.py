"""From candidates to training sets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark.functions.labels import verdict_label
from quillspark.functions.text import first_parts, mask_pad, pad_ids, piece_count, scored_text
from quillspark.functions.tokens import bind, words
from quillspark.operators.filters import target_class
from quillspark.operators.joins import lookup
from quillspark.operators.ranking import numbered
from quillspark.operators.sampling import seeded_sample
from quillspark.session import shuffle_width

# Sequence lengths of the two kinds of training set, and the masked label.
LM_LENGTH = 80
CLASSIFIER_LENGTH = 128
IGNORED_LABEL = -100

PAD, UNKNOWN = 0, 1
FIRST_WORD_ID = 2

# Prefix lengths handled by one task at a time.
PREFIX_CHUNK = 1024

# Sub-groups that a context is dealt to while its first targets are picked.
SALTS = 64


def numbered_columns(df: DataFrame, stem: str) -> list[str]:
    """``stem_0``, ``stem_1``, ... in number order; other names do not count."""
    found = [c for c in df.columns if re.fullmatch(rf"{stem}_\d+", c)]
    return sorted(found, key=lambda c: int(c.rsplit("_", 1)[1]))


def melt_candidates(df: DataFrame, stems: tuple[str, ...] = ("gen",)) -> DataFrame:
    """Wide candidate columns to long rows with ``cand_idx``; one pass, no shuffle."""
    columns = {stem: numbered_columns(df, stem) for stem in stems}
    n = min(len(names) for names in columns.values())
    taken = {name for names in columns.values() for name in names}
    rows = F.array(*[
        F.struct(F.lit(i).alias("cand_idx"), *[F.col(columns[s][i]).alias(s) for s in stems])
        for i in range(n)
    ])
    rest = [c for c in df.columns if c not in taken]
    return df.select(*rest, F.inline(rows))


def widen_candidates(df: DataFrame, ids: list[str], n: int, stem: str = "gen") -> DataFrame:
    """Long rows back to ``stem_0 .. stem_{n-1}``, for the edge of the system."""
    picks = [F.max(F.when(F.col("cand_idx") == i, F.col(stem))).alias(f"{stem}_{i}") for i in range(n)]
    return df.groupBy(*ids).agg(*picks)


def unravel(df: DataFrame, include_prompt: bool = True, cond: bool = False) -> DataFrame:
    """Judged wide candidates to ``(text, label)`` or ``(prompt, gen, label)`` rows.

    Other columns, such as row ids, stay. ``unravel_prefixes`` makes prefixes of them.
    """
    rows = melt_candidates(df, ("gen", "pred")).filter(F.col("pred").isNotNull())
    rows = rows.withColumn("label", verdict_label(F.col("pred"))).drop("pred")
    if cond:
        return rows
    text = scored_text(F.col("prompt"), F.col("gen"), include_prompt)
    return rows.withColumn("text", text).drop("prompt", "gen")


def unravel_prefixes(df: DataFrame, path: str, include_prompt: bool = True, include_full: bool = False) -> PrefixSet:
    """The prefixes of judged candidates, each with its candidate's label, stored under ``path``."""
    return PrefixSet.write(unravel(df, include_prompt), "text", path, include_full)


def capped(df: DataFrame, ids: list[str], max_points: int | None) -> DataFrame:
    """At most ``max_points`` rows, sampled by seed, when a cap is asked for."""
    return df if max_points is None else seeded_sample(df, ids, max_points)


def prefixes(df: DataFrame, text: str, max_words: int | None = None, include_full: bool = False,
             chunk: int = PREFIX_CHUNK) -> DataFrame:
    """Every proper word prefix of the text as a row, with all other columns kept.

    W pieces make W-1 prefixes, so the output grows with the square of the
    length. A text is first cut into runs of prefix lengths, and the runs, not
    the texts, are spread over tasks; a prefix is then one scan of the text.
    """
    longest = piece_count(F.col(text)) - F.lit(0 if include_full else 1)
    if max_words is not None:
        longest = F.least(longest, F.lit(max_words))
    bounded = df.withColumn("_n", longest).filter(F.col("_n") >= 1)
    runs = bounded.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(chunk))))
    spread = runs.repartition(shuffle_width(df.sparkSession))
    lengths = F.sequence(F.col("_from"), F.least(F.col("_from") + (chunk - 1), F.col("_n")))
    rows = spread.withColumn("n_words", F.explode(lengths))
    rows = rows.withColumn("prefix", first_parts(F.col(text), " ", F.col("n_words")))
    return rows.filter(F.col("prefix").rlike(r"\S")).drop("_n", "_from", text)


@dataclass(frozen=True)
class PrefixSet:
    """The word prefixes of texts, held as places in texts that are stored once.

    A text of W pieces has about W prefixes and W * W / 2 pieces in them. Stored are the
    text and the characters up to the end of each prefix, ascending, which delta coding
    packs into little; so the set grows with the texts. A reader cuts prefixes out of
    the text, and only those it wants: ``lengths`` names them without a text, ``read`` takes
    any choice of them.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def write(df: DataFrame, text: str, path: str, include_full: bool = False) -> PrefixSet:
        """Texts without a prefix that holds more than white space are left out; other columns stay."""
        pieces = F.split(text, " ")
        # Characters before each piece's end, running; the last one is the text itself.
        start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("ends"))
        sizes = F.transform(pieces, F.length)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / ENDS_BLOCK).cast("int")),
                             lambda k: F.slice(sizes, k * ENDS_BLOCK + 1, F.lit(ENDS_BLOCK)))
        ends = F.aggregate(blocks, start, lambda sofar, block: _extended(sofar, block), lambda sofar: sofar["ends"])
        listed = ends if include_full else F.slice(ends, 1, F.size(ends) - 1)
        first = F.length(F.regexp_extract(text, r"^\s*", 0))
        kept = df.filter(F.col(text).isNotNull()).withColumn("ends", F.filter(listed, lambda end: end > first))
        kept = kept.withColumnRenamed(text, "text").filter(F.size("ends") > 0)
        keyed = kept.withColumn("text_key", F.monotonically_increasing_id())
        keyed.write.options(**{
            "parquet.writer.version": "v2", "parquet.enable.dictionary#ends.list.element": "false", "compression": "zstd",
        }).parquet(path)
        return PrefixSet(df.sparkSession, path)

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        """Prefixes in the set; reads no text."""
        return self.texts.agg(F.coalesce(F.sum(F.size("ends")), F.lit(0))).first()[0]

    def lengths(self) -> DataFrame:
        """``text_key, end`` of every prefix; reads no text."""
        return self.texts.select("text_key", F.explode("ends").alias("end"))

    def read(self, chosen: DataFrame | None = None) -> DataFrame:
        """Prefixes as rows: the other columns, ``n_words`` and ``prefix``; all of them, or ``chosen`` (text_key, end)."""
        texts = self.texts
        if chosen is not None:
            # The chosen ends of one text are some of its own, so they form a value no larger than the stored one.
            wanted = chosen.select("text_key", "end").distinct().groupBy("text_key").agg(
                F.sort_array(F.collect_list("end")).alias("ends"))
            texts = texts.drop("ends").join(wanted, "text_key")
        width = shuffle_width(self.spark)
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("ends") - 1) / PREFIX_CHUNK).cast("int")),
                           lambda k: F.slice("ends", k * PREFIX_CHUNK + 1, F.lit(PREFIX_CHUNK)))
        spread = texts.withColumn("ends", F.explode(runs)).repartition(width)
        rows = spread.withColumn("_end", F.explode("ends"))
        prefix = F.substring(F.col("text"), F.lit(1), F.col("_end"))
        pieces = F.size(F.split("prefix", " "))
        return rows.withColumn("prefix", prefix).withColumn("n_words", pieces).drop("ends", "_end", "text", "text_key")


# Pieces whose ends are worked out together: joining arrays costs their length, so long texts go by blocks.
ENDS_BLOCK = 256


def _extended(sofar: Column, block: Column) -> Column:
    """Running ends with those of one more block of piece lengths."""
    inner = F.aggregate(
        block, F.struct(sofar["at"].alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda acc, size: F.struct(
            (acc["at"] + 1 + size).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + 1 + size)).alias("ends")))
    return bind(inner, lambda made: F.struct(made["at"].alias("at"), F.concat(sofar["ends"], made["ends"]).alias("ends")))


@dataclass(frozen=True)
class Vocabulary:
    """Words by rank of frequency: ``token, token_id, n``; ids 0 and 1 are pad and unknown."""

    table: DataFrame
    total: int  # occurrences of its words


def vocabulary(df: DataFrame, text: str, size: int | None = None) -> Vocabulary:
    """All words of the texts, or the ``size`` most frequent ones, with ids by rank."""
    counts = df.select(F.explode(F.transform(words(F.col(text)), F.lower)).alias("token"))
    ranked = numbered(counts.groupBy("token").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("token")])
    if size is not None:
        ranked = ranked.filter(F.col("rank") < size)
    table = ranked.select("token", (F.col("rank") + FIRST_WORD_ID).cast("int").alias("token_id"), "n")
    return Vocabulary(table, table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def token_ids(df: DataFrame, ids: str, text: str, vocab: Vocabulary, max_length: int = LM_LENGTH,
              out: str = "token_ids") -> DataFrame:
    """Fixed-length id arrays: cut or padded to ``max_length``.

    Words find their ids by a lookup that broadcasts frequent words only;
    positions of one row are at most ``max_length``.
    """
    first = F.slice(F.transform(words(F.col(text)), F.lower), 1, max_length)
    spelled = df.select(ids, F.posexplode_outer(first).alias("pos", "token"))
    known = lookup(spelled, vocab.table, "token", "n", vocab.total)
    number = F.when(F.col("token").isNotNull(), F.coalesce(F.col("token_id"), F.lit(UNKNOWN)))
    collected = F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct("pos", number.alias("id")))))
    return (
        known.groupBy(ids).agg(collected.alias("_ids"))
        .select(ids, pad_ids(F.transform("_ids", lambda x: x["id"]), max_length, PAD).alias(out))
    )


def lm_set(df: DataFrame, ids: str, vocab: Vocabulary, label: str | None = None, cls: int = 1,
           max_length: int = LM_LENGTH) -> DataFrame:
    """Language-model training rows of one class: ids, and the same ids as labels.

    Judged candidates bring their first verdict as the label, other rows ``label``.
    """
    text = next(c for c in ("gen_0", "text", "gen") if c in df.columns)
    label = label or next(c for c in ("pred_0", "label") if c in df.columns)
    kept, _ = target_class(df.withColumn(label, F.col(label).cast("int")), label, cls)
    return token_ids(kept, ids, text, vocab, max_length).withColumn("labels", F.col("token_ids"))


def cond_set(df: DataFrame, ids: str, vocab: Vocabulary, label: str = "pred_0", cls: int = 1,
             max_length: int = LM_LENGTH, gen: str = "gen_0") -> DataFrame:
    """Conditional training rows: prompt ids, and candidate ids with padding masked."""
    kept, _ = target_class(df.withColumn(label, F.col(label).cast("int")), label, cls)
    asked = token_ids(kept, ids, "prompt", vocab, max_length)
    wanted = token_ids(kept, ids, gen, vocab, max_length, "labels")
    return asked.join(wanted, ids).withColumn("labels", mask_pad(F.col("labels"), PAD, IGNORED_LABEL))


def index_labels(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Label ids by sorted distinct value, and the table behind them; a null label has a null id.

    A floating label means regression and has no ids.
    """
    if dict(df.dtypes)[col] in ("float", "double"):
        raise ValueError(f"{col} is a regression target")
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    dim = numbered(values, [col]).select(col, F.col("rank").cast("int").alias("label_id"))
    return df.join(dim, col, "left"), dim


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key in the order (_o, _v), nulls first; k rows a key leave a task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "_v"))
    return rows.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def group_targets(df: DataFrame, context: str, value: str, order: str, max_targets: int | None = None,
                  salts: int = SALTS) -> DataFrame:
    """One row per context with its targets in order, the first ``max_targets`` of them if given.

    Without a limit the targets of a context form one value; ``target_rows`` has no such
    bound. With one, a context is dealt to ``salts`` sub-groups by a hash of its
    rows, each of which keeps its own first targets; these meet in a second step, so
    a task sees a share of a hot context and then ``salts`` times ``max_targets`` rows at most.
    Targets of one order value come by value; a null context is a context.
    """
    rows = df.select(F.col(context).alias("context"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    if max_targets is not None:
        if max_targets < 1:
            raise ValueError("max_targets must be at least 1")
        salted = rows.withColumn("_s", F.pmod(F.xxhash64("_o", "_v"), F.lit(salts)))
        rows = _first(_first(salted, ["context", "_s"], max_targets).drop("_s"), ["context"], max_targets)
    item = F.struct(F.col("_o").alias("o"), F.col("_v").alias("v"))
    grouped = rows.groupBy("context").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return grouped.select("context", F.transform("_items", lambda x: x["v"]).alias("targets"))


def target_rows(df: DataFrame, context: str, value: str, order: str) -> DataFrame:
    """``context, ord, target``: the targets of every context, numbered from 0, one row each.

    Rows are range-partitioned by context and order, so that a context of any
    size spreads over tasks.
    """
    rows = df.select(F.col(context).alias("context"), F.col(order).alias("_o"), F.col(value).alias("target"))
    ranked = numbered(rows, ["context", "_o", "target"])
    first = ranked.groupBy(F.col("context").alias("_c")).agg(F.min("rank").alias("_first"))
    placed = ranked.join(first, F.col("context").eqNullSafe(F.col("_c")))
    return placed.select("context", (F.col("rank") - F.col("_first")).alias("ord"), "target")
