"""Evaluation metrics over candidates, pairs and predictions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.tokens import gram_rows, words_and_marks
from quillspark.operators.filters import pending_metric, union_all
from quillspark.operators.fingerprints import distinct_grams
from quillspark.operators.joins import key_sizes, split_hot
from quillspark.session import shuffle_width

MAX_ORDER = 4

# Bytes of texts that become n-grams of one order in one task.
GRAM_BYTES = 16 << 20


def _gram_width(df: DataFrame, size: Column, orders: Sequence[int]) -> int:
    """Partitions in which the n-grams of texts of ``size`` bytes are counted: a task's counts don't grow with the table."""
    return _width_of(df, df.agg(F.sum(size)).first()[0], orders)


def _width_of(df: DataFrame, total: int | None, orders: Sequence[int]) -> int:
    return max(shuffle_width(df.sparkSession), -(-(total or 0) * len(orders) // GRAM_BYTES))


def distinct_n(cands: DataFrame, group: str, gen: str = "gen", orders: Sequence[int] = (1, 2, 3, 4),
               normalize: str = "candidates", floor: int = 10_000) -> DataFrame:
    """Distinct n-grams of a group's candidates over its candidates (or its n-grams).

    Groups with one candidate drop out. The candidates of an ordinary group are
    placed together, text by text, and their n-grams never leave the task. The
    n-grams of a hot group, one of ``floor`` candidates or more, are counted by their fingerprints over all tasks.
    Candidates are worked out once for the sizes of groups, and once for each kind of group that there is.
    """
    if normalize not in ("candidates", "ngrams"):
        raise ValueError(f"unknown normalization {normalize!r}")
    kept = cands.filter(F.col(gen).isNotNull()).select(group, gen)
    sizes = key_sizes(kept, group, floor, F.octet_length(gen))
    usual, hot = split_hot(kept, group, floor, sizes)
    total = {r["_hot"]: r["_total"] for r in sizes.groupBy("_hot").agg(F.sum("_size").alias("_total")).collect()}
    parts = []
    if False in total or not total:
        placed = usual.repartition(_width_of(kept, total.get(False), orders), group)
        parts.append(_gram_counts(placed, group, gen, orders))
    if True in total:
        parts.append(_hot_counts(hot, sizes, group, gen, orders, _width_of(kept, total[True], orders), normalize))
    counted = union_all(parts)

    def value(n: int) -> Column:
        under = F.col("_candidates") if normalize == "candidates" else F.col(f"_t{n}")
        return F.coalesce(F.col(f"_d{n}") / under, F.lit(0.0)).alias(f"distinct_{n}_gram")

    return counted.filter(F.col("_candidates") > 1).select(group, *[value(n) for n in orders])


def _hot_counts(rows: DataFrame, sizes: DataFrame, group: str, gen: str, orders: Sequence[int], buckets: int,
                normalize: str) -> DataFrame:
    """The columns of ``_gram_counts`` for hot groups; total n-grams only if they are what is divided by."""
    tokens = words_and_marks(F.col(gen))
    groups = sizes.filter("_hot").select(F.col("_key").alias(group), "_id", F.col("_n").alias("_candidates"))
    counts = distinct_grams(rows, "_id", tokens, orders, buckets)
    if normalize == "ngrams":
        size = F.col("_tokens")
        totals = rows.select("_id", F.size(tokens).cast("bigint").alias("_tokens")).groupBy("_id").agg(
            *[F.sum(F.when(size >= n, size - (n - 1))).alias(f"_t{n}") for n in orders])
        counts = counts.join(totals, "_id")
    else:
        counts = counts.withColumns({f"_t{n}": F.lit(None).cast("bigint") for n in orders})
    return groups.join(counts, "_id", "left").drop("_id")


def _gram_counts(rows: DataFrame, group: str, gen: str, orders: Sequence[int]) -> DataFrame:
    """Per group: candidates, and distinct and total n-grams of each order.

    Every candidate adds one row of order 0, whose count is the group's size: no
    second aggregate and no join.
    """
    grams = gram_rows(rows, [group], words_and_marks(F.col(gen)), orders, count_texts=True)
    times = grams.groupBy(group, "n", "gram").agg(F.count(F.lit(1)).alias("_times"))
    return times.groupBy(group).agg(
        F.sum(F.when(F.col("n") == 0, F.col("_times"))).alias("_candidates"),
        *[F.count_if(F.col("n") == n).alias(f"_d{n}") for n in orders],
        *[F.sum(F.when(F.col("n") == n, F.col("_times"))).alias(f"_t{n}") for n in orders],
    )


def _clipped(df: DataFrame, ids: str, pred: str, refs: str, orders: Sequence[int]) -> DataFrame:
    """Per row: for each order n-grams of the prediction, and those the references also hold, and text lengths.

    ``refs`` is an array of texts. Rows are numbered, so rows with one id stay
    apart, and their texts placed by number once; every count after that is local
    to its partition, because all its keys start with the number. Lengths come
    along as rows of order 0, which a text without tokens has too.
    """
    numbered = df.select(ids, pred, refs).withColumn("_row", F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length(pred), F.lit(0)) + F.coalesce(F.octet_length(F.array_join(refs, "")), F.lit(0))
    placed = numbered.repartition(_gram_width(df, size, orders), "_row")
    sides = F.concat(
        F.array(F.struct(F.lit(-1).alias("side"), F.col(pred).alias("text"))),
        F.transform(F.coalesce(F.col(refs), F.array().cast("array<string>")),
                    lambda text, i: F.struct(i.alias("side"), text.alias("text"))),
    )
    keys = ["_row", ids]
    texts = placed.select(*keys, F.inline(sides))
    grams = gram_rows(texts, [*keys, "side"], words_and_marks(F.col("text")), orders, count_texts=True)
    # A length belongs to its side, so the side becomes part of the key.
    grams = grams.withColumn("gram", F.when(F.col("n") == 0, F.concat_ws(":", "side", "gram")).otherwise(F.col("gram")))
    counts = grams.groupBy(*keys, "n", "gram", "side").agg(F.count(F.lit(1)).alias("c"))
    in_pred = F.coalesce(F.max(F.when(F.col("side") == -1, F.col("c"))), F.lit(0))
    in_refs = F.coalesce(F.max(F.when(F.col("side") >= 0, F.col("c"))), F.lit(0))
    met = counts.groupBy(*keys, "n", "gram").agg(in_pred.alias("p"), in_refs.alias("r"))
    length = F.substring_index("gram", ":", -1).cast("int")
    return met.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("n") == n, F.col(x))).alias(f"_{x}{n}") for n in orders for x in ("p", "r")],
        *[F.sum(F.when(F.col("n") == n, F.least("p", "r"))).alias(f"_o{n}") for n in orders],
        F.max(F.when((F.col("n") == 0) & (F.col("p") > 0), length)).alias("_c"),
        F.collect_list(F.when((F.col("n") == 0) & (F.col("r") > 0), length)).alias("_rs"),
    )


def bleu(df: DataFrame, ids: str, pred: str, refs: str, max_n: int = MAX_ORDER) -> DataFrame:
    """BLEU per row against one or more references, without smoothing.

    Counts are clipped at the largest count in any reference; the reference
    length is the closest one, the shorter of two equally close.
    """
    orders = range(1, max_n + 1)
    closest = F.array_min(F.transform(
        "_rs", lambda s: F.struct(F.abs(s - F.col("_c")).alias("d"), s.alias("r"))))["r"]
    stats = _clipped(df, ids, pred, refs, orders).withColumn("_r", closest)
    mean_log = sum((F.log(F.col(f"_o{n}") / F.col(f"_p{n}")) for n in orders), F.lit(0.0)) / max_n
    usable = F.lit(True)
    for n in orders:
        usable = usable & (F.coalesce(F.col(f"_o{n}"), F.lit(0)) > 0)
    penalty = F.when(F.col("_c") > F.col("_r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("_r") / F.col("_c")))
    value = F.when(usable, penalty * F.exp(mean_log)).otherwise(F.lit(0.0))
    return stats.select(ids, F.coalesce(value, F.lit(0.0)).alias("bleu"))


def rouge_n(df: DataFrame, ids: str, pred: str, ref: str, n: int = 1) -> DataFrame:
    """Clipped n-gram overlap: recall, precision and F1; zero where a side is empty."""
    paired = df.select(ids, pred, F.array(ref).alias("_refs"))
    stats = _clipped(paired, ids, pred, "_refs", [n])
    recall = F.when(F.col(f"_r{n}") > 0, F.col(f"_o{n}") / F.col(f"_r{n}")).otherwise(F.lit(0.0))
    precision = F.when(F.col(f"_p{n}") > 0, F.col(f"_o{n}") / F.col(f"_p{n}")).otherwise(F.lit(0.0))
    both = stats.select(ids, F.coalesce(recall, F.lit(0.0)).alias("recall"),
                        F.coalesce(precision, F.lit(0.0)).alias("precision"))
    total = F.col("recall") + F.col("precision")
    return both.withColumn("f1", F.when(total > 0, 2 * F.col("recall") * F.col("precision") / total).otherwise(0.0))


def accuracy(df: DataFrame, pred: str, label: str, by: str | None = None) -> DataFrame:
    hit = (F.col(pred) == F.col(label)).cast("double")
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def mse(df: DataFrame, pred: str, label: str, by: str | None = None) -> DataFrame:
    grouped = df.groupBy(by) if by else df.groupBy()
    error = F.pow(F.col(pred) - F.col(label), 2)
    return grouped.agg(F.avg(error).alias("mse"), F.count(F.lit(1)).alias("n_samples"))


def combined_score(*values: Column) -> Column:
    """The mean of several metric values of one row."""
    return sum(values[1:], values[0]) / len(values)


def long_metrics(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Metric columns as ``(ids, metric, value)`` rows."""
    return df.unpivot(list(ids), list(values), "metric", "value")


def metric_run(df: DataFrame, done: DataFrame, keys: Sequence[str],
               metrics: Mapping[str, Callable[[DataFrame], DataFrame]], overwrite: bool = False) -> DataFrame:
    """The long table of metrics after a run over ``df``.

    A metric, a function that returns the keys and ``value``, gets the rows that have
    no value of it yet, or with ``overwrite`` all rows in place of the values there are.
    """
    columns = [*keys, "metric", "value"]
    kept = done.filter(~F.col("metric").isin(*metrics)) if overwrite else done
    parts = [kept.select(*columns)]
    for name, work in metrics.items():
        todo = pending_metric(df, done, keys, name, overwrite)
        parts.append(work(todo).withColumn("metric", F.lit(name)).select(*columns))
    return union_all(parts)
