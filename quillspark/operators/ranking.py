"""Exact positions in a table without sorting the table.

A position is found by counting: a histogram over a prefix of the order key
says which bucket holds the wanted row, that bucket is counted again over a
longer prefix, and so on until it holds few rows. Every pass reads the key
columns only and moves one small histogram. The answer, a key value, then acts
as a literal filter on the table, so a split, sample or head of any size is a
narrow scan and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import materialize

# A bucket this small is read and sorted.
LEAF_ROWS = 4096
# Histogram size, and so the most rows one pass collects.
HEX_DIGITS_PER_PASS = 4
HASH_DIGITS = 32


@dataclass(frozen=True)
class Cut:
    """The place of a rank in an order; ``upto`` selects the rows up to it.

    ``values`` is the order key of the row there. If rows that are equal altogether stand on both sides,
    no filter can tell them apart: ``taken`` of ``same`` equal rows are in front.
    """

    columns: tuple[Column, ...]
    values: tuple | None  # None: before the first row
    everything: bool = False
    taken: int = 0
    same: int = 0

    @property
    def parts_equal_rows(self) -> bool:
        return 0 < self.taken < self.same

    def below(self) -> Column:
        """Rows in front of those that are equal to the row at the cut."""
        return _below(self.columns, self.values)

    def equal(self) -> Column:
        return _equal(self.columns, self.values)

    def upto(self) -> Column:
        if self.everything:
            return F.lit(True)
        if self.values is None:
            return F.lit(False)
        return self.below() | self.equal()


def hash_key(ids: Sequence[str], seed: int) -> Column:
    """The seeded order: md5 over the row's id and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def hash_cuts(df: DataFrame, ids: Sequence[str], seed: int,
              ranks: Sequence[int] | Callable[[int], Sequence[int]]) -> list[Cut]:
    """The cuts at the given 1-based ranks of the seeded order.

    Ranks may depend on the row count, which the first pass yields anyway. Rows that share
    ``ids`` are ordered by a hash of the whole row; only if a rank falls among such rows are they
    read, sorted apart and counted, however many they are.
    """
    columns = (hash_key(ids, seed), *[F.col(c) for c in ids])
    keys = df.select(hash_key(ids, seed).alias("_h"), *ids)
    width = HEX_DIGITS_PER_PASS
    top = {r[0]: r[1] for r in keys.groupBy(F.substring("_h", 1, width)).count().collect()}
    total = sum(top.values())
    if callable(ranks):
        ranks = ranks(total)

    found: dict[int, Cut] = {}
    open_ranks: dict[int, tuple[str, int, int]] = {}  # rank -> bucket, rank inside it, its size
    for rank in set(ranks):
        if rank < 1:
            found[rank] = Cut(columns, None)
        elif rank >= total:
            found[rank] = Cut(columns, None, everything=True)
        else:
            open_ranks[rank] = _locate(top, rank)
    while width < HASH_DIGITS and any(size > LEAF_ROWS for _, _, size in open_ranks.values()):
        buckets = {b for b, _, size in open_ranks.values() if size > LEAF_ROWS}
        inside = keys.filter(F.substring("_h", 1, width).isin(*buckets))
        finer = width + HEX_DIGITS_PER_PASS
        hist = {r[0]: r[1] for r in inside.groupBy(F.substring("_h", 1, finer)).count().collect()}
        for rank, (bucket, offset, size) in list(open_ranks.items()):
            if size > LEAF_ROWS:
                open_ranks[rank] = _locate({k: v for k, v in hist.items() if k.startswith(bucket)}, offset)
        width = finer
    small = {rank: held for rank, held in open_ranks.items() if held[2] <= LEAF_ROWS}
    if small:
        near = F.lit(False)
        for bucket in {b for b, _, _ in small.values()}:
            near = near | F.col("_h").startswith(bucket)
        rows = sorted((tuple(r) for r in keys.filter(near).collect()), key=_nulls_first)
        for rank, (bucket, offset, _) in small.items():
            inside = [r for r in rows if r[0].startswith(bucket)]
            key = inside[offset - 1]
            first = inside.index(key)
            same = inside.count(key)
            found[rank] = Cut(columns, key, taken=same, same=same) if offset - first == same else _among(
                df.filter(_equal(columns, key)), columns, key, offset - first)
    for rank, (bucket, offset, _) in open_ranks.items():
        # A whole hash in one bucket: rows of one key, unless two keys share their hash.
        if rank not in small:
            found[rank] = _among(df.filter(columns[0] == bucket), columns, None, offset)
    return [found[r] for r in ranks]


def _nulls_first(key: tuple) -> tuple:
    return tuple((value is not None, value) if value is not None else (False,) for value in key)


def _among(rows: DataFrame, columns: tuple[Column, ...], key: tuple | None, rank: int) -> Cut:
    """The cut at a rank of rows that share a hash, in the order of ids and a hash of the whole row."""
    whole = (*columns, F.xxhash64(*rows.columns), F.hash(*rows.columns))
    names = [f"_k{i}" for i in range(len(whole))]
    ranked = numbered(rows.select(*[c.alias(n) for c, n in zip(whole, names)]), names)
    values = tuple(ranked.filter(F.col("rank") == rank - 1).select(*names).first())
    same, taken = ranked.filter(_equal([F.col(n) for n in names], values)).agg(
        F.count(F.lit(1)), F.count_if(F.col("rank") < rank)).first()
    return Cut(whole, values, taken=taken, same=same)


def dealt(df: DataFrame, cuts: Sequence[Cut], name: str) -> DataFrame:
    """``df`` with the number of the first of some ascending cuts that a row is up to; their count behind all.

    A projection, but for a cut that parts equal rows: as many of those as needed get each number.
    """
    part = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        part = F.when(cuts[i].upto(), F.lit(i)).otherwise(part)
    parting = {}
    for cut in cuts:
        if cut.parts_equal_rows:
            parting.setdefault(cut.values, cut)
    if not parting:
        return df.withColumn(name, part)
    apart = F.lit(False)
    for cut in parting.values():
        apart = apart | cut.equal()
    out = df.filter(~apart).withColumn(name, part)
    for values, cut in parting.items():
        # How many of the equal rows are up to each cut: none for cuts in front of them, all for cuts behind.
        at = [i for i, other in enumerate(cuts) if other.values == values]
        upto = [cuts[i].taken if i in at else 0 if i < at[0] else cut.same for i in range(len(cuts))]
        counts = [b - a for a, b in zip([0, *upto], [*upto, cut.same])]
        numbers = F.flatten(F.array(*[F.array_repeat(F.lit(i), n) for i, n in enumerate(counts) if n]))
        out = out.unionByName(df.filter(cut.equal()).limit(1).withColumn(name, F.explode(numbers)))
    return out


def _locate(hist: dict[str, int], rank: int) -> tuple[str, int, int]:
    seen = 0
    for bucket in sorted(hist):
        if seen + hist[bucket] >= rank:
            return bucket, rank - seen, hist[bucket]
        seen += hist[bucket]
    raise ValueError("rank beyond the table")


def numbered(df: DataFrame, order_by: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's 0-based position in an order of any sortable columns.

    The rows are range-partitioned, sorted and written once; the positions in a
    partition then shift by the sizes of the partitions before it, one number each.
    Nulls come first and rows that tie take neighbouring positions.
    """
    ordered = df.orderBy(*order_by).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    rows = materialize(ordered, "numbered")
    shifts, before = [], 0
    for part, first, size in sorted(
            tuple(r) for r in rows.groupBy("_part").agg(F.min("_at"), F.count(F.lit(1))).collect()):
        shifts.append((part, before - first))
        before += size
    dim = df.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    return rows.join(F.broadcast(dim), "_part").withColumn(
        name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def parted(df: DataFrame, order_by: Sequence[str], n: int | Callable[[int], int]) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of an order, and the others; ``n`` may depend on the row count.

    Only the order columns and a hash of the row are sorted. The row at the edge
    then acts as a filter on the table, so rows themselves do not move. Ties are
    ordered by the hash; of equal rows as many as needed are taken.
    """
    whole = [F.xxhash64(*df.columns).alias("_t0"), F.hash(*df.columns).alias("_t1")]
    names = [f"_k{i}" for i in range(len(order_by))] + ["_t0", "_t1"]
    ranked = numbered(df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_by)], *whole), names)
    total = ranked.count()
    wanted = n(total) if callable(n) else n
    if wanted <= 0:
        return df.filter(F.lit(False)), df
    if wanted >= total:
        return df, df.filter(F.lit(False))
    edge = ranked.filter(F.col("rank") == wanted - 1).select(*names).first()
    values = list(edge)
    columns = [F.col(c) for c in order_by] + [F.xxhash64(*df.columns), F.hash(*df.columns)]
    same, taken = ranked.filter(_equal([F.col(c) for c in names], values)).agg(
        F.count(F.lit(1)), F.count_if(F.col("rank") < wanted)).first()
    below, equal = _below(columns, values), _equal(columns, values)
    if same == taken:
        return df.filter(below | equal), df.filter(~(below | equal))
    one = df.filter(equal).limit(1)

    def times(count: int) -> DataFrame:
        return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(count)))).drop("_copy")

    return (df.filter(below).unionByName(times(taken)),
            df.filter(~(below | equal)).unionByName(times(same - taken)))


def _equal(columns: Sequence[Column], values: Sequence) -> Column:
    test = F.lit(True)
    for column, value in zip(columns, values):
        test = test & column.eqNullSafe(F.lit(value))
    return test


def _below(columns: Sequence[Column], values: Sequence) -> Column:
    """Rows in front of these values in ascending order, nulls first."""
    test = F.lit(False)
    for column, value in reversed(list(zip(columns, values))):
        less = F.lit(False) if value is None else column.isNull() | F.coalesce(column < F.lit(value), F.lit(False))
        test = less | (column.eqNullSafe(F.lit(value)) & test)
    return test
