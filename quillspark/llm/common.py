"""What the operators of this folder share: settings, order, row keys, words, digests."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.session import configure, fresh_path, materialize, shuffle_width
from quillspark.sources.readers import spread

# Rows and bytes that one Arrow batch may hold: what a Python worker keeps in memory at once.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# The ASCII white space between words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Bytes that belong to a word of digits, lower-case letters and characters from U+0080 on.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def prepared(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its rows over all task slots if it has few splits."""
    return spread(prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def remainder(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    as_text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(as_text.cast("binary")), F.lit(5))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null is empty."""
    return [text or "" for text in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null is empty."""
    return [text or b"" for text in batch.column(name).cast(pa.binary()).to_pylist()]


def lowered(raw: bytes) -> bytes:
    """A-Z in lower case; bytes of other characters stay."""
    return raw.translate(LOWER)


def alnum_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of digits, letters and non-ASCII characters."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ALNUM[np.frombuffer(raw, dtype=np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen again; the memo is emptied when it is full."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; order counts."""
    if len(hashes) < size:
        return hashes[:0]
    out = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return mixed(out)


def in_order(docs: DataFrame, key: str, shards: int | None = None) -> DataFrame:
    """Rows in shards of ascending ``key``, sorted within each; adds ``shard``.

    The bounds come from a scan of the key alone, so texts are read and moved once.
    A row finds its shard by binary search in the bounds. Rows without a key come
    first; rows of one key are ordered by the other columns' hash. A key that takes up several
    bounds has as many shards, by ranges of that hash, and so do rows without a key; only
    rows that are equal altogether are never parted. There are somewhat more than ``shards`` shards then.
    """
    n = shards or shuffle_width(docs.sparkSession)
    fractions = [i / n for i in range(1, n)]
    found, bare = {}, 0
    if n > 1:
        seen = docs.agg(F.percentile_approx(key, fractions, 20 * n).alias("b"), F.count("*").alias("rows"),
                        F.count(key).alias("known")).first()
        found = Counter(seen["b"] or [])
        bare = n * (seen["rows"] - seen["known"]) // max(1, seen["rows"])
    bounds = sorted(found)
    tie = F.xxhash64(*[c for c in docs.columns if c != key])

    def part(count: Column) -> Column:
        """Which of ``count`` equal ranges the hash lies in."""
        return F.least(F.floor((tie.cast("double") / 2.0**64 + 0.5) * count), count - 1).cast("int")

    first = bare if bare > 1 else 0
    at = F.lit(first)
    if bounds:
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        held = F.lit(np.array(bounds, dtype=np.int64))
        place = F.aggregate(
            steps, F.lit(0),
            lambda sofar, step: F.when(
                F.coalesce(F.get(held, sofar + step - 1) < F.col(key), F.lit(False)), sofar + step).otherwise(sofar),
        )
        # Keys up to a bound are one shard; a bound's own key, if it comes again, has shards of its own behind.
        own = np.array([found[b] if found[b] > 1 else 0 for b in bounds] + [0], dtype=np.int64)
        starts = first + np.arange(len(own)) + np.cumsum(own) - own
        docs = docs.withColumn("shard", place)
        parts = F.get(F.lit(own), F.col("shard")).cast("int")
        repeated = (parts > 0) & (F.col(key) == F.get(held, F.col("shard")))
        at = F.get(F.lit(starts), F.col("shard")).cast("int") + F.when(repeated, 1 + part(parts)).otherwise(0)
        total = int(starts[-1]) + 1
    else:
        total = first + 1
    if first:
        at = F.when(F.col(key).isNull(), part(F.lit(first))).otherwise(at)
    columns = [c for c in docs.columns if c != "shard"]
    return (
        docs.select(*columns, at.alias("shard"))
        .repartitionById(total, F.col("shard"))
        .sortWithinPartitions("shard", key, F.xxhash64(*[c for c in columns if c != key]))
    )


def running_start(totals: DataFrame, key: str, total: str) -> DataFrame:
    """``key, before``: the sum of ``total`` over smaller keys. One row per shard, so one task is enough."""
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(total).over(before), F.lit(0)).alias("before"))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches sorted by ``keys``, one table each."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(column[start] for column in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, comp``: the smallest node of each connected component of ``edges`` (a, b).

    Large-star and small-star rounds: every node links its neighbours to the
    smallest of them. A node's neighbours meet only in a ``min`` that is summed up
    map-side and in a join that adaptive execution may split. The number of rounds
    grows with the logarithm of the component size. Each round is written to the
    shared folder, which cuts the lineage; the test for the end counts rows on
    the executors.
    """
    links = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small star: a node's smaller neighbours, and the node, link to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = materialize(small, name)
        if _digest(after) == _digest(links):
            return after.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        links = after


def _digest(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())


def arrow_rows(names_types: list[tuple[str, pa.DataType]]) -> Callable[..., pa.RecordBatch]:
    """A maker of batches with these columns."""
    schema = pa.schema(names_types)

    def make(*columns) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    return make


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Rows of ``counts`` ids each, out of all ids in one array."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def id_checksums(lists: pa.ListArray) -> list[int]:
    """The unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers; all rows share one buffer."""
    offsets = lists.offsets.to_numpy().astype(np.int64) * 4
    ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    held = memoryview(np.ascontiguousarray(ids)).cast("B")
    return [zlib.crc32(held[start:end]) for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``materialize``, for tables that hold text: written with the denser codec."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names like these that no column of ``df`` has, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, first: str = "_k1", second: str = "_k2") -> DataFrame:
    """Adds the id, and a hash of id and text, under these names. Only equal rows share both; neither is null."""
    return docs.withColumns({
        first: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        second: F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))),
    })
