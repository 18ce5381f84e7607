"""Benchmark phrases found in documents by an FM-index per shard of documents.

A task numbers the words of some documents, puts a separator behind each, sorts the
suffixes, and keeps the Burrows-Wheeler transform as a wavelet matrix with rank counts,
the number of smaller symbols, and the text places of every 32nd suffix and of every document
start. These rows are written: an index that any set of phrases can be searched in later. Phrases
are matched from their last word by backward search, all phrases of a block at once;
occurrences are placed by stepping back to the nearest sampled suffix. Their spans are merged
per document.

Windows are cut and made distinct on the executors and written with a block number, about ``block_words``
words to a block. One block at a time is read, broadcast, searched in one pass over the index, and
dropped when its hits are written, so the driver holds one block of a benchmark of any size, with the
item ids of its windows. A shard holds ``shard_words`` words or a single longer document.

Defined cases: a null or empty text has no words and is never contaminated; an item without words has
no window; repeated items count by their item_id once; a null item_id is the empty string; rows with
one doc_id are judged row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import ALNUM, LOWER, arrow_rows, free, raw_texts
from quillspark.session import fresh_path, materialize

SAMPLE = 32
INDEX_COLUMNS = ("shard long, doc_ids array<long>, text_hashes array<long>, starts binary, words binary, n int, smaller binary, bits binary, "
                 "marks binary, samples binary")

# Letter case and separators in one table: A-Z to a-z, every byte outside words to a space.
_FOLD = bytes(LOWER[b] if ALNUM[LOWER[b]] else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1  # 0 separates documents
        return number


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; a separator (0) ends a comparison, earlier separators are smaller.

    Each round sorts only suffixes that are not alone in their group yet.
    """
    n = len(symbols)
    separators = symbols == 0
    rank = symbols + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    nxt = np.append(rank[1:], 0)
    key = np.where(separators, rank * (int(rank.max()) + 1), rank * (int(rank.max()) + 1) + nxt)
    order = np.argsort(key, kind="stable")
    width = 2
    first = np.append(True, key[order][1:] != key[order][:-1])
    while True:
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = group
        alone = first & np.append(first[1:], True)
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            return order
        held = order[open_places]
        following = rank[held + width]  # two equal runs hold no separator, so there is more text behind
        inner = np.lexsort((following, group[open_places]))
        order[open_places] = held[inner]
        following = following[inner]
        changed = np.append(True, following[1:] != following[:-1])
        first[open_places] |= changed
        width *= 2


@dataclass
class Index:
    """One shard's FM-index."""

    n: int
    smaller: np.ndarray  # symbols smaller than each symbol
    bits: np.ndarray  # levels x words of 64 bits
    ranks: np.ndarray  # ones before each word, per level
    zeros: np.ndarray
    nodes: np.ndarray  # where a symbol's run begins below the last level
    marks: np.ndarray
    mark_ranks: np.ndarray
    samples: np.ndarray

    @staticmethod
    def pack(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(flags) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view("<u8")

    @staticmethod
    def _before(words: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(words).astype(np.int64)
        return np.cumsum(ones, axis=-1) - ones

    @classmethod
    def build(cls, symbols: np.ndarray, starts: np.ndarray) -> Index:
        order = suffix_order(symbols.copy())
        levels = max(1, int(symbols.max()).bit_length())
        counts = np.bincount(symbols)
        smaller = np.cumsum(counts) - counts
        row = symbols[order - 1]  # of suffix 0 the last separator
        bits = []
        for level in reversed(range(levels)):
            one = (row >> level) & 1 == 1
            bits.append(cls.pack(one))
            row = np.concatenate([row[~one], row[one]])
        sampled = np.zeros(len(symbols), dtype=bool)
        sampled[::SAMPLE] = True
        sampled[starts] = True
        marks = sampled[order]
        return cls.load(len(symbols), smaller, np.array(bits), cls.pack(marks), order[marks])

    @classmethod
    def load(cls, n: int, smaller: np.ndarray, bits: np.ndarray, marks: np.ndarray, samples: np.ndarray) -> Index:
        ranks = cls._before(bits)
        ones = ranks[:, -1] + np.bitwise_count(bits[:, -1])
        self = cls(n, smaller, bits, ranks, n - ones, np.zeros(0, dtype=np.int64), marks, cls._before(marks), samples)
        symbols = np.arange(len(smaller))
        self.nodes = self._descend(symbols, np.zeros(len(smaller), dtype=np.int64))
        return self

    def _ones(self, level: int, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level, word] + np.bitwise_count(self.bits[level, word] & below)

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        levels = len(self.bits)
        for level in range(levels):
            ones = self._ones(level, places)
            places = np.where((symbols >> (levels - 1 - level)) & 1 == 1, self.zeros[level] + ones, places - ones)
        return places

    def _back(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """From an interval bound of X to that of symbol X."""
        return self.smaller[symbols] + self._descend(symbols, places) - self.nodes[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases: rows of symbols, padded behind."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((step < lengths) & (low < high))
            symbols = phrases[live, lengths[live] - 1 - step]
            low[live] = self._back(symbols, low[live])
            high[live] = self._back(symbols, high[live])
        return low, np.maximum(low, high)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by steps back to a sampled one."""
        out = np.full(len(rows), -1, dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.marks[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.marks[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.samples[(self.mark_ranks[word] + below)[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            symbols, places = np.zeros(len(at), dtype=np.int64), at
            for level in range(len(self.bits)):
                ones = self._ones(level, places)
                one = (self.bits[level, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
                places = np.where(one, self.zeros[level] + ones, places - ones)
                symbols = symbols * 2 + one
            at = self.smaller[symbols] + places - self.nodes[symbols]
            steps += 1
        return out


def write_index(docs: DataFrame, path: str, shard_words: int = 250_000) -> None:
    """Index rows for all ``docs`` (doc_id, text) under ``path``."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = arrow_rows([
            ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())),
            ("starts", pa.binary()), ("words", pa.binary()),
            ("n", pa.int32()), ("smaller", pa.binary()), ("bits", pa.binary()), ("marks", pa.binary()),
            ("samples", pa.binary())])
        shard = TaskContext.get().partitionId() << 32
        numbers, ids, hashes, parts, size = _Numbers(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            symbols = np.zeros(int(lengths.sum()) + len(parts), dtype=np.int64)
            starts = np.cumsum(lengths + 1) - lengths - 1
            for part, start in zip(parts, starts):
                symbols[start : start + len(part)] = part
            index = Index.build(symbols, starts)
            return rows(
                [shard], [ids], [hashes], [starts.astype("<i4").tobytes()], [b" ".join(numbers)], [index.n],
                [index.smaller.astype("<i4").tobytes()], [index.bits.astype("<u8").tobytes()],
                [index.marks.astype("<u8").tobytes()], [index.samples.astype("<i4").tobytes()])

        for batch in batches:
            for doc_id, text_hash, raw in zip(
                    batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), raw_texts(batch)):
                words = words_of(raw)
                if parts and size + len(words) > shard_words:
                    yield flush()
                    shard += 1
                    numbers, ids, hashes, parts, size = _Numbers(), [], [], [], 0
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
                ids.append(doc_id)
                hashes.append(text_hash)
                size += len(words) + 1
        if parts:
            yield flush()

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    read.mapInArrow(indexed, INDEX_COLUMNS).write.option("compression", "zstd").option(
        "parquet.block.size", 8 << 20).parquet(path)


@dataclass
class Phrases:
    """A block of distinct windows and the items that each belongs to."""

    windows: list[tuple[bytes, ...]]
    items: list[list[str]]


def written_windows(items: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """``run, items, block``: the distinct windows of ``items`` (item_id, text), written, and the number of blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("run", pa.binary()), ("n", pa.int64()), ("item", pa.string())])
        out: list[tuple] = []
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), raw_texts(batch)):
                words = words_of(raw)
                n = min(len(words), window)
                for i in range(len(words) - n + 1 if words else 0):
                    out.append((b" ".join(words[i : i + n]), n, item))
                    if len(out) >= 20_000:
                        yield rows(*zip(*out))
                        out = []
        if out:
            yield rows(*zip(*out))

    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    runs = materialize(
        read.mapInArrow(cut, "run binary, n long, item string").groupBy("run").agg(
            F.any_value("n").alias("n"), F.collect_set("item").alias("items")), "windows")
    n_runs, n_words = runs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, min(n_runs, -(-n_words // block_words)))
    path = fresh_path(items.sparkSession, "window-blocks")
    numbered = runs.select("run", "items", F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int").alias("block"))
    numbered.write.partitionBy("block").parquet(path)
    return items.sparkSession.read.schema(numbered.schema).parquet(path), blocks


def phrase_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The windows of ``items``, a block at a time; at least one, which may be empty."""
    windows, blocks = written_windows(items, window, block_words)
    for block in range(blocks):
        rows = windows.where(F.col("block") == block).select("run", "items").collect()
        yield Phrases([tuple(bytes(r["run"]).split()) for r in rows], [sorted(r["items"]) for r in rows])


def _hits(index: Index, vocabulary: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text places, lengths and phrase numbers of all occurrences, a bounded number of steps at a time."""
    numbers = {word: k for k, word in enumerate(vocabulary, 1)}
    known = [k for k, run in enumerate(phrases.windows) if all(w in numbers for w in run)]
    if not known:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    lengths = np.array([len(phrases.windows[k]) for k in known])
    rows = np.zeros((len(known), int(lengths.max())), dtype=np.int64)
    for row, k in enumerate(known):
        rows[row, : lengths[row]] = [numbers[w] for w in phrases.windows[k]]
    low, high = index.search(rows, lengths)
    counts = high - low
    which = np.repeat(np.arange(len(known)), counts)
    suffixes = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    places = np.concatenate([index.place(suffixes[i : i + 100_000]) for i in range(0, len(suffixes), 100_000)] or
                            [np.zeros(0, dtype=np.int64)])
    return places, lengths[which], np.array(known)[which]


def search(spark: SparkSession, path: str, items: DataFrame, *, window: int = 13,
           block_words: int = 1 << 20) -> DataFrame:
    """``shard, row, doc_id, text_hash, n_words, spans, items`` for every indexed document.

    ``spans`` holds merged word ranges (first, end) inside occurrences of any window of ``window`` item words, ``items``
    the sorted ids of the items.
    """
    schema = ("shard long, row int, doc_id long, text_hash long, n_words long, spans array<struct<first: long, end: long>>, "
              "items array<string>")

    def write_hits(block: Phrases, everything: bool) -> str:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            rows = arrow_rows([
                ("shard", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
                ("n_words", pa.int64()),
                ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                ("items", pa.list_(pa.string()))])
            for batch in batches:
                for x in batch.to_pylist():
                    smaller = np.frombuffer(x["smaller"], dtype="<i4").astype(np.int64)
                    words = x["words"].split()
                    bits = np.frombuffer(x["bits"], dtype="<u8").reshape(-1, x["n"] // 64 + 1)
                    index = Index.load(
                        x["n"], smaller, bits, np.frombuffer(x["marks"], dtype="<u8"),
                        np.frombuffer(x["samples"], dtype="<i4").astype(np.int64))
                    places, lengths, which = _hits(index, words, phrases)
                    starts = np.frombuffer(x["starts"], dtype="<i4").astype(np.int64)
                    n_words, spans, named = _by_document(starts, x["n"], places, lengths, which, phrases)
                    count = len(starts)
                    yield rows([x["shard"]] * count, list(range(count)), x["doc_ids"], x["text_hashes"], n_words, spans, named)

        hits = spark.read.schema(INDEX_COLUMNS).parquet(path).mapInArrow(run, schema)
        out = fresh_path(spark, "hits")
        (hits if everything else hits.where("size(spans) > 0")).write.parquet(out)
        sent.destroy()
        return out

    # The first block writes a row for every document, the others for those hit.
    written = [write_hits(block, k == 0) for k, block in enumerate(phrase_blocks(items, window, block_words))]
    return spark.read.schema(schema).parquet(*written).groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _by_document(starts: np.ndarray, n: int, places: np.ndarray, lengths: np.ndarray, which: np.ndarray,
                 phrases: Phrases) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Words, merged spans and item ids of each document of a shard."""
    count = len(starts)
    ends = np.append(starts[1:], n) - 1
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, places, 1)
    np.add.at(depth, places + lengths, -1)
    inside = np.concatenate([[0], (np.cumsum(depth)[:n] > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    spans: list[list[dict]] = [[] for _ in range(count)]
    for d, a, b in zip(np.searchsorted(starts, first, "right") - 1, first, end):
        spans[d].append({"first": int(a - starts[d]), "end": int(b - starts[d])})
    named: list[set[str]] = [set() for _ in range(count)]
    pairs = np.unique(np.stack([np.searchsorted(starts, places, "right") - 1, which]), axis=1)
    for d, k in zip(*pairs.tolist()):
        named[d].update(phrases.items[k])
    return (ends - starts).tolist(), spans, [sorted(x) for x in named]


def contamination(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``: at least a twentieth of the words are hit."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        rows = arrow_rows([
            ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
            ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", span)])
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                spans = merged([(s["first"], s["end"]) for s in x["spans"]])
                hit = sum(b - a for a, b in spans)
                digest = hashlib.sha256(",".join(sorted(x["items"])).encode()).hexdigest()
                out.append((x["doc_id"], x["text_hash"], x["n_words"], hit, len(x["items"]), digest, hit > 0 and 20 * hit >= x["n_words"],
                            [{"first": a, "end": b} for a, b in spans]))
            if out:
                yield rows(*zip(*out))

    return found.mapInArrow(
        judged, "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                "spans array<struct<first: long, end: long>>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, shard_words: int = 250_000,
            block_words: int = 1 << 20) -> DataFrame:
    """Index ``docs``, search every window of ``benchmark`` (item_id, text), and judge each document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "fm-index")
    write_index(docs, path, shard_words)
    return contamination(search(spark, path, benchmark, window=window, block_words=block_words))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, with all their columns and unchanged.

    Contaminated rows are found by id and text hash, so equal rows need no further key.
    """
    own, digest = free(docs, "_id", "_hash")
    bad = scanned(docs, benchmark, **settings).where("contaminated").select("doc_id", "text_hash").distinct().toDF(own, digest)
    found = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(digest))
    return docs.join(bad, found, "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS run
  FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i
        FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS run
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hit AS (
  SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (n, run)
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hit) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)
"""
