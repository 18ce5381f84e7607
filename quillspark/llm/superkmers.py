"""Repeated runs of words, found by super-k-mers.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash of the
``mer``-word runs in it, so equal windows have equal minimisers. Consecutive windows with one
minimiser form a super-k-mer: its words travel once, as one packed string, to the bucket of
the minimiser, where all windows of the bucket are sorted and equal neighbours compared
word by word. Words inside a window that starts anywhere else too are removed. The runs are long
enough (8 words) that few of them repeat by chance, however large the corpus is.

Two passes over the texts: the first counts minimiser occurrences in 2^``slot_bits`` slots, which
gives two bit maps of fixed size; in the second, only super-k-mers of slots with two or more
occurrences travel. A window that occurs twice has two minimiser occurrences, so
none is missed. In slots with more than ``hot`` occurrences (a passage that very many documents
share) every window goes alone, as its 128-bit digest, into a count that is summed up
map-side and a join that adaptive execution may split; no bucket gets large.

Defined cases: a null or empty text has no words and stays as it is; a text shorter than the window
loses nothing; rows with one doc_id are told apart by their texts, equal rows repeat each other's windows;
an empty table gives no rows; columns named like the operator's own do not meet them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import WordHashes, arrow_rows, free, gram_hashes, keyed, mixed, raw_texts, stored
from quillspark.session import shuffle_width

PAGE = 1 << 16
LONGEST = 64  # windows in one packed string


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every run of ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def minimisers(hashes: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of every window, and the hashes at all places that are the minimiser of some window."""
    mers = gram_hashes(hashes, mer)
    width = window - mer + 1
    least = _slide(mers, width, np.minimum)
    # A place is a minimiser if the largest of the minima of the windows over it is its own hash.
    edge = np.zeros(width - 1, dtype=np.uint64)
    largest = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    return least, mers[largest == mers]


def runs(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end window of the runs with one minimiser, at most ``LONGEST`` windows each."""
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cuts])
    end = np.append(cuts, len(least))
    if (end - first).max() > LONGEST:
        extra = [np.arange(a, b, LONGEST) for a, b in zip(first, end)]
        first = np.concatenate(extra)
        end = np.append(first[1:], len(least))
    return first, end


def slots_of(values: np.ndarray, slot_bits: int) -> np.ndarray:
    """The slots of minimisers. Least hashes crowd near zero, so they are mixed again."""
    return (mixed(values) >> np.uint64(64 - slot_bits)).astype(np.int64)


def slot_counts(docs: DataFrame, window: int, mer: int, slot_bits: int) -> DataFrame:
    """``slot, n``: minimiser occurrences in each slot, as far as one task has added them up."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = WordHashes(), [], 0
        rows = arrow_rows([("slot", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for raw in raw_texts(batch):
                words = raw.split()
                if len(words) >= window:
                    found = slots_of(minimisers(memo.of(words), window, mer)[1], slot_bits)
                    held.append(found.astype(np.int32))
                    size += len(found)
            if size > 1 << 20:
                yield rows(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield rows(*np.unique(np.concatenate(held), return_counts=True))

    return docs.select("text").mapInArrow(counted, "slot int, n long")


def slot_maps(counts: DataFrame, slot_bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of the slots with two or more occurrences and of those with more than ``hot``.

    Each page of 65,536 slots becomes bits on the executors; the driver joins pages, 2^slot_bits / 8
    bytes for each map whatever the input.
    """
    pages = (
        counts.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
        .groupBy(F.shiftright("slot", 16).alias("page"))
        .agg(F.collect_list(F.struct(F.pmod("slot", F.lit(PAGE)).alias("slot"), (F.col("n") > hot).alias("hot"))).alias("slots"))
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("page", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())])
        for batch in batches:
            for page, slots in zip(batch.column("page"), batch.column("slots")):
                inside = slots.values
                bits = np.zeros((2, PAGE), dtype=bool)
                at = inside.field("slot").to_numpy(zero_copy_only=False)
                bits[0, at] = True
                bits[1, at] = inside.field("hot").to_numpy(zero_copy_only=False)
                both = np.packbits(bits, axis=1, bitorder="little")
                yield rows([page.as_py()], [both[0].tobytes()], [both[1].tobytes()])

    maps = np.zeros((2, max(1, (1 << slot_bits) // PAGE), PAGE // 8), dtype=np.uint8)
    for row in pages.mapInArrow(packed, "page int, repeated binary, hot binary").collect():
        maps[0, row["page"]] = np.frombuffer(row["repeated"], dtype=np.uint8)
        maps[1, row["page"]] = np.frombuffer(row["hot"], dtype=np.uint8)
    return maps[0].ravel(), maps[1].ravel()


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def packed_runs(docs: DataFrame, window: int, mer: int, slot_bits: int, hot: int) -> DataFrame:
    """``_k1, _k2, start, bucket, words`` per super-k-mer, or with ``digest`` in place of words per window of a hot slot."""
    spark = docs.sparkSession
    maps = spark.sparkContext.broadcast(slot_maps(slot_counts(docs, window, mer, slot_bits), slot_bits, hot))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (repeated, crowded) = WordHashes(), maps.value
        rows = arrow_rows([("_k1", pa.int64()), ("_k2", pa.int64()), ("start", pa.int32()), ("bucket", pa.int64()),
                           ("words", pa.binary()), ("digest", pa.binary())])
        out: list[tuple] = []
        for batch in batches:
            for k1, k2, raw in zip(batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), raw_texts(batch)):
                words = raw.split()
                if len(words) < window:
                    continue
                least, _ = minimisers(memo.of(words), window, mer)
                first, end = runs(least)
                slots = slots_of(least[first], slot_bits)
                kept = np.flatnonzero(_has(repeated, slots))
                alone = _has(crowded, slots[kept])
                buckets = least[first[kept]].view(np.int64)
                for a, b, bucket, single in zip(first[kept].tolist(), end[kept].tolist(), buckets.tolist(), alone.tolist()):
                    if single:
                        out += [(k1, k2, i, bucket, None, hashlib.blake2b(
                            b" ".join(words[i : i + window]), digest_size=16).digest()) for i in range(a, b)]
                    else:
                        out.append((k1, k2, a, bucket, b" ".join(words[a : b - 1 + window]), None))
                if len(out) >= 5000:
                    yield rows(*zip(*out))
                    out = []
        if out:
            yield rows(*zip(*out))

    schema = "_k1 long, _k2 long, start int, bucket long, words binary, digest binary"
    return stored(docs.select("_k1", "_k2", "text").mapInArrow(cut, schema), "super-k-mers")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each packed string, which of its windows also starts elsewhere in these strings."""
    numbers = _Numbers()
    parts = []
    for string in strings:
        words = string.split()
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    sizes = np.array([len(p) - window + 1 for p in parts])
    ids = np.concatenate(parts)
    offsets = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
    begins = np.concatenate([np.arange(o, o + s) for o, s in zip(offsets, sizes)])
    hashes = gram_hashes(ids.astype(np.uint64) + np.uint64(1), window)[begins]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    near = np.flatnonzero(ordered[1:] == ordered[:-1])
    views = np.lib.stride_tricks.sliding_window_view(ids, window)
    equal = np.zeros(len(near), dtype=bool)
    for at in range(0, len(near), 20_000):
        some = near[at : at + 20_000]
        equal[at : at + 20_000] = (views[begins[order[some]]] == views[begins[order[some + 1]]]).all(axis=1)
    if not equal.all():
        # Different windows share a hash: sort these runs by their words instead.
        order = np.lexsort(views[begins].T[::-1])
        rows = views[begins[order]]
        near = np.flatnonzero((rows[1:] == rows[:-1]).all(axis=1))
    repeated = np.zeros(len(begins), dtype=bool)
    repeated[order[near]] = True
    repeated[order[near + 1]] = True
    return np.split(repeated, np.cumsum(sizes)[:-1])


def _ranges(flags: np.ndarray, start: int, window: int) -> list[tuple[int, int]]:
    """Word ranges under flagged windows, the first of which starts at word ``start``; close ones joined."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(flags).tolist():
        if out and start + i <= out[-1][1]:
            out[-1] = (out[-1][0], start + i + window)
        else:
            out.append((start + i, start + i + window))
    return out


def repeated_spans(docs: DataFrame, *, window: int = 35, mer: int = 8, slot_bits: int = 27, hot: int = 20_000,
                   chunk_words: int = 1 << 19) -> DataFrame:
    """``_k1, _k2, spans``: word ranges to remove from ``docs`` (with keys, see ``keyed``), for texts that have any."""
    cut = packed_runs(docs, window, mer, slot_bits, hot)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("_k1", pa.int64()), ("_k2", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            out = []
            for (k1, k2, start, _, _), flags in zip(held, repeated_windows([x[4] for x in held], window)):
                out += [(k1, k2, a, b) for a, b in _ranges(flags, start, window)]
            return rows(*zip(*out)) if out else None

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_k1", "_k2", "start", "bucket", "words")]
            for row in zip(*columns):
                if size >= chunk_words and row[3] != held[-1][3]:
                    found = flush()
                    if found is not None:
                        yield found
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
        if held:
            found = flush()
            if found is not None:
                yield found

    width = shuffle_width(docs.sparkSession)
    packed = cut.where("digest IS NULL").drop("digest").repartition(width, "bucket").sortWithinPartitions("bucket")
    cold = packed.mapInArrow(counted, "_k1 long, _k2 long, first int, end int")
    single = cut.where("digest IS NOT NULL")
    many = single.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    crowded = single.join(many, "digest", "left_semi").select(
        "_k1", "_k2", F.col("start").alias("first"), (F.col("start") + window).alias("end"))
    return cold.unionByName(crowded).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def _kept(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["end"]] -= 1
    stay = np.cumsum(gone)[:-1] == 0
    return [w for w, keep in zip(words, stay.tolist()) if keep]


def removals(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row of ``docs`` (doc_id, text).

    ``kept_text`` is the kept words joined by one space.
    """
    read = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated_spans(read, **settings)

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                           ("kept_text", pa.string())])
        for batch in batches:
            out = []
            for doc_id, raw, found in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), batch.column("spans").to_pylist()):
                words = raw.split()
                kept = _kept(words, found)
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            if out:
                yield rows(*zip(*out))

    joined = read.join(spans.hint("shuffle_hash"), ["_k1", "_k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(stripped, "doc_id long, n_words long, n_removed long, kept_text string")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without repeated words. A text that loses none stays as it is; one that loses all goes."""
    *keys, place = free(docs, "_k1", "_k2", "_spans")
    spans = repeated_spans(keyed(docs.select("doc_id", "text")), **settings).select("_k1", "_k2", "spans").toDF(*keys, place)

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for raw, found in zip(raw_texts(batch), batch.column(place).to_pylist()):
                kept = _kept(raw.split(), found)
                keep.append(bool(kept))
                texts.append(b" ".join(kept).decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, type=pa.string())).filter(pa.array(keep)).drop_columns([place])

    joined = keyed(docs, *keys).join(spans.hint("shuffle_hash"), keys, "left").drop(*keys)
    whole = joined.where(F.col(place).isNull()).drop(place)
    changed = joined.where(F.col(place).isNotNull()).mapInArrow(stripped, docs.schema)
    return whole.unionByName(changed)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS run
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), p AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY run) > 1
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, unnest(range(0, 35)) AS k FROM p)
), lost AS (
  SELECT r, list(i) AS gone FROM gone GROUP BY r
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
