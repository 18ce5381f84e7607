"""Packing of documents into sequences, in order, by dynamic programming over cut points.

Documents stand in ascending order of their ids, one behind the other. Windows of at most
``capacity`` tokens may end at document ends, at ends of sentences or lines and, where a
sentence is longer than ``long_gap`` tokens, at some words inside it. A window costs its
padding (none if its length is the capacity or one of ``buckets``) and a cut inside
a document costs a penalty. With P(j) the tokens before cut j and D(j) the least cost up to
it, D(j) = penalty(j) + capacity - P(j) + min of D(i) + P(i) over cuts at most
``capacity`` tokens back: the minimum of a sliding window, held in a queue of rising
values, so the work is linear in the cuts. Windows of a bucket's exact length are looked up.

A shard of the id order is packed by one task, in stretches of about ``stretch`` tokens,
each of which ends with a document; so a task holds one stretch and leaves one short
window per stretch.

Defined cases: a null text counts as empty and is its end id alone; a null id sorts first;
rows with one id stay apart; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.bpe import encoder
from quillspark.llm.common import arrow_rows, id_checksums, id_lists, in_order, running_start
from quillspark.session import fresh_path

PIECE_COLUMNS = ("shard int, shard_sequence long, doc_id long, start long, length long, doc_tokens long, "
                 "offset long, token_ids array<int>")


def window_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int, buckets: list[int]) -> list[int]:
    """Indexes into ``places`` (tokens before each cut, from 0, steps of at most ``capacity``) where windows end."""
    n = len(places) - 1
    exact: dict[int, list[int]] = {}
    for size in buckets:
        back = np.searchsorted(places, places - size)
        for j in np.flatnonzero(places[np.minimum(back, n)] == places - size).tolist():
            exact.setdefault(j, []).append(int(back[j]))
    place, penalty = places.tolist(), penalties.tolist()
    cost, came = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n + 1):
        here = place[j]
        while here - place[queue[0][1]] > capacity:
            queue.popleft()
        best, i = queue[0]
        best += capacity - here
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += penalty[j]
        cost[j], came[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends = [n]
    while came[ends[-1]] > 0:
        ends.append(came[ends[-1]])
    return ends[::-1]


def _cut_points(lengths: np.ndarray, ends: np.ndarray, sentence: float, inside: float,
                long_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of one document of pieces with these lengths: tokens before each, and its penalty. The last is the end."""
    before = np.cumsum(lengths)
    total = int(before[-1])
    cuts = before[ends]
    cuts = cuts[(cuts > 0) & (cuts < total)]
    bounds = np.concatenate([[0], cuts, [total]])
    gaps = np.diff(bounds)
    if gaps.max() <= long_gap:
        return np.append(cuts, total), np.append(np.full(len(cuts), sentence), 0.0)
    step = long_gap // 2
    extra = np.concatenate([np.arange(bounds[k] + step, bounds[k + 1], step) for k in np.flatnonzero(gaps > long_gap)])
    # The nearest word end in front, unless a single word is longer than the step.
    snapped = before[np.maximum(np.searchsorted(before, extra, "right") - 1, 0)]
    extra = np.where((snapped <= extra) & (extra - snapped < step), snapped, extra)
    extra = np.setdiff1d(extra[(extra > 0) & (extra < total)], cuts)
    places = np.concatenate([cuts, extra])
    costs = np.concatenate([np.full(len(cuts), sentence), np.full(len(extra), inside)])
    order = np.argsort(places, kind="stable")
    return np.append(places[order], total), np.append(costs[order], 0.0)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = 2048, sentence_penalty: float = 4.0,
         inside_penalty: float = 24.0, smallest_bucket: int = 256, long_gap: int = 128, stretch: int = 1 << 20,
         shards: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``doc_id, start, length, doc_tokens, sequence_id, offset, token_ids``."""
    buckets, size = [], smallest_bucket
    while size < capacity:
        buckets.append(size)
        size *= 2

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        rows = arrow_rows([("shard", pa.int32()), ("shard_sequence", pa.int64()), ("doc_id", pa.int64()),
                           ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                           ("offset", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
        held: list[tuple] = []
        shard, sequence = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            ids = np.concatenate([h[1] for h in held])
            sizes = np.array([len(h[1]) for h in held], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            places = np.concatenate([[0], *[h[2] + s for h, s in zip(held, starts)]])
            windows = places[window_cuts(places, np.concatenate([[0.0], *[h[3] for h in held]]), capacity, buckets)]
            edges = np.unique(np.concatenate([starts, windows, [0]]))
            begins, lengths = edges[:-1], np.diff(edges)
            doc = np.searchsorted(starts, begins, "right") - 1
            window = np.searchsorted(windows, begins, "right")
            window_start = np.concatenate([[0], windows])[window]
            for at in range(0, len(begins), 2000):
                part = slice(at, at + 2000)
                low, high = begins[part][0], begins[part][-1] + lengths[part][-1]
                yield rows(
                    np.full(len(begins[part]), shard, dtype=np.int32), sequence + window[part],
                    pa.array([held[k][0] for k in doc[part]], type=pa.int64()), begins[part] - starts[doc[part]],
                    lengths[part], sizes[doc[part]], begins[part] - window_start[part],
                    id_lists(ids[low:high], lengths[part]))
            sequence += len(windows)
            held = []

        waiting = 0
        for batch in batches:
            found = codec.encode_batch(batch.column("text"), end_id)
            ids = np.concatenate([[0], np.cumsum(found.counts)])
            pieces = np.concatenate([[0], np.cumsum(found.pieces)])
            for k, (shard_of, doc_id) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist())):
                shard, part = shard_of, slice(pieces[k], pieces[k + 1])
                cuts = _cut_points(found.lengths[part], found.sentence_ends[part], sentence_penalty, inside_penalty, long_gap)
                held.append((doc_id, found.ids[ids[k] : ids[k + 1]], *cuts))
                waiting += int(found.counts[k])
                if waiting >= stretch:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    spark = docs.sparkSession
    path = fresh_path(spark, "packed")
    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", shards)
    ordered.mapInArrow(packed, PIECE_COLUMNS).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(PIECE_COLUMNS).parquet(path)
    totals = pieces.groupBy("shard").agg((F.max("shard_sequence") + 1).alias("total"))
    bases = running_start(totals, "shard", "total")  # one row per shard
    return pieces.join(F.broadcast(bases), "shard").select(
        "doc_id", "start", "length", "doc_tokens", (F.col("before") + F.col("shard_sequence")).alias("sequence_id"),
        "offset", "token_ids")


def with_checksums(pieces: DataFrame) -> DataFrame:
    """``token_ids`` replaced by ``ids_crc32``, the unsigned crc32 of the ids as little-endian 32-bit integers."""
    kept = [c for c in pieces.columns if c != "token_ids"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = pa.array(id_checksums(batch.column("token_ids")), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), crcs], names=[*kept, "ids_crc32"])

    return pieces.mapInArrow(summed, ", ".join(f"{c} long" for c in kept) + ", ids_crc32 long")
