"""Distinct n-grams of groups of any size, counted by fingerprints in sorted blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fingerprints that a task sorts at once: about 200 MB of its Python worker.
BLOCK_GRAMS = 1 << 22

# Odd numbers that mix the words of an n-gram, of 64 and of 32 bits, and one that keeps cells apart.
_MIX, _MIX_TAIL, _CELL = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B), np.uint64(0xC2B2AE3D27D4EB4F)

_Prints = tuple[np.ndarray, np.ndarray, np.ndarray]


def distinct_grams(rows: DataFrame, group: str, tokens: Column, orders: Sequence[int], buckets: int) -> DataFrame:
    """``group`` and ``_d{n}``: the distinct n-grams of its texts; groups without any of them are left out.

    ``group`` is a whole number, not negative. An n-gram's fingerprint has 80 bits, of two hashes of its words,
    and is compared together with group and order: of 2.5 billion n-grams any two are taken for one with a chance of
    3 in a million. Each task sorts blocks of fingerprints, drops those that come twice, and cuts the rest at fixed
    bounds into buckets, so an n-gram or a group that is everywhere fills no bucket more than others.
    """
    hashed = F.transform(tokens, lambda t: F.struct(F.xxhash64(t).alias("head"), F.hash(t).alias("tail")))
    blocks = rows.select(F.col(group).cast("bigint").alias("_group"), hashed.alias("_words")).mapInArrow(
        _cut(list(orders), buckets), "bucket int, heads binary, tails binary, cells binary")
    # The number of partitions is given: adaptive execution would merge them by bytes.
    counted = blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_counted, "cell bigint, n bigint")
    place = F.col("cell") % len(orders)
    return counted.groupBy(F.expr(f"cell div {len(orders)}").alias(group)).agg(
        *[F.sum(F.when(place == k, F.col("n"))).alias(f"_d{n}") for k, n in enumerate(orders)])


def _cut(orders: list[int], buckets: int) -> Callable:
    step = max(1, BLOCK_GRAMS // len(orders))
    width = 2**64 // buckets + 1
    bounds = np.array([k * width for k in range(1, buckets)], dtype=np.uint64)

    def block(held: list[_Prints]) -> pa.RecordBatch:
        heads, tails, cells = _unique(*map(np.concatenate, zip(*held)))
        cuts = [0, *np.searchsorted(heads, bounds).tolist(), len(heads)]
        full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
        parts = [slice(cuts[k], cuts[k + 1]) for k in full]
        return pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()),
            pa.array([_packed(heads[part]) for part in parts], pa.binary()),
            pa.array([tails[part].tobytes() for part in parts], pa.binary()),
            pa.array([cells[part].astype(np.min_scalar_type(cells[part].max())).tobytes() for part in parts], pa.binary()),
        ], names=["bucket", "heads", "tails", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Prints] = []
        size = 0
        for batch in batches:
            for prints in _prints(batch, orders, step):
                held.append(prints)
                size += len(prints[0])
                if size >= BLOCK_GRAMS:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return run


def _prints(batch: pa.RecordBatch, orders: list[int], step: int) -> Iterator[_Prints]:
    """Fingerprints of the n-grams that start at ``step`` words of a batch of texts, and on."""
    lists = batch.column(1)
    words = lists.flatten().flatten()
    heads, tails = words[0].to_numpy().view(np.uint64), words[1].to_numpy().view(np.uint32)
    lengths = lists.value_lengths().to_numpy()
    groups = np.repeat(batch.column(0).to_numpy().astype(np.uint64), lengths)
    room = np.repeat(np.cumsum(lengths, dtype=np.int64), lengths) - np.arange(len(heads))
    span = max(orders)
    for at in range(0, len(heads), step):
        here = slice(at, at + step)
        rooms, cells = room[here], groups[here] * np.uint64(len(orders))
        size = len(rooms)
        ahead = np.zeros(size + span, dtype=np.uint64), np.zeros(size + span, dtype=np.uint32)
        for padded, whole in zip(ahead, (heads, tails)):
            found = whole[at:at + size + span]
            padded[:len(found)] = found
        head, tail = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint32)
        for n in range(1, span + 1):
            head = (head ^ (head >> np.uint64(32))) * _MIX + ahead[0][n - 1:n - 1 + size]
            tail = (tail ^ (tail >> np.uint32(16))) * _MIX_TAIL + ahead[1][n - 1:n - 1 + size]
            if n in orders:
                fit = rooms >= n
                cell = cells[fit] + np.uint64(orders.index(n))
                found = head[fit]
                yield ((found ^ (found >> np.uint64(32))) * _MIX + cell * _CELL,
                       (tail[fit] >> np.uint32(16)).astype(np.uint16), cell)


def _unique(heads: np.ndarray, tails: np.ndarray, cells: np.ndarray) -> _Prints:
    """Fingerprints that differ, sorted."""
    order = np.argsort(heads)
    heads, tails, cells = heads[order], tails[order], cells[order]
    same = heads[1:] == heads[:-1]
    alike = (tails[1:] == tails[:-1]) & (cells[1:] == cells[:-1])
    if (same & ~alike).any():  # equal heads of different n-grams, in any order
        order = np.lexsort((cells, tails, heads))
        heads, tails, cells = heads[order], tails[order], cells[order]
        alike = (tails[1:] == tails[:-1]) & (cells[1:] == cells[:-1])
    new = np.ones(len(heads), dtype=bool)
    new[1:] = ~(same & alike)
    return heads[new], tails[new], cells[new]


def _packed(heads: np.ndarray) -> bytes:
    """Sorted numbers as steps, byte by byte: the highest bytes are zeros, which the shuffle's compression drops."""
    return np.diff(heads, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(heads: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(heads, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _counted(bucket: pa.Table) -> pa.Table:
    blocks = []
    for row in bucket.select(["heads", "tails", "cells"]).to_pylist():
        heads = _unpacked(row["heads"])
        kind = np.dtype(f"u{len(row['cells']) // len(heads)}")
        blocks.append((heads, np.frombuffer(row["tails"], dtype=np.uint16), np.frombuffer(row["cells"], dtype=kind)))
    cells, n = np.unique(_unique(*map(np.concatenate, zip(*blocks)))[2], return_counts=True)
    return pa.table({"cell": cells.astype(np.int64), "n": n.astype(np.int64)})
