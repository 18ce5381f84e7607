"""Grams of texts as sorted blocks of fingerprints: they ask a model's counts bucket by bucket, and answers come home.

A block holds the words of some texts as numbers of its own list of words. Of its grams each distinct one travels once,
however often it occurs there, and what comes back is as long as what was asked and in the same order. So no key is heavy in any
bucket, and nothing travels per word but the block itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

# Rows that travel. ``kind`` is 0 for a block itself, else the order of the grams; ``block`` is MODEL for rows of a model.
# ``bucket`` is the task that answers, ``slot`` the one where a block and its answers meet.
ROWS = ("slot int, bucket int, block bigint, kind int, heads binary, tails binary, counts binary, lengths binary, "
        "once bigint, twice bigint, kinds bigint, total bigint")
SCHEMA = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()),
                    *[(name, pa.binary()) for name in ("heads", "tails", "counts", "lengths")],
                    *[(name, pa.int64()) for name in ("once", "twice", "kinds", "total")]])
MODEL = -1

# Odd numbers that mix the words of a gram, of 64 and of 32 bits.
_MIX, _MIX_TAIL = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B)


@dataclass
class Block:
    """Texts as numbers of words; a text, or a piece of one, begins with the two words or start marks before it."""

    codes: np.ndarray  # into heads and tails, which are distinct, common words first
    lengths: np.ndarray  # of each piece, the two before it included
    heads: np.ndarray
    tails: np.ndarray
    ids: pa.Array | None = None  # of each piece


@dataclass
class Grams:
    """Distinct grams sorted by fingerprint, of 80 bits, and the place of each among them where it ends in the block."""

    heads: np.ndarray
    tails: np.ndarray
    places: np.ndarray


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the highest bytes together and without those that are all zero, compressed."""
    used = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    raw = values.view(np.uint8).reshape(-1, values.itemsize).T[:used].tobytes() if used else b""
    return len(values).to_bytes(8, "little") + bytes([used]) + pa.compress(raw, codec="zstd", asbytes=True)


def size_of(data: bytes) -> int:
    return int.from_bytes(data[:8], "little")


def unpacked(data: bytes, kind: type = np.uint64) -> np.ndarray:
    size, used = size_of(data), data[8]
    if not used:
        return np.zeros(size, kind)
    raw = np.frombuffer(pa.decompress(memoryview(data)[9:], size * used, codec="zstd"), np.uint8)
    if used == 1:
        return raw.astype(kind)
    found = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    found[:, :used] = raw.reshape(used, -1).T
    return found.view(kind).ravel()


def _stepped(heads: np.ndarray) -> bytes:
    """Sorted numbers as steps, whose highest bytes are alike."""
    return packed(np.diff(heads, prepend=np.uint64(0)))


def _unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def word_prints(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    digests = b"".join([hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).digest() for word in words])
    found = np.frombuffer(digests, np.dtype([("head", "<u8"), ("tail", "<u4")]))
    return found["head"].copy(), found["tail"].copy()


def _order(heads: np.ndarray) -> np.ndarray:
    """The order of numbers; they are sorted by their upper bits together with their places, which is faster than by reference."""
    bits = np.uint64(max(1, len(heads)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = (heads & ~low) | np.arange(len(heads), dtype=np.uint64)
    keys.sort()
    order = (keys & low).astype(np.int64)
    found = heads[order]
    return np.argsort(heads) if (found[1:] < found[:-1]).any() else order


def ranked(heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints, sorted, and the place of each given one among them."""
    order = _order(heads)
    first, second = heads[order], tails[order]
    same, alike = first[1:] == first[:-1], second[1:] == second[:-1]
    if (same & ~alike).any():  # equal heads of different grams, in any order
        order = np.lexsort((tails, heads))
        second = tails[order]
        alike = second[1:] == second[:-1]
    new = np.ones(len(heads), dtype=bool)
    new[1:] = ~(same & alike)
    places = np.empty(len(heads), dtype=np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return first[new], second[new], places


def _mixed(heads: np.ndarray) -> np.ndarray:
    return (heads ^ (heads >> np.uint64(32))) * _MIX


def _mixed_tail(tails: np.ndarray) -> np.ndarray:
    return (tails ^ (tails >> np.uint32(16))) * _MIX_TAIL


def _grams(heads: np.ndarray, tails: np.ndarray) -> Grams:
    return Grams(*ranked(_mixed(heads), (tails >> np.uint32(16)).astype(np.uint16)))


class Counted:
    """A block's places and grams: ``at`` is where a word ends a trigram, ``pair_at`` where one ends a pair."""

    def __init__(self, block: Block):
        self.block, size = block, len(block.codes)
        starts = np.cumsum(block.lengths, dtype=np.int64) - block.lengths
        behind = np.ones(size, dtype=bool)
        behind[starts] = False
        self.pair_at = np.flatnonzero(behind)
        behind[starts + 1] = False
        self.at = np.flatnonzero(behind)
        self.piece = np.repeat(np.arange(len(starts)), block.lengths)[self.at]
        self._heads, self._tails = block.heads[block.codes], block.tails[block.codes]
        self._pair_heads, self._pair_tails = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
        self._pair_heads[1:] = _mixed(self._heads[:-1]) + self._heads[1:]
        self._pair_tails[1:] = _mixed_tail(self._tails[:-1]) + self._tails[1:]

    def words(self) -> Grams:
        """Places are those of the codes."""
        return _grams(self.block.heads, self.block.tails)

    def pairs(self) -> Grams:
        """Places are those of all words of the block; a piece's first ends none."""
        found = _grams(self._pair_heads[self.pair_at], self._pair_tails[self.pair_at])
        places = np.zeros(len(self.block.codes), dtype=np.int32)
        places[self.pair_at] = found.places
        return Grams(found.heads, found.tails, places)

    def triples(self) -> Grams:
        """Places are those of ``at``."""
        at = self.at
        return _grams(_mixed(self._pair_heads[at - 1]) + self._heads[at], _mixed_tail(self._pair_tails[at - 1]) + self._tails[at])


def _cut(batches: list[pa.RecordBatch], size: int) -> Iterator[Block]:
    """The texts of batches in blocks of ``size`` words, up to twice that; a text that is cut goes on behind its last two words."""
    ids, lists = (pa.concat_arrays([batch.column(k) for batch in batches]) for k in (0, 1))
    batches.clear()
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
    heads, tails = word_prints(coded.dictionary.to_pylist())
    del coded, lists  # the words themselves are not needed any more
    parts = max(1, len(codes) // size)
    cuts = [0]
    for k in range(1, parts):
        cut = len(codes) * k // parts
        text = int(np.searchsorted(starts, cut, "right")) - 1
        cut = cut if cut - starts[text] > 2 else int(starts[text])
        if cut > cuts[-1]:
            cuts.append(cut)
    for low, high in zip(cuts, [*cuts[1:], len(codes)]):
        first, last = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high, "left"))
        own = starts[first:last].copy()
        own[0] = low if low == own[0] else low - 2
        part = codes[own[0]:high]
        times = np.bincount(part, minlength=len(heads))
        common = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
        places = np.zeros(len(heads), dtype=np.uint32)
        places[common] = np.arange(len(common), dtype=np.uint32)
        yield Block(places[part], np.diff(own, append=high), heads[common], tails[common], ids.slice(first, last - first))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            words += pc.sum(batch.column(1).value_lengths()).as_py()
        del batch
        if words >= size:
            yield from _cut(held, size)
            words = 0
    if held:
        yield from _cut(held, size)


def block_row(block: Block, slot: int, number: int, buckets: int) -> dict:
    words = len(block.codes) - 2 * len(block.lengths)
    return {"slot": slot, "bucket": slot % buckets, "block": number, "kind": 0, "heads": block.heads.tobytes(), "tails": block.tails.tobytes(),
            "counts": packed(block.codes), "lengths": packed(block.lengths.astype(np.uint32)), "total": words}


def block_of(row: dict) -> Block:
    return Block(unpacked(row["counts"], np.uint32), unpacked(row["lengths"], np.uint32).astype(np.int64),
                 np.frombuffer(row["heads"], np.uint64), np.frombuffer(row["tails"], np.uint32))


def cut_rows(grams: Grams, counts: Sequence[np.ndarray], buckets: int, **row: int) -> list[dict]:
    """Grams and their counts, a row for each bucket that has any; buckets are equal ranges of fingerprints, a power of two."""
    bits = buckets.bit_length() - 1
    bounds = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    cuts = [0, *np.searchsorted(grams.heads, bounds).tolist(), len(grams.heads)]
    rows = []
    for bucket in range(buckets):
        part = slice(cuts[bucket], cuts[bucket + 1])
        if part.start < part.stop:
            rows.append(row | {"bucket": bucket, "heads": _stepped(grams.heads[part]), "tails": packed(grams.tails[part]),
                               "counts": packed(np.concatenate([c[part] for c in counts])) if counts else None})
    return rows


def as_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=SCHEMA)


def answer_of(rows: list[dict], kind: int, width: int) -> np.ndarray:
    """What came back for a block's grams of one order, ``width`` numbers each."""
    own = sorted((row for row in rows if row["kind"] == kind), key=lambda row: row["bucket"])
    if not own:
        return np.zeros((width, 0), np.uint64)
    return np.concatenate([unpacked(row["counts"]).reshape(width, -1) for row in own], axis=1)


def each_block(ask: Callable[[Block, list[dict]], list[dict]]) -> Callable[[pa.Table], pa.Table]:
    """For a group of a block and its answers: the rows that ``ask`` makes of them."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        home = next(row for row in rows if row["kind"] == 0)
        own = {"slot": home["slot"], "block": home["block"]}
        return as_table([row | own for row in ask(block_of(home), rows)])

    return run


def ask_each(ask: Callable[[Block, list[dict]], list[dict]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for blocks that need no answer."""
    one = each_block(ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from one(pa.Table.from_batches([batch.slice(k, 1)])).to_batches()

    return run


def write_blocks(size: int, slots: int, buckets: int, ask: Callable[[Block, list[dict]], list[dict]],
                 with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (``id, words``), two start marks in front of each, to blocks and the rows that these ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, block in enumerate(blocks(batches, size)):
            number, slot = (task << 32) + n, (task + n) % slots
            own = {"slot": slot, "block": number}
            rows = as_table([block_row(block, slot, number, buckets), *[row | own for row in ask(block, [])]])
            if with_ids:
                ends = pa.array([0, *[len(block.ids)] * rows.num_rows], pa.int32())
                rows = rows.append_column("ids", pa.ListArray.from_arrays(ends, block.ids))
            yield from rows.to_batches()
            del rows, block
            pa.default_memory_pool().release_unused()

    return run


def merged(owner: int) -> Callable[[pa.Table], pa.Table]:
    """All blocks' counts of one order and bucket, summed as rows of the model; back goes which of its grams a block owns.

    A gram is owned by one of the blocks whose count number 0 of it is over 0, so blocks can count distinct grams.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda row: row["block"])
        heads, tails = (np.concatenate(x) for x in zip(*[(_unstepped(row["heads"]), unpacked(row["tails"], np.uint16)) for row in rows]))
        sizes = [size_of(row["tails"]) for row in rows]
        counts = np.concatenate([unpacked(row["counts"]).reshape(-1, size) for row, size in zip(rows, sizes)], axis=1)
        heads, tails, places = ranked(heads, tails)
        sums = [np.bincount(places, count, len(heads)).astype(np.uint64) for count in counts]
        mine = np.flatnonzero(counts[0])[::-1]
        first = np.full(len(heads), -1, dtype=np.int64)
        first[places[mine]] = mine  # of several the last one written, which is the first row
        owned = np.zeros(len(places), dtype=np.uint64)
        owned[first[first >= 0]] = 1
        kept = np.logical_or.reduce([count > 0 for count in sums])
        found = sums[0]
        kind, bucket = rows[0]["kind"], rows[0]["bucket"]
        made = [{"slot": 0, "bucket": bucket, "block": MODEL, "kind": kind, "heads": _stepped(heads[kept]), "tails": packed(tails[kept]),
                 "counts": packed(np.concatenate([count[kept] for count in sums])), "once": int((found == 1).sum()),
                 "twice": int((found == 2).sum()), "kinds": int((found > 0).sum()), "total": int(found.sum())}]
        ends = np.cumsum(sizes).tolist()
        if owner:
            made += [{"slot": row["slot"], "bucket": bucket, "block": row["block"], "kind": kind, "counts": packed(owned[end - size:end])}
                     for row, size, end in zip(rows, sizes, ends)]
        return as_table(made)

    return run


def recut(buckets: int, widths: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a model for as many buckets as texts ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = row["kind"]
                grams = Grams(_unstepped(row["heads"]), unpacked(row["tails"], np.uint16), np.zeros(0, np.int32))
                counts = unpacked(row["counts"]).reshape(widths[kind], -1)
                yield from as_table(cut_rows(grams, list(counts), buckets, slot=0, block=MODEL, kind=kind)).to_batches()

    return run


def _looked_up(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's grams of one order in a bucket, sorted, and their counts."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros((width, 0), np.uint64)
    heads, tails = (np.concatenate(x) for x in zip(*[(_unstepped(row["heads"]), unpacked(row["tails"], np.uint16)) for row in rows]))
    counts = np.concatenate([unpacked(row["counts"]).reshape(width, -1) for row in rows], axis=1)
    order = np.lexsort((tails, heads)) if len(rows) > 1 else slice(None)
    return heads[order], tails[order], counts[:, order]


def answered(widths: dict[int, int]) -> Callable[[pa.Table], pa.Table]:
    """The counts that a bucket's rows of a model have for grams of the same bucket, 0 for one it lacks; blocks pass."""

    def run(group: pa.Table) -> pa.Table:
        through = group.filter(pc.equal(group["kind"], 0))
        rows = group.filter(pc.greater(group["kind"], 0)).select(SCHEMA.names).to_pylist()
        made = []
        for kind, width in widths.items():
            own = [row for row in rows if row["kind"] == kind]
            heads, tails, counts = _looked_up([row for row in own if row["block"] == MODEL], width)
            for row in (row for row in own if row["block"] != MODEL):
                asked, marks = _unstepped(row["heads"]), unpacked(row["tails"], np.uint16)
                found = np.zeros((width, len(asked)), np.uint64)
                if len(heads):
                    place = np.searchsorted(heads, asked)
                    open_ = np.flatnonzero((place < len(heads)) & (heads[np.minimum(place, len(heads) - 1)] == asked))
                    while len(open_):  # more than once only where heads of different grams are equal
                        here = place[open_]
                        hit = tails[here] == marks[open_]
                        found[:, open_[hit]] = counts[:, here[hit]]
                        open_ = open_[~hit]
                        place[open_] += 1
                        open_ = open_[(place[open_] < len(heads)) & (heads[np.minimum(place[open_], len(heads) - 1)] == asked[open_])]
                made.append({"slot": row["slot"], "bucket": row["bucket"], "block": row["block"], "kind": kind,
                             "counts": packed(found.ravel())})
        answers = as_table(made)
        if "ids" in group.column_names:
            answers = answers.append_column("ids", pa.nulls(len(made), group.schema.field("ids").type))
        return pa.concat_tables([through.cast(answers.schema), answers])

    return run


def rows_type(ids: DataType) -> StructType:
    return StructType([*StructType.fromDDL(ROWS).fields, StructField("ids", ArrayType(ids))])


def by_bucket(rows: DataFrame, buckets: int, run: Callable[[pa.Table], pa.Table], kind: StructType | str = ROWS) -> DataFrame:
    return rows.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(run, kind)


def by_block(rows: DataFrame, slots: int, run: Callable[[pa.Table], pa.Table], kind: StructType | str = ROWS) -> DataFrame:
    return rows.repartitionById(slots, "slot").groupBy("slot", "block").applyInArrow(run, kind)
