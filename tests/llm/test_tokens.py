"""Token files, packing and token counts against the libraries themselves."""

import glob
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import brute
from quillspark.llm import packing, token_counts, token_store
from quillspark.llm.bpe import PieceEncoder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTE_BPE)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PARTS = [*"ab .,'\n\tÉß日\xa0\u2003\x1c!9_▁", "<|endoftext|>", "the", " The", "’s", "\U0001F600", "  ", ".\n"]
ODD = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(group):
    encoder = test_pieces_give_the_ids_of_the_whole_text.encoder
    assert [found.tolist() for found, _, _ in encoder.encode(group)] == [ids_of(t) for t in group]


test_pieces_give_the_ids_of_the_whole_text.encoder = PieceEncoder(BYTE_BPE, limit=200, budget=50)


@settings(max_examples=150, deadline=None)
@given(ODD, st.integers(2, 12), st.integers(1, 3))
def test_spliced_counts_are_those_of_the_whole_text(text, chunk, overlap):
    counter = test_spliced_counts_are_those_of_the_whole_text.counter
    counter.chunk, counter.overlap = chunk, overlap
    for t in (text, text * 7):
        assert counter.count(t) == len(MODEL.encode(t))


test_spliced_counts_are_those_of_the_whole_text.counter = token_counts.SpliceCounter(PIECES)


def test_widens_where_no_boundary_is_stable():
    counter = token_counts.SpliceCounter(PIECES, chunk=64, overlap=4)
    assert counter.count("e" * 1000) == len(MODEL.encode("e" * 1000))
    assert counter.widened > 0


def test_token_files(llm, docs, sample, tmp_path):
    path = str(tmp_path / "ids")
    token_store.write_tokens(docs, path, BYTE_BPE, shards=4)
    got = token_store.checksums(token_store.read_tokens(llm, path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(ids_of(t)) + 1, brute.crc(ids_of(t) + [0])) for i, t, _ in sample)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert [-1 if r.doc_id is None else r.doc_id for r in ordered] == sorted(-1 if i is None else i for i, _, _ in sample)
    meta = token_store.read_metadata(llm, path)
    assert "token_ids" not in meta.columns and meta.count() == len(sample)
    some = token_store.read_tokens(llm, path, 9, 12)
    assert {r.doc_id for r in some.collect()} == {9, 10, 11, 12}
    assert "doc_id" in some._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_token_files_layout(llm, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_store.write_tokens(docs, path, BYTE_BPE, shards=1)
    file = pq.ParquetFile(sorted(glob.glob(f"{path}/*.parquet"))[0]).metadata
    columns = {file.row_group(0).column(k).path_in_schema: file.row_group(0).column(k) for k in range(file.num_columns)}
    assert "RLE_DICTIONARY" in columns["token_ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_no_documents(llm, none, tmp_path):
    token_store.write_tokens(none, str(tmp_path / "ids"), BYTE_BPE)
    assert token_store.read_tokens(llm, str(tmp_path / "ids")).count() == 0
    assert packing.pack(none, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(none, PIECES).count() == 0


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


@pytest.mark.parametrize("seed", range(8))
def test_windows_cost_least(seed):
    random = np.random.default_rng(seed)
    places = np.concatenate([[0], np.cumsum(random.integers(1, 9, 40))])
    penalties = random.choice([0.0, 3.0, 9.0], len(places))
    capacity, buckets = 16, [4, 8]
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = int(places[j] - places[i])
            if size <= capacity:
                pad = 0 if size in (*buckets, capacity) else capacity - size
                best[j] = min(best[j], best[i] + pad + penalties[j])
    ends = packing.window_cuts(places, penalties, capacity, buckets)
    cost = 0.0
    for i, j in zip([0, *ends], ends):
        size = int(places[j] - places[i])
        assert 0 < size <= capacity
        cost += (0 if size in (*buckets, capacity) else capacity - size) + penalties[j]
    assert ends[-1] == len(places) - 1 and cost == pytest.approx(best[-1])


@pytest.mark.parametrize("stretch", [1 << 20, 300])
def test_packing_holds_every_id_once(docs, sample, stretch):
    pieces = packing.pack(docs, BYTE_BPE, shards=3, stretch=stretch).collect()
    sequences, parts = {}, {}
    for r in pieces:
        assert len(r.token_ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, list(r.token_ids)))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    expected = {}
    for i, t, _ in sample:
        expected.setdefault((i, len(ids_of(t)) + 1), []).extend(ids_of(t) + [1])
    got = {k: [x for _, ids in sorted(v, key=lambda p: p[0]) for x in ids] for k, v in parts.items() if k[0] != 13}
    assert got == {k: v for k, v in expected.items() if k[0] != 13}
    assert sum(len(r.token_ids) for r in pieces if r.doc_id == 13) == 2 * (len(ids_of("twice " * 50)) + 1)


def test_packing_pads_little(llm):
    rows = [(i, "Some sentence of a few words. " * (3 + i % 40)) for i in range(300)]
    pieces = packing.pack(llm.createDataFrame(rows, "doc_id long, text string"), BYTE_BPE, shards=1)
    sizes = [r["n"] for r in pieces.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()]
    assert sum(padding(n, 2048) for n in sizes) < 0.03 * sum(sizes)


def test_cut_inside_a_single_long_word(llm):
    text = "x1" * 20_000
    pieces = packing.pack(llm.createDataFrame([(1, text)], "doc_id long, text string"), BYTE_BPE, shards=1).collect()
    ids = [x for r in sorted(pieces, key=lambda r: r.start) for x in r.token_ids]
    assert ids == ids_of(text) + [1] and max(r.length for r in pieces) <= 2048


def test_counts_of_the_sample(docs, sample):
    got = token_counts.count_tokens(docs, PIECES, chunk=500, overlap=8).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(i), len((t or "").encode()), n := len(MODEL.encode(t or "")), n > 4096) for i, t, _ in sample)


def test_heavy_keys_are_parted(llm):
    """A third of the rows has one id and a third has none: no shard holds either, and the order is kept."""
    from quillspark.llm import common

    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}", "x") for i in range(6000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, other string").repartition(5)
    for shards in (1, 2, 12):
        placed = common.in_order(docs, "doc_id", shards)
        found = placed.select("shard", "doc_id", F.spark_partition_id().alias("task"), F.xxhash64("text", "other").alias("tie")).collect()
        assert len(found) == 6000 and all(r["task"] == r["shard"] for r in found)
        sizes = Counter(r["shard"] for r in found)
        if shards == 12:
            assert max(sizes.values()) <= 2 * 6000 / 12
        keys = [(r["shard"], r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]) for r in found]
        ordered = sorted(keys)
        # Shards follow the order of id and hash.
        assert [k[1:] for k in ordered] == sorted(k[1:] for k in keys)


def test_heavy_keys_keep_their_tokens(llm, tmp_path):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}, one two") for i in range(600)]
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "tokens")
    token_store.write_tokens(docs, path, BYTE_BPE, shards=8)
    found = sorted(token_store.checksums(token_store.read_tokens(llm, path)).collect(), key=lambda r: r["start"])
    assert len(found) == 600 and found[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    pieces = packing.pack(docs, BYTE_BPE, shards=8).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in found)
