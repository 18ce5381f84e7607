"""Near duplicates, repeated passages and benchmark passages."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark import SparkContext

import brute
from quillspark.llm import fm_index, lsh_forest, superkmers
from quillspark.llm.common import components, keyed


def near_rows(found):
    return Counter((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in found.collect())


def near_expected(rows):
    pairs = brute.near([t for _, t in rows])
    label = brute.groups(len(rows), pairs)
    words = [tuple(brute.space_words(t)) for _, t in rows]
    sets = [frozenset(w[i : i + min(5, len(w))] for i in range(len(w) - min(5, len(w)) + 1)) if w else None for w in words]
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        links = sum(a == i for a, _ in pairs)
        copies = 1 + sum(j != i and sets[j] is not None and sets[j] == sets[i] for j in range(len(rows)))
        out[str(doc_id), str(min(ids) if ids else None), links, copies] += 1
    return out


@pytest.mark.parametrize("settings", [{}, {"block_docs": 1}])
def test_near_duplicates(docs, sample, settings):
    assert near_rows(lsh_forest.near_duplicates(docs, **settings)) == near_expected([(i, t) for i, t, _ in sample])


@pytest.mark.parametrize("block_docs", [256, 7])
def test_large_group_of_near_copies(llm, block_docs):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:60], f"own{i}", *words[61:]])) for i in range(60)]
    rows += [(100 + i, " ".join([*words[:60], f"own{i}", *words[61:], *[f"more{i}x{k}" for k in range(9)]])) for i in range(20)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(lsh_forest.near_duplicates(docs, block_docs=block_docs)) == near_expected(rows)


def test_recall_at_the_threshold(llm):
    """Pairs just above the threshold, against brute force."""
    random = np.random.default_rng(3)
    rows = []
    for k in range(150):
        words = [f"d{k}w{i}" for i in range(100)]
        rows.append((2 * k, " ".join(words)))
        for at in random.choice([20, 60], 2, replace=False)[:2]:
            words[at] = f"changed{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    expected = brute.near([t for _, t in rows])
    got = sum(r.n_links for r in lsh_forest.near_duplicates(docs).collect())
    assert len(expected) == 300 and got >= 0.99 * len(expected)


def test_depth_follows_the_documents(llm):
    """Copies that differ in a word behind are met at the deepest prefix; pairs at the threshold need shorter ones."""
    close = [(3 * g + k, " ".join([*(f"g{g}w{i}" for i in range(60)), *(["more"] * (k > 0)), *(["still"] * (k > 1))]))
             for g in range(400) for k in range(3)]
    told = []
    found = lsh_forest.near_duplicates(llm.createDataFrame(close, "doc_id long, text string"), told=told).collect()
    assert [depth for depth, _ in told] == [8] and told[0][1] >= 0.9999
    assert all(r.n_links == 2 and r.class_id == r.doc_id // 3 * 3 for r in found)
    far = []
    for g in range(1100):
        words = [f"g{g}w{i}" for i in range(100)]
        far.append((2 * g, " ".join(words)))
        words[30], words[70] = "changed", "altered"
        far.append((2 * g + 1, " ".join(words)))
    told = []
    found = lsh_forest.near_duplicates(llm.createDataFrame(far, "doc_id long, text string"), told=told).collect()
    depths, shares = zip(*told)
    assert depths[0] == 8 and depths[-1] == 6 and list(shares) == sorted(shares) and shares[0] < 0.9999
    # What is found: links of 86 of 106 runs, all but a few of them.
    assert sum(r.n_links for r in found) >= 0.999 * 2200 and max(r.n_links for r in found) == 1


def test_trie_links_the_runs_of_every_depth(llm):
    """Links of d and more values connect just the classes that share d values in some tree, over task bounds too."""
    random = np.random.default_rng(5)
    trees, deepest = 3, 4
    signs = random.integers(0, 3, (200, trees, deepest))
    rows = [(k, s.astype(">u2").tobytes()) for k, s in enumerate(signs)]
    classes = llm.createDataFrame(rows, "cls long, signatures binary").repartition(5)
    links = [(r.a, r.b, r.depth) for r in lsh_forest.trie(classes, trees, deepest, 2).collect()]
    assert all(d >= 2 for *_, d in links)
    for depth in (2, 3, 4):
        expected, got = list(range(200)), list(range(200))

        def root(label, x):
            while label[x] != x:
                x = label[x]
            return x

        for tree in range(trees):
            first = {}
            for k in range(200):
                head = first.setdefault(tuple(signs[k, tree, :depth]), k)
                a, b = root(expected, k), root(expected, head)
                expected[max(a, b)] = min(a, b)
        for a, b, d in links:
            if d >= depth:
                a, b = root(got, a), root(got, b)
                got[max(a, b)] = min(a, b)
        assert [root(expected, k) for k in range(200)] == [root(got, k) for k in range(200)]


def test_prefix_is_shortened_to_the_recall():
    length = lsh_forest.prefix_length(0.8, 32, 8, 0.9999)
    reach = lambda k: 1 - (1 - 0.8**k) ** 32
    assert reach(length) >= 0.9999 > reach(length + 1)
    assert lsh_forest.prefix_length(0.8, 32, 8, 0.5) == 8 and lsh_forest.prefix_length(0.5, 1, 8, 0.999) == 1


def test_one_of_each(docs, sample):
    kept = lsh_forest.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(i, t) for i, t, _ in sample]
    label = brute.groups(len(rows), brute.near([t for _, t in rows]))
    got = Counter(r.text for r in kept.collect())
    assert sum(got.values()) == len(set(label))
    assert (9 in {r.doc_id for r in kept.collect()}) and not {10, 11} & {r.doc_id for r in kept.collect()}
    assert got["twice " * 50] == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(llm, seed):
    random = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)]
    got = dict(components(llm.createDataFrame(edges, "a long, b long"), "test").collect())
    label = brute.groups(300, edges + [(b, a) for a, b in edges])
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in used}


def kept_rows(found):
    return Counter((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found.collect())


@pytest.mark.parametrize("settings", [{}, {"hot": 0}, {"hot": 2}, {"chunk_words": 10, "slot_bits": 16}, {"mer": 1}, {"mer": 35}])
def test_repeated_runs(docs, sample, settings):
    kept = brute.repeats([t for _, t, _ in sample])
    expected = Counter(
        (str(i), len(brute.space_words(t)), len(brute.space_words(t)) - len(k), b" ".join(k).decode())
        for (i, t, _), k in zip(sample, kept))
    assert kept_rows(superkmers.removals(docs, **settings)) == expected


def test_deduplicated_keeps_what_repeats_nothing(docs, sample):
    out = superkmers.deduplicated(docs)
    assert out.columns == docs.columns
    got = Counter((str(r.doc_id), r.text) for r in out.collect())
    expected = Counter()
    for (i, t, _), k in zip(sample, brute.repeats([t for _, t, _ in sample])):
        if len(k) == len(brute.space_words(t)):
            expected[str(i), t] += 1
        elif k:
            expected[str(i), b" ".join(k).decode()] += 1
    assert got == expected


@pytest.mark.parametrize("seed", range(5))
def test_minimisers(seed):
    random = np.random.default_rng(seed)
    hashes = random.integers(0, 6, 200).astype(np.uint64)
    least, places = superkmers.minimisers(hashes, 12, 3)
    mers = superkmers.gram_hashes(hashes, 3)
    assert least.tolist() == [mers[i : i + 10].min() for i in range(len(hashes) - 11)]
    own = [p for p in range(len(mers)) if any(least[i] == mers[p] for i in range(max(0, p - 9), min(len(least), p + 1)))]
    assert places.tolist() == mers[own].tolist()
    first, end = superkmers.runs(least)
    assert first[0] == 0 and end[-1] == len(least) and (first[1:] == end[:-1]).all()
    assert (end - first).max() <= superkmers.LONGEST


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(superkmers, "gram_hashes", lambda ids, size: np.zeros(len(ids) - size + 1, dtype=np.uint64))
    got = superkmers.repeated_windows([b"a b c d", b"b c x", b"a b"], 2)
    assert [x.tolist() for x in got] == [[True, True, False], [True, False], [True]]


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    random = np.random.default_rng(seed)
    symbols = random.integers(0, 5, 400).astype(np.int64)
    symbols[-1] = 0
    starts = np.append(0, np.flatnonzero(symbols[:-1] == 0) + 1)
    order = fm_index.suffix_order(symbols.copy())
    rank = {p: k for k, p in enumerate(np.flatnonzero(symbols == 0))}
    text = [(1, int(s)) if s else (0, rank[p]) for p, s in enumerate(symbols)]

    def suffix(p):
        end = next(k for k in range(p, len(text)) if text[k][0] == 0)
        return text[p : end + 1]

    assert order.tolist() == sorted(range(len(symbols)), key=suffix)
    index = fm_index.Index.build(symbols, starts)
    phrases = random.integers(1, 5, (60, 4)).astype(np.int64)
    lengths = random.integers(1, 5, 60)
    low, high = index.search(phrases, lengths)
    for row, n, a, b in zip(phrases, lengths, low, high):
        expected = [i for i in range(len(symbols) - n + 1) if (symbols[i : i + n] == row[:n]).all()]
        assert sorted(index.place(np.arange(a, b)).tolist()) == expected


ITEMS = [
    (1, " ".join(f"passage{i}" for i in range(5, 30))), (2, "QUICK brown-fox"), (3, None), (4, "..."), (5, "one two three"),
    (5, "one two three"), (6, " ".join(f"absent{i}" for i in range(20))), (None, "lazy dog"), (7, "x"),
]


@pytest.mark.parametrize("settings", [{}, {"block_words": 3}, {"shard_words": 5}])
def test_contamination(llm, docs, sample, settings):
    items = llm.createDataFrame([(i, t, "extra") for i, t in ITEMS], "item_id long, text string, spans string")
    found = fm_index.scanned(docs, items, **settings).collect()
    got = Counter((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    expected = Counter(
        (str(i), n, hit, len(ids), brute.sha(",".join(ids)), hit > 0 and 20 * hit >= n)
        for (i, _, _), (n, hit, ids) in zip(sample, brute.contamination([t for _, t, _ in sample], ITEMS)))
    assert got == expected
    assert all(sum(s.end - s.first for s in r.spans) == r.n_hit for r in found)


def test_benchmark_reaches_the_driver_in_blocks(llm, docs, sample, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("all items on the driver")

    sent, broadcast = [], SparkContext.broadcast

    def watched(self, value):
        if isinstance(value, fm_index.Phrases):
            assert not any(os.path.exists(b._path) for b in sent)  # the block before is gone
            sent.append(broadcast(self, value))
            return sent[-1]
        return broadcast(self, value)

    monkeypatch.setattr(type(docs), "toLocalIterator", refused)
    monkeypatch.setattr(SparkContext, "broadcast", watched)
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    got = fm_index.scanned(docs, items, block_words=20).collect()
    expected = brute.contamination([t for _, t, _ in sample], ITEMS)
    assert Counter((r.n_words, r.n_hit, r.n_items) for r in got) == Counter((n, hit, len(ids)) for n, hit, ids in expected)
    assert len(sent) > 5


def test_decontaminated(llm, docs, sample):
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    out = fm_index.decontaminated(docs, items)
    assert out.columns == docs.columns
    clean = [
        (str(i), str(t)) for (i, t, _), (n, hit, _) in zip(sample, brute.contamination([t for _, t, _ in sample], ITEMS))
        if not (hit and 20 * hit >= n)]
    assert Counter((str(r.doc_id), str(r.text)) for r in out.collect()) == Counter(clean)


def test_no_documents(llm, none):
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    assert lsh_forest.near_duplicates(none).count() == 0 and lsh_forest.one_of_each(none).count() == 0
    assert superkmers.removals(none).count() == 0 and superkmers.deduplicated(none).count() == 0
    assert fm_index.scanned(none, items).count() == 0 and fm_index.decontaminated(none, items).count() == 0


def test_no_items(llm, docs, sample):
    items = llm.createDataFrame([], "item_id long, text string")
    found = fm_index.scanned(docs, items).collect()
    assert len(found) == len(sample) and not any(r.contaminated or r.n_hit for r in found)


def test_only_equal_rows_share_keys(docs, sample):
    keys = keyed(docs).select("_k1", "_k2").distinct().count()
    assert keys == len({(i, t or "") for i, t, _ in sample})
