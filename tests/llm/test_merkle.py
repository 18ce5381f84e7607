"""Merkle manifests against a plain version."""

import zlib
from collections import Counter, defaultdict

import pytest

import brute
from quillspark.llm import merkle

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def leaf(row):
    return brute.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def above(nodes):
    return [brute.sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]


def path(nodes, place):
    """Siblings (left, right) by level, and the last digest."""
    steps = []
    while len(nodes) > 1:
        run = place // 16 * 16
        steps.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 16])))
        nodes, place = above(nodes), place // 16
    return steps, nodes[0]


def plain(rows):
    """(doc_id, source, lang, n_chars, text) to the query's rows."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(((row[0] is not None, row[0] or 0, leaf(row)), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for name in names:
        groups[name].sort(key=lambda pair: pair[0])
        subs.append(path([key[2] for key, _ in groups[name]], 0)[1])
    out = []
    for at, name in enumerate(names):
        leaves = [key[2] for key, _ in groups[name]]
        for place, (_, row) in enumerate(groups[name]):
            steps, sub = path(leaves, place)
            more, root = path(subs, at)
            given = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                given = leaf((*row[:4], row[4].translate(LOW)))
            proof = "".join(left + right for left, right in steps + more)
            for left, right in steps + more:
                given = brute.sha(left + given + right)
            out.append((row[0], leaf(row), sub, root, brute.sha(proof), given, given == root))
    return out


COLUMNS = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def table(llm, rows):
    data = [(i, s, la, n, t, "x", 1, "y") for i, s, la, n, t in rows]
    return llm.createDataFrame(
        data, "doc_id long, source string, lang string, n_chars long, text string, key string, digest int, tree string").repartition(3)


def test_odd_rows(llm, sample):
    rows = [(i, s, None if s == "c" else "en", None if t is None else len(t), t) for i, t, s in sample]
    assert found(merkle.tampered(table(llm, rows))) == Counter(plain(rows))


@pytest.mark.parametrize("levels", [1, 3])
def test_many_rounds(llm, levels):
    """Blocks of 16 leaves take three rounds for a group of a thousand; groups of 1, 16, 17, and a forest of over 16."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(1000)]
    for k, size in enumerate([1, 16, 17, 33] + [2] * 30):
        rows += [(5000 + 100 * k + i, f"s{k}é", "en", None, f"Other {i}" if i else None) for i in range(size)]
    rows += [(None, None, None, None, None)] * 20
    assert found(merkle.tampered(table(llm, rows), levels=levels)) == Counter(plain(rows))


def test_proofs_fold_to_the_root(llm):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(200)]
    made = merkle.proofs(table(llm, rows)).collect()
    assert len(made) == 200 and len({r.root for r in made}) == 1
    assert all(merkle.folded(r.leaf, r.proof) == r.root for r in made)
    assert merkle.folded(made[0].leaf, made[1].proof) != made[0].root


def test_one_changed_row_changes_the_root(llm):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(50)]
    before = merkle.manifest(table(llm, rows))
    rows[17] = (17, "s", "en", 17, "text 17")
    after = merkle.manifest(table(llm, rows))
    assert before.root != after.root and before.subroots.count() == 1


def test_no_documents(llm, none):
    made = merkle.manifest(none)
    assert made.root is None and made.subroots.count() == 0
    assert merkle.tampered(none).count() == 0 and merkle.proofs(none).count() == 0


def test_sweeps():
    leaves = [f"{i}" for i in range(300)]
    found_levels = merkle.forward(leaves, 3)
    assert [len(level) for level in found_levels] == [300, 19, 2, 1]
    proofs = dict(merkle.backward(found_levels, ""))
    assert sorted(proofs) == list(range(300))
    assert all(merkle.folded(leaves[i], p) == found_levels[3][0] for i, p in proofs.items())
