"""Line rules, licence scans, quality and likelihood."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import brute
from quillspark.llm import lattice_lm, licences, line_rules, quadratic

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def lines(found):
    return Counter(tuple(str(r[c]) for c in (
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"))
        for r in found.collect())


@pytest.mark.parametrize("least", [1, 20])
def test_line_rules(docs, sample, least):
    expected = brute.line_rules([(i, s, t) for i, t, s in sample], least)
    got = line_rules.judged(docs, least_docs=least)
    assert lines(got) == Counter(tuple(map(str, row)) for row in expected)


def test_lines_count_distinct_documents(llm):
    own = "\n".join(" ".join(f"w{k}x{{0}}x{j}" for j in range(6)) for k in range(4))
    rows = [(i, "h", "Shared footer of this host here\n" + own.format(i)) for i in range(30)]
    rows += [(100 + i, "h", "A copied text line\nand ten more words on the next one") for i in range(40)]
    docs = llm.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_rules.judged(docs, least_docs=20).collect()}
    assert got[3].removed_words == 6 and got[3].kept
    assert got[103].removed_words == 0  # forty copies are one document
    cleaned = {r.doc_id: r.text for r in line_rules.cleaned(docs, least_docs=20).collect()}
    assert cleaned[3] == own.format(3)


def test_cleaned_keeps_all_columns(docs):
    out = line_rules.cleaned(docs)
    assert out.columns == docs.columns
    judged = {r.doc_id for r in line_rules.judged(docs).where("kept").collect()}
    found = out.collect()
    assert {r.doc_id for r in found} == judged and {r["_row"] for r in found} == {"row"}


def test_line_rules_reject_depleted(llm):
    rows = [(i, "h", "This boilerplate line stands in every document of the host\nmine {}".format(i)) for i in range(30)]
    docs = llm.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_rules.judged(docs, least_docs=20).collect()
    assert not any(r.kept or r.base_failed for r in got)


def test_limit_holds_in_large_hosts(llm):
    """30 documents of 2,000 are more than 20 and less than 2 %."""
    own = "\n" + " ".join(f"w{{0}}x{j}" for j in range(12))
    rows = [(i, "h", ("Shared footer of this host here" if i < 30 else f"First line of document {i}") + own.format(i))
            for i in range(2000)]
    rows += [(3000 + i, "h", "A banner in twenty documents only" + own.format(3000 + i)) for i in range(20)]
    rows += [(4000 + i, "h", "This boilerplate line stands in the place of a text" + f"\nmine {i}") for i in range(25)]
    docs = llm.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.removed_words, r.kept) for r in line_rules.judged(docs).collect()}
    assert {i for i, (removed, _) in got.items() if removed} == {*range(30), *range(4000, 4025)}
    assert got[3] == (6, True) and got[3003] == (0, True)
    assert {i for i, (_, kept) in got.items() if not kept} == set(range(4000, 4025))
    cleaned = {r.doc_id: r.text for r in line_rules.cleaned(docs).collect()}
    assert cleaned[3] == own.format(3)[1:] and 4003 not in cleaned


def test_the_sql_states_the_rule_of_large_hosts(llm):
    """2,000 texts of one host: the operator, its SQL and the plain version remove the same lines."""
    import duckdb

    own = "\n" + " ".join(f"w{{0}}x{j}" for j in range(12))
    rows = [(i, "h" if i % 50 else None, ("Shared footer of this host here" if i % 65 == 0 else f"First line of {i}") + own.format(i))
            for i in range(2000)]
    rows += [(3000 + i, "h", "A banner in twenty documents only" + own.format(3000 + i)) for i in range(20)]
    given = llm.createDataFrame(rows, "doc_id long, source string, text string")
    got = lines(line_rules.judged(given))
    assert got == Counter(tuple(map(str, row)) for row in brute.line_rules(rows, 20))
    con = duckdb.connect()
    con.register("documents", given.toPandas())
    found = con.execute(line_rules.ORACLE)
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in (
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")]
    assert got == Counter(tuple(str(row[k]) for k in at) for row in found.fetchall())
    # 31 texts hold the footer, 4 of them without a host.
    assert sum(int(row[-1]) > 0 for row in got) == 27


def test_no_documents(llm, none):
    labels = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_rules.judged(none).count() == 0
    assert line_rules.cleaned(none).count() == 0
    assert licences.scanned(none).count() == 0
    assert quadratic.scored(none, labels).count() == 0
    assert lattice_lm.scored(none, PIECES).count() == 0


def test_line_rules_run_no_python(docs):
    plan = line_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def base_places(text):
    words = brute.alnum_words(text)
    found = []
    for phrase, label in ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved")):
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


def test_licences(docs, sample, llm):
    texts = [(i, t) for i, t, _ in sample] + [
        (200, "cc-by CC BY cc by, all rights reserved all rights reserved"), (201, "xcc by ccby cc  by-sa 4.0 é"),
    ]
    got = licences.scanned(llm.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    for (_, text), r in zip(texts, got):
        n, found = base_places(text)
        labels = sorted({label for _, label in found})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), ",".join(labels))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0.0 <= r.score <= 1.0
    by_id = {r.doc_id: r for r in got}
    assert "gpl-3" in by_id[17].labels.split(",") and "cc-by-4.0" in by_id[17].labels.split(",")
    assert by_id[1].labels == "" and by_id[1].score == 0.0


@pytest.mark.parametrize("text,label", [
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"), ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
    ("Creative Commons Attribution-ShareAlike 3.0", "cc-by-sa-3.0"), ("Mozilla Public License v2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
])
def test_licence_forms(text, label):
    assert label in licences.Scanner().scan(text.encode())[5].split(",")


def test_hundreds_of_rules():
    assert len(licences.rules()) > 300
    priorities = [r.priority for r in licences.rules()]
    assert priorities == sorted(priorities)


@pytest.mark.parametrize("seed", range(20))
def test_suppression(seed):
    random = np.random.default_rng(seed)
    starts = random.integers(0, 20, 25)
    ends = starts + random.integers(1, 10, 25)
    order, priorities = random.permutation(25), random.integers(0, 3, 25)
    expected = [
        not any(
            j != i and starts[j] <= starts[i] and ends[j] >= ends[i] and priorities[j] <= priorities[i]
            and ((starts[j], ends[j]) != (starts[i], ends[i]) or priorities[j] < priorities[i] or order[j] < order[i])
            for j in range(25))
        for i in range(25)
    ]
    # A rule's priority follows its order, so of equal spans the earlier rule has no later priority.
    ranked = np.argsort(np.lexsort((order, priorities)))
    assert licences.surviving(starts, ends, ranked, priorities).tolist() == expected


def test_quality_on_held_out_rows(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quadratic.scored(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert len(rows) > 50 and sum(r.quality == r.predicted for r in rows) >= 0.97 * len(rows)


def test_quality_of_odd_rows(llm, docs, sample):
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(1, 20)] * 2 + [(None, 1, 0), (500, 1, 0)], "doc_id long, quality int, toxic int")
    got = quadratic.scored(docs, labels).collect()
    assert len(got) == len(sample) and all(0.0 <= r.score <= 1.0 for r in got)
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (brute.fold(r.doc_id) == 0) for r in got)
    one_class = quadratic.scored(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1 and one_class[0].score > 0.5
    kept = quadratic.passing(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_discriminant_is_the_log_density_difference():
    random = np.random.default_rng(1)
    size = 4
    rows = {0: random.normal(0, 1, (200, size)), 1: random.normal(1, 2, (300, size))}
    sums = {k: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]) for k, x in rows.items()}
    model = quadratic.fitted(sums, size, 0.2, 0.1)
    z = (rows[1][:5] - model.center) / model.scale
    scaled = {k: (x - model.center) / model.scale for k, x in rows.items()}
    covariance = {k: np.cov(x.T, bias=True) for k, x in scaled.items()}
    pooled = (200 * covariance[0] + 300 * covariance[1]) / 500
    density = []
    for k in (0, 1):
        c = 0.8 * covariance[k] + 0.2 * pooled
        c = 0.9 * c + 0.1 * np.trace(c) / size * np.eye(size) + 1e-6 * np.eye(size)
        d = z - scaled[k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * math.log(np.linalg.det(c)))
    expected = 1 / (1 + np.exp(-(density[1] - density[0] + math.log(301 / 201))))
    assert np.allclose(model.scores(rows[1][:5]), expected)


def segmentations(word, scores, byte_scores):
    if not word:
        return 1.0
    total = math.exp(byte_scores[list(word[0].encode())].sum()) * segmentations(word[1:], scores, byte_scores)
    for piece, score in scores.items():
        if word.startswith(piece):
            total += math.exp(score) * segmentations(word[len(piece):], scores, byte_scores)
    return total


def test_lattice_adds_up_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "é"]
    scores = np.log(np.array([0.1, 0.2, 0.05, 0.1, 0.02, 0.1, 0.07, 0.01]))
    spelled = np.full(256, math.log(0.01))
    lattice = lattice_lm.Lattice(pieces, scores, spelled)
    words = ["▁a", "▁abab", "▁c", "▁abéba", "▁ba", "▁\U0001F600a"]
    expected = [math.log(segmentations(w, dict(zip(pieces, scores)), spelled)) for w in words]
    assert np.allclose(lattice.log_probabilities(words), expected)
    assert lattice.log_probabilities(["▁" + "ab" * 3000])[0] < -1000  # no underflow
    # Expected uses are the derivatives of the log probability.
    got, _ = lattice.expected(words, np.arange(1.0, 7.0))
    for k in range(len(pieces)):
        moved = scores.copy()
        moved[k] += 1e-6
        up = lattice_lm.Lattice(pieces, moved, spelled).log_probabilities(words)
        assert got[k] == pytest.approx(((up - expected) * np.arange(1.0, 7.0)).sum() / 1e-6, abs=1e-3)


@pytest.mark.parametrize("head", [500_000, 3])
def test_likelihood(docs, sample, head):
    got = lattice_lm.scored(docs, PIECES, rounds=1, head=head).collect()
    expected = brute.word_base([(i, t) for i, t, _ in sample])
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    for g, e in zip(sorted((tuple(r) for r in got), key=key), sorted(expected, key=key)):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5]) and g[6] < 0
    again = {(r.doc_id, r.n_tokens): r.score for r in lattice_lm.scored(docs, PIECES, rounds=1).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score) for r in got)


def test_rounds_raise_the_training_likelihood(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    total = [
        sum(r.score for r in lattice_lm.scored(docs, PIECES, rounds=k).where("not held_out").collect()) for k in (1, 2)]
    assert total[1] > total[0]


def test_long_words_are_walked_in_bounded_groups():
    """16 M characters of rare long strings: groups hold few characters, every word is in one of them."""
    lattice = lattice_lm.Lattice(["a", "ab"], np.array([-1.0, -2.0]), np.full(256, -5.0))
    words = ["x" * 2000] * 8000 + ["y" * (1 + i % 40) for i in range(30_000)] + ["z" * 500_000, "q"]
    seen = np.zeros(len(words), dtype=int)
    for part in lattice.groups(words):
        size = sum(len(words[k]) for k in part)
        assert len(part) <= lattice.GROUP and (size <= lattice.CHARACTERS or len(part) == 1)
        seen[part] += 1
    assert (seen == 1).all()
