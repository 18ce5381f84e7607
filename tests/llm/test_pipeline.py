"""The pipeline's stages, each on its own input."""

from collections import Counter

import pytest

import brute
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm, tmp_path_factory):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(llm, docs, SF).write.parquet(path)
        docs = llm.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns(stages):
    for _, df in stages[1:-1]:
        assert df.dtypes == stages[0][1].dtypes


def test_quality_keeps_rows_as_they_are(stages, llm):
    given = Counter(map(tuple, stages[0][1].collect()))
    kept = Counter(map(tuple, stages[1][1].collect()))
    assert kept <= given and kept != given
    labels = {r.doc_id: r.quality for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in stages[1][1].collect()}
    right = [(i in ids) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages[1][1].collect(), key=lambda r: r.doc_id)
    label = brute.groups(len(rows), brute.near([r.text for r in rows]))
    assert {r.doc_id for r in stages[2][1].collect()} == {rows[k].doc_id for k in set(label)}


def test_repeated_passages_go(stages):
    rows = stages[2][1].collect()
    expected = {}
    for r, kept in zip(rows, brute.repeats([r.text for r in rows])):
        if kept:
            changed = len(kept) < len(brute.space_words(r.text))
            expected[r.doc_id] = b" ".join(kept).decode() if changed else r.text
    assert {r.doc_id: r.text for r in stages[3][1].collect()} == expected
    assert all(r.n_chars == len(r.text) for r in stages[3][1].collect())


def test_contaminated_documents_go(stages, llm):
    rows = stages[3][1].collect()
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([r.text for r in rows], items)
    clean = {r.doc_id for r, (n, hit, _) in zip(rows, found) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in stages[4][1].collect()} == clean


def test_every_document_left_is_packed(stages):
    left = {r.doc_id for r in stages[4][1].collect()}
    pieces = stages[5][1].collect()
    assert {r.doc_id for r in pieces} == left
    for doc_id in left:
        own = [r for r in pieces if r.doc_id == doc_id]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_run(llm, stages):
    assert pipeline.run(llm, SF).count() == stages[5][1].count()
