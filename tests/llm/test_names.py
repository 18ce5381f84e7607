"""Columns of any name, empty tables, nulls and repeated rows, through the filters and the whole pipeline."""

from collections import Counter

import pytest

import brute
import corpus_pipeline as pipeline
from quillspark.llm import fm_index, line_rules, lsh_forest, quadratic, superkmers

OWN = ["_k1", "_k2", "_spans", "_id", "_hash", "_lines_row", "_row", "_drop", "_host", "_part", "cls", "comp", "block", "shard", "row_id", "label"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {'long' if i % 2 else 'string'}" for i, c in enumerate(OWN))


def rows_of(sample):
    return [(i, t, "en", s, None if t is None else len(t), *[k * 100 + n if n % 2 else f"own {k} {n}" for n in range(len(OWN))])
            for k, (i, t, s) in enumerate(sample)]


@pytest.fixture(scope="module")
def items(llm, sample):
    text = next(t for i, t, _ in sample if i == 1)
    return llm.createDataFrame([(1, text), (None, "two words"), (3, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(llm):
    return llm.createDataFrame([(i, i % 2, 0) for i in range(1, 20)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def own_values(df):
    return Counter((r.doc_id, *(r[c] for c in OWN)) for r in df.collect())


def test_own_columns_stay_as_they_are(llm, sample, items, labels):
    given = rows_of(sample)
    docs = llm.createDataFrame(given, SCHEMA).repartition(3)
    whole = own_values(docs)
    for kept in (lsh_forest.one_of_each(docs), superkmers.deduplicated(docs), fm_index.decontaminated(docs, items),
                 line_rules.cleaned(docs), quadratic.passing(docs, labels)):
        assert kept.columns == docs.columns and [t for _, t in kept.dtypes] == [t for _, t in docs.dtypes]
        found = own_values(kept)
        assert found and found <= whole
    texts = {r[5]: r[1] for r in given}
    assert all(r.text == texts[r["_k1"]] for r in lsh_forest.one_of_each(docs).collect())
    assert all(r.text == texts[r["_k1"]] for r in fm_index.decontaminated(docs, items).collect())
    left = {r["_k1"]: r.text for r in superkmers.deduplicated(docs).collect()}
    for (k1, text), words in zip(texts.items(), brute.repeats(list(texts.values()))):
        changed = len(words) < len(brute.space_words(text))
        assert left.get(k1) == ((b" ".join(words).decode() if changed else text) if words or not changed else None)


def test_names_in_upper_case_are_taken_too(llm):
    docs = llm.createDataFrame([(1, "some words here", 7, "x")], "doc_id long, text string, _K1 long, _SPANS string")
    assert lsh_forest.one_of_each(docs).collect() == docs.collect() == superkmers.deduplicated(docs).collect()


def folder(llm, tmp_path, rows, items, labels):
    llm.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_with_odd_rows(llm, sample, items, labels, tmp_path):
    """Null texts, null and repeated ids, repeated rows and own columns through all stages."""
    given = rows_of(sample) * 2
    sf = folder(llm, tmp_path, given, items, labels)
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    whole = own_values(docs)
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(llm, docs, sf)
        assert after.dtypes == docs.dtypes
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = llm.read.parquet(path)
        assert own_values(docs) <= whole
    pieces = pipeline.STAGES[-1][1](llm, docs, sf).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in docs.collect())
    assert len(pipeline.run(llm, sf).collect()) == len(pieces)


def test_pipeline_without_rows(llm, tmp_path):
    sf = folder(llm, tmp_path, [], llm.createDataFrame([], "item_id long, text string"), llm.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert pipeline.run(llm, sf).count() == 0
