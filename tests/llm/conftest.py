"""Small tables for the operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillspark.llm.common import prepared  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, shard string, _row string"


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def sample():
    """Rows (doc_id, text, source) with nulls, empty and long texts, ties and repeated rows."""
    passage = " ".join(f"Passage{i}" for i in range(60))
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
    near = [f"n{i}" for i in range(80)]
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, again and again until it stops.", "a"),
        (2, None, "a"), (3, "", None), (4, " \t\n ", "b"), (None, "No id here, but some words that count all the same today.", "b"),
        (5, passage + " tail of five", "a"), (6, "head of six " + passage, "b"), (7, long, "a"), (8, long + " end", "b"),
        (9, " ".join(near), "a"), (10, " ".join([*near[:-1], "changed"]), "b"), (11, " ".join(near), None),
        (12, "same same same same same same same same same same same same", "a"), (12, "tie of twelve, another text", "a"),
        (13, "twice " * 50, "c"), (13, "twice " * 50, "c"), (14, "x", "c"), (15, "one two three", "c"), (16, "one two three", "d"),
        (17, "Released under CC BY 4.0. All rights reserved.\nGNU General Public License, version 3", "d"),
        (18, "日本語 の テキスト です 。  Ünïcödé \U0001F600 ﬁn\x00 end <|endoftext|> <s> don't", "d"),
        (19, "a  b   c \n\n  d\t\te  ", "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(llm, sample):
    data = [(i, t, "en", s, None if t is None else len(t), -1, "spans", "shard", "row") for i, t, s in sample]
    return llm.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], SCHEMA)
