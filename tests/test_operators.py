"""Operators against brute force, with hot keys and with settings forced small."""

import math
import os
import random
import re
import time
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quillspark.operators import filters as fl, fingerprints as fp, joins as jn, metrics as mt, opaque as op, prompts as pr
from quillspark.operators import ranking as rk, reshape as rs, sampling as sp
from quillspark.operators.classify import NaiveBayes
from quillspark.operators.language_model import BigramModel
from quillspark.operators.similarity import greedy_match
from quillspark.plans import recipes, standins as st
from quillspark.functions.text import story_prompt
from quillspark.session import fresh_path, materialize, scratch
from quillspark.sources import catalog as cat, readers as rd, writers as wr
from quillspark.streaming.incremental import run_incrementally


@pytest.fixture
def small_leaf(monkeypatch):
    """Small buckets, so that the histograms are refined even on few rows."""
    monkeypatch.setattr(rk, "LEAF_ROWS", 3)
    monkeypatch.setattr(rk, "HEX_DIGITS_PER_PASS", 1)


def numbers(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


@pytest.mark.parametrize("n, sizes", [(0, (0, 0, 0)), (1, (0, 0, 1)), (3, (2, 0, 1)), (10, (7, 1, 2)), (200, (140, 30, 30))])
def test_split_sizes(spark, small_leaf, n, sizes):
    parts = sp.split_exact(numbers(spark, n), "k").collect()
    found = Counter(r["split"] for r in parts)
    assert tuple(found[s] for s in sp.SPLITS) == sizes
    assert len({r["k"] for r in parts}) == n


def test_split_does_not_depend_on_partitions(spark, small_leaf):
    one = sp.split_exact(numbers(spark, 100).repartition(1), "k")
    seven = sp.split_exact(numbers(spark, 100).repartition(7), "k")
    assert sorted(one.collect()) == sorted(seven.collect())


def test_legacy_split_overlaps(spark, small_leaf):
    found = Counter(r["split"] for r in sp.split_exact(numbers(spark, 10), "k", legacy_bounds=True).collect())
    assert (found["train"], found["validation"], found["test"]) == (8, 2, 10)


def test_sample_is_a_prefix_of_the_seeded_order(spark, small_leaf):
    small = {r[0] for r in sp.seeded_sample(numbers(spark, 300), "k", 40).collect()}
    large = {r[0] for r in sp.seeded_sample(numbers(spark, 300), "k", 90).collect()}
    assert len(small) == 40 and len(large) == 90 and small < large
    assert sp.seeded_sample(numbers(spark, 5), "k", 90).count() == 5


def test_repeated_keys_have_exact_parts(spark, monkeypatch):
    """Two keys of rows that are equal altogether, and repeated and null keys: every size is exact."""
    monkeypatch.setattr(rk, "LEAF_ROWS", 3)
    monkeypatch.setattr(rk, "HEX_DIGITS_PER_PASS", 16)
    tables = [
        spark.range(60).select((F.col("id") % 2).alias("k")),
        spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 20).alias("k"), F.col("id").alias("v")),
    ]
    for df in tables:
        rows = Counter(map(tuple, df.collect()))
        n = sum(rows.values())
        before = Counter()
        for size in (7, 8, 31):
            found = Counter(map(tuple, sp.seeded_sample(df, "k", size).collect()))
            assert sum(found.values()) == size and found <= rows and before <= found
            before = found
        assert before == Counter(map(tuple, sp.seeded_sample(df.repartition(3), "k", 31).collect()))
        parts = sp.split_exact(df, "k", (0.5, 0.05, 0.45)).collect()
        sizes = Counter(r["split"] for r in parts)
        assert (sizes["train"], sizes["validation"]) == (30, 3) and Counter(tuple(r)[:-1] for r in parts) == rows
    legacy = Counter(r["split"] for r in sp.split_exact(tables[0], "k", legacy_bounds=True).collect())
    assert (legacy["train"], legacy["validation"], legacy["test"]) == (43, 10, n)


def test_parted_with_a_hot_first_key(spark):
    """One key holds most rows; the second key must decide."""
    random.seed(1)
    rows = [(7, i) for i in random.sample(range(-500, 500), 120)] + [(random.randint(-9, 20), 1000 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for n in (0, 1, 60, 179, 180, 500):
        first, rest = rk.parted(df, ["a", "b"], n)
        assert sorted(tuple(r) for r in first.collect()) == sorted(rows)[:n]
        assert sorted(tuple(r) for r in rest.collect()) == sorted(rows)[n:]


@pytest.mark.parametrize("kind", ["double", "string", "int"])
def test_head_of_any_order(spark, kind):
    """Keys with fractions, texts, nulls, ties, and rows that occur several times."""
    random.seed(5)
    keys = {"double": [None, 0.5, 1.5, 2.25, float("nan")], "string": [None, "a", "b", "ab"], "int": [None, 1, 2]}[kind]
    rows = [(random.choice(keys), i % 7) for i in range(90)] + [(keys[1], 3)] * 20

    def place(key):
        return (key is not None, key != key, key if key is not None and key == key else keys[1])

    df = spark.createDataFrame(rows, f"k {kind}, v int").repartition(4)
    ordered = sorted((place(k) for k, _ in rows))
    for n in (1, 10, 33, 60, 109, 110, 200):
        found = sp.head(df, n, "k").collect()
        assert sorted(place(r["k"]) for r in found) == ordered[:n]
        whole = Counter(map(repr, rows))
        assert not Counter(repr(tuple(r)) for r in found) - whole


def test_numbered(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k int").repartition(5)
    assert sorted((r["k"], r["rank"]) for r in rk.numbered(df, ["k"]).collect()) == [(i, i) for i in range(101)]
    assert rk.numbered(df.filter("k < 0"), ["k"]).count() == 0


def test_hard_easy_mix_and_carve(spark, small_leaf):
    df = numbers(spark, 60).withColumn("hard", F.col("k") % 20 == 0)
    mixed = sp.hard_easy_mix(df, "hard", "k", ratio=4).collect()
    assert sum(r["hard"] for r in mixed) == 3 and len(mixed) == 15
    unset = df.withColumn("hard", F.when(F.col("k") % 20 == 0, True))  # null where not set
    assert sp.hard_easy_mix(unset, "hard", "k", ratio=4).count() == 15
    parts = sp.split_exact(numbers(spark, 40), "k")
    kept = sp.carve_validation(parts, "k").filter("split = 'validation'").collect()
    last = sorted(r["k"] for r in parts.filter("split = 'validation'").collect())[-2:]
    assert sorted(r["k"] for r in kept) == last


def test_rerank_ties_and_top_k(spark):
    rows = [(1, 0, 0.5, 0.0), (1, 1, 0.5, 0.0), (1, 2, 0.4, 1.0), (2, 0, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "p int, c int, base double, con double")
    best = {r["p"]: r["c"] for r in sp.reranked(df, "p", F.col("base"), F.col("con"), "c").collect()}
    assert best == {1: 2, 2: 0}
    tied = sp.reranked(df, "p", F.col("base"), F.lit(0.0), "c", k=2).collect()
    assert sorted((r["p"], r["c"]) for r in tied) == [(1, 0), (1, 1), (2, 0)]


@pytest.mark.parametrize("limit", [1, 40, 1000])
def test_lookups_withhot_and_cold_and_unknown(spark, monkeypatch, limit):
    monkeypatch.setattr(jn, "BROADCAST_BYTES", limit)
    dim = spark.createDataFrame([("the", 900, 1.0), ("cat", 2, 2.0), ("dog", 1, 3.0)], "w string, n bigint, x double")
    words = ["the"] * 50 + ["cat", "dog", "bird", None]
    fact = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    values = {"the": 1.0, "cat": 2.0, "dog": 3.0}
    expected = {i: values.get(w) for i, w in enumerate(words)}
    found = jn.lookup(fact, dim, "w", "n", 903).collect()
    assert len(found) == len(words) and {r["id"]: r["x"] for r in found} == expected
    near, far = jn.split_lookup(fact, dim, ["w"], "n", 903)
    assert (far is None) == (limit == 1000)
    rows = near.collect() + (far.collect() if far is not None else [])
    assert len(rows) == len(words) and {r["id"]: r["x"] for r in rows} == expected


def test_scoring_does_not_depend_on_broadcasts(spark, monkeypatch):
    """Count tables too large to broadcast join by shuffle, to the same scores."""
    train = spark.createDataFrame([(i, f"the w{i % 7} of w{i % 5}" if i else "") for i in range(50)], "id int, text string")
    texts = train.union(spark.createDataFrame([(50, "new the new w1 w9"), (51, None)], "id int, text string"))

    def scores():
        model = BigramModel.fit(train, "text")
        bayes = NaiveBayes.fit(train.withColumn("label", F.col("id") % 2), "text", "label")
        fluency = {r["id"]: r["fluency"] and round(r["fluency"], 9) for r in model.fluency(texts, "id", "text").collect()}
        greedy = {r["id"]: r["gen"] for r in model.continue_greedy(texts, "id", "text", 4).collect()}
        drawn = sorted(tuple(r) for r in model.continue_sampled(texts, "id", "text", 2, 7).collect())
        return fluency, greedy, drawn, {r["id"]: (r["label"], round(r["score"], 9)) for r in
                                        bayes.predict(texts, "id", "text").collect()}

    usual = scores()
    assert len(usual[0]) == 52 and len(usual[3]) == 52 and usual[0][51] is None
    monkeypatch.setattr(jn, "BROADCAST_BYTES", 150)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        assert scores() == usual
    finally:
        for name in names:
            spark.conf.unset(name)


def test_split_hot_loses_no_row(spark):
    rows = [("a", i) for i in range(30)] + [(None, i) for i in range(12)] + [("c", 0)]
    df = spark.createDataFrame(rows, "k string, i int")
    usual, hot = jn.split_hot(df, "k", floor=10)
    assert sorted(map(repr, usual.union(hot).collect())) == sorted(map(repr, df.collect()))
    assert {r["k"] for r in usual.collect()} == {"c"} and {r["k"] for r in hot.collect()} == {"a", None}
    assert jn.split_hot(df, "k")[1].count() == 0


def test_broadcast_part_is_bounded_by_bytes(spark, monkeypatch):
    """Long tokens and a thousand classes: few rows, many bytes."""
    monkeypatch.setattr(jn, "BROADCAST_BYTES", 100_000)
    wide = spark.range(50).select(
        F.concat(F.lit("w"), F.col("id")).alias("w"), (F.col("id") + 1).alias("n"),
        F.array_repeat(F.lit(0.5), 1000).alias("ll"))
    assert not jn.fits(wide) and jn.fits(wide.drop("ll"))
    hot, cold = jn.hot_and_cold(wide, "n", 1275)
    assert (hot.agg(F.sum(jn._row_bytes(wide))).first()[0] or 0) <= 100_000 and hot.count() + cold.count() == 50


def test_evidence_indexes_out_of_range(spark):
    df = spark.createDataFrame([(["a.", "b."], [1, 5])], "abstract array<string>, idx array<int>")
    assert df.select(jn.pick_sentences(F.col("abstract"), F.col("idx")).alias("x")).first()["x"] == "b."


def test_group_targets_and_rows(spark):
    rows = [("hot", f"q{i}", i) for i in range(200)] + [(f"c{i % 5}", f"q{i}", i) for i in range(20)] + [(None, "x", 3)]
    df = spark.createDataFrame(rows, "context string, question string, id bigint").repartition(5)
    expected = {}
    for context, question, _ in rows:
        expected.setdefault(context, []).append(question)
    whole = rs.group_targets(df, "context", "question", "id").collect()
    assert {r["context"]: r["targets"] for r in whole} == expected
    single = rs.target_rows(df, "context", "question", "id").collect()
    assert {(r["context"], r["ord"]): r["target"] for r in single} == {
        (c, i): q for c, targets in expected.items() for i, q in enumerate(targets)}


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_prefixes(spark, chunk):
    text = "a  b c"
    df = spark.createDataFrame([(1, text), (2, "one"), (3, " x")], "id int, text string")
    found = sorted((r["id"], r["prefix"]) for r in rs.prefixes(df, "text", chunk=chunk).collect())
    expected = []
    for key, t in ((1, text), (2, "one"), (3, " x")):
        pieces = t.split(" ")
        expected += [(key, " ".join(pieces[:j])) for j in range(len(pieces)) if " ".join(pieces[:j]).strip()]
    assert found == sorted(expected)
    full = rs.prefixes(df, "text", include_full=True).collect()
    assert (2, "one") in [(r["id"], r["prefix"]) for r in full]


def test_unravel_only_counts_numbered_columns(spark):
    df = spark.createDataFrame([(1, "p", "horror", "g0", "g1", True)],
                               "id int, prompt string, genre string, gen_0 string, gen_1 string, pred_0 boolean")
    rows = rs.unravel(df).collect()
    assert [(r["text"], r["label"]) for r in rows] == [("p g0", 1)]


def test_widen_reverses_melt(spark):
    df = spark.createDataFrame([(1, "p", "a", None), (2, "q", "c", "d")], "id int, prompt string, gen_0 string, gen_1 string")
    back = rs.widen_candidates(rs.melt_candidates(df), ["id", "prompt"], 2).select(df.columns)
    assert sorted(back.collect()) == sorted(df.collect())


def test_training_sets(spark):
    df = spark.createDataFrame([(1, "b a b", "a", 1), (2, "z", "", 1), (3, "a", "b", 0)],
                               "id int, prompt string, gen_0 string, pred_0 int")
    vocab = rs.vocabulary(df, "prompt", 2)
    rows = {r["id"]: r for r in rs.cond_set(df, "id", vocab, max_length=4).collect()}
    ids = {r["token"]: r["token_id"] for r in vocab.table.collect()}
    assert ids == {"a": 2, "b": 3}
    assert rows[1]["token_ids"] == [3, 2, 3, 0] and rows[1]["labels"] == [2, -100, -100, -100]
    assert rows[2]["token_ids"] == [1, 0, 0, 0] and rows[2]["labels"] == [-100] * 4
    assert set(rows) == {1, 2}
    judged = df.drop("prompt")
    assert {r["id"] for r in rs.lm_set(judged, "id", rs.vocabulary(df, "prompt"), max_length=4).collect()} == {1, 2}


def test_index_labels(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), (None, 4.0)], "l string, x double")
    indexed, dim = rs.index_labels(df, "l")
    assert {r["l"]: r["label_id"] for r in dim.collect()} == {"a": 0, "b": 1}
    assert {r["x"]: r["label_id"] for r in indexed.collect()} == {1.0: 1, 2.0: 0, 3.0: 1, 4.0: None}
    with pytest.raises(ValueError):
        rs.index_labels(df, "x")


def _ngrams(tokens, n):
    return [tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]


@pytest.mark.parametrize("floor", [10_000, 20])
def test_distinct_n_against_sets(spark, floor):
    """With a low floor the hot group takes the other way to the same numbers."""
    random.seed(2)
    rows = [(0 if i % 3 == 0 else i % 4 + 1, " ".join(random.choices("a b c d .".split(), k=random.randint(0, 9))))
            for i in range(120)] + [(99, "only one")]
    df = spark.createDataFrame(rows, "g int, gen string")
    for normalize in ("candidates", "ngrams"):
        found = {r["g"]: r for r in mt.distinct_n(df, "g", normalize=normalize, floor=floor).collect()}
        assert 99 not in found
        for g in {g for g, _ in rows} - {99}:
            texts = [t.split() for k, t in rows if k == g]
            for n in range(1, 5):
                grams = [x for t in texts for x in _ngrams(t, n)]
                under = len(texts) if normalize == "candidates" else len(grams)
                assert found[g][f"distinct_{n}_gram"] == pytest.approx(len(set(grams)) / under if under else 0)


def _bleu(pred, refs):
    logs = 0.0
    for n in range(1, 5):
        mine = Counter(_ngrams(pred, n))
        most = Counter()
        for ref in refs:
            most |= Counter(_ngrams(ref, n))
        overlap = sum((mine & most).values())
        if not overlap:
            return 0.0
        logs += math.log(overlap / sum(mine.values())) / 4
    nearest = min((abs(len(r) - len(pred)), len(r)) for r in refs)[1]
    return math.exp(logs) * (1 if len(pred) > nearest else math.exp(1 - nearest / len(pred)))


def test_bleu_against_counters(spark):
    random.seed(3)
    rows = []
    for i in range(40):
        base = random.choices("a b c d e".split(), k=random.randint(0, 12))
        refs = [" ".join(base[random.randint(0, 2):] + ["x"] * random.randint(0, 3)) for _ in range(random.randint(1, 3))]
        rows.append((i, " ".join(base), refs))
    df = spark.createDataFrame(rows, "id int, pred string, refs array<string>")
    found = {r["id"]: r["bleu"] for r in mt.bleu(df, "id", "pred", "refs").collect()}
    assert len(found) == len(rows) and any(0 < v < 1 for v in found.values())
    for key, pred, refs in rows:
        assert found[key] == pytest.approx(_bleu(pred.split(), [r.split() for r in refs]))


def test_rouge_empty_sides(spark):
    df = spark.createDataFrame([(1, "", "a b"), (2, "a b", ""), (3, "a b a", "a a c d")], "id int, pred string, ref string")
    found = {r["id"]: (r["recall"], r["precision"]) for r in mt.rouge_n(df, "id", "pred", "ref", 1).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (pytest.approx(0.5), pytest.approx(2 / 3))}


def test_accuracy_mse_combined(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0)], "p double, l double")
    assert mt.accuracy(df, "p", "l").first()["accuracy"] == 0.5
    assert mt.mse(df, "p", "l").first()["mse"] == 2.0
    assert df.select(mt.combined_score(F.col("p"), F.col("l")).alias("x")).collect()[1]["x"] == 1.0


@pytest.mark.parametrize("block", [2, 256])
def test_greedy_match_blocks(spark, block):
    """Many small blocks give the same as one product."""
    random.seed(4)
    vectors = [(p, s, i, [random.gauss(0, 1) for _ in range(5)]) for p in range(2) for s in range(2) for i in range(7 + p)]
    df = spark.createDataFrame(vectors, "pair int, side int, at bigint, v array<float>")
    found = {r["pair"]: r for r in greedy_match(df, "pair", "side", "at", "v", block=block).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for p in range(2):
        pred = [v for q, s, _, v in vectors if (q, s) == (p, 0)]
        ref = [v for q, s, _, v in vectors if (q, s) == (p, 1)]
        precision = sum(max(cosine(a, b) for b in ref) for a in pred) / len(pred)
        recall = sum(max(cosine(a, b) for a in pred) for b in ref) / len(ref)
        assert found[p]["precision"] == pytest.approx(precision, abs=1e-5)
        assert found[p]["recall"] == pytest.approx(recall, abs=1e-5)


def test_bigram_model_by_hand(spark):
    train = spark.createDataFrame([(1, "the cat sat"), (2, "The cat ran"), (3, "!")], "id int, text string")
    model = BigramModel.fit(train, "text")
    assert (model.n_words, model.total) == (4, 6)
    scored = {r["id"]: r["fluency"] for r in model.fluency(train, "id", "text").collect()}
    expected = (math.log(3 / 7) + math.log(3 / 7) + math.log(2 / 7)) / 3
    assert scored[1] == pytest.approx(expected) and scored[3] is None and len(scored) == 3
    prompts = spark.createDataFrame([(1, "the"), (2, "unseen"), (3, "")], "id int, prompt string")
    greedy = {r["id"]: r["gen"] for r in model.continue_greedy(prompts, "id", "prompt", 3).collect()}
    assert greedy == {1: "cat ran", 2: "", 3: "the cat ran"}


def test_sampled_continuations_follow_the_counts(spark):
    train = spark.createDataFrame([(i, "a " + ("b" if i < 30 else "c")) for i in range(40)], "id int, text string")
    model = BigramModel.fit(train, "text")
    prompts = spark.range(300).select("id", F.lit("a").alias("prompt"))
    drawn = [r["gen"] for r in model.continue_sampled(prompts, "id", "prompt", n_gens=2, steps=1).collect()]
    assert len(drawn) == 600 and set(drawn) == {"b", "c"}
    assert 0.68 < drawn.count("b") / 600 < 0.82
    laid = model.sampler().filter("v = 'a'").select("w", "low", "high").distinct().orderBy("low").collect()
    assert laid[0]["low"] == 0 and laid[0]["high"] == laid[1]["low"] and laid[1]["high"] == 40


def test_naive_bayes_by_hand(spark):
    train = spark.createDataFrame([("good good", "pos"), ("bad", "neg"), ("fine", "pos")], "text string, label string")
    model = NaiveBayes.fit(train, "text", "label")
    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "")], "id int, text string")
    found = {r["id"]: r for r in model.predict(texts, "id", "text").collect()}
    assert (found[1]["label"], found[2]["label"], found[3]["label"]) == ("pos", "neg", "pos")
    neg = math.log(1 / 3) + math.log(1 / 4)
    pos = math.log(2 / 3) + math.log(3 / 6)
    assert found[1]["scores"] == [pytest.approx(neg), pytest.approx(pos)]
    assert found[1]["score"] == pytest.approx(math.exp(pos) / (math.exp(pos) + math.exp(neg)))
    assert found[3]["scores"] == [pytest.approx(math.log(1 / 3)), pytest.approx(math.log(2 / 3))]


def test_naive_bayes_ignores_rows_without_label(spark):
    labelled = spark.createDataFrame([("good", "pos"), ("bad", "neg")], "text string, label string")
    more = labelled.union(spark.createDataFrame([("other words", None)], "text string, label string"))
    found = [sorted((r["token"], r["ll"]) for r in NaiveBayes.fit(df, "text", "label").table.collect()) for df in (labelled, more)]
    assert found[0] == found[1]


def test_greedy_match_of_one_side_and_of_zero_vectors(spark):
    rows = [(1, 0, 0, [1.0, 0.0]), (2, 0, 0, [0.0, 0.0]), (2, 1, 0, [1.0, 0.0]), (2, 1, 10**12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "pair int, side int, at bigint, v array<float>")
    found = {r["pair"]: (r["precision"], r["recall"], r["f1"]) for r in greedy_match(df, "pair", "side", "at", "v").collect()}
    assert found == {1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0)}


def test_bleu_and_rouge_keep_repeated_ids_apart(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e", "a b c d e"), (1, "x y z", "a b"), (2, None, "a"), (3, "a", None)], "id int, pred string, ref string")
    many = df.select("id", "pred", F.array("ref").alias("refs"))
    assert sorted((r["id"], r["bleu"]) for r in mt.bleu(many, "id", "pred", "refs").collect()) == [(1, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    assert sorted((r["id"], r["f1"]) for r in mt.rouge_n(df, "id", "pred", "ref").collect()) == [(1, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    plan = mt.bleu(many, "id", "pred", "refs")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_failures_are_judged_by_the_whole_job(spark, parts):
    """One bad row of eight, alone in a task or not, is a null; only a job that failed throughout is an error."""
    def picky(texts):
        if any(t == "bad" for t in texts):
            raise TypeError("no such argument")
        return [t.upper() for t in texts]

    def broken(texts):
        raise TypeError("no such argument")

    rows = [(i, "bad" if i == 3 else None if i == 5 else f"t{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(parts, "id")
    seen = op.Outcome()
    found = {r["id"]: r["x"] for r in op.asked(df, picky, [F.col("t")], out="x", outcome=seen).collect()}
    assert found == {i: None if t in ("bad", None) else t.upper() for i, t in rows}
    assert (seen.seen.get["asked"], seen.seen.get["failed"]) == (7, 1)
    seen.check()
    with pytest.raises(RuntimeError, match="1 of 7 calls failed"):
        seen.check(most=0.1)
    lost = op.Outcome()
    assert op.asked(df, broken, [F.col("t")], out="x", outcome=lost).filter("x IS NOT NULL").count() == 0
    with pytest.raises(RuntimeError, match="7 of 7 calls failed, one with TypeError"):
        lost.check()
    prompts = spark.createDataFrame([(i, "t") for i in range(4)], "id int, prompt string").repartition(parts)
    made = op.generate(prompts, lambda prompts, numbers: [
        None if n == 1 else p for p, n in zip(prompts, numbers)], 3, keep_failed=True)
    assert made.filter("gen IS NULL").count() == 4 and made.count() == 12


def test_a_job_without_calls_is_no_error(spark):
    seen = op.Outcome()
    df = spark.createDataFrame([(None,)], "t string")
    assert op.asked(df, len, [F.col("t")], out="x", outcome=seen).collect()[0]["x"] is None
    seen.check()


def test_bad_rows_are_found_by_halving():
    asked = []

    def picky(texts):
        asked.append(len(texts))
        if "bad" in texts:
            raise ValueError("bad")
        return texts

    calls = op._Calls(picky, 3, op.TRANSIENT)
    texts = [f"t{i}" for i in range(10_000)]
    texts[1234] = texts[7777] = "bad"
    assert calls([texts]) == [None if t == "bad" else t for t in texts]
    assert [k for k, error in enumerate(calls.errors) if error] == [1234, 7777] and len(asked) < 60


def test_only_transient_errors_are_tried_again():
    asked = []

    def down(texts):
        asked.append(list(texts))
        raise ConnectionError("down")

    calls = op._Calls(down, 3, op.TRANSIENT)
    assert calls([["a", "b"]]) == [None, None] and asked == [["a", "b"]] * 3
    assert all("down" in error for error in calls.errors)
    asked.clear()
    calls = op._Calls(lambda texts: asked.append(list(texts)) or [t for t in texts if t != "b"], 3, op.TRANSIENT)
    assert calls([["a", "b"]]) == ["a", None] and asked == [["a", "b"], ["a"], ["b"]]


def test_model_failures_become_null(spark):
    def flaky(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", None, "c"])], "id int, t string").coalesce(1)
    found = {r["id"]: r["x"] for r in df.select("id", op.replies(flaky, F.col("t")).alias("x")).collect()}
    assert found == {0: "A", 1: None, 2: None, 3: "C"}


def test_outside_scorer(spark):
    def scorer(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("down")
        return [float(len(t)) for t in texts]

    df = spark.createDataFrame([("abc",), ("bad",), (None,)], "t string").coalesce(1)
    found = {r["t"]: r["score"] for r in op.score_text(df, scorer, F.col("t")).collect()}
    assert found == {"abc": 3.0, "bad": None, None: None}


def test_throttle_waits():
    start = time.monotonic()
    assert op.throttled(lambda texts: texts, 6000)(["a"] * 20) == ["a"] * 20
    assert time.monotonic() - start >= 0.19


def test_allowance_slides():
    clock = []
    allowance = op.Allowance(10, 0.3)
    ask = allowance.limited(lambda texts: clock.extend([time.monotonic()] * len(texts)) or texts)
    assert ask([str(i) for i in range(25)]) == [str(i) for i in range(25)]
    assert ask(["x"] * 3) == ["x"] * 3
    assert all(sum(t <= u < t + 0.3 for u in clock) <= 10 for t in clock)
    with pytest.raises(ValueError):
        op.Allowance(0, 1.0)


def _most_at_once(path, period):
    """The most texts that were sent in any period, by the times the service has noted."""
    with open(path) as log:
        sent = [(float(at), int(n)) for at, n in (line.split() for line in log)]
    return max(sum(n for u, n in sent if t <= u < t + period) for t, _ in sent), sum(n for _, n in sent)


def test_tasks_share_a_quota(spark, tmp_path):
    """Four tasks keep 20 texts in any 1.5 seconds together; so do they when a task dies and all are run again."""
    period, quota = 1.5, 20
    steady, dying, died = (str(tmp_path / name) for name in ("steady", "dying", "died"))
    rows = [(i, None if i == 7 else "w " * (i % 5 + 1)) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, t string")

    def service(log, fatal):
        def ask(texts):
            with open(log, "a") as file:
                file.write(f"{time.time()} {len(texts)}\n")
            if fatal and "w w w w w " in texts:
                try:
                    os.mkdir(fatal)
                except FileExistsError:
                    pass
                else:
                    os._exit(3)
            return [len(t.split()) for t in texts]
        return ask

    expected = {i: None if t is None else float(len(t.split())) for i, t in rows}
    for log, fatal in ((steady, None), (dying, died)):
        made = op.scored_under_quota(df, service(log, fatal), "t", quota, period)
        assert {r["id"]: r["score"] for r in made.collect()} == expected
        most, total = _most_at_once(log, period)
        assert most <= quota and total >= 69
    assert os.path.isdir(died)


def test_quota_smaller_than_the_tasks_and_empty_tasks(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    made = op.scored_under_quota(df, lambda texts: [len(t) for t in texts], "t", 1, 0.2, tasks=8)
    assert sorted(made.collect()) == [(1, "a b", 3.0), (2, None, None)]
    assert op.scored_under_quota(df.limit(0), len, "t", 5, 0.2).count() == 0
    with pytest.raises(ValueError):
        op.scored_under_quota(df, len, "t", 0)


def test_fan_out_limits(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "prompt string")
    rows = op.fan_out(df, 2, max_words=2).collect()
    assert sorted((r["prompt"], r["cand_idx"]) for r in rows) == [("a b", 0), ("a b", 1)]
    assert op.fan_out(df, 50).count() == 50
    with pytest.raises(ValueError):
        op.fan_out(df, 0)


def test_fewshot_templates(spark):
    demos = st.demos(spark)
    own = st.QUESTIONS["sentiment"]
    question = pr.judge_template(own)
    assert pr.fewshot_template(demos, "sentiment", own, k=0) == question
    assert pr.fewshot_template(demos, "sentiment", own, k="all").count(pr.REPLY_CUE) == 5
    assert pr.fewshot_template(demos, "sentiment", own, k=2, author="second", cot=True).count(" | ") == 2
    with pytest.raises(ValueError):
        pr.fewshot_template(demos, "sentiment", own, k=9)
    with pytest.raises(ValueError):
        pr.fewshot_template(demos, "irony", own, k="all")


def test_drop_null_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "x int, y string")
    kept, counts = fl.drop_null(df, ["y"])
    assert kept.collect() == [(1, "a")] and counts.get == {"before": 3, "kept": 1}
    stages = {r["stage"]: r["n_rows"] for r in fl.row_report({"raw": df, "kept": kept}).collect()}
    assert stages == {"raw": 3, "kept": 1}


def test_target_class_warns(spark):
    df = spark.createDataFrame([(1,)] + [(0,)] * 9, "label int")
    kept, counts = fl.target_class(df, "label")
    assert len(kept.collect()) == 1
    with pytest.warns(UserWarning):
        fl.warn_if_few(counts)
    kept, counts = fl.target_class(df, "label", 0)
    assert len(kept.collect()) == 9
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fl.warn_if_few(counts)


def test_pending_metric(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    done = spark.createDataFrame([(1, "bleu", 0.1), (2, "other", 0.2)], "id int, metric string, value double")
    assert [r["id"] for r in fl.pending_metric(df, done, ["id"], "bleu").collect()] == [2]
    assert fl.pending_metric(df, done, ["id"], "bleu", overwrite=True).count() == 2


def test_catalog(spark):
    with pytest.raises(ValueError):
        cat.route("nothing")
    with pytest.raises(ValueError):
        cat.Catalog(spark).load("imdb")
    assert cat.route("ag_news").constraint_type == "topic" and cat.route("xsum").presplit
    assert set(recipes.RECIPES) - set(cat.DATASETS) == {"cnn_dailymail_summ", "xsum_summ"}
    assert set(cat.DATASETS) <= set(recipes.RECIPES)


def test_existing_output_is_refused(spark):
    path = fresh_path(spark, "refuse")
    df = spark.createDataFrame([(1, "train")], "x int, split string")
    wr.write_splits(df, path)
    with pytest.raises(Exception):
        wr.write_splits(df, path)


def test_read_many(spark):
    first, second = fresh_path(spark, "a"), fresh_path(spark, "b")
    spark.createDataFrame([(1, "x", "y")], "id int, t string, extra string").write.option("header", True).option("sep", "\t").csv(first)
    spark.createDataFrame([(2, "z")], "id int, t string").write.option("header", True).option("sep", "\t").csv(second)
    both = rd.read_many(spark, [first, second], ["id int, t string, extra string", "id int, t string"], ["id", "t"], sep="\t")
    assert sorted(both.collect()) == [(1, "x"), (2, "z")]


def test_judging_resumes(spark):
    """A second run handles only the files that came after the first."""
    source, target, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "log"))
    schema = "id int, prompt string, gen string, cand_idx int"

    def judge(df):
        return op.judge(df, lambda qs: ["True" for _ in qs], pr.judge_template(st.QUESTIONS["humor"]))

    for wave in range(2):
        spark.createDataFrame([(wave, "p", "g", 0)], schema).write.mode("append").parquet(source)
        run_incrementally(spark, source, schema, target, checkpoint, judge, files_per_batch=1)
        assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(wave + 1))


def test_recipes_on_tiny_corpora(spark):
    r = recipes

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    reviews = frame([("a", 0), ("b", 1)], "text string, label int")
    assert sorted(r.binary_reviews(reviews, reviews).collect()) == [("a", 0), ("a", 0), ("b", 1), ("b", 1)]
    assert sorted(r.topic_news(reviews).collect()) == [("a", 1), ("b", 0)]
    sst = frame([(1, "a", 4), (2, "b", 2), (3, "c", 0)], "idx int, text string, label int")
    assert sorted(r.five_class_sentiment(sst).collect()) == [("a", 1), ("c", 0)]
    cola = frame([("a", 1), ("b", 0)], "sentence string, label int")
    assert sorted(r.acceptability(cola).collect()) == [("a", 0), ("b", 1)]
    assert sorted(r.sentence_sentiment(cola).collect()) == [("a", 1), ("b", 0)]
    columns = "id string, comment_text string, toxic int, severe_toxic int, obscene int, threat int, insult int, identity_hate int"
    train = frame([("1", "a", 1, 0, 0, 0, 0, 0)], columns)
    test = frame([("2", "b"), ("3", "c")], "id string, comment_text string")
    given = frame([("3", -1), ("2", 0)], "id string, toxic int")
    assert sorted(r.toxicity_challenge(train, test, given).collect()) == [("a", 1), ("b", 0)]
    bias = frame([("a", 0.0), ("b", 0.3), ("c", 0.9)], "comment_text string, toxicity double")
    assert sorted(r.toxicity_bias(bias).collect()) == [("a", 0), ("c", 1)]
    stories = frame([("a", "horror"), ("b", "romance"), ("c", "other")], "synopsis string, genre string")
    assert sorted(r.genre(stories).collect()) == [("a", 1), ("b", 0)]
    formal = frame([("a", 1.5), ("b", -1.0), ("c", 0.2)], "sentence string, avg_score double")
    assert sorted(r.formality(formal).collect()) == [("a", 1), ("b", 0)]
    bait = frame([("a", "clickbait"), ("b", "news")], "title string, label string")
    assert sorted(r.clickbait_names(bait).collect()) == [("a", 1), ("b", 0)]
    concepts = frame([(["dog", "run"], "t")], "concepts array<string>, target string")
    assert r.concept_sets(concepts).first()["prompt"] == "dog run "
    pair = frame([({"es": "hola", "en": "hello"},)], "translation map<string,string>")
    assert r.translations(pair).first() == ("hola", "hello")
    claims = frame([("c", "CONTRADICT", "1", [0])], "claim string, evidence_label string, evidence_doc_id string, evidence_sentences array<int>")
    corpus = frame([(1, ["s."])], "doc_id bigint, abstract array<string>")
    assert r.claims_with_sentences([claims], corpus).first()["prompt"] == f"{jn.EVIDENCE_MARKER}s.{jn.CLAIM_MARKER}c"
    assert r.claims_with_sentences([claims], corpus, use_evidence=False).first()["prompt"] == f"{jn.CLAIM_MARKER}c"
    tweets = frame([(None, "'1'", "a"), ("x", "'2'", "b"), ("x", None, "c")], "choose_one_category string, tweet_id string, tweet_text string")
    levels = frame([("'1'", "not_urgent"), ("'2'", "extremely_urgent")], "tweet_id string, urgency string")
    assert {x["text"] for x in r.urgency([tweets], levels).collect()} == {"a", "b"}
    other = frame([("2", 0, -1), ("3", 0, 0)], "id string, toxic int, insult int")
    assert {x["text"] for x in r.toxicity_challenge(train, test, other).collect()} == {"a", "c"}


def test_presplit_corpora_keep_their_parts(spark):
    raw = spark.createDataFrame([(1, "d", "s", "train"), (2, "e", "t", "test")], "row_id int, document string, summary string, split string")
    path = fresh_path(spark, "presplit")
    recipes.finish(recipes.RECIPES["xsum_summ"](raw), "gigaword", "row_id", path=path)
    back = rd.read_csv(spark, path, "row_id int, prompt string, target string, split string")
    assert {(r["row_id"], r["split"]) for r in back.collect()} == {(1, "train"), (2, "test")}
    with pytest.raises(ValueError):
        recipes.finish(recipes.RECIPES["gigaword"](raw.drop("split")), "gigaword", "row_id")


def test_paths_are_routed():
    assert cat.route_path("/data/urgency/tweets.csv") == cat.Dataset("tweets", "constraint", "urgency")
    assert cat.route_path("/data/roc-stories/x.csv").kind == "task"
    with pytest.raises(ValueError):
        cat.route_path("x.csv")


def test_written_tables_can_be_released(spark):
    import os

    with scratch(spark):
        kept = materialize(spark.range(3), "released")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_story_needs_its_sentences():
    with pytest.raises(ValueError):
        story_prompt([F.col("a")], 2)


def test_row_ids_follow_through_a_recipe(spark):
    raw = recipes.with_row_id(spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "text string, label int"))
    done = recipes.finish(recipes.binary_reviews(raw), "imdb", "row_id")
    assert done.count() == 3 and set(done.columns) == {"row_id", "text", "label", "split"}


def test_runs_flags_and_caps(spark):
    df = spark.createDataFrame([(1, True, "p"), (2, False, None)], "id int, flag boolean, prompt string")
    yes, no = fl.partition_by_flag(df, "flag")
    assert (yes.count(), no.count(), fl.nonnull(df, "prompt").count()) == (1, 1, 1)
    marked = wr.with_run(df, {"seed": 42}).withColumn("run", wr.run_key(seed=F.col("seed"), judge="j"))
    assert {r["run"] for r in marked.collect()} == {"seed=42/judge=j"}
    assert rs.capped(numbers(spark, 50), ["k"], 7).count() == 7 and rs.capped(df, ["id"], None) is df
    path = fresh_path(spark, "appended")
    wr.append_finished(df, path, ["id"], ["prompt"])
    assert jn.pending(df, spark.read.parquet(path), ["id"]).count() == 1


def test_spread_leaves_large_scans_alone(spark):
    assert rd.spread(spark.range(0, 10, 1, 20)).rdd.getNumPartitions() == 20
    assert rd.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_distill_writes_texts_once(spark, monkeypatch):
    """the training rows are the only table of texts, and both models are asked in the pass that writes them."""
    from quillspark.plans import distill as ds

    written = []

    def recorded(df, name, write=ds.materialize):
        made = write(df, name)
        written.append([c for c, kind in made.dtypes if kind == "string" and c != "row_id"])
        return made

    monkeypatch.setattr(ds, "materialize", recorded)
    df = spark.createDataFrame([(i, f"some words {i} " * (i % 4 + 1)) for i in range(60)], "id int, prompt string")
    report = ds.distill(df, lambda ps, ks: [f"{p} {k}" for p, k in zip(ps, ks)],
                        lambda qs: ["true" if len(q) % 2 else "false" for q in qs], "Is it?", "id").first()
    assert written == [["text"]] and report["n_samples"] == 27
    with pytest.raises(RuntimeError, match="calls failed"):
        ds.distill(df, lambda ps, ks: [1 / 0 for _ in ps], lambda qs: ["true"] * len(qs), "Is it?", "id")


def test_quota_uses_all_slots(spark, monkeypatch):
    """the texts of a task don't grow as long as slots are idle."""
    monkeypatch.setattr(op, "QUOTA_TASK_BYTES", 4)
    df = spark.createDataFrame([(i, "t") for i in range(64)], "id int, t string")
    made = op.scored_under_quota(df, lambda texts: [float(os.getpid())] * len(texts), "t", 10**6, 0.1)
    slots = spark.sparkContext.defaultParallelism
    assert slots > 4 and made.count() == 64 and made.rdd.getNumPartitions() == slots


def test_quota_tasks_get_few_bytes(spark):
    """idle slots are used before a task has more than 32 MB of texts."""
    df = spark.range(6, numPartitions=6).select(F.expr("repeat('x', 33554432)").alias("t"))
    made = op.scored_under_quota(df, lambda texts: [1.0] * len(texts), "t", 10**6, 0.1)
    assert made.rdd.getNumPartitions() == 6


def test_quota_tasks_get_bounded_parts(spark, tmp_path, monkeypatch):
    """with more texts than the slots may get at once, waves are asked; together they keep the quota."""
    monkeypatch.setattr(op, "QUOTA_WAVE_BYTES", 25, raising=False)
    period, quota, log, of_tasks = 5.0, 40, str(tmp_path / "log"), str(tmp_path / "tasks")

    def service(texts):
        with open(log, "a") as file, open(of_tasks, "a") as tasks:
            file.write(f"{time.time()} {len(texts)}\n")
            tasks.write(f"{TaskContext.get().stageId()}:{TaskContext.get().partitionId()} {len(texts)}\n")
        return [float(t) for t in texts]

    rows = [(i, None if i == 7 else f"{i:04d}", "x") for i in range(100)] + [(3, "0003", None)]
    df = spark.createDataFrame(rows, "id int, t string, other string").repartition(3)
    made = op.scored_under_quota(df, service, "t", quota, period, tasks=4)
    assert sorted(made.collect(), key=str) == sorted([(*r, None if r[1] is None else float(r[1])) for r in rows], key=str)
    assert made.columns == ["id", "t", "other", "score"]
    most, total = _most_at_once(log, period - 0.2)  # what the service notes lags a little
    assert most <= quota and total == 100
    asked = Counter()
    for line in open(of_tasks):
        asked[line.split()[0]] += int(line.split()[1])
    assert max(asked.values()) <= 10 and len(asked) >= 12


def test_quota_result_keeps_columns(spark, monkeypatch):
    df = spark.createDataFrame([(i, "t" * i, None) for i in range(40)], "id int, t string, other string")
    once = op.scored_under_quota(df, lambda texts: [len(t) for t in texts], "t", 10**6, 0.1, keep=["id"])
    monkeypatch.setattr(op, "QUOTA_WAVE_BYTES", 50)
    waves = op.scored_under_quota(df, lambda texts: [len(t) for t in texts], "t", 10**6, 0.1, keep=["id"])
    assert sorted(once.collect()) == sorted(waves.collect()) == [(i, float(i)) for i in range(40)]


def test_gram_counts_of_a_task_are_bounded(spark, monkeypatch):
    """more text makes more partitions, not larger ones; numbers stay."""
    df = spark.createDataFrame([(i // 2, "a b c d " * 20, "a b c " * 20) for i in range(40)], "id int, gen string, ref string")
    few = (sorted(mt.distinct_n(df, "id").collect()), sorted(mt.rouge_n(df, "id", "gen", "ref", 2).collect()))
    monkeypatch.setattr(mt, "GRAM_BYTES", 400)
    many = (sorted(mt.distinct_n(df, "id").collect()), sorted(mt.rouge_n(df, "id", "gen", "ref", 2).collect()))
    assert few == many
    assert mt._gram_width(df, F.octet_length("gen"), [1, 2]) == 40 * 160 * 2 // 400
    asked = mt.rouge_n(df, "id", "gen", "ref", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [_row" in asked and f", {-(-40 * 280 // 400)}" in asked


def test_unknown_words_end_before_the_sum(spark):
    """F8: words that the table lacks are not shuffled a second time; rows of such words keep their priors."""
    train = spark.createDataFrame([("a b b", 0), ("a c", 1), ("a a", 1)], "t string, l int")
    model = NaiveBayes.fit(train, "t", "l")
    df = spark.createDataFrame([(1, "a b x y"), (2, "x"), (3, None), (4, ""), (5, "c c")], "id int, t string")
    whole = {r["id"]: list(r["scores"]) for r in model.scores(df, "id", "t").collect()}
    for limit in (1, 50):
        part = model.scores(df, "id", "t", limit)
        assert {r["id"]: [pytest.approx(x) for x in r["scores"]] for r in part.collect()} == whole
        joins = re.findall(r"Join (\w+)", part._jdf.queryExecution().optimizedPlan().toString())
        assert joins.count("LeftOuter") == 1 and "Inner" in joins  # the rest of the table asks no row without an answer
    assert whole[2] == whole[3] == whole[4] == pytest.approx(model.priors)


def test_hot_groups_count_fingerprints(spark, monkeypatch):
    """n-grams of hot groups travel as sorted blocks of fingerprints; any number of groups, blocks and buckets."""
    monkeypatch.setattr(fp, "BLOCK_GRAMS", 50)
    monkeypatch.setattr(mt, "GRAM_BYTES", 30)
    random.seed(5)
    rows = [(i % 3 or None, " ".join(random.choices("a b ab é . a1".split(), k=random.randint(0, 12)))) for i in range(90)]
    rows += [(7, ""), (7, " "), (8, "a"), (8, None), (9, "a b"), (9, "b a"), (9, "a b")]
    df = spark.createDataFrame(rows, "g int, gen string").repartition(5)
    asked = [4, 1, 2]
    for normalize in ("candidates", "ngrams"):
        made = mt.distinct_n(df, "g", orders=asked, normalize=normalize, floor=1)
        assert " gram#" not in made._jdf.queryExecution().optimizedPlan().toString()
        usual = mt.distinct_n(df, "g", orders=asked, normalize=normalize, floor=10_000)
        key = lambda r: (r["g"] is None, r["g"])
        assert sorted(made.collect(), key=key) == sorted(usual.collect(), key=key) and made.schema == usual.schema
    assert mt.distinct_n(df.limit(0), "g", floor=2).count() == 0


def test_equal_heads_of_different_ngrams_stay_apart():
    heads = np.array([5, 9, 5, 5, 9, 5, 1], dtype=np.uint64)
    tails = np.array([1, 1, 2, 1, 1, 2, 1], dtype=np.uint16)
    cells = np.array([0, 0, 0, 0, 3, 0, 0], dtype=np.uint64)
    found = fp._unique(heads, tails, cells)
    assert sorted(zip(*[x.tolist() for x in found])) == sorted(set(zip(heads.tolist(), tails.tolist(), cells.tolist())))
    top = np.array([0, 1, 2**63, 2**64 - 1], dtype=np.uint64)
    assert fp._unpacked(fp._packed(top)).tolist() == top.tolist()
