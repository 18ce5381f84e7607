"""Bounded grouping, tags, relational constraints, routed scans, repeated batches, pruned matching, order-three models, prefix sets."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillspark import session as qs
from quillspark.operators import constraints as cs, joins as jn, reshape as rs, similarity as sm, tagging as tg
from quillspark.operators.kneser_ney import KneserNey, trigrams
from quillspark.operators.language_model import BigramModel
from quillspark.plans import recipes
from quillspark.session import fresh_path, shared_folder
from quillspark.sources import catalog as cat
from quillspark.sources.finished import FinishedRows


def targets(spark, rows, k, salts=64):
    df = spark.createDataFrame(rows, "context string, value string, o int").repartition(5)
    return {r["context"]: r["targets"] for r in rs.group_targets(df, "context", "value", "o", k, salts).collect()}


def test_first_targets(spark):
    """A hot context, ties, repeated rows, nulls in every column."""
    random.seed(1)
    rows = [("hot" if i % 3 == 0 else f"c{i % 7}", f"v{random.randint(0, 50)}", random.randint(0, 9)) for i in range(2000)]
    rows += [(None, "n", 1), (None, None, None), ("c1", "z", None), ("c1", None, 0), ("same", "s", 1)] + [("same", "s", 1)] * 40
    expected = defaultdict(list)
    for context, value, o in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or "")):
        expected[context].append(value)
    for k in (1, 5, 30):
        assert targets(spark, rows, k) == {c: v[:k] for c, v in expected.items()}
    assert targets(spark, rows, 5, salts=1) == targets(spark, rows, 5, salts=999)
    assert targets(spark, rows[:0] + [("a", "b", 1)], 3) == {"a": ["b"]}
    with pytest.raises(ValueError):
        targets(spark, rows, 0)


def test_no_task_holds_a_hot_context(spark):
    """A third of the rows are of one context: tasks get even shares, and few rows a context reach the second step."""
    n, k, salts = 90_000, 10, 64
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("context"),
        F.col("id").cast("string").alias("_v"), (F.col("id") % 1000).alias("_o"))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("_o", "_v"), F.lit(salts)))
    dealt = [r["count"] for r in salted.repartition(8, "context", "_s").groupBy(F.spark_partition_id()).count().collect()]
    assert max(dealt) <= 2 * sorted(dealt)[len(dealt) // 2]
    some = rs._first(salted, ["context", "_s"], k)
    assert some.groupBy("context").count().agg(F.max("count")).first()[0] <= salts * k
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once in front of the shuffle, once behind it


def cheapest(options, transitions, other):
    """All sequences of tags; ties by the smaller tag from the end on."""
    import itertools

    best = None
    for tags in itertools.product(*[sorted(o) for o in options]):
        cost, before = 0, ""
        for tag, choice in zip(tags, options):
            cost += transitions.get((before, tag), other) + choice[tag]
            before = tag
        found = (cost, tags[::-1])
        best = found if best is None else min(best, found)
    return list(best[1][::-1])


def test_tags_are_the_cheapest(spark):
    rng = random.Random(5)
    words = {w: {t: rng.randint(0, 3) for t in rng.sample("ABC", rng.randint(1, 3))} for w in "pqrstu"}
    transitions = {(a, b): rng.randint(0, 4) for a in ["", *"ABCX"] for b in "ABCX" if rng.random() < 0.7}
    lexicon = spark.createDataFrame([(w, t, c) for w, o in words.items() for t, c in o.items()] + [("p", "A", 9)], "token string, tag string, cost int")
    words["p"]["A"] = min(words["p"].get("A", 9), 9)
    unknown = [("X", 1), ("B", 2)]
    texts = [" ".join(rng.choice("pqrstuzP") for _ in range(rng.randint(1, 7))) + rng.choice(".!?") for _ in range(60)]
    rows = [(i, " ".join(texts[i : i + rng.randint(0, 4)])) for i in range(50)] + [(98, None), (99, " . ! ")]
    for limit in (None, 0):
        df = spark.createDataFrame(rows, "id int, text string").repartition(3)
        before = tg.fits
        if limit == 0:
            tg.fits = lambda dim: False
        try:
            found = tg.tag_tokens(df, "id", "text", lexicon, transitions, unknown, other=6).collect()
        finally:
            tg.fits = before
        by_id = defaultdict(dict)
        for r in found:
            by_id[r["id"]][r["sentence"]] = (r["tokens"], r["tags"])
        for i, text in rows[:-2]:
            sentences = [s for s in (text or "").replace("!", ".").replace("?", ".").split(".") if s.strip()]
            assert sorted(by_id[i]) == list(range(len(sentences)))
            for k, sentence in enumerate(sentences):
                tokens = sentence.split()
                options = [words.get(t.lower(), dict(unknown)) for t in tokens]
                assert by_id[i][k] == (tokens, cheapest(options, transitions, 6))
        assert 98 not in by_id and 99 not in by_id
    with pytest.raises(ValueError):
        tg.tag_tokens(df, "id", "text", lexicon, transitions, [])


def test_a_long_sentence_is_tagged(spark):
    text = " ".join(["the", "zog"] * 2500)
    lexicon = spark.createDataFrame([("the", "DET", 0)], "token string, tag string, cost int")
    df = spark.createDataFrame([(1, text)], "id int, text string")
    (row,) = tg.tag_tokens(df, "id", "text", lexicon, {("DET", "NOUN"): 0}, [("NOUN", 1), ("VERB", 1)]).collect()
    assert row["tags"] == ["DET", "NOUN"] * 2500


def test_tags_of_sentences_together(spark, monkeypatch):
    """no word is shuffled for a lexicon that fits; sentences of all lengths, also with few pairs at once."""
    random.seed(4)
    tags, words = ["A", "B", "C", "D"], [f"w{i}" for i in range(30)]
    entries = [(w, t, random.randint(0, 3)) for w in words[:20] for t in random.sample(tags, random.randint(1, 4))]
    transitions = {(a, b): random.randint(0, 4) for a in ["", *tags] for b in tags if random.random() < 0.6}
    unknown = [("B", 2), ("X", 1), ("B", 1)]
    rows = [(i, ". ".join(" ".join(random.choices(words, k=random.choice([1, 2, 5, 40]))) for _ in range(3))) for i in range(20)]
    rows += [(i, "W1 W1. w2") for i in (50, 50, None, None)] + [(60, None), (61, " . ")]
    df = spark.createDataFrame(rows, "id int, text string")
    options = defaultdict(list, {w: sorted((t, c) for x, t, c in entries if x == w) for w in words[:20]})

    def cheapest(sentence):
        ways = {"": (0, [])}
        for word in sentence:
            ways = {tag: (min((w[0] + transitions.get((b, tag), 8), b) for b, w in ways.items()), cost, tag) for tag, cost in
                    options.get(word.lower(), [("B", 1), ("X", 1)])} | {"_": ways}
            before = ways.pop("_")
            ways = {tag: (way[0] + cost, before[way[1]][1] + [tag]) for tag, (way, cost, _) in ways.items()}
        return min((w[0], tag, w[1]) for tag, w in ways.items())[2]

    lexicon = spark.createDataFrame(entries, "token string, tag string, cost int")
    for pairs, fit in ((1 << 20, True), (1, True), (20, False)):
        monkeypatch.setattr(tg, "STEP_PAIRS", pairs)
        monkeypatch.setattr(tg, "fits", lambda dim: fit)  # noqa: B023
        made = tg.tag_tokens(df, "id", "text", lexicon, transitions, unknown)
        if fit:
            assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
        found = {(r["id"], r["sentence"]): r for r in made.collect()}
        assert len(found) == 60 + 4 and found[50, 0]["tokens"] == ["W1"] * 4 and found[None, 1]["tokens"] == ["w2"] * 2
        for r in found.values():
            assert r["tags"] == cheapest(r["tokens"])


def test_relational_constraints_are_joined_once(spark):
    rows = [(i, "one two three" if i % 2 else "four five", "who asks") for i in range(6)]
    df = spark.createDataFrame(rows, "k int, gen string, prompt string")
    model = BigramModel.fit(spark.createDataFrame([("who asks one two",)], "t string"), "t")
    vectors = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (0, 1, 0, [1.0, 0.0]), (1, 0, 0, [1.0, 0.0]), (77, 0, 0, [1.0, 1.0])],
                                    "k int, side int, at int, vector array<double>")
    table = spark.createDataFrame([(2, 10.0), (3, None)], "k int, v double")
    merged = cs.Merged([
        cs.Fluency(model=model), cs.PairMatch(weight=2.0, vectors=vectors), cs.Joined(weight=3.0, table=table, column="v", missing=-1.0),
        cs.StructRange(weight=5.0, lower=4, upper=4)], use_prompt=True)
    scored = merged.scored(df, "k", F.col("gen"), F.col("prompt"))
    assert scored.columns == ["k", "gen", "prompt", "score"]
    fluency = {r["k"]: r["fluency"] for r in model.fluency(df.withColumn("x", F.concat("prompt", F.lit(" "), "gen")), "k", "x").collect()}
    for r in scored.collect():
        expected = fluency[r["k"]] + 2.0 * (r["k"] == 0) + 3.0 * (10.0 if r["k"] == 2 else -1.0) + 5.0 / (1 + abs(len((r["prompt"] + " " + r["gen"]).split()) - 4))
        assert r["score"] == pytest.approx(expected)
    with pytest.raises(TypeError):
        merged.score(F.col("gen"))
    plain = cs.Merged([cs.StructRange(lower=2, upper=3)])
    assert plain.scored(df, "k", F.col("gen")).filter("score = 1").count() == 6


def test_one_join_for_all_relations(spark):
    df = spark.range(5).select("id", F.lit("a b").alias("gen"))
    tables = [spark.range(5).select("id", (F.col("id") * n).alias("value")) for n in range(3)]
    merged = cs.Merged([cs.Joined(table=t) for t in tables])
    scored = merged.scored(df, "id", F.col("gen"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r["id"]: r["score"] for r in scored.collect()} == {i: 3.0 * i for i in range(5)}


def files(spark):
    root, catalog = fresh_path(spark, "files"), cat.Catalog(spark)
    for i in range(40):
        part = "train" if i % 2 else "test"
        spark.createDataFrame([(i, f'say "{i}",\nnow', "x")], "id int, body string, kind string").coalesce(1).write.options(
            header=True, quote='"', escape='"').csv(f"{root}/ag news+1/{part}/n{i}")
        spark.createDataFrame([(i + 100, f"j{i}")], "no long, said string").coalesce(1).write.json(f"{root}/spam/{part}/n{i}")
    spark.createDataFrame([("line one",), ("line two",)], "value string").coalesce(1).write.text(f"{root}/plain")
    catalog.register_files(
        *[cat.Files("ag_news", "csv", f"{root}/ag news+1/{part}/*", {"id": ("id", "int"), "text": ("body", "string"), "label": ("kind", "string")}, part)
          for part in ("train", "test")],
        *[cat.Files("sms_spam", "json", f"{root}/spam/{part}/n*", {"id": ("no", "int"), "text": ("said", "string")}, part) for part in ("train", "test")],
        cat.Files("plain-prompts", "text", f"{root}/plain", {"text": ("value", "string")}))
    return root, catalog


def test_files_are_read_by_one_scan_a_format(spark):
    root, catalog = files(spark)
    rows = catalog.scan(["id", "text", "label"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3
    found = Counter(tuple(r) for r in rows.collect())
    expected = Counter()
    for i in range(40):
        part = "train" if i % 2 else "test"
        expected[("ag_news", part, i, f'say "{i}",\nnow', "x")] += 1
        expected[("sms_spam", part, i + 100, f"j{i}", None)] += 1
    expected.update([("plain-prompts", "train", None, "line one", None), ("plain-prompts", "train", None, "line two", None)])
    assert found == expected
    assert catalog.scan(["id"], split="test").count() == 40 and catalog.scan(["text"], names=["sms_spam"]).count() == 40
    assert catalog.load("sms_spam", "test").columns == ["id", "text"] and catalog.load("sms_spam", "test").count() == 20
    for bad in (lambda: catalog.scan(["nothing"]), lambda: catalog.scan(["id"], names=["imdb"]), lambda: catalog.load("sms_spam", "other"),
                lambda: cat.Files("imdb", "xml", "x", {}), lambda: cat.Files("imdb", "text", "x", {"a": ("b", "string")}),
                lambda: catalog.register_files(cat.Files("unheard", "json", "x", {}))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("pattern,path,fits", [
    ("/a/*.csv", "file:///a/b.csv", True), ("/a/*.csv", "file:/a/b.csv", True), ("/a/*.csv", "/a/c/b.csv", False),
    ("s3a://k/a/{x,y}?/n[0-3]", "s3a://k/a/x1/n2/part-0", True), ("s3a://k/a/{x,y}?/n[!0-3]", "s3a://k/a/x1/n2", False),
    ("/a/b.c", "/a/bxc", False), ("/a/b", "/a/bc", False), ("hdfs://h:9/q/*", "hdfs://h:9/q/z", True),
])
def test_patterns(pattern, path, fits):
    import re

    assert bool(re.match(cat.pattern_regex(pattern), path)) == fits


def test_a_file_of_one_split(spark):
    root = fresh_path(spark, "one")
    for part in ("train", "test"):
        spark.createDataFrame([(part,)], "t string").write.option("header", True).csv(f"{root}/{part}/mood/own")
    catalog = cat.Catalog(spark)
    catalog.register_file(f"{root}/train/mood/own", "t string", split="train")
    catalog.register_file(f"{root}/test/mood/own", "t string", split="test")
    assert catalog.load("own", "train").first()["t"] == "train" and catalog.load("own", "test").first()["t"] == "test"
    with pytest.raises(ValueError):
        catalog.load("own", "validation")


SCHEMA = StructType([StructField("k", LongType()), StructField("n", IntegerType()), StructField("pred", StringType())])


def batch(spark, ids, word):
    return spark.createDataFrame([(i, i % 3, None if i % 10 == 9 else f"{word}{i}") for i in ids], SCHEMA)


def test_a_batch_written_twice_counts_once(spark):
    path = fresh_path(spark, "finished")
    finished = FinishedRows(spark, path, SCHEMA, ["k", "n"], buckets=4)
    todo = spark.createDataFrame([(i, i % 3, f"q{i}") for i in range(60)] + [(None, 1, "no key")], "k bigint, n int, q string")
    assert finished.read().count() == 0 and finished.pending(todo).count() == 61
    assert finished.write(batch(spark, range(30), "a"), 1, ["pred"]) == 27
    assert finished.write(batch(spark, range(30, 40), "b"), 2, ["pred"]) == 9
    assert finished.write(batch(spark, range(20), "c"), 1, ["pred"]) == 18
    kept = {r["k"]: (r["pred"], r["batch"]) for r in finished.read().collect()}
    assert kept == {**{i: (f"c{i}", 1) for i in range(20) if i % 10 != 9}, **{i: (f"b{i}", 2) for i in range(30, 39)}}
    assert {r["k"] for r in finished.pending(todo).collect()} == {None, *range(60)} - set(kept)
    # Another reader of the same folder, and a batch that is left without rows.
    other = FinishedRows(spark, path, SCHEMA, ["k", "n"], buckets=4, name="finished_other")
    assert other.read().count() == 27
    assert other.write(batch(spark, [], "d"), 2) == 0 and other.read().count() == 18


def test_a_batch_that_died_does_not_count(spark):
    finished = FinishedRows(spark, fresh_path(spark, "died"), SCHEMA, ["k"], buckets=4)
    finished.write(batch(spark, range(5), "a"), 1)

    def dies(text):
        raise RuntimeError("out of power")

    broken = batch(spark, range(5, 9), "b").withColumn("pred", F.udf(dies)("pred"))
    for number in (1, 2):
        with pytest.raises(Exception, match="out of power"):
            finished.write(broken, number)
    assert finished.read().count() == 0
    finished.write(batch(spark, range(5), "a"), 1)
    assert {r["k"] for r in finished.read().collect()} == set(range(5))


def test_finished_rows_are_not_shuffled(spark):
    finished = FinishedRows(spark, fresh_path(spark, "layout"), SCHEMA, ["k", "n"], buckets=4)
    for number in (1, 2):
        finished.write(batch(spark, range(100 * number, 100 * number + 50), "a"), number)
    plan = finished.pending(batch(spark, range(200), "x"))._jdf.queryExecution().executedPlan().toString()
    done = plan[plan.index("FileScan"):] if plan.index("FileScan") > plan.index("SortMergeJoin") else plan
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "Exchange" not in done
    with pytest.raises(ValueError):
        FinishedRows(spark, "x", SCHEMA, ["nothing"])


def vectors(spark, seed, spread):
    """Pairs of sequences around a few directions; one pair has a zero vector, one has one side."""
    rng = random.Random(seed)
    rows = []
    for pair in range(3):
        centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
        for side in range(2):
            for at in range(300):
                centre = rng.choice(centres)
                rows.append((pair, side, at, [x + rng.gauss(0, spread) for x in centre]))
    rows += [(1, 0, 900, [0.0] * 4), (1, 1, 901, [0.0] * 4), (5, 0, 0, [1.0, 0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "pair int, side int, at bigint, v array<double>").repartition(4)


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_pruned_matches_are_the_grid(spark, spread):
    df = vectors(spark, 7, spread)
    whole = {r["pair"]: r for r in sm.greedy_match(df, "pair", "side", "at", "v", block=16).collect()}
    scored, visits = sm.greedy_match_pruned(df, "pair", "side", "at", "v", block=8)
    found = {r["pair"]: r for r in scored.collect()}
    assert set(found) == set(whole) == {0, 1, 2, 5}
    for pair, r in found.items():
        for name in ("precision", "recall", "f1"):
            assert r[name] == pytest.approx(whole[pair][name], abs=1e-12)
    seen = {r["pair"]: (r["visited"], r["blocks"]) for r in visits.collect()}
    if spread < 1:  # close directions: few block pairs meet
        assert all(v <= 0.5 * n for pair, (v, n) in seen.items() if pair != 1), seen
    assert all(v <= n for v, n in seen.values())


def kn(texts):
    grams = Counter()
    for t in texts:
        ws = ["<s>", "<s>", *t.split()]
        grams.update(zip(ws, ws[1:], ws[2:]))
    pairs, singles = Counter((v, w) for _, v, w in grams), Counter()
    singles.update(w for _, w in pairs)

    def discount(counts):
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    d3, d2, d1 = map(discount, (grams, pairs, singles))

    def price(u, v, w):
        n_pairs, words = sum(singles.values()), len(singles)
        p = max(singles[w] - d1, 0) / n_pairs + d1 * words / n_pairs / (words + 1)
        after = {x: n for (y, x), n in pairs.items() if y == v}
        if after:
            p = max(after.get(w, 0) - d2, 0) / sum(after.values()) + d2 * len(after) / sum(after.values()) * p
        after = {x: n for (a, b, x), n in grams.items() if (a, b) == (u, v)}
        if after:
            p = max(after.get(w, 0) - d3, 0) / sum(after.values()) + d3 * len(after) / sum(after.values()) * p
        return p

    return price, set(singles)


@pytest.mark.parametrize("limit", [32 << 20, 400])
def test_kneser_ney_by_hand(spark, monkeypatch, limit):
    from quillspark.operators import joins as jn

    monkeypatch.setattr(jn, "BROADCAST_BYTES", limit)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    model = KneserNey.fit(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string"), "t")
    price, known = kn(texts)
    # The shares of all known words and one unknown word add up to one in every context.
    for u, v in (("<s>", "<s>"), ("a", "b"), ("zz", "a"), ("zz", "yy")):
        assert sum(price(u, v, w) for w in [*known, "unknown"]) == pytest.approx(1.0)
    asked = ["a b c", "a", "zz a b zz", "g f e d c b a", "zz"] + texts[:10] + texts[:2]
    rows = list(enumerate(asked)) + [(100, ""), (101, None)]
    found = {r["i"]: r["fluency"] for r in model.fluency(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    for i, text in enumerate(asked):
        ws = ["<s>", "<s>", *text.split()]
        logs = [math.log(price(*g)) for g in zip(ws, ws[1:], ws[2:])]
        assert found[i] == pytest.approx(sum(logs) / len(logs))
    assert found[100] is None and found[101] is None
    perplexity = {r["i"]: r["perplexity"] for r in model.perplexity(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert perplexity[0] == pytest.approx(math.exp(-found[0]))


def test_kneser_ney_without_training(spark):
    model = KneserNey.fit(spark.createDataFrame([], "t string"), "t")
    df = spark.createDataFrame([(1, "a b")], "i int, t string")
    assert model.fluency(df, "i", "t").first()["fluency"] == 0.0  # one unknown word has the whole share
    assert trigrams(df, "t").count() == 2


def test_prefix_sets(spark):
    """The same rows as prefixes in memory, from texts stored once; a choice of them; odd spaces and characters."""
    texts = ["a bb ccc", " lead  two ", "one", "", "  ", None, "é 日本 \U0001F600 x", "w " * 700 + "end", "tab\tin word", "x y\nz w"]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(0, "a bb ccc", 0)]
    df = spark.createDataFrame(rows, "id int, text string, label int").repartition(3)
    for full in (False, True):
        held = rs.PrefixSet.write(df, "text", fresh_path(spark, "prefixes"), include_full=full)
        expected = Counter(tuple(r) for r in rs.prefixes(df, "text", include_full=full).select("id", "label", "n_words", "prefix").collect())
        assert Counter(tuple(r) for r in held.read().select("id", "label", "n_words", "prefix").collect()) == expected
        assert held.count() == sum(expected.values()) == held.lengths().count()
    some = held.lengths().filter("end % 3 = 0")
    assert held.read(some).count() == some.count()
    assert set(held.read().columns) == {"id", "label", "n_words", "prefix"}
    none = rs.PrefixSet.write(df.limit(0), "text", fresh_path(spark, "prefixes"))
    assert none.count() == 0 and none.read().count() == 0


def test_stored_prefixes_grow_with_the_texts(spark):
    """Twice the words make four times the characters in prefixes and about twice the bytes stored."""
    sizes = []
    for n in (2000, 4000):
        path = fresh_path(spark, "prefixes")
        df = spark.range(20).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(
            F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(997)).cast("string"))), " ").alias("text")).coalesce(1)
        rs.PrefixSet.write(df, "text", path)
        sizes.append(sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet")))
    assert sizes[1] < 2.3 * sizes[0]


def test_parts_of_the_story_corpus(spark):
    parts = {name: spark.createDataFrame([(f"[WP] {name} one [x]",)], "prompt string") for name in ("train", "valid", "test")}
    found = recipes.story_parts(parts).collect()
    assert sorted(r["split"] for r in found) == ["test", "train", "validation"]
    assert all(r["prompt"].startswith({"validation": "valid"}.get(r["split"], r["split"])) for r in found)
    with pytest.raises(ValueError):
        recipes.story_parts({"dev": parts["train"]})


def test_prompt_files_are_one_corpus(spark):
    schema = "id string, prompt struct<text: string>, continuation struct<text: string>"
    files = [spark.createDataFrame([(f"{k}-{i}", (f"p{k}{i}",), (f"c{k}{i}",)) for i in range(20)], schema) for k in range(3)]
    rows = recipes.united_prompts(files, "id").collect()
    assert Counter(r["split"] for r in rows) == {"train": 42, "validation": 9, "test": 9}
    assert {(r["row_id"], r["prompt"], r["continuation"]) for r in rows} == {(f"{k}-{i}", f"p{k}{i}", f"c{k}{i}") for k in range(3) for i in range(20)}


def test_grid_with_a_lookup_of_constraints(spark):
    datasets = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    lookup = spark.createDataFrame([("a", "topic"), ("a", "spam"), ("b", "topic"), ("b", "topic")], "dataset string, constraint string")
    grid = jn.experiment_grid(datasets, ["g"], ["j", "k"], lookup).collect()
    assert Counter((r["dataset"], r["constraint"]) for r in grid) == {("a", "topic"): 2, ("a", "spam"): 2, ("b", "topic"): 2, ("c", None): 2}


def test_a_driver_folder_is_refused_on_a_cluster(spark, monkeypatch):
    class Context:
        def __init__(self, master):
            self.master = master

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    for folder in ("/tmp/x", "file:/tmp/x", "file:///var/tmp/x", "/tmp"):
        for master in ("spark://h:7077", "yarn", "k8s://h"):
            with pytest.raises(ValueError):
                qs._refuse_own_disk(Session(master), folder)
        qs._refuse_own_disk(Session("local[4]"), folder)
        qs._refuse_own_disk(Session("local-cluster[3,2,1000]"), folder)
    for folder in ("hdfs://h/tmp/x", "s3a://b/tmp", "/mnt/shared", "file:///mnt/shared", "/tmpfoo"):
        qs._refuse_own_disk(Session("yarn"), folder)


def test_kneser_ney_writes_nothing_per_text(spark, monkeypatch):
    """F1: tables that scoring writes are the model's, however many texts are scored."""
    from quillspark.operators import joins as jn, kneser_ney as kn_module

    monkeypatch.setattr(jn, "BROADCAST_BYTES", 300)
    rows = []

    def counted(df, name, write=kn_module.materialize):
        written = write(df, name)
        rows[-1][name] = written.count()
        return written

    monkeypatch.setattr(kn_module, "materialize", counted)
    model = None
    for times in (1, 30):
        rows.append({})
        model = model or KneserNey.fit(spark.createDataFrame([("a b c a b d",)], "t string"), "t")
        rows[-1].clear()
        df = spark.createDataFrame([(i, f"a b x{i} c a b") for i in range(times)], "i int, t string")
        assert model.fluency(df, "i", "t").count() == times
    assert rows[0] == rows[1]


@pytest.mark.parametrize("limit", [32 << 20, 40, 0])
def test_facts_without_an_answer_end_before_the_sum(spark, limit):
    """a fact that no row of the table answers is no row behind the shuffle; all facts stay for counts."""
    from quillspark.operators import joins as jn

    dim = spark.createDataFrame([("a", 1.0, 90), ("b", 2.0, 1), ("c", 4.0, 1)], "key string, term double, n bigint")
    words = ["a"] * 50 + ["b", "c", "b"] + ["never"] * 40 + [None]
    facts = spark.createDataFrame([(i % 3, w, 1) for i, w in enumerate(words)], "id int, key string, one int")
    made = jn.answered(facts, dim, "key", "n", 92, ["id"], limit=limit or 1)
    found = made.agg(F.sum("term"), F.sum("one"), F.count("term"), F.count(F.lit(1))).first()
    assert tuple(found)[:3] == (50 + 8.0, len(words), 53)
    assert found[3] == len(words) + {32 << 20: 0, 40: 3, 0: 53}[limit]


def test_block_bounds_are_spread(spark, monkeypatch):
    """the tasks that bound block pairs follow the number of block pairs, though all are of three keys; results stay."""
    df = vectors(spark, 11, 0.5)
    whole = [sorted(t.collect()) for t in sm.greedy_match_pruned(df, "pair", "side", "at", "v", block=8)]
    bounds = []

    def watched(made, name, write=sm.materialize):
        if name == "match-bounds":
            bounds.append(made._jdf.queryExecution().optimizedPlan().toString())
        return write(made, name)

    monkeypatch.setattr(sm, "materialize", watched)
    monkeypatch.setattr(sm, "BOUNDED", 200)
    assert [sorted(t.collect()) for t in sm.greedy_match_pruned(df, "pair", "side", "at", "v", block=8)] == whole
    # 38 by 38 blocks or one more of each of three pairs, 200 block pairs a part.
    assert int(re.search(r"RepartitionByExpression \[pair.*, (\d+)", bounds[0]).group(1)) >= 3 * 38 * 38 // 200


def _disk(spark):
    """Bytes of shuffle files, and of the tables in the shared folder."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    folder = shared_folder(spark)
    tables = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]
    return sum(os.path.getsize(f) for f in [*held, *tables] if os.path.exists(f))


def test_kneser_ney_keeps_little_on_disk(spark, monkeypatch):
    """what a fit and a scoring in waves leave on disk is the model, some bytes a gram, and no shuffle of what has ended."""
    from quillspark.operators import kneser_ney as kn_module

    monkeypatch.setattr(kn_module, "WAVE_BYTES", 1 << 17, raising=False)
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(20_000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(known, k=500))) for i in range(160)], "i int, t string")
    before = _disk(spark)
    scored = KneserNey.fit(df, "t").fluency(df, "i", "t")
    assert _disk(spark) - before < 60 * 160 * 500
    assert scored.count() == 160


def test_kneser_ney_in_blocks_buckets_and_waves(spark, monkeypatch):
    """texts that are cut, grams of many blocks and buckets, and ids that are null or come again, in several waves."""
    from quillspark.operators import kneser_ney as kn_module

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    trained = spark.createDataFrame([(t,) for t in texts[:40]] + [(None,)], "t string").repartition(3)
    price, _ = kn(texts[:40])
    rows = [(None if i % 20 == 7 else f"k{i % 45}", t + " new" * (i % 3)) for i, t in enumerate(texts)] + [("no text", None), ("empty", " . ")]
    logs = {}
    for key, text in rows:
        ws = ["<s>", "<s>", *(text or "").replace(".", "").split()]
        logs.setdefault(key, []).extend(math.log(price(*g)) for g in zip(ws, ws[1:], ws[2:]))
    expected = {key: pytest.approx(sum(x) / len(x)) if x else None for key, x in logs.items()}
    for block, bucket, wave in ((7, 16, 200), (1, 500, 1), (50, 1 << 20, 1 << 20)):
        for name, value in (("BLOCK_WORDS", block), ("BUCKET_WORDS", bucket), ("WAVE_BYTES", wave)):
            monkeypatch.setattr(kn_module, name, value)
        model = KneserNey.fit(trained, "t")
        monkeypatch.setattr(kn_module, "BUCKET_WORDS", max(1, bucket // 4))  # texts may ask for more buckets than the model has
        found = model.fluency(spark.createDataFrame(rows, "id string, t string").repartition(2), "id", "t").collect()
        assert len(found) == len(expected) and {r["id"]: r["fluency"] for r in found} == expected


def test_gram_blocks_tell_equal_heads_apart():
    """fingerprints whose first 64 bits are equal, in any order; numbers of any width come back as they were."""
    import numpy as np

    from quillspark.operators import gram_blocks as gb

    heads = np.array([9, 5, 5, 9, 5, 2**64 - 1, 5], np.uint64)
    tails = np.array([1, 7, 3, 1, 7, 0, 4], np.uint16)
    first, second, places = gb.ranked(heads, tails)
    assert list(zip(first.tolist(), second.tolist())) == [(5, 3), (5, 4), (5, 7), (9, 1), (2**64 - 1, 0)]
    assert places.tolist() == [3, 2, 0, 3, 2, 4, 1]
    for values in ([], [0, 0], [3], [255, 256], [2**64 - 1, 0, 70_000]):
        assert gb.unpacked(gb.packed(np.array(values, np.uint64))).tolist() == values
    grams = gb.Grams(first, second, places)
    model = gb.cut_rows(grams, [np.array([10, 20, 30, 40, 50])], 1, slot=0, block=gb.MODEL, kind=3)
    asked = gb.Grams(np.array([5, 5, 5, 8, 9], np.uint64), np.array([2, 4, 7, 1, 1], np.uint16), places)
    answers = gb.answered({3: 1})(gb.as_table(model + gb.cut_rows(asked, [], 1, slot=4, block=6, kind=3))).to_pylist()
    assert [(r["slot"], r["block"]) for r in answers] == [(4, 6)]
    assert gb.unpacked(answers[0]["counts"]).tolist() == [0, 20, 30, 0, 40]
