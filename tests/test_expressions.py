"""Column expressions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import labels as lb, parse, text as tx, tokens as tk
from quillspark.operators import classify as cl, constraints as cs, prompts as pr


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("a b c", ["a", "b", "c"]), ("", []), ("don't 3.5", ["don", "t", "3", "5"]), ("été, là", ["été", "là"])])
def test_words(spark, text, expected):
    assert value(spark, tk.words(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("A b. C d! ", ["A b.", "C d!"]), ("none", ["none"]), ("...", []), ("", [])])
def test_sentences(spark, text, expected):
    assert value(spark, tk.sentences(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [
    ("By . Name . Last updated x. Body. More", " Body. More"),
    ("PUBLISHED: x. 10 EST. Body", " Body"),
    ("UPDATED. Last updated", ""),
    ("By Name. Body", "By Name. Body"),
    ("Body. PUBLISHED later", "Body. PUBLISHED later"),
    ("a|b. Body", " Body"),
    ("By . x", ""),
    ("", ""),
])
def test_strip_boilerplate(spark, text, expected):
    assert value(spark, tx.strip_boilerplate(F.col("t")), t=text) == expected


def test_lead_parts(spark):
    assert value(spark, tx.lead_words(F.col("t"), 2), t="a  b c") == "a "
    assert value(spark, tx.lead_words(F.col("t"), 9), t="a b") == "a b"
    assert value(spark, tx.lead_sentences(F.col("t"), 2), t="a. b. c") == "a. b"


def test_strip_tags_and_ends(spark):
    assert value(spark, tx.strip_tags(F.col("t")), t=" [WP] a [b] c ") == "a  c"
    assert value(spark, tx.strip_ends(F.col("t")), t=" ..Hello, you!\n") == "Hello, you"


def test_fill_is_literal(spark):
    assert value(spark, tx.fill("x [text] $1", F.col("t")), t="a\\b$2") == "x a\\b$2 $1"


def test_ids(spark):
    assert value(spark, tx.clean_id(F.col("t")), t="'17'") == 17
    assert value(spark, tx.numeric_id(F.col("t")), t="n/a") is None
    assert value(spark, tx.numeric_id(F.col("t")), t="12") == 12


def test_story_prompt_is_null_without_a_sentence(spark):
    parts = [F.col("a"), F.col("b"), F.col("c")]
    assert value(spark, tx.story_prompt(parts), a="x", b="y", c="z") == " x y z"
    assert value(spark, tx.story_prompt(parts), a="x", b="y", c=None) is None


@pytest.mark.parametrize("reply, expected", [
    ("True", True), (" false.", False), ("true or false", None), ("maybe", None), ("untrue", True), (None, None)])
def test_parse_verdict(spark, reply, expected):
    assert value(spark, parse.parse_verdict(F.col("t")), t=reply) is expected


def test_parse_verdict_strict(spark):
    assert value(spark, parse.parse_verdict(F.col("t"), strict=True), t="untrue") is None


@pytest.mark.parametrize("reply, loose, strict", [
    ("Score: 10", 1.0, 1.0), ("1 of 10", 1.0, 1.0), ("17", 0.7, None), ("0", 0.0, 0.0), ("Yes", 0.7, 0.7),
    ("I know", 0.3, None), ("no", 0.3, 0.3), ("?", None, None), (None, None, None)])
def test_parse_score(spark, reply, loose, strict):
    assert value(spark, parse.parse_score(F.col("t")), t=reply) == loose
    assert value(spark, parse.parse_score(F.col("t"), strict=True), t=reply) == strict


@pytest.mark.parametrize("reply, expected", [("a | b", " b"), ("a", "a"), ("a|b|c", "a|b|c"), (None, None)])
def test_parse_cot(spark, reply, expected):
    assert value(spark, parse.parse_cot(F.col("t")), t=reply) == expected


def test_judge_score(spark):
    assert value(spark, parse.judge_score(F.col("v"), 0), v=0.7) == pytest.approx(0.3)
    assert value(spark, parse.judge_score(F.lit(None).cast("boolean"), 0), v=0.0) == 0.0


@pytest.mark.parametrize("text, score, distance", [
    ("a b", 1.0, 0.0), ("a b c", 1.0, 0.0), ("a", 0.5, -1.0), ("a b c d e", 1 / 3, -2.0), ("", 1 / 3, -2.0),
    (None, None, None)])
def test_struct_range(spark, text, score, distance):
    assert value(spark, cs.StructRange().score(F.col("t")), t=text) == (score if score is None else pytest.approx(score))
    assert value(spark, cs.StructRange(zero_to_one=False).score(F.col("t")), t=text) == distance


@pytest.mark.parametrize("text, score", [("The cats!", 1.0), ("The cat", 0.5), ("a cats", 0.5), ("a cat", 0.0)])
def test_start_end(spark, text, score):
    assert value(spark, cs.StartEnd(start="The", end="cats").score(F.col("t")), t=text) == score
    assert value(spark, cs.StartEnd().success(F.col("t")), t=text) == 1


def test_constraint_checks_arguments():
    for bad in ({"kind": "line"}, {"pos": "XX"}, {"pos": "DET"}):
        with pytest.raises(ValueError):
            cs.StructRange(**bad)
    assert cs.StructRange().key() == "SR_word_None_2_3"
    assert cs.StartEnd(start="a", end="b").key() == "SE_a_b"


def test_spec_columns_agree_with_specs(spark):
    for spec in (cs.StructRange(), cs.StructRange(lower=3), cs.StructRange(kind="sentence"),
                 cs.StructRange(pos="DET", lexicon={"the": "DET"})):
        parts = (F.lit(spec.kind), F.lit(spec.pos).cast("string"), F.lit(spec.lower), F.lit(spec.upper))
        assert value(spark, cs.range_instruction(*parts), t="") == spec.instruction()
        assert value(spark, cs.range_key(*parts), t="") == spec.key()


def test_class_scores(spark):
    logits = F.array(F.lit(1.0), F.lit(3.0), F.lit(2.5))
    assert value(spark, cs.class_score(logits, 1, "diff"), t="") == pytest.approx(0.5)
    assert value(spark, cs.class_score(logits, 0, "diff"), t="") == pytest.approx(-2.0)
    total = sum(value(spark, cs.class_score(logits, c), t="") for c in range(3))
    assert total == pytest.approx(1.0)
    assert value(spark, cl.softmax(logits), t="")[1] == pytest.approx(value(spark, cs.class_score(logits, 1), t=""))


def test_prompts(spark):
    filled = value(spark, pr.judge_prompt(F.col("t"), "Is it short?"), t="hello")
    assert "\nhello\n" in filled and "Is it short?" in filled and filled.endswith(pr.REPLY_CUE)
    assert value(spark, pr.generation_prompt(F.col("t")), t="x") == "x" + pr.CONTINUE + "[/INST]"
    assert pr.CONTINUE not in value(spark, pr.generation_prompt(F.col("t"), "[INST]Be brief"), t="x[INST]")


def test_attribute_schemes():
    with pytest.raises(ValueError):
        lb.attribute_label("other", lb.BIAS_ATTRIBUTES)


def test_target_score(spark):
    score = cl.target_score(F.col("l"), F.col("s"), "POS")
    assert value(spark, score, l="pos", s=0.8) == pytest.approx(0.8)
    assert value(spark, score, l="neg", s=0.8) == pytest.approx(0.2)


def test_small_helpers(spark):
    assert value(spark, tx.icontains(F.col("t"), "ABC"), t="xabcx") is True
    assert value(spark, tx.with_instruction(F.col("t"), "]", "["), t="x") == "[x]"
    assert value(spark, lb.demo_target(F.col("s")), s=6.0) == "False"
    assert value(spark, lb.demo_target(F.col("s")), s=7.0) == "True"
    assert value(spark, tx.mask_pad(tx.pad_ids(F.array(F.lit(5)), 3, 0), 0), t="") == [5, -100, -100]
    assert value(spark, cs.top2_margin(F.array(F.lit(1.0), F.lit(4.0), F.lit(2.0))), t="") == 2.0
    assert value(spark, tk.bind(F.col("s"), lambda s: s + s), s=2.0) == 4.0
