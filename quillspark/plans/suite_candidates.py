"""Registered queries: constraints, prompts, generation and judging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import parse
from quillspark.operators import constraints as cs, opaque as op, prompts as pr
from quillspark.operators.language_model import BigramModel
from quillspark.operators.similarity import greedy_match
from quillspark.operators.sampling import split_exact
from quillspark.plans import standins as st
from quillspark.plans.registry import query
from quillspark.plans.standins import table, with_tables

PUNCTUATION_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""
WITH n AS (SELECT doc_id, len({st.words_sql('text')}) AS n FROM documents)
SELECT doc_id, round(CASE WHEN n BETWEEN 100 AND 200 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 200, 100 - n) + 1) END, 6)
  AS score, (CASE WHEN n BETWEEN 100 AND 200 THEN 0 ELSE -greatest(n - 200, 100 - n) END)::DOUBLE AS distance FROM n""")
def word_count_range(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return st.texts(spark, sf).select(
        "doc_id", F.round(cs.StructRange(lower=100, upper=200).score(text), 6).alias("score"),
        cs.StructRange(lower=100, upper=200, zero_to_one=False).score(text).alias("distance"))


@query(f"""
WITH n AS (SELECT doc_id, len({st.SENT}) AS n FROM documents)
SELECT doc_id, round(0.5 * CASE WHEN n BETWEEN 5 AND 9 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 9, 5 - n) + 1) END, 6)
  AS score FROM n""")
def sentence_count_range(spark: SparkSession, sf: str) -> DataFrame:
    score = cs.StructRange(kind="sentence", lower=5, upper=9, weight=0.5).score(F.col("text"))
    return st.texts(spark, sf).select("doc_id", F.round(score, 6).alias("score"))


@query(f"""
WITH n AS (SELECT lang, len({st.words_sql('text')}) AS n, trim(trim(text, {st.SPACE}), {PUNCTUATION_SQL}) AS core
  FROM documents)
SELECT lang, round(avg((n BETWEEN 20 AND 200)::INTEGER::DOUBLE), 6) AS in_range,
  round(avg((starts_with(core, 'The') AND ends_with(core, 's'))::INTEGER::DOUBLE), 6) AS start_end FROM n GROUP BY lang""")
def constraint_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    flags = st.texts(spark, sf).select(
        "lang", cs.StructRange(lower=20, upper=200, zero_to_one=False).success(text).alias("a"),
        cs.StartEnd(start="The", end="s").success(text).alias("b"))
    return flags.groupBy("lang").agg(F.round(F.avg("a"), 6).alias("in_range"), F.round(F.avg("b"), 6).alias("start_end"))


DET_SQL = ", ".join(_sql(w) for w, tag in sorted(st.LEXICON.items()) if tag == "DET")


@query(f"""
WITH n AS (SELECT doc_id, len(list_filter({st.words_lower_sql('text')}, lambda w: w IN ({DET_SQL}))) AS n FROM documents)
SELECT doc_id, n::INTEGER AS n_tagged,
  round(CASE WHEN n BETWEEN 5 AND 20 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 20, 5 - n) + 1) END, 6) AS score,
  round(CASE WHEN n BETWEEN 5 AND 20 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 20, 5 - n) + 1) END, 6) AS joined_score
FROM n""")
def pos_count_range(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged words twice: inside the row, and through a lexicon table."""
    lexicon = spark.createDataFrame(list(st.LEXICON.items()), "token string, tag string")
    docs = st.texts(spark, sf).select("doc_id", "text")
    counted = cs.tagged_counts(docs, "doc_id", "text", lexicon, "DET")
    inside = cs.StructRange(pos="DET", lower=5, upper=20, lexicon=st.LEXICON).score(F.col("text"))
    scored = docs.select("doc_id", F.round(inside, 6).alias("score"))
    return scored.join(counted, "doc_id").select(
        "doc_id", "n_tagged", "score", F.round(cs.range_score(F.col("n_tagged"), 5, 20), 6).alias("joined_score"))


@query(f"""
WITH c AS (SELECT doc_id, trim(trim(text, {st.SPACE}), {PUNCTUATION_SQL}) AS core FROM documents)
SELECT doc_id, (starts_with(core, 'The')::INTEGER + ends_with(core, 's')::INTEGER) / 2.0::DOUBLE AS both,
  (starts_with(core, 'The')::INTEGER + 1) / 2.0::DOUBLE AS start_only FROM c""")
def start_end_score(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", cs.StartEnd(start="The", end="s").score(text).alias("both"),
        cs.StartEnd(start="The").score(text).alias("start_only"))


@query(with_tables(st.JUDGED, f"""
, x AS (SELECT *, prompt || ' ' || gen AS text FROM verdicts),
n AS (SELECT *, len({st.words_sql('text')}) AS n, len({st.SENT}) AS s,
  CASE WHEN pred THEN 1.0 ELSE 0.0 END AS j FROM x)
SELECT doc_id, cand_idx, round(
  CASE WHEN n BETWEEN 40 AND 80 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 80, 40 - n) + 1) END
  + 0.5 * CASE WHEN s BETWEEN 2 AND 4 THEN 1 ELSE 1.0::DOUBLE / (greatest(s - 4, 2 - s) + 1) END
  + 2.0 * j, 10) AS score FROM n"""))
def merged_constraints(spark: SparkSession, sf: str) -> DataFrame:
    judged = st.judged(spark, sf)
    scored = judged.withColumn("judge", parse.judge_score(parse.parse_verdict(F.col("response"))))
    merged = cs.Merged([
        cs.StructRange(lower=40, upper=80), cs.StructRange(kind="sentence", lower=2, upper=4, weight=0.5),
        cs.ScoreColumn(weight=2.0, column="judge"),
    ], use_prompt=True)
    return scored.select("doc_id", "cand_idx",
                         F.round(merged.score(F.col("gen"), F.col("prompt")), 10).alias("score"))


@query(f"""
WITH s AS (SELECT lang, source, min(len({st.words_sql('text')})) AS lo, max(len({st.words_sql('text')})) AS hi
  FROM documents GROUP BY ALL),
k AS (SELECT *, CASE lang WHEN 'es' THEN 'sentence' ELSE 'word' END AS kind,
  CASE lang WHEN 'en' THEN 'NOUN' WHEN 'de' THEN 'VERB' END AS pos FROM s)
SELECT lang, source, 'SR_' || kind || '_' || coalesce(pos, 'None') || '_' || lo || '_' || hi AS key,
  '. Write ' || CASE WHEN lo = hi THEN 'exactly ' || lo ELSE 'from ' || lo || ' to ' || hi END || ' '
  || CASE WHEN kind = 'sentence' THEN 'sentences' WHEN pos = 'NOUN' THEN 'words used as nouns'
    WHEN pos = 'VERB' THEN 'words used as verbs' ELSE 'words' END AS instruction FROM k""")
def constraint_spec_text(spark: SparkSession, sf: str) -> DataFrame:
    """A specification per language and source, from the lengths found there, as key and instruction."""
    size = cs.StructRange().count(F.col("text"))
    spec = st.texts(spark, sf).select("lang", "source", size.alias("n")).groupBy("lang", "source").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"))
    kind = F.when(F.col("lang") == "es", "sentence").otherwise("word")
    pos = F.when(F.col("lang") == "en", "NOUN").when(F.col("lang") == "de", "VERB")
    parts = (kind, pos, F.col("lo"), F.col("hi"))
    return spec.select("lang", "source", cs.range_key(*parts).alias("key"),
                       cs.range_instruction(*parts).alias("instruction"))


LOGITS_SQL = """
logits AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l, label FROM embeddings)"""


@query(with_tables(LOGITS_SQL, "SELECT vec_id, round(l[label + 1], 6) AS score FROM logits"))
def class_score_value(spark: SparkSession, sf: str) -> DataFrame:
    score = cs.class_score(F.col("logits"), F.col("label"), "value")
    return st.logits(spark, sf).select("vec_id", F.round(score, 6).alias("score"))


@query(with_tables(LOGITS_SQL, """
SELECT vec_id, round(exp(l[label + 1]) / list_sum(list_transform(l, lambda x: exp(x))), 6) AS score FROM logits"""))
def class_score_softmax(spark: SparkSession, sf: str) -> DataFrame:
    score = cs.class_score(F.col("logits"), F.col("label"))
    return st.logits(spark, sf).select("vec_id", F.round(score, 6).alias("score"))


@query(with_tables(LOGITS_SQL, """
SELECT vec_id, round(CASE WHEN list_position(l, list_max(l)) = label + 1 THEN l[label + 1] - list_reverse_sort(l)[2]
  ELSE l[label + 1] - list_max(l) END, 6) AS score,
  round(list_max(l) - list_reverse_sort(l)[2], 6) AS margin FROM logits"""))
def class_score_diff(spark: SparkSession, sf: str) -> DataFrame:
    score = cs.class_score(F.col("logits"), F.col("label"), "diff")
    return st.logits(spark, sf).select("vec_id", F.round(score, 6).alias("score"),
                                       F.round(cs.top2_margin(F.col("logits")), 6).alias("margin"))


BIGRAM_SQL = st.SPLIT_TRAIN + f""",
train AS (SELECT doc_id, {st.words_lower_sql('text')} AS t FROM parts WHERE split = 'train'),
tok AS (SELECT unnest(list_concat(['<s>'], t[1:len(t) - 1])) AS v, unnest(t) AS w FROM train WHERE len(t) > 0),
c AS (SELECT v, w, count(*) AS n FROM tok GROUP BY v, w),
cv AS (SELECT v, sum(n) AS n_v FROM c GROUP BY v),
nv AS (SELECT count(DISTINCT w) AS nv FROM c)"""

FLUENCY_SQL = BIGRAM_SQL + f""",
alltok AS (SELECT doc_id, {st.words_lower_sql('text')} AS t FROM documents),
big AS (SELECT doc_id, unnest(list_concat(['<s>'], t[1:len(t) - 1])) AS v, unnest(t) AS w FROM alltok WHERE len(t) > 0),
flu AS (SELECT doc_id,  avg(ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(cv.n_v, 0) + nv + 1)::DOUBLE)) AS fluency
  FROM big LEFT JOIN c USING (v, w) LEFT JOIN cv USING (v), nv GROUP BY doc_id)"""


def _bigram_model(spark: SparkSession, sf: str) -> BigramModel:
    train = split_exact(st.labelled(spark, sf), "doc_id").filter(F.col("split") == "train")
    return BigramModel.fit(train, "text")


@query(with_tables(FLUENCY_SQL, "SELECT doc_id, round(fluency, 6) AS fluency FROM flu"))
def lm_fluency(spark: SparkSession, sf: str) -> DataFrame:
    scored = _bigram_model(spark, sf).fluency(st.texts(spark, sf), "doc_id", "text")
    return scored.select("doc_id", F.round("fluency", 6).alias("fluency"))


@query(with_tables(FLUENCY_SQL, "SELECT doc_id, round(exp(-fluency), 4) AS perplexity FROM flu"))
def lm_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    scored = _bigram_model(spark, sf).perplexity(st.texts(spark, sf), "doc_id", "text")
    return scored.select("doc_id", F.round("perplexity", 4).alias("perplexity"))


@query(with_tables(st.JUDGED, """
SELECT doc_id, cand_idx, coalesce(pred::INTEGER::DOUBLE, 0) AS desired, coalesce(1 - pred::INTEGER::DOUBLE, 0)
  AS undesired FROM verdicts"""))
def judge_constraint(spark: SparkSession, sf: str) -> DataFrame:
    verdict = parse.parse_verdict(F.col("response"))
    return st.judged(spark, sf).select("doc_id", "cand_idx", parse.judge_score(verdict).alias("desired"),
                                       parse.judge_score(verdict, desired_class=0).alias("undesired"))


@query("""
WITH t AS (SELECT vec_id // 10 AS pair, vec_id % 2 AS side, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings),
m AS (SELECT p.pair, p.vec_id AS p, r.vec_id AS r, list_cosine_similarity(p.e, r.e) AS s
  FROM t p JOIN t r ON p.pair = r.pair WHERE p.side = 0 AND r.side = 1),
pr AS (SELECT pair, avg(b) AS v FROM (SELECT pair, p, max(s) AS b FROM m GROUP BY pair, p) GROUP BY pair),
re AS (SELECT pair, avg(b) AS v FROM (SELECT pair, r, max(s) AS b FROM m GROUP BY pair, r) GROUP BY pair)
SELECT pair, round(pr.v, 6) AS precision, round(re.v, 6) AS recall, round(2 * pr.v * re.v / (pr.v + re.v), 6) AS f1
FROM pr JOIN re USING (pair)""")
def greedy_match_f1(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("pair"), (F.col("vec_id") % 2).alias("side"), "vec_id", "embedding")
    scored = greedy_match(vectors, "pair", "side", "vec_id", "embedding")
    return scored.select("pair", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


CONSTRAINT_OF_LANG = {"en": "sentiment", "de": "humor", "fr": "formality", "es": "toxicity"}


def _template_sql(score: bool, cot: bool) -> str:
    whens = " ".join(
        f"WHEN {_sql(lang)} THEN {_sql(pr.judge_template(st.QUESTIONS[c], score, cot))}" for lang, c in CONSTRAINT_OF_LANG.items())
    return f"CASE lang {whens} END"


@query(f"""
SELECT doc_id, replace({_template_sql(False, False)}, '[text]', text) AS verdict_prompt,
  replace({_template_sql(True, True)}, '[text]', text) AS score_prompt FROM documents""")
def zeroshot_judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(part) for pair in CONSTRAINT_OF_LANG.items() for part in pair])
    constraint = F.element_at(names, F.col("lang"))
    docs = table(spark, sf, "documents").select("doc_id", "text", constraint.alias("constraint"))
    asked = pr.with_judge_prompt(docs, st.wording(spark), "text", out="verdict_prompt")
    both = pr.with_judge_prompt(asked, st.wording(spark), "text", out="score_prompt", score=True, cot=True)
    return both.select("doc_id", "verdict_prompt", "score_prompt")


DEMO_ROWS_SQL = ", ".join(
    f"({_sql(c)}, {_sql(t)}, {s}, {_sql(e)}, {_sql(a)})" for c, t, s, e, a in st.DEMONSTRATIONS)


def _fewshot_sql(constraint: str, k: int, score: bool, cot: bool, author: str | None = None) -> str:
    question = _sql(pr.judge_template(st.QUESTIONS[constraint], score, cot))
    target = "score::VARCHAR" if score else "CASE WHEN score > 6 THEN 'True' ELSE 'False' END"
    reply = f"explanation || ' | ' || {target}" if cot else target
    of_author = f"AND trim(author) = {_sql(author)}" if author else ""
    return f"""(SELECT string_agg(replace({question}, '[text]', text) || {reply} || chr(10), '' ORDER BY h, text)
  || {question} FROM (SELECT *, md5(text || ':42') AS h FROM demo WHERE "constraint" = {_sql(constraint)} {of_author}
  ORDER BY h, text LIMIT {k}))"""


@query(f"""
WITH demo("constraint", text, score, explanation, author) AS (VALUES {DEMO_ROWS_SQL}),
a AS MATERIALIZED (SELECT {_fewshot_sql('sentiment', 3, False, False)} AS t),
b AS MATERIALIZED (SELECT {_fewshot_sql('sentiment', 2, True, True, 'second')} AS t)
SELECT doc_id, replace(a.t, '[text]', d.text) AS verdict_prompt, replace(b.t, '[text]', d.text) AS cot_prompt
FROM documents d, a, b""")
def fewshot_judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    demos, text = st.demos(spark), F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", pr.fewshot_judge_prompt(text, demos, "sentiment", st.QUESTIONS["sentiment"], k=3).alias("verdict_prompt"),
        pr.fewshot_judge_prompt(text, demos, "sentiment", st.QUESTIONS["sentiment"], k=2, author="second",
                                          score=True, cot=True).alias("cot_prompt"))


TOPIC_TAIL = st.TOPIC_INSTRUCTION + cs.StructRange(lower=5, upper=9).instruction() + pr.END_INSTRUCTION


@query(f"""
WITH x AS (SELECT conv_id, turn, text || CASE WHEN role = 'assistant' THEN '[INST]Reply' ELSE '' END AS x
  FROM conversations)
SELECT conv_id, turn, x || CASE WHEN contains(x, '[INST]') THEN '' ELSE {_sql(pr.CONTINUE)} END
  || {_sql(TOPIC_TAIL)} AS topic_prompt, x || {_sql(pr.CONTINUE + pr.END_INSTRUCTION)} AS continue_prompt FROM x""")
def zeroshot_gen_prompt(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("role") == "assistant", "[INST]Reply").otherwise(""))
    struct = cs.StructRange(lower=5, upper=9).instruction()
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", pr.generation_prompt(text, st.TOPIC_INSTRUCTION, struct).alias("topic_prompt"),
        pr.generation_prompt(text).alias("continue_prompt"))


# Instructions and examples of our own, by dataset.
GENERATION_EXAMPLES = {
    "roc-stories": (pr.CONTINUE + " as a cheerful story[/INST]",
                    [("The boy found a map.", " It led to a field of flowers."), ("Rain fell.", " They danced in it.")]),
    "squad": ("[INST]Ask a polite question[/INST]", [("The bridge is long.", "How long is the bridge, please?")]),
}


def _example_sql(name: str) -> str:
    instruction, shown = GENERATION_EXAMPLES[name]
    front = "".join(f"[Q]{q}{instruction}[A]{a}\n" for q, a in shown) + "[Q]"
    return f"{_sql(front)} || text || {_sql(instruction + '[A]')}"


@query(f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN {_example_sql('roc-stories')} ELSE {_example_sql('squad')} END AS prompt
FROM documents""")
def fewshot_gen_prompt(spark: SparkSession, sf: str) -> DataFrame:
    dataset = F.when(F.col("lang") == "en", "roc-stories").otherwise("squad")
    prompt = pr.fewshot_generation_prompt_by(F.col("text"), dataset, GENERATION_EXAMPLES)
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))


def _greedy_steps(n: int) -> str:
    steps = [f"g0 AS (SELECT doc_id, coalesce(list_last({st.words_lower_sql('prompt')}), '<s>') AS last, "
             "[]::VARCHAR[] AS gen FROM cand)"]
    for i in range(1, n + 1):
        steps.append(
            f"g{i} AS (SELECT doc_id, best.w AS last, CASE WHEN best.w IS NULL THEN gen ELSE list_append(gen, best.w) END "
            f"AS gen FROM g{i - 1} LEFT JOIN best ON best.v = g{i - 1}.last)")
    return ",\n".join(steps)


@query(with_tables(BIGRAM_SQL + "," + st.CAND + f""",
best AS (SELECT v, w FROM c QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC, w) = 1),
{_greedy_steps(5)}""", "SELECT doc_id, array_to_string(gen, ' ') AS gen FROM g5"))
def ngram_generate(spark: SparkSession, sf: str) -> DataFrame:
    return _bigram_model(spark, sf).continue_greedy(st.cand(spark, sf), "doc_id", "prompt", steps=5)


def _sampled_steps(n: int) -> str:
    steps = [f"s0 AS (SELECT doc_id, cand_idx, coalesce(list_last({st.words_lower_sql('prompt')}), '<s>') AS last, "
             "'' AS gen FROM cand_long)"]
    for i in range(1, n + 1):
        draw = f"('0x' || substr(md5(doc_id || ':' || cand_idx || ':{i - 1}:42'), 1, 15))::BIGINT"
        steps.append(
            f"s{i} AS (SELECT doc_id, cand_idx, laid.w AS last, "
            f"CASE WHEN laid.w IS NULL THEN gen WHEN gen = '' THEN laid.w ELSE gen || ' ' || laid.w END AS gen "
            f"FROM (SELECT s.*, {draw} % cv.n_v AS u FROM s{i - 1} s LEFT JOIN cv ON cv.v = s.last) q "
            f"LEFT JOIN laid ON laid.v = q.last AND q.u >= laid.low AND q.u < laid.high)")
    return ",\n".join(steps)


@query(with_tables(BIGRAM_SQL + "," + st.CAND + f""",
laid AS (SELECT v, w, sum(n) OVER o - n AS low, sum(n) OVER o AS high FROM c
  WINDOW o AS (PARTITION BY v ORDER BY substr(md5(w), 1, 2), w)),
{_sampled_steps(3)}""", "SELECT doc_id, cand_idx, gen FROM s3"))
def ngram_sample(spark: SparkSession, sf: str) -> DataFrame:
    model = _bigram_model(spark, sf)
    return model.continue_sampled(st.cand(spark, sf), "doc_id", "prompt", n_gens=3, steps=3)


def echo_generator(prompts: Sequence[str], numbers: Sequence[int]) -> list[str | None]:
    """Stands in for a model: the prompt's words from the candidate's number on; the third one fails on short prompts."""
    made = []
    for prompt, number in zip(prompts, numbers):
        words = prompt.split(" ")[number:]
        made.append(" ".join(words) if words else None)
    return made


def length_judge(questions: Sequence[str]) -> list[str]:
    """Stands in for a model: answers by the number of words asked about."""
    return ["True" if len(q.split(" ")) % 2 else "I say false" for q in questions]


@query("""
WITH c AS (SELECT doc_id, text AS prompt, unnest([0, 1, 2])::INTEGER AS cand_idx FROM documents)
SELECT doc_id, cand_idx, prompt, CASE WHEN len(string_split(prompt, ' ')) > cand_idx
  THEN array_to_string(string_split(prompt, ' ')[1 + cand_idx:], ' ') END AS gen,
  len(string_split(prompt, ' ')) <= cand_idx AS failed FROM c""")
def generate_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates, and which of them failed."""
    prompts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    made = op.generate(prompts, echo_generator, 3, keep_failed=True)
    return made.select("doc_id", "cand_idx", "prompt", "gen", F.col("gen").isNull().alias("failed"))


@query(with_tables(st.CAND, f"""
, q AS (SELECT *, replace({_sql(pr.judge_template(st.QUESTIONS['toxicity']))}, '[text]', prompt || ' ' || gen) AS q FROM cand_long)
SELECT doc_id, cand_idx, CASE WHEN len(string_split(q, ' ')) % 2 = 1 THEN 'True' WHEN q IS NOT NULL THEN 'I say false' END
  AS response FROM q"""))
def judge_batch(spark: SparkSession, sf: str) -> DataFrame:
    judged = op.judge(st.cand_long(spark, sf), length_judge, pr.judge_template(st.QUESTIONS["toxicity"]), n=10)
    return judged.select("doc_id", "cand_idx", "response")
