"""Registered queries: evaluation metrics, classifiers and distillation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import classify as cl, metrics as mt, opaque as op, prompts as pr
from quillspark.operators.sampling import split_exact
from quillspark.plans import distill as ds, standins as st
from quillspark.plans.registry import query
from quillspark.plans.standins import table, with_tables
from quillspark.plans.suite_candidates import echo_generator, length_judge
from quillspark.session import fresh_path
from quillspark.sources.readers import read_csv
from quillspark.sources.writers import write_predictions


def _grams_sql(source: str, keys: str, text: str, orders: range) -> str:
    parts = [
        f"SELECT {keys}, {n} AS n, unnest(list_transform(range(1, len(t) - {n - 1} + 1), "
        f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS gram "
        f"FROM (SELECT {keys}, {st.marks_sql(text)} AS t FROM {source})"
        for n in orders
    ]
    return " UNION ALL ".join(parts)


@query(with_tables(st.CAND, f"""
, kept AS (SELECT doc_id, cand_idx, gen FROM cand_long WHERE gen IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS k FROM kept GROUP BY doc_id HAVING count(*) > 1),
grams AS ({_grams_sql('kept', 'doc_id', 'gen', range(1, 5))}),
d AS (SELECT doc_id, n, count(DISTINCT gram) AS c FROM grams GROUP BY doc_id, n)
SELECT s.doc_id, {", ".join(f"round(coalesce(max(CASE WHEN n = {n} THEN c END) / max(k)::DOUBLE, 0), 6) AS distinct_{n}_gram" for n in range(1, 5))}
FROM sizes s LEFT JOIN d USING (doc_id) GROUP BY s.doc_id"""))
def distinct_n(spark: SparkSession, sf: str) -> DataFrame:
    scored = mt.distinct_n(st.cand_long(spark, sf), "doc_id")
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in scored.columns[1:]])


@query(with_tables(st.CAND, f"""
, kept AS (SELECT cand_idx, gen FROM cand_long WHERE gen IS NOT NULL),
sizes AS (SELECT cand_idx, count(*) AS k FROM kept GROUP BY cand_idx HAVING count(*) > 1),
grams AS ({_grams_sql('kept', 'cand_idx', 'gen', range(1, 5))}),
d AS (SELECT cand_idx, n, count(DISTINCT gram) AS c FROM grams GROUP BY cand_idx, n)
SELECT s.cand_idx, {", ".join(f"round(coalesce(max(CASE WHEN n = {n} THEN c END) / max(k)::DOUBLE, 0), 6) AS distinct_{n}_gram" for n in range(1, 5))}
FROM sizes s LEFT JOIN d USING (cand_idx) GROUP BY s.cand_idx"""))
def distinct_n_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Three groups that hold all candidates, counted the way of hot groups."""
    scored = mt.distinct_n(st.cand_long(spark, sf), "cand_idx", floor=10)
    return scored.select("cand_idx", *[F.round(c, 6).alias(c) for c in scored.columns[1:]])


@query(with_tables(st.CONV_PAIRS, f"""
, p AS (SELECT conv_id || '-' || turn AS pair_id, replied AS pred, asked AS ref_0,
  array_to_string(list_concat(string_split(replied, ' ')[1:2], string_split(replied, ' ')[4:]), ' ') AS ref_1 FROM conv_pairs),
texts AS (SELECT pair_id, -1 AS side, pred AS text FROM p UNION ALL SELECT pair_id, 0, ref_0 FROM p
  UNION ALL SELECT pair_id, 1, ref_1 FROM p),
grams AS ({_grams_sql('texts', 'pair_id, side', 'text', range(1, 5))}),
counts AS (SELECT pair_id, n, gram, side, count(*) AS c FROM grams GROUP BY ALL),
met AS (SELECT pair_id, n, gram, coalesce(max(CASE WHEN side = -1 THEN c END), 0) AS p,
  coalesce(max(CASE WHEN side >= 0 THEN c END), 0) AS r FROM counts GROUP BY ALL),
per AS (SELECT pair_id, n, sum(p) AS p, sum(least(p, r)) AS o FROM met GROUP BY ALL),
stats AS (SELECT pair_id, count(CASE WHEN o > 0 THEN 1 END) AS usable,
  sum(CASE WHEN o > 0 THEN ln(o::DOUBLE / p::DOUBLE) END) / 4 AS m FROM per GROUP BY pair_id),
lens AS (SELECT pair_id, len({st.marks_sql('pred')}) AS c, len({st.marks_sql('ref_0')}) AS r0,
  len({st.marks_sql('ref_1')}) AS r1 FROM p),
near AS (SELECT *, CASE WHEN abs(r0 - c) < abs(r1 - c) OR (abs(r0 - c) = abs(r1 - c) AND r0 <= r1) THEN r0 ELSE r1 END
  AS r FROM lens)
SELECT pair_id, round(CASE WHEN usable = 4 THEN (CASE WHEN c > r THEN 1 ELSE exp(1 - r::DOUBLE / c) END) * exp(m)
  ELSE 0 END, 6) AS bleu FROM near LEFT JOIN stats USING (pair_id)"""))
def bleu(spark: SparkSession, sf: str) -> DataFrame:
    scored = mt.bleu(st.pairs(spark, sf), "pair_id", "pred", "refs")
    return scored.select("pair_id", F.round("bleu", 6).alias("bleu"))


@query(f"""
WITH docs AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
p AS (SELECT doc_id, array_to_string(w[11:], ' ') AS pred, array_to_string(w[1:greatest(len(w) - 10, 0)], ' ') AS ref
  FROM docs),
texts AS (SELECT doc_id, -1 AS side, pred AS text FROM p UNION ALL SELECT doc_id, 0, ref FROM p),
grams AS ({_grams_sql('texts', 'doc_id, side', 'text', range(2, 3))}),
met AS (SELECT doc_id, gram, count(CASE WHEN side = -1 THEN 1 END) AS p, count(CASE WHEN side = 0 THEN 1 END) AS r
  FROM grams GROUP BY ALL),
s AS (SELECT doc_id, sum(p)::DOUBLE AS p, sum(r)::DOUBLE AS r, sum(least(p, r))::DOUBLE AS o FROM met GROUP BY doc_id),
x AS (SELECT p.doc_id, coalesce(CASE WHEN s.r > 0 THEN o / s.r END, 0) AS recall,
  coalesce(CASE WHEN s.p > 0 THEN o / s.p END, 0) AS precision FROM p LEFT JOIN s USING (doc_id))
SELECT doc_id, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1
FROM x""")
def rouge_n(spark: SparkSession, sf: str) -> DataFrame:
    scored = mt.rouge_n(st.shifted_pairs(spark, sf), "doc_id", "pred", "ref", n=2)
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(with_tables(st.CAND, f"""
, q AS (SELECT *, replace('{pr.judge_template(st.QUESTIONS['humor']).replace("'", "''")}', '[text]', prompt || ' ' || gen) AS q
  FROM cand_long),
j AS (SELECT cand_idx, CASE WHEN q IS NOT NULL THEN len(string_split(q, ' ')) % 2 END AS pred FROM q)
SELECT cand_idx, round(avg(CASE WHEN pred = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS score,
  count(*) - count(pred) AS unread, count(*) AS n_samples FROM j GROUP BY cand_idx"""))
def judged_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of every document judged against the undesired class."""
    report = ds.judged_eval(st.cand_long(spark, sf), length_judge, pr.judge_template(st.QUESTIONS["humor"]), n=3, desired_class=0)
    return report.withColumn("score", F.round("score", 6))


NB_SQL = st.SPLIT_TRAIN + f""",
nb_train AS (SELECT toxic AS label, text FROM parts WHERE split = 'train'),
nb_tok AS (SELECT label, unnest({st.words_lower_sql('text')}) AS token FROM nb_train),
nb_tf AS (SELECT token, count(CASE WHEN label = 0 THEN 1 END) AS n0, count(CASE WHEN label = 1 THEN 1 END) AS n1
  FROM nb_tok GROUP BY token),
nb_sum AS (SELECT count(*) AS v, sum(n0)::BIGINT AS s0, sum(n1)::BIGINT AS s1 FROM nb_tf),
nb_model AS (SELECT token, n0, n1, ln((n0 + 1)::DOUBLE / (s0 + v)::DOUBLE) AS l0, ln((n1 + 1)::DOUBLE / (s1 + v)::DOUBLE) AS l1
  FROM nb_tf, nb_sum),
nb_prior AS (SELECT ln(avg((label = 0)::INTEGER::DOUBLE)) AS p0, ln(avg((label = 1)::INTEGER::DOUBLE)) AS p1
  FROM nb_train)"""


def _nb_scores_sql(source: str, ids: str) -> str:
    return f"""
nb_words AS (SELECT {ids}, unnest({st.words_lower_sql('text')}) AS token FROM {source}),
nb_found AS (SELECT {ids}, sum(l0) AS a, sum(l1) AS b FROM nb_words JOIN nb_model USING (token) GROUP BY {ids}),
nb_scores AS (SELECT {ids}, p0 + coalesce(a, 0) AS s0, p1 + coalesce(b, 0) AS s1
  FROM (SELECT {ids} FROM {source}) x LEFT JOIN nb_found USING ({ids}), nb_prior),
nb_out AS (SELECT {ids}, CASE WHEN round(s1, 6) > round(s0, 6) THEN 1 ELSE 0 END AS label,
  1 / (1 + exp(s0 - s1)) AS prob_1 FROM nb_scores)"""


def _split(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.labelled(spark, sf).select("doc_id", "text", F.col("toxic").alias("label"))
    return split_exact(rows, "doc_id")


def _part(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name)


def _toxic_model(spark: SparkSession, sf: str) -> cl.NaiveBayes:
    return cl.NaiveBayes.fit(_part(_split(spark, sf), "train"), "text", "label")


def _candidate_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.cand_long(spark, sf).filter(F.col("gen").isNotNull())
    return rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), "cand_idx").alias("cand_id"),
                       F.concat_ws(" ", "prompt", "gen").alias("text"))


CAND_TEXTS_SQL = """
texts AS (SELECT doc_id || ':' || cand_idx AS cand_id, prompt || ' ' || gen AS text FROM cand_long
  WHERE gen IS NOT NULL)"""


@query(with_tables(NB_SQL, "SELECT token, n0, n1, round(l0, 6) AS ll_0, round(l1, 6) AS ll_1 FROM nb_model"))
def nb_train(spark: SparkSession, sf: str) -> DataFrame:
    model = _toxic_model(spark, sf).table
    return model.select("token", F.col("tf")[0].alias("n0"), F.col("tf")[1].alias("n1"),
                        F.round(F.col("ll")[0], 6).alias("ll_0"), F.round(F.col("ll")[1], 6).alias("ll_1"))


VALIDATED_SQL = """
SELECT doc_id, toxic AS label, true AS beats_prior FROM parts WHERE split = 'validation'"""


@query(with_tables(st.SPLIT_TRAIN, VALIDATED_SQL))
def lr_train(spark: SparkSession, sf: str) -> DataFrame:
    """Every validation row gets a prediction, and the fit has a smaller training loss than the class shares alone."""
    rows = _split(spark, sf)
    model = cl.fit_logistic(_part(rows, "train"))
    right = F.greatest(vector_to_array("probability")[F.col("label")], F.lit(1e-12))
    loss = model.transform(_part(rows, "train")).agg(
        F.avg(-F.log(right)).alias("loss"), F.avg(F.col("label").cast("double")).alias("share"))
    prior = -F.col("share") * F.log("share") - (1 - F.col("share")) * F.log(1 - F.col("share"))
    better = loss.select((F.col("loss") < prior).alias("beats_prior"))
    found = model.transform(_part(rows, "validation")).filter(F.col("prediction").isin(0.0, 1.0))
    return found.select("doc_id", "label").join(F.broadcast(better))  # one row


LENGTH_SQL = """
SELECT doc_id, round(ln(1 + n_chars), 6) AS label, true AS beats_mean FROM parts WHERE split = 'validation'"""


@query(with_tables(st.SPLIT_TRAIN, LENGTH_SQL))
def linear_train(spark: SparkSession, sf: str) -> DataFrame:
    """A label that is a number: the fit has a smaller squared error on the training part than the mean."""
    rows = split_exact(st.labelled(spark, sf), "doc_id").select(
        "doc_id", "text", F.log(1 + F.col("n_chars")).alias("label"), "split")
    model = cl.fit_linear(_part(rows, "train"))
    error = mt.mse(model.transform(_part(rows, "train")), "prediction", "label")
    spread = _part(rows, "train").agg(F.var_pop("label").alias("spread"))
    better = error.join(F.broadcast(spread)).select((F.col("mse") < F.col("spread")).alias("beats_mean"))
    found = model.transform(_part(rows, "validation")).filter(F.col("prediction").isNotNull())
    return found.select("doc_id", F.round("label", 6).alias("label")).join(F.broadcast(better))


def keyword_classifier(texts: Sequence[str]) -> list[tuple[str, float]]:
    """Stands in for an outside classifier: names a label and how sure it is."""
    return [("1", 0.75) if len(t.split(" ")) % 2 else ("0", 0.5) for t in texts]


@query(with_tables(st.CAND, """
, t AS (SELECT doc_id, cand_idx, len(string_split(gen, ' ')) % 2 AS odd FROM cand_long WHERE gen IS NOT NULL)
SELECT doc_id, cand_idx, odd::VARCHAR AS label, CASE WHEN odd = 1 THEN 0.75 ELSE 0.5 END::DOUBLE AS score FROM t"""))
def external_target_score(spark: SparkSession, sf: str) -> DataFrame:
    """The score of the wanted label from a classifier that returns a label and its score."""
    rows = st.cand_long(spark, sf).filter(F.col("gen").isNotNull())
    named = op.label_text(rows, keyword_classifier, F.col("gen"))
    return named.select("doc_id", "cand_idx", "label", cl.target_score(F.col("label"), F.col("score")).alias("score"))


def half_words(texts: Sequence[str]) -> list[float]:
    """Stands in for an outside scorer."""
    return [len(t.split(" ")) / 2 for t in texts]


@query(with_tables(st.CAND, """
, v AS (SELECT doc_id, cand_idx, len(string_split(gen, ' '))::DOUBLE AS n FROM cand_long WHERE gen IS NOT NULL)
SELECT doc_id, cand_idx, 'words' AS metric, n AS value FROM v UNION ALL
SELECT doc_id, cand_idx, 'halved', n / 2 FROM v"""))
def metrics_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the long metrics table: a finished metric is not worked out again, the other one is added."""
    rows = st.cand_long(spark, sf).filter(F.col("gen").isNotNull()).select("doc_id", "cand_idx", "gen")
    keys = ["doc_id", "cand_idx"]
    size = F.size(F.split("gen", " ")).cast("double")
    half = mt.long_metrics(rows.filter("doc_id % 2 = 0").select(*keys, size.alias("words")), keys, ["words"])
    first = mt.metric_run(rows, half, keys, {"words": lambda df: df.select(*keys, size.alias("value"))})
    return mt.metric_run(rows, first, keys, {
        "words": lambda df: df.select(*keys, F.lit(-1.0).alias("value")),  # nothing is left to do
        "halved": lambda df: op.score_text(
            df, op.throttled(half_words, 1e9), F.col("gen"), "value").select(*keys, "value"),
    })


@query(with_tables(NB_SQL + ", held AS (SELECT doc_id, text FROM parts WHERE split = 'test'),"
                   + _nb_scores_sql("held", "doc_id"), """
SELECT doc_id AS index, CASE label WHEN 1 THEN 'toxic' ELSE 'clean' END AS prediction FROM nb_out"""))
def predict_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions under their label names, written and read as a tab-separated dump."""
    path = fresh_path(spark, "predictions")
    held = _part(_split(spark, sf), "test")
    found = _toxic_model(spark, sf).predict(held, "doc_id", "text")
    named = found.withColumn("prediction", F.when(F.col("label") == 1, "toxic").otherwise("clean"))
    write_predictions(named, path, "doc_id", "prediction")
    return read_csv(spark, path, "index bigint, prediction string", sep="\t", multi_line=False)


@query(with_tables(NB_SQL + "," + st.CAND + "," + CAND_TEXTS_SQL + "," + _nb_scores_sql("texts", "cand_id"), """
SELECT cand_id, label, round(CASE WHEN label = 1 THEN prob_1 ELSE 1 - (1 - prob_1) END, 6) AS score FROM nb_out"""))
def classifier_target_score(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier names one label with its score; the score of the wanted label follows."""
    found = _toxic_model(spark, sf).predict(_candidate_texts(spark, sf), "cand_id", "text")
    return found.select("cand_id", "label",
                        F.round(cl.target_score(F.col("label"), F.col("score")), 6).alias("score"))


@query(with_tables(NB_SQL + "," + st.CAND + "," + CAND_TEXTS_SQL + "," + _nb_scores_sql("texts", "cand_id"), """
SELECT cand_id, label FROM nb_out"""))
def nb_predict_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same model where only its heaviest words may be broadcast and the others join by shuffle."""
    found = _toxic_model(spark, sf).predict(_candidate_texts(spark, sf), "cand_id", "text", limit=20_000)
    return found.select("cand_id", "label")


@query(with_tables(NB_SQL + "," + st.CAND + "," + CAND_TEXTS_SQL + "," + _nb_scores_sql("texts", "cand_id"), """
SELECT cand_id, 'toxicity' AS metric, round(prob_1, 6) AS value FROM nb_out"""))
def toxicity_score(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity per candidate as rows of the long metrics table."""
    model = _toxic_model(spark, sf)
    found = model.predict(_candidate_texts(spark, sf), "cand_id", "text")
    scored = found.select("cand_id", F.round(model.probability(1), 6).alias("toxicity"))
    return mt.long_metrics(scored, ["cand_id"], ["toxicity"])


@query(f"""
WITH c AS (SELECT doc_id, text AS prompt, unnest([0, 1, 2])::INTEGER AS cand_idx FROM documents),
g AS (SELECT doc_id || ':' || cand_idx AS row_id, prompt || ' ' || array_to_string(string_split(prompt, ' ')[1 + cand_idx:], ' ')
  AS text FROM c WHERE len(string_split(prompt, ' ')) > cand_idx),
j AS (SELECT row_id, text, len(string_split(replace('{pr.judge_template(st.QUESTIONS['toxicity']).replace("'", "''")}', '[text]', text), ' ')) % 2
  AS label FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) AS rn, count(*) OVER () AS n FROM j),
parts AS (SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r),
{NB_SQL[NB_SQL.index('nb_train AS'):].replace('SELECT toxic AS label', 'SELECT label')},
held AS (SELECT row_id, text FROM parts WHERE split = 'validation'),
{_nb_scores_sql('held', 'row_id')}
SELECT round(avg((o.label = p.label)::INTEGER::DOUBLE), 6) AS accuracy, count(*) AS n_samples
FROM nb_out o JOIN parts p USING (row_id)""")
def distill_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts, candidates, verdicts, training rows, classifier, evaluation."""
    prompts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    report = ds.distill(prompts, echo_generator, length_judge, st.QUESTIONS["toxicity"], "doc_id")
    return report.select(F.round("accuracy", 6).alias("accuracy"), "n_samples")
