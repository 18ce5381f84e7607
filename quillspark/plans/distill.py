"""From prompts to a trained classifier: candidates, verdicts, training rows, model, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.parse import judge_score, parse_cot, parse_score, parse_verdict
from quillspark.functions.text import scored_text
from quillspark.operators.classify import NaiveBayes
from quillspark.operators.metrics import accuracy
from quillspark.operators.opaque import BatchFunction, CandidateFunction, Outcome, generate, judge
from quillspark.operators.prompts import judge_template
from quillspark.operators.sampling import split_exact
from quillspark.session import materialize


def verdicts(judged: DataFrame, score: bool = False, cot: bool = False) -> DataFrame:
    """Parse the replies; unreadable ones become null."""
    reply = parse_cot(F.col("response")) if cot else F.col("response")
    return judged.withColumn("pred", parse_score(reply) if score else parse_verdict(reply))


def judged_eval(cands: DataFrame, judge_fn: BatchFunction, template: str, n: int = 1, score: bool = False,
                cot: bool = False, desired_class: int = 1) -> DataFrame:
    """How well candidates meet a constraint in a judge's eyes, per candidate number.

    The template may be a zero-shot or a few-shot one; ``unread`` counts the
    replies that could not be read.
    """
    judged = verdicts(judge(cands, judge_fn, template, n), score, cot)
    value = judge_score(F.col("pred"), desired_class)
    return judged.groupBy("cand_idx").agg(
        F.avg(value).alias("score"), F.count_if(F.col("pred").isNull()).alias("unread"),
        F.count(F.lit(1)).alias("n_samples"))


def training_rows(judged: DataFrame, include_prompt: bool = True) -> DataFrame:
    """Rows with a verdict as ``text`` and ``label``; row keys stay."""
    text = scored_text(F.col("prompt"), F.col("gen"), include_prompt)
    return (
        judged.filter(F.col("pred").isNotNull())
        .withColumn("text", text).withColumn("label", F.col("pred").cast("int"))
        .drop("prompt", "gen", "response", "pred")
    )


def train_and_predict(rows: DataFrame, row_id: str) -> DataFrame:
    """Fit naive Bayes on the train part and predict the validation part."""
    split = split_exact(rows, row_id)
    model = NaiveBayes.fit(split.filter(F.col("split") == "train"), "text", "label")
    held = split.filter(F.col("split") == "validation")
    predicted = model.predict(held, row_id, "text").select(row_id, F.col("label").alias("pred"))
    return held.select(row_id, "label").join(predicted, row_id)


def distill(prompts: DataFrame, generator: CandidateFunction, judge_fn: BatchFunction, question: str,
            prompt_id: str, n_gens: int = 3) -> DataFrame:
    """Accuracy of a classifier that was trained on a judge's verdicts.

    Model replies are written once: they are costly and may differ when asked again. Both models are asked
    in one pass that writes the training rows, so no text is written before it is needed, and a candidate's
    prompt and text are stored as one. A model that failed on every row of the job is an error.
    """
    generated, said = Outcome("generator"), Outcome("judge")
    cands = generate(prompts, generator, n_gens, outcome=generated)
    judged = verdicts(judge(cands, judge_fn, judge_template(question), n_gens, outcome=said))
    rows = materialize(training_rows(judged).select(
        F.concat_ws(":", F.col(prompt_id).cast("string"), "cand_idx").alias("row_id"), "text", "label"), "training-rows")
    generated.check()
    said.check()
    return accuracy(train_and_predict(rows, "row_id"), "pred", "label")
