"""Constraint classifiers: naive Bayes in count tables, and logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.tokens import words
from quillspark.operators.joins import answered
from quillspark.session import fresh_path, materialize


# Counted once per text beside its words.
TEXT_MARK = "\x00"


@dataclass(frozen=True)
class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing over lower-cased words."""

    table: DataFrame  # token, n, tf and ll: counts and log likelihoods, in class order
    n_tokens: int
    classes: list
    priors: list[float]
    total: int

    @staticmethod
    def fit(df: DataFrame, text: str, label: str) -> NaiveBayes:
        import math

        df = df.filter(F.col(label).isNotNull())  # rows without a label teach nothing
        # Each text has one word more, which no text holds: one pass counts words and texts.
        listed = F.concat(F.coalesce(words(F.lower(F.col(text))), F.array().cast("array<string>")), F.array(F.lit(TEXT_MARK)))
        spelled = df.select(F.col(label).alias("_c"), F.explode(listed).alias("token"))
        by_class = materialize(spelled.groupBy("token", "_c").agg(F.count(F.lit(1)).alias("n")), "class-counts")
        sizes = {r[0]: r[1] for r in by_class.filter(F.col("token") == TEXT_MARK).select("_c", "n").collect()}  # one row per class
        classes = sorted(sizes)
        everything = sum(sizes.values())
        priors = [math.log(sizes[c] / everything) for c in classes]

        tf = F.array(*[F.coalesce(F.sum(F.when(F.col("_c") == F.lit(c), F.col("n"))), F.lit(0)) for c in classes])
        grouped = by_class.filter(F.col("token") != TEXT_MARK).groupBy("token").agg(F.sum("n").alias("n"), tf.alias("tf"))
        counts = materialize(grouped, "token-counts")
        sums = [F.sum(F.col("tf")[i]).alias(f"n{i}") for i in range(len(classes))]
        first = counts.agg(F.count(F.lit(1)).alias("v"), *sums).first()
        of_class = [first[f"n{i}"] or 0 for i in range(len(classes))]
        ll = F.array(*[
            F.log((F.col("tf")[i] + 1) / F.lit(float(of_class[i] + first["v"]))) for i in range(len(classes))
        ])
        return NaiveBayes(counts.withColumn("ll", ll), first["v"], classes, priors, sum(of_class))

    def scores(self, df: DataFrame, ids: str, text: str, limit: int | None = None) -> DataFrame:
        """``ids, scores``: one joint log score per class; unknown words do not count.

        Rows without words keep their priors, by their row without a word. A row's words are summed before the last
        shuffle, and words that the table lacks don't get there. ``limit`` is the most bytes of the table to broadcast.
        """
        spelled = df.select(ids, F.explode_outer(words(F.lower(F.col(text)))).alias("token"))
        known = answered(spelled, self.table.select("token", "n", "ll"), "token", "n", self.total, [ids], limit)
        sums = [
            F.coalesce(F.sum(F.col("ll")[i]), F.lit(0.0)) + F.lit(prior)
            for i, prior in enumerate(self.priors)
        ]
        return known.groupBy(ids).agg(F.array(*sums).alias("scores"))

    def predict(self, df: DataFrame, ids: str, text: str, limit: int | None = None) -> DataFrame:
        """``ids, label, score, scores, probabilities``; ties go to the smaller class.

        ``score`` is the probability of the predicted label.
        """
        found = self.scores(df, ids, text, limit)
        rounded = F.transform("scores", lambda s: F.round(s, 6))
        best = F.array_position(rounded, F.array_max(rounded)).cast("int")
        labels = F.array(*map(F.lit, self.classes))
        return (
            found.withColumn("probabilities", softmax(F.col("scores")))
            .withColumn("label", F.element_at(labels, best))
            .withColumn("score", F.element_at("probabilities", best))
        )

    def probability(self, cls) -> Column:
        """The probability of one class, on a table made by ``predict``."""
        return F.element_at("probabilities", self.classes.index(cls) + 1)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of log scores."""
    # Lambdas see maximum and total as bound variables, so neither is computed per element.
    shifted = F.transform(
        F.array(F.array_max(scores)), lambda top: F.transform(scores, lambda s: F.exp(s - top)))[0]
    return F.transform(
        F.array(shifted), lambda parts: F.transform(
            F.array(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)),
            lambda total: F.transform(parts, lambda p: p / total))[0])[0]


def fit_logistic(df: DataFrame, text: str = "text", label: str = "label",
                 features: int = 1 << 18) -> PipelineModel:
    """Hashed word counts, inverse document frequency and logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", gaps=False, pattern=r"[\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
    ]
    # The written model comes back without its training summary, which holds on to
    # the session and so keeps the model from being shipped to tasks.
    path = fresh_path(df.sparkSession, "logistic")
    Pipeline(stages=stages).fit(df).write().save(path)
    return PipelineModel.load(path)


def fit_linear(df: DataFrame, text: str = "text", label: str = "label",
               features: int = 1 << 18) -> PipelineModel:
    """The same features with linear regression, for a label that is a number."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", gaps=False, pattern=r"[\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LinearRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01, solver="l-bfgs"),
    ]
    path = fresh_path(df.sparkSession, "linear")
    Pipeline(stages=stages).fit(df).write().save(path)
    return PipelineModel.load(path)


def target_score(label: Column, score: Column, target: str = "1") -> Column:
    """The score when the label is the target, ignoring case; else one minus it."""
    return F.when(F.lower(label.cast("string")) == target.lower(), score).otherwise(1.0 - score)
