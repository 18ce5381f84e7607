"""Dataset recipes: raw tables in, ``(text, label)`` or ``(prompt, target)`` out.

A recipe is a function of DataFrames, so a raw corpus may come from any source.
Splitting, sampling and writing are separate steps (``finish``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import labels as lb, text as tx
from quillspark.operators import filters as fl, joins as jn, sampling as sp
from quillspark.operators.reshape import group_targets
from quillspark.sources.catalog import route
from quillspark.session import materialize
from quillspark.sources.writers import write_splits

# Our own wording of the instruction suffixes; each recipe takes another one.
SUMMARY_SUFFIX = "[INST]Summarize the paragraph above in a few words[/INST]"
ANSWER_SUFFIX = "[INST]Answer the question above in a few words[/INST]"
QUESTION_SUFFIX = "[INST]Ask a question about the paragraph above[/INST]"
STORY_SUFFIX = "[INST]Tell a story of two sentences from the prompt above[/INST]"

# Class names and codes in the raw corpora.
NEWS_CLASSES = {"World": 0, "Sports": 1, "Business": 2, "Sci/Tech": 3}
FIVE_CLASS_ENDS = (0, 4)
REFUTED = "REFUTES"
CONTRADICTED = "CONTRADICT"
NOT_URGENT = "not_urgent"
URGENT = ("definitely_urgent", "extremely_urgent")
GENRES = ("romance", "horror")
CLICKBAIT = "clickbait"
# The parts of the story corpus as its files name them.
STORY_PARTS = {"train": "train", "valid": "validation", "test": "test"}


def _keys(df: DataFrame) -> list[str]:
    """The row's id, which a split needs, and the part it belongs to in a corpus that comes split."""
    return [c for c in ("row_id", "split") if c in df.columns]


def _pick(df: DataFrame, **columns: Column) -> DataFrame:
    """The wanted columns, and id and part where the rows have them."""
    return df.select(*_keys(df), *[c.alias(name) for name, c in columns.items()])


def with_row_id(df: DataFrame) -> DataFrame:
    """Give rows an id, for raw corpora without a key; written once, so that ids never change."""
    return materialize(df.withColumn("row_id", F.monotonically_increasing_id()), "row-ids")


# --- constraint data ---------------------------------------------------------

def binary_reviews(*splits: DataFrame) -> DataFrame:
    return _pick(fl.union_all(splits), text=F.col("text"), label=lb.binarize(F.col("label")))


def topic_news(*splits: DataFrame, cls: str = "World") -> DataFrame:
    return _pick(fl.union_all(splits), text=F.col("text"), label=lb.one_vs_rest(F.col("label"), NEWS_CLASSES[cls]))


def sentence_sentiment(*splits: DataFrame) -> DataFrame:
    return _pick(fl.union_all(splits), text=F.col("sentence"), label=F.col("label"))


def five_class_sentiment(*splits: DataFrame) -> DataFrame:
    kept = lb.two_class(fl.union_all(splits), "label", *FIVE_CLASS_ENDS)
    return _pick(kept, text=F.col("text"), label=F.col("label")).dropna()


def acceptability(*splits: DataFrame) -> DataFrame:
    return _pick(fl.union_all(splits), text=F.col("sentence"), label=lb.invert(F.col("label")))


def spam(df: DataFrame, text: str = "sms") -> DataFrame:
    return _pick(df, text=F.col(text), label=F.col("label"))


def toxicity_challenge(train: DataFrame, test: DataFrame, test_labels: DataFrame,
                       attribute: str = "toxicity") -> DataFrame:
    """Train rows plus the test rows whose labels were all given (-1 means not)."""
    joined = jn.join_labels(test, test_labels, "id")
    labelled = lb.drop_sentinel(joined, [c for c in lb.CHALLENGE_ATTRIBUTES.values() if c in joined.columns])
    rows = [_pick(df, text=F.col("comment_text"), label=lb.attribute_label(attribute, lb.CHALLENGE_ATTRIBUTES).cast("int"))
            for df in (train, labelled)]
    return fl.union_all(rows)


def toxicity_bias(df: DataFrame, attribute: str = "toxicity", high: float = 0.5) -> DataFrame:
    scored = _pick(df, text=F.col("comment_text"), score=lb.attribute_label(attribute, lb.BIAS_ATTRIBUTES))
    kept = lb.zero_or_high(scored, "score", high)
    return _pick(kept, text=F.col("text"), label=lb.binarize(F.col("score")))


def genre(*parts: DataFrame, text: str = "synopsis", classes: Sequence[str] = GENRES) -> DataFrame:
    kept = lb.two_class(fl.union_all(parts), "genre", *classes)
    return _pick(kept, text=F.col(text), label=F.col("label"))


def formality(*splits: DataFrame, margin: float = 1.0) -> DataFrame:
    kept = lb.margin_label(fl.union_all(splits), "avg_score", margin)
    return _pick(kept, text=F.col("sentence"), label=F.col("label"))


def clickbait_flags(df: DataFrame) -> DataFrame:
    return _pick(df, text=F.col("headline"), label=F.col("clickbait"))


def clickbait_names(df: DataFrame, value: str = CLICKBAIT) -> DataFrame:
    return _pick(df, text=F.col("title"), label=lb.label_equals(F.col("label"), value))


def urgency(texts: Sequence[DataFrame], levels: DataFrame) -> DataFrame:
    columns = ["choose_one_category", "tweet_id", "tweet_text"]
    rows = fl.union_all([df.select(*_keys(df), *columns) for df in texts]).dropna(subset=["tweet_id"])
    joined = jn.join_cleaned_id(levels, rows, "tweet_id")
    kept = lb.severity_label(joined, "urgency", NOT_URGENT, URGENT)
    return _pick(kept, text=F.col("tweet_text"), label=F.col("label"))


# --- task data ---------------------------------------------------------------

def toxic_prompts(df: DataFrame, order_by: str | Sequence[str], ratio: int = sp.HARD_EASY_RATIO) -> DataFrame:
    return struct_prompts(sp.hard_easy_mix(df, "challenging", order_by, ratio))


def struct_prompts(df: DataFrame) -> DataFrame:
    """Prompt and continuation out of their structs."""
    return _pick(df, prompt=F.col("prompt.text"), continuation=F.col("continuation.text"))


def plain_prompts(df: DataFrame, text: str = "text") -> DataFrame:
    return _pick(df, prompt=F.col(text))


def document_summary(df: DataFrame) -> DataFrame:
    return _pick(df, prompt=F.col("document"), target=F.col("summary"))


def concept_sets(df: DataFrame) -> DataFrame:
    return _pick(df, prompt=tx.concept_prompt(F.col("concepts")), concepts=F.col("concepts"), target=F.col("target"))


def translations(df: DataFrame, source: str = "es", target: str = "en") -> DataFrame:
    pair = F.col("translation")
    return _pick(df, prompt=tx.translation(pair, source), target=tx.translation(pair, target))


def news_continuation(df: DataFrame, n_words: int = tx.LEAD_WORDS) -> DataFrame:
    return _pick(df, prompt=tx.lead_words(tx.strip_boilerplate(F.col("article")), n_words))


def news_summary(df: DataFrame, n_sentences: int = tx.LEAD_SENTENCES, suffix: str = SUMMARY_SUFFIX) -> DataFrame:
    lead = tx.lead_sentences(tx.strip_boilerplate(F.col("article")), n_sentences)
    return _pick(df, prompt=tx.with_instruction(lead, suffix), target=F.col("highlights"))


def document_continuation(df: DataFrame, n_words: int = tx.LEAD_WORDS) -> DataFrame:
    return _pick(df, prompt=tx.lead_words(F.col("document"), n_words))


def explain_questions(df: DataFrame, suffix: str = ANSWER_SUFFIX) -> DataFrame:
    return _pick(df, prompt=tx.with_instruction(F.col("title"), suffix), target=F.col("answers.text"))


def claims_with_sentences(claims: Sequence[DataFrame], corpus: DataFrame, suffix: str = "",
                          use_evidence: bool = True) -> DataFrame:
    """Contradicted claims with their evidence sentences, or alone."""
    raw = fl.union_all(claims)
    if not use_evidence:
        kept = jn.evidence_filter(raw, "evidence_label", CONTRADICTED, [])
        return fl.distinct_prompts(_pick(kept, prompt=F.concat(F.lit(jn.CLAIM_MARKER), F.col("claim"))))
    kept = jn.evidence_filter(raw, "evidence_label", CONTRADICTED, ["evidence_sentences"])
    return jn.evidence_join(kept, corpus, "evidence_doc_id", "evidence_sentences", suffix=suffix)


def claims_with_pages(claims: DataFrame, pages: DataFrame, suffix: str = jn.EVIDENCE_SUFFIX) -> DataFrame:
    kept = jn.evidence_filter(claims, "label", REFUTED, ["claim"])
    named = pages.withColumnsRenamed({"id": "evidence_wiki_url", "text": "evidence"})
    return jn.claims_pages(kept, named, "evidence_wiki_url", suffix=suffix)


def context_questions(*splits: DataFrame, order: str = "id", max_sentences: int = tx.MAX_CONTEXT_SENTENCES,
                      suffix: str = QUESTION_SUFFIX) -> DataFrame:
    """One row per context with its questions; contexts with many sentences drop out first."""
    raw = max_sentences_filter(fl.union_all(splits), "context", max_sentences)
    grouped = group_targets(raw, "context", "question", order)
    return grouped.select(
        tx.with_instruction(F.col("context"), suffix).alias("prompt"), F.col("targets").alias("target"))


def max_sentences_filter(df: DataFrame, col: str, n: int = tx.MAX_CONTEXT_SENTENCES) -> DataFrame:
    return df.filter(tx.split_count(F.col(col)) <= n)


def story_lines(df: DataFrame, suffix: str = STORY_SUFFIX) -> DataFrame:
    return _pick(df, prompt=tx.with_instruction(tx.strip_tags(F.col("prompt")), suffix))


def story_parts(parts: Mapping[str, DataFrame], suffix: str = STORY_SUFFIX) -> DataFrame:
    """The story corpus from its files by the parts' own names, with ``split``."""
    unknown = set(parts) - set(STORY_PARTS)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}")
    return fl.union_all([
        story_lines(df.withColumn("split", F.lit(STORY_PARTS[part])), suffix) for part, df in parts.items()])


def united_prompts(files: Sequence[DataFrame], ids: str, path: str | None = None, max_points: int | None = None,
                   seed: int = sp.SEED) -> DataFrame:
    """Prompt files whose rows carry the key ``ids``, as one corpus of prompts and continuations, shuffled and split exactly."""
    rows = fl.union_all([struct_prompts(df.withColumn("row_id", F.col(ids))) for df in files])
    return finish(rows, "sentiment-prompts", "row_id", path, max_points, seed)


def five_sentence_stories(df: DataFrame, k: int = tx.STORY_SENTENCES) -> DataFrame:
    return _pick(df, prompt=tx.story_prompt([F.col(f"sentence{i + 1}") for i in range(5)], k))


def prompt_only(df: DataFrame) -> DataFrame:
    return _pick(df, prompt=F.col("prompt"))


RECIPES: dict[str, Callable[..., DataFrame]] = {
    "imdb": binary_reviews,
    "yelp_polarity": binary_reviews,
    "ag_news": topic_news,
    "sst2": sentence_sentiment,
    "sst5": five_class_sentiment,
    "cola": acceptability,
    "sms_spam": spam,
    "spamassassin": lambda df: spam(df, "text"),
    "jigsaw": toxicity_challenge,
    "jigsaw_bias": toxicity_bias,
    "tagmybook": genre,
    "storycontrol": lambda *parts: genre(*parts, text="content"),
    "pavlick": formality,
    "stop_clickbait": clickbait_flags,
    "clickbait_news": clickbait_names,
    "urgency": urgency,
    "real-toxicity-prompts": toxic_prompts,
    "bookcorpus": plain_prompts,
    "plain-prompts": plain_prompts,
    "gigaword": document_summary,
    "common_gen": concept_sets,
    "opus100": translations,
    "opus_books": translations,
    "tatoeba": translations,
    "cnn_dailymail": news_continuation,
    "cnn_dailymail_summ": news_summary,
    "xsum": document_continuation,
    "xsum_summ": document_summary,
    "eli5": explain_questions,
    "scifact": claims_with_sentences,
    "fever": claims_with_pages,
    "squad": context_questions,
    "sentiment-prompts": struct_prompts,
    "nontoxic-prompts": struct_prompts,
    "writing-prompts": story_lines,
    "factuality-prompts": prompt_only,
    "roc-stories": five_sentence_stories,
}


def finish(df: DataFrame, name: str, ids: str | Sequence[str], path: str | None = None,
           max_points: int | None = None, seed: int = sp.SEED, threshold: float | None = 0.0) -> DataFrame:
    """Drop nulls, binarize constraint labels, cap by seed, split exactly, and write when a path is given.

    A corpus that comes split keeps its parts. ``threshold=None`` leaves labels as they are.

    The recipe's rows are written once: sample and split then count over the id
    column of that table instead of running the recipe again for every pass.
    """
    known = route(name)
    if known.presplit and "split" not in df.columns:
        raise ValueError(f"{name} comes split, but its rows have no column named split")
    rows = materialize(df.dropna(), "recipe")
    if threshold is not None and known.kind == "constraint" and "label" in rows.columns:
        rows = rows.withColumn("label", lb.binarize(F.col("label"), threshold))
    if max_points is not None:
        rows = sp.seeded_sample(rows, ids, max_points, seed)
    if not known.presplit:
        rows = sp.split_exact(rows, ids, seed=seed)
    if path is not None:
        write_splits(rows, path)
    return rows
