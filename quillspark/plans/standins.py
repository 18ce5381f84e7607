"""Stand-in tables for the raw corpora, each as a DataFrame and as a SQL common table expression.

Every stand-in covers its whole source table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import tokens as tk
from quillspark.functions.parse import parse_verdict
from quillspark.functions.text import lead_words
from quillspark.operators.reshape import melt_candidates
from quillspark.sources.readers import spread

N_GENS = 3

# Replies of a judge that is not always clear; see the SQL below for the same lists.
VERDICT_REPLIES = ["True", " false.", "True or False", "maybe", "because of it | True", None]
SCORE_REPLIES = ["Score: 10", "7", "17 of 20", "yes", "I do not know", "n/a"]

# Demonstrations of our own: constraint, text, score, explanation, author.
DEMONSTRATIONS = [
    ("sentiment", "The garden looks lovely in the morning.", 9, "it praises the garden", "first"),
    ("sentiment", "The train was late again.", 3, "it complains of a delay", "first"),
    ("sentiment", "We measured the table twice.", 5, "it states a fact", " second"),
    ("sentiment", "Everyone enjoyed the soup.", 8, "it reports joy", "second"),
    ("humor", "My clock is so slow that it shows last week.", 8, "it is a joke", "first"),
    ("humor", "The box holds twelve pencils.", 1, "it is plain", "first"),
    ("formality", "We kindly ask you to reply in writing.", 9, "it is polite and formal", "second"),
    ("formality", "hey, call me later", 2, "it is casual", "first"),
]

# Tags of common words in the four languages of the documents.
LEXICON = {
    "the": "DET", "a": "DET", "an": "DET", "la": "DET", "le": "DET", "un": "DET", "der": "DET", "el": "DET",
    "of": "ADP", "in": "ADP", "on": "ADP", "de": "ADP", "and": "CONJ", "und": "CONJ", "et": "CONJ",
    "is": "VERB", "it": "PRON",
}

# The same and more of them with all tags they may have and a cost for each, what a word may be that the
# lexicon lacks, and what one tag behind another costs; the empty tag stands in front of a sentence.
TAG_COSTS = [
    ("the", "DET", 0), ("a", "DET", 1), ("a", "ADP", 4), ("an", "DET", 0), ("la", "DET", 1), ("la", "PRON", 3),
    ("le", "DET", 1), ("le", "PRON", 3), ("un", "DET", 1), ("un", "NUM", 3), ("der", "DET", 1), ("der", "PRON", 4),
    ("die", "DET", 1), ("die", "VERB", 5), ("el", "DET", 0), ("of", "ADP", 0), ("in", "ADP", 1), ("in", "PRT", 4),
    ("on", "ADP", 1), ("on", "PRT", 2), ("de", "ADP", 0), ("and", "CONJ", 0), ("und", "CONJ", 0), ("et", "CONJ", 0),
    ("is", "VERB", 0), ("it", "PRON", 0), ("that", "CONJ", 2), ("that", "DET", 2), ("that", "PRON", 2), ("to", "PRT", 1),
    ("to", "ADP", 1), ("que", "CONJ", 1), ("que", "PRON", 1), ("los", "DET", 1), ("los", "PRON", 3), ("as", "ADP", 1), ("as", "ADV", 2),
]
UNKNOWN_TAGS = [("NOUN", 2), ("VERB", 3), ("ADJ", 4)]
TRANSITIONS = {
    ("", "DET"): 1, ("", "PRON"): 2, ("", "NOUN"): 3, ("", "VERB"): 4, ("", "ADP"): 3, ("DET", "NOUN"): 0, ("DET", "ADJ"): 1,
    ("ADJ", "NOUN"): 0, ("ADJ", "ADJ"): 3, ("NOUN", "VERB"): 1, ("NOUN", "ADP"): 1, ("NOUN", "CONJ"): 2, ("NOUN", "NOUN"): 3,
    ("PRON", "VERB"): 0, ("VERB", "DET"): 1, ("VERB", "ADP"): 2, ("VERB", "PRT"): 2, ("VERB", "NOUN"): 3, ("VERB", "ADV"): 2,
    ("ADP", "DET"): 0, ("ADP", "NOUN"): 1, ("ADP", "PRON"): 2, ("PRT", "VERB"): 0, ("CONJ", "NOUN"): 2, ("CONJ", "DET"): 1,
    ("CONJ", "VERB"): 2, ("ADV", "ADJ"): 1, ("ADV", "VERB"): 2,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table for work that costs far more than its scan."""
    return spread(table(spark, sf_dir, name))


def third(words: Column, j: int) -> Column:
    """The j-th third of the words after the fifteenth; null when empty."""
    size = F.greatest(F.ceil((F.size(words) - 15) / 3), F.lit(0)).cast("int")
    return F.nullif(F.array_join(F.slice(words, F.lit(16) + size * j, size), " "), F.lit(""))


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide candidates: the lead words as the prompt, the rest of the text in three parts."""
    docs = texts(spark, sf_dir).select("doc_id", "text", F.split("text", " ").alias("w"))
    return docs.select("doc_id", lead_words(F.col("text")).alias("prompt"),
                       *[third(F.col("w"), j).alias(f"gen_{j}") for j in range(N_GENS)])


def cand_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt_candidates(cand(spark, sf_dir))


def _reply(replies: list, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in replies]), (number % len(replies) + 1).cast("int"))


def judged(spark: SparkSession, sf_dir: str, replies: list = VERDICT_REPLIES) -> DataFrame:
    long = cand_long(spark, sf_dir)
    return long.withColumn("response", _reply(replies, F.col("doc_id") + F.col("cand_idx")))


def judged_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = cand(spark, sf_dir)
    return wide.withColumns({
        f"pred_{j}": parse_verdict(_reply(VERDICT_REPLIES, F.col("doc_id") + j)) for j in range(N_GENS)
    })


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                       F.col("text").alias("asked"))
    reply = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("replied"))
    return user.join(reply, ["conv_id", "turn"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with news boilerplate in front, by language."""
    lang = F.col("lang")
    front = (
        F.when(lang == "fr", "By . Name . Last updated at noon . ")
        .when(lang == "de", "PUBLISHED: today. 10:00 EST. ").when(lang == "es", "By x|y. ").otherwise("")
    )
    return texts(spark, sf_dir).select(
        "doc_id", F.concat(front, "text").alias("article"), F.col("source").alias("highlights"))


# Questions and an instruction of the queries.
QUESTIONS = {
    "sentiment": "Would a reader come away cheered?",
    "humor": "Is somebody joking here?",
    "formality": "Could this stand in a contract?",
    "toxicity": "Should a moderator look at this?",
}
TOPIC_INSTRUCTION = "[INST]Stay with the news of the day"


def wording(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS.items()), "constraint string, question string")


def demos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DEMONSTRATIONS, "constraint string, text string, score int, explanation string, author string")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubtful = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labelled(spark, sf_dir).select(
        F.concat(F.lit("Claim from "), "source").alias("claim"),
        F.when(F.col("lang") == "es", "n/a").otherwise(F.col("doc_id").cast("string")).alias("evidence_doc_id"),
        F.when(doubtful, "CONTRADICT").otherwise("SUPPORT").alias("evidence_label"),
        F.array(F.lit(0), F.lit(2)).alias("evidence_sentences"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", tk.sentences(F.col("text")).alias("abstract"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as predictions; the user turn, and the reply without its third word, as references."""
    words = F.split("replied", " ")
    rest = F.concat(F.slice(words, 1, 2), F.slice(words, 4, F.size(words)))
    return conv_pairs(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.col("replied").alias("pred"),
        F.array(F.col("asked"), F.array_join(rest, " ")).alias("refs"), F.col("asked").alias("ref"))


def shifted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without its first ten words against it without its last ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    rest = F.greatest(F.size("w") - 10, F.lit(0))
    return docs.select("doc_id", F.array_join(F.slice("w", 11, rest), " ").alias("pred"),
                       F.array_join(F.slice("w", 1, rest), " ").alias("ref"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), "label")


# --- the same in SQL ---------------------------------------------------------

SPACE = r"chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"
WORD = tk.WORD
MARK = tk.WORD_OR_MARK
SENT = (f"list_filter(list_transform(regexp_extract_all(text, '{tk.SENTENCE}'), "
        f"lambda s: trim(s, {SPACE})), lambda s: s <> '')")

CAND = """
docs_w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
docs_l AS (SELECT *, greatest((len(w) - 15 + 2) // 3, 0) AS l FROM docs_w),
cand AS (
  SELECT doc_id, array_to_string(w[1:15], ' ') AS prompt,
    CASE WHEN len(w) > 15 THEN nullif(array_to_string(w[16:15 + l], ' '), '') END AS gen_0,
    CASE WHEN len(w) > 15 THEN nullif(array_to_string(w[16 + l:15 + 2 * l], ' '), '') END AS gen_1,
    CASE WHEN len(w) > 15 THEN nullif(array_to_string(w[16 + 2 * l:15 + 3 * l], ' '), '') END AS gen_2
  FROM docs_l),
cand_long AS (
  SELECT doc_id, 0 AS cand_idx, prompt, gen_0 AS gen FROM cand
  UNION ALL SELECT doc_id, 1, prompt, gen_1 FROM cand
  UNION ALL SELECT doc_id, 2, prompt, gen_2 FROM cand)"""

JUDGED = CAND + """,
judged AS (
  SELECT *, CASE (doc_id + cand_idx) % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' false.' WHEN 2 THEN 'True or False'
    WHEN 3 THEN 'maybe' WHEN 4 THEN 'because of it | True' END AS response FROM cand_long),
verdicts AS (
  SELECT *, CASE WHEN contains(lower(response), 'true') AND NOT contains(lower(response), 'false') THEN true
    WHEN contains(lower(response), 'false') AND NOT contains(lower(response), 'true') THEN false END AS pred
  FROM judged)"""

SCORED = CAND + """,
scored AS (
  SELECT *, CASE (doc_id + cand_idx) % 6 WHEN 0 THEN 'Score: 10' WHEN 1 THEN '7' WHEN 2 THEN '17 of 20'
    WHEN 3 THEN 'yes' WHEN 4 THEN 'I do not know' ELSE 'n/a' END AS response FROM cand_long)"""

CONV_PAIRS = """
conv_pairs AS (
  SELECT u.conv_id, a.turn, u.text AS asked, a.text AS replied FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

LABELLED = """
labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""

NEWS = """
news AS (
  SELECT doc_id, CASE lang WHEN 'fr' THEN 'By . Name . Last updated at noon . '
    WHEN 'de' THEN 'PUBLISHED: today. 10:00 EST. ' WHEN 'es' THEN 'By x|y. ' ELSE '' END || text AS article,
    source AS highlights FROM documents)"""

# Drops the byline and then every leading piece with a marker.
STRIPPED = NEWS + f""",
news_p AS (SELECT *, string_split(trim(article, {SPACE}), '.') AS p0 FROM news),
news_b AS (SELECT *, CASE WHEN p0[1] = 'By ' THEN p0[3:] ELSE p0 END AS p FROM news_p),
news_k AS (
  SELECT *, list_position(list_transform(p, lambda s: contains(s, 'Last updated') OR contains(s, 'EST')
    OR contains(s, 'PUBLISHED') OR contains(s, 'UPDATED') OR contains(s, '|')), false) AS k FROM news_b),
stripped AS (
  SELECT doc_id, highlights, CASE WHEN coalesce(k, 0) = 0 THEN '' ELSE array_to_string(p[k:], '.') END AS article
  FROM news_k)"""

CLAIMS = LABELLED + f""",
claims AS (
  SELECT 'Claim from ' || source AS claim, CASE WHEN lang = 'es' THEN 'n/a' ELSE doc_id::VARCHAR END AS evidence_doc_id,
    CASE WHEN toxic = 1 OR quality = 0 THEN 'CONTRADICT' ELSE 'SUPPORT' END AS evidence_label FROM labelled),
corpus AS (SELECT doc_id, {SENT} AS abstract FROM documents)"""

SPLIT_TRAIN = LABELLED + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS rn, count(*) OVER () AS n FROM labelled),
parts AS (
  SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation'
    ELSE 'test' END AS split FROM ranked)"""


def with_tables(tables: str, body: str) -> str:
    return f"WITH {tables.strip()}\n{body.strip()}"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}')"


def marks_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{MARK}')"


def words_lower_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"
