"""Registered queries: column derivations, labels, filters and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import labels as lb, parse, text as tx, tokens as tk
from quillspark.operators import filters as fl, reshape as rs, sampling as sp
from quillspark.plans import recipes, standins as st
from quillspark.plans.registry import query
from quillspark.plans.standins import table, with_tables


@query("SELECT doc_id, text AS prompt, lang AS label FROM documents")
def standardize_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return fl.standardize(docs, {"text": "prompt", "lang": "label"}, ["doc_id", "prompt", "label"])


@query(with_tables(st.CONV_PAIRS, "SELECT conv_id, turn, asked AS prompt, replied AS target FROM conv_pairs"))
def translation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.create_map(F.lit("es"), F.col("asked"), F.lit("en"), F.col("replied"))
    rows = st.conv_pairs(spark, sf).withColumn("translation", pair)
    return rows.select("conv_id", "turn", tx.translation(F.col("translation"), "es").alias("prompt"),
                       tx.translation(F.col("translation"), "en").alias("target"))


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct({st.words_lower_sql('text')})), ' ') || ' ' AS prompt
FROM documents""")
def concepts_prompt(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_sort(F.array_distinct(tk.words(F.lower("text"))))
    return st.texts(spark, sf).select("doc_id", tx.concept_prompt(words).alias("prompt"))


@query(with_tables(st.CONV_PAIRS, f"""
SELECT conv_id, turn, asked || '{recipes.ANSWER_SUFFIX}' AS prompt, replied || '|' || asked AS target
FROM conv_pairs"""))
def answers_target(spark: SparkSession, sf: str) -> DataFrame:
    raw = st.conv_pairs(spark, sf).select(
        F.struct("conv_id", "turn").alias("row_id"), F.col("asked").alias("title"),
        F.struct(F.array("replied", "asked").alias("text")).alias("answers"))
    asked = recipes.explain_questions(raw)
    return asked.select("row_id.*", "prompt", F.array_join("target", "|").alias("target"))


@query(f"""
WITH s AS (SELECT doc_id, {st.SENT} AS s FROM documents),
l AS (SELECT *, (len(s) + 4) // 5 AS l FROM s),
p AS (SELECT doc_id, nullif(array_to_string(s[1:l], ' '), '') AS s1,
  nullif(array_to_string(s[1 + l:2 * l], ' '), '') AS s2,
  nullif(array_to_string(s[1 + 2 * l:3 * l], ' '), '') AS s3 FROM l)
SELECT doc_id, ' ' || s1 || ' ' || s2 || ' ' || s3 AS prompt FROM p""")
def story_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = st.texts(spark, sf).select("doc_id", tk.sentences(F.col("text")).alias("s"))
    size = F.ceil(F.size("s") / 5).cast("int")
    fifths = [
        F.nullif(F.array_join(F.slice("s", F.lit(1) + size * i, size), " "), F.lit("")).alias(f"sentence{i + 1}")
        for i in range(5)
    ]
    stories = recipes.five_sentence_stories(docs.select(F.col("doc_id").alias("row_id"), *fifths))
    return stories.withColumnRenamed("row_id", "doc_id")


@query(with_tables(st.CAND, "SELECT doc_id, cand_idx, prompt || ' ' || gen AS text FROM cand_long"))
def scored_text(spark: SparkSession, sf: str) -> DataFrame:
    text = tx.scored_text(F.col("prompt"), F.col("gen"))
    return st.cand_long(spark, sf).select("doc_id", "cand_idx", text.alias("text"))


@query("""
SELECT l_orderkey, l_linenumber, (l_tax > 0)::INTEGER AS taxed, (l_discount > 0.05)::INTEGER AS discounted
FROM lineitem""")
def label_binarize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", lb.binarize(F.col("l_tax")).alias("taxed"),
        lb.binarize(F.col("l_discount"), 0.05).alias("discounted"))


@query("SELECT event_id, (event_type = 'click')::INTEGER AS label FROM events")
def label_equals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", lb.label_equals(F.col("event_type"), "click").alias("label"))


@query("SELECT doc_id, text, (lang = 'fr')::INTEGER AS label FROM documents WHERE lang IN ('de', 'fr')")
def label_two_class(spark: SparkSession, sf: str) -> DataFrame:
    return lb.two_class(table(spark, sf, "documents"), "lang", "de", "fr").select("doc_id", "text", "label")


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS label FROM customer")
def label_one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", lb.one_vs_rest(F.col("c_mktsegment"), "BUILDING").alias("label"))


@query("SELECT doc_id, (quality = 0)::INTEGER AS label FROM labels")
def label_invert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", lb.invert(F.col("quality")).alias("label"))


@query("""
SELECT c_custkey, (c_acctbal / 1000 >= 1)::INTEGER AS label FROM customer
WHERE c_acctbal / 1000 <= -1 OR c_acctbal / 1000 >= 1""")
def label_margin_signed(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "customer").withColumn("score", F.col("c_acctbal") / 1000)
    return lb.margin_label(scored, "score").select("c_custkey", "label")


@query("""
SELECT l_orderkey, l_linenumber, (l_discount > 0)::INTEGER AS label FROM lineitem
WHERE l_discount = 0 OR l_discount >= 0.05""")
def label_band_zero_high(spark: SparkSession, sf: str) -> DataFrame:
    kept = lb.zero_or_high(table(spark, sf, "lineitem"), "l_discount", 0.05)
    return kept.select("l_orderkey", "l_linenumber", lb.binarize(F.col("l_discount")).alias("label"))


@query("SELECT doc_id, toxic AS label FROM labels")
def attribute_label(spark: SparkSession, sf: str) -> DataFrame:
    label = lb.attribute_label("toxicity", lb.CHALLENGE_ATTRIBUTES)
    return table(spark, sf, "labels").select("doc_id", label.alias("label"))


@query("SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)")
def sentinel_dropna(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label carry -1, as the released test labels do."""
    from quillspark.operators.joins import join_labels

    features = table(spark, sf, "documents").select("doc_id", "text")
    given = features.select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").fillna(-1, ["toxic"])
    joined = join_labels(features, given, "doc_id")
    return lb.drop_sentinel(joined, ["toxic"]).select("doc_id", "text", F.col("toxic").alias("label"))


@query("""
WITH dim AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS label_id
  FROM (SELECT DISTINCT lang FROM documents))
SELECT d.doc_id, d.lang, dim.label_id FROM documents d JOIN dim USING (lang)""")
def label_index(spark: SparkSession, sf: str) -> DataFrame:
    indexed, _ = rs.index_labels(table(spark, sf, "documents"), "lang")
    return indexed.select("doc_id", "lang", "label_id")


@query(with_tables(st.CAND, """
SELECT 'before' AS stage, count(*) AS n_rows FROM cand UNION ALL
SELECT 'kept', count(*) FROM cand WHERE gen_0 IS NOT NULL AND gen_1 IS NOT NULL AND gen_2 IS NOT NULL"""))
def drop_null_report(spark: SparkSession, sf: str) -> DataFrame:
    """The counts come from the job that consumes the kept rows."""
    kept, counts = fl.drop_null(st.cand(spark, sf), ["gen_0", "gen_1", "gen_2"])
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(counts.get.items()), "stage string, n_rows bigint")


@query(with_tables(st.LABELLED, """
, hard AS (SELECT count(*) AS n FROM labelled WHERE toxic = 1),
easy AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM labelled WHERE toxic <> 1)
SELECT doc_id, 1 AS challenging, text AS prompt, source AS continuation FROM labelled WHERE toxic = 1
UNION ALL SELECT doc_id, 0, text, source FROM easy WHERE rn <= 2 * (SELECT n FROM hard)"""))
def challenge_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.labelled(spark, sf).select(
        "doc_id", (F.col("toxic") == 1).alias("challenging"), F.struct("text").alias("prompt"),
        F.struct(F.col("source").alias("text")).alias("continuation"))
    mixed = sp.hard_easy_mix(rows, "challenging", "doc_id", ratio=2)
    return mixed.select("doc_id", F.col("challenging").cast("int").alias("challenging"),
                        F.col("prompt.text").alias("prompt"), F.col("continuation.text").alias("continuation"))


@query(f"""
SELECT text || '{recipes.QUESTION_SUFFIX}' AS prompt, count(*) AS n_targets,
  string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS targets
FROM documents WHERE len(string_split(text, '.')) <= 10 GROUP BY text""")
def group_context(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").select(
        F.col("text").alias("context"), F.col("doc_id").cast("string").alias("question"), F.col("doc_id").alias("id"))
    grouped = recipes.context_questions(raw)
    return grouped.select("prompt", F.size("target").cast("bigint").alias("n_targets"),
                          F.array_join("target", ",").alias("targets"))


@query("""
SELECT lang AS context, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ord, source AS target
FROM documents""")
def group_context_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The targets of a few large contexts, numbered, one row each."""
    return rs.target_rows(table(spark, sf, "documents"), "lang", "source", "doc_id")


@query(with_tables(st.LABELLED, "SELECT doc_id, text, toxic FROM labelled WHERE toxic = 1"))
def target_class_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.labelled(spark, sf).select("doc_id", "text", "toxic")
    return fl.target_class(rows, "toxic", 1)[0]


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:15], ' ') AS text FROM documents")
def lead_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.lead_words(F.col("text")).alias("text"))


@query("SELECT doc_id, array_to_string(string_split(text, '.')[1:8], '.') AS text FROM documents")
def lead_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.lead_sentences(F.col("text")).alias("text"))


@query(with_tables(st.STRIPPED, "SELECT doc_id, article AS text FROM stripped"))
def strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return st.news(spark, sf).select("doc_id", tx.strip_boilerplate(F.col("article")).alias("text"))


@query("""
WITH w AS (SELECT conv_id, turn, (role = 'assistant')::INTEGER AS label, string_split(text, ' ') AS w
  FROM conversations),
n AS (SELECT *, unnest(range(1, len(w))) AS n_words FROM w),
p AS (SELECT conv_id, turn, label, n_words::INTEGER AS n_words, array_to_string(w[1:n_words], ' ') AS prefix FROM n)
SELECT * FROM p WHERE regexp_matches(prefix, '\\S')""")
def prefix_expand(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", (F.col("role") == "assistant").cast("int").alias("label"))
    return rs.prefixes(rows, "text")


@query(f"""
WITH counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({st.words_lower_sql('text')}) AS token FROM documents)
  GROUP BY token),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM counts),
lab AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
pos AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {st.words_lower_sql('text')}[1:80] AS t FROM lab)),
ids AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM pos LEFT JOIN vocab USING (token) GROUP BY doc_id),
padded AS (SELECT lab.doc_id, coalesce(ids, []) AS ids FROM lab LEFT JOIN ids USING (doc_id))
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(80 - len(ids)), lambda x: 0)), ' ') AS token_ids,
  array_to_string(list_concat(ids, list_transform(range(80 - len(ids)), lambda x: -100)), ' ') AS masked
FROM padded""")
def token_ids_padded(spark: SparkSession, sf: str) -> DataFrame:
    """The language-model training set of good documents, and the same labels with padding masked."""
    vocab = rs.vocabulary(st.texts(spark, sf), "text")
    rows = st.labelled(spark, sf).select("doc_id", "text", F.col("quality").alias("label"))
    ids = rs.lm_set(rows, "doc_id", vocab)
    return ids.select("doc_id", F.array_join("token_ids", " ").alias("token_ids"),
                      F.array_join(tx.mask_pad(F.col("labels"), rs.PAD), " ").alias("masked"))


@query(with_tables(st.JUDGED, f"""
, counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({st.words_lower_sql('text')}) AS token FROM documents)
  GROUP BY token),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM counts),
won AS (SELECT doc_id, prompt, gen FROM verdicts WHERE cand_idx = 0 AND pred),
pos AS (SELECT doc_id, side, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM (
  SELECT doc_id, 'p' AS side, {st.words_lower_sql('prompt')}[1:80] AS t FROM won
  UNION ALL SELECT doc_id, 'g', {st.words_lower_sql('gen')}[1:80] FROM won)),
ids AS (SELECT doc_id, side, list(coalesce(id, 1) ORDER BY pos) AS ids FROM pos LEFT JOIN vocab USING (token) GROUP BY ALL),
both_ids AS (SELECT won.doc_id, coalesce(p.ids, []) AS p, coalesce(g.ids, []) AS g FROM won
  LEFT JOIN ids p ON p.doc_id = won.doc_id AND p.side = 'p' LEFT JOIN ids g ON g.doc_id = won.doc_id AND g.side = 'g')
SELECT doc_id, array_to_string(list_concat(p, list_transform(range(80 - len(p)), lambda x: 0)), ' ') AS token_ids,
  array_to_string(list_concat(g, list_transform(range(80 - len(g)), lambda x: -100)), ' ') AS labels FROM both_ids"""))
def cond_set_padded(spark: SparkSession, sf: str) -> DataFrame:
    """The conditional training set of first candidates that passed: prompt ids, candidate ids with padding masked."""
    vocab = rs.vocabulary(st.texts(spark, sf), "text")
    judged = st.judged_wide(spark, sf).select("doc_id", "prompt", "gen_0", F.col("pred_0").cast("int").alias("pred_0"))
    ids = rs.cond_set(judged, "doc_id", vocab)
    return ids.select("doc_id", F.array_join("token_ids", " ").alias("token_ids"), F.array_join("labels", " ").alias("labels"))


@query(with_tables(st.JUDGED, "SELECT doc_id, cand_idx, coalesce(pred::VARCHAR, 'none') AS verdict FROM verdicts"))
def parse_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdict = parse.parse_verdict(F.col("response")).cast("string")
    return st.judged(spark, sf).select("doc_id", "cand_idx", F.coalesce(verdict, F.lit("none")).alias("verdict"))


@query(with_tables(st.SCORED, """
SELECT doc_id, cand_idx, CASE response WHEN 'Score: 10' THEN 1.0 WHEN '7' THEN 0.7 WHEN '17 of 20' THEN 0.7
  WHEN 'yes' THEN 0.7 WHEN 'I do not know' THEN 0.3 END::DOUBLE AS score FROM scored"""))
def parse_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.judged(spark, sf, st.SCORE_REPLIES)
    return rows.select("doc_id", "cand_idx", parse.parse_score(F.col("response")).alias("score"))


@query(with_tables(st.JUDGED, """
SELECT doc_id, cand_idx, CASE WHEN len(string_split(response, '|')) = 2 THEN string_split(response, '|')[2]
  ELSE response END AS answer FROM judged"""))
def parse_cot(spark: SparkSession, sf: str) -> DataFrame:
    return st.judged(spark, sf).select("doc_id", "cand_idx", parse.parse_cot(F.col("response")).alias("answer"))


@query(with_tables(st.JUDGED, """
SELECT doc_id, cand_idx, prompt || ' ' || gen AS text, pred::INTEGER AS label FROM verdicts
WHERE pred IS NOT NULL"""))
def unravel_text(spark: SparkSession, sf: str) -> DataFrame:
    return rs.unravel(st.judged_wide(spark, sf)).select("doc_id", "cand_idx", "text", "label")


@query(with_tables(st.JUDGED, """
SELECT doc_id, cand_idx, prompt, gen, pred::INTEGER AS label FROM verdicts WHERE pred IS NOT NULL"""))
def unravel_cond(spark: SparkSession, sf: str) -> DataFrame:
    return rs.unravel(st.judged_wide(spark, sf), cond=True).select("doc_id", "cand_idx", "prompt", "gen", "label")
