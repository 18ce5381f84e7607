"""Registered queries: sources and sinks, joins, set operations, aggregates, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import text as tx
from quillspark.operators import constraints as cs, filters as fl, joins as jn, metrics as mt
from quillspark.operators import opaque as op, reshape as rs, sampling as sp
from quillspark.plans import recipes, standins as st
from quillspark.plans.registry import query
from quillspark.plans.standins import table, with_tables
from quillspark.session import fresh_path
from quillspark.sources import catalog as cat, readers as rd, writers as wr
from quillspark.streaming.incremental import run_incrementally

GENERATORS = ["gen-a", "gen-b"]
JUDGES = ["judge-a", "judge-b"]

# Datasets that stand for the sources of the documents, by language.
DATASET_OF_LANG = {"en": "cnn_dailymail", "de": "imdb", "fr": "cola", "es": "opus100"}


@query(with_tables(st.SPLIT_TRAIN, """
SELECT doc_id, '"' || source || '", ' || text AS prompt, lang AS target, split FROM parts"""))
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes, commas and newlines survive a write by split and a read."""
    path = fresh_path(spark, "csv")
    rows = st.labelled(spark, sf).select(
        "doc_id", F.concat(F.lit('"'), "source", F.lit('", '), "text").alias("prompt"), F.col("lang").alias("target"))
    wr.write_splits(sp.split_exact(rows, "doc_id"), path)
    return rd.read_csv(spark, path, "doc_id bigint, prompt string, target string, split string")


@query("SELECT doc_id, text AS prompt, source AS continuation FROM documents")
def jsonl_struct_prompts(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "jsonl")
    table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.struct("text").alias("prompt"),
        F.struct(F.col("source").alias("text")).alias("continuation"), F.md5("text").alias("md5_hash"),
        F.lit(5).alias("num_positive")).write.json(path)
    raw = rd.read_jsonl(spark, path, f"row_id bigint, {rd.PROMPT_STRUCT}, md5_hash string, num_positive int")
    return recipes.struct_prompts(raw).withColumnRenamed("row_id", "doc_id")


@query(f"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT trim(regexp_replace('[WP] ' || line || ' [x]', '\\[.*?\\]', '', 'g'), {st.SPACE})
  || '{recipes.STORY_SUFFIX}' AS prompt FROM lines""")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a text file, tags removed."""
    path = fresh_path(spark, "lines")
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    lines.select(F.concat(F.lit("[WP] "), "line", F.lit(" [x]")).alias("value")).write.text(path)
    return recipes.story_lines(rd.read_lines(spark, path))


@query("""
SELECT doc_id AS id, text, lang AS topic FROM documents UNION ALL
SELECT item_id, text, 'benchmark' FROM benchmark UNION ALL
SELECT conv_id, text, NULL FROM conversations""")
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with differing columns, one of them several files; a missing column is null."""
    columns = "id bigint, text string, topic string"
    paths = []
    for part, chosen in (("a", F.col("doc_id") % 2 == 0), ("b", F.col("doc_id") % 2 == 1)):
        paths.append(fresh_path(spark, f"documents-{part}"))
        rows = table(spark, sf, "documents").filter(chosen).select(
            F.col("doc_id").alias("id"), "text", F.col("lang").alias("topic"), F.lit(part).alias("part"))
        wr.write_splits(rows, paths[-1], partition_by=["part"])
    docs = rd.read_many(spark, paths, [columns, columns], ["id", "text", "topic"])
    items = table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("topic"), F.col("item_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select("text", F.col("conv_id").alias("id"))
    return fl.union_all([docs, items, turns])


@query("""
WITH d AS (SELECT source, lang, count(*) AS n_docs FROM documents GROUP BY ALL)
SELECT source, CASE lang WHEN 'en' THEN 'cnn_dailymail' WHEN 'de' THEN 'imdb' WHEN 'fr' THEN 'cola' ELSE 'opus100' END
  AS dataset, CASE WHEN lang IN ('de', 'fr') THEN 'constraint' ELSE 'task' END AS kind,
  CASE lang WHEN 'de' THEN 'sentiment' WHEN 'fr' THEN 'grammar' END AS constraint_type,
  CASE WHEN lang IN ('en', 'es') THEN 'True' ELSE 'False' END AS presplit, n_docs FROM d""")
def catalog_route(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(part) for pair in DATASET_OF_LANG.items() for part in pair])
    catalog = cat.Catalog(spark)
    catalog.register("bookcorpus", lambda session, split: table(session, sf, "documents"))
    counted = catalog.load("bookcorpus").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"))
    routed = counted.withColumn("dataset", F.element_at(names, F.col("lang")))
    return routed.select("source", "dataset", *[
        cat.route_column(F.col("dataset"), what).alias(what) for what in ("kind", "constraint_type", "presplit")
    ], "n_docs")


@query("""
WITH d AS (SELECT DISTINCT source AS dataset, lang AS "constraint" FROM documents)
SELECT dataset, "constraint", generator, judge,
  'dataset=' || dataset || '/llm=' || generator || '/constraint=' || "constraint" || '/judge=' || judge || '/seed=42'
    AS run FROM d, (VALUES ('gen-a'), ('gen-b')) g(generator), (VALUES ('judge-a'), ('judge-b')) j(judge)""")
def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    datasets = table(spark, sf, "documents").select(
        F.col("source").alias("dataset"), F.col("lang").alias("constraint")).distinct()
    grid = jn.experiment_grid(datasets, GENERATORS, JUDGES)
    run = wr.run_key(dataset=F.col("dataset"), llm=F.col("generator"), constraint=F.col("constraint"),
                     judge=F.col("judge"), seed=42)
    return grid.withColumn("run", run)


@query(with_tables(st.CAND, """
SELECT doc_id, cand_idx, gen FROM cand_long WHERE gen IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)"""))
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of labelled documents count as finished; failed ones have no prediction and stay pending."""
    path = fresh_path(spark, "finished")
    todo = st.cand_long(spark, sf).filter(F.col("gen").isNotNull()).select("doc_id", "cand_idx", "gen")
    judged = todo.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("pred", F.col("toxic") == 1)
    wr.append_finished(judged.select("doc_id", "cand_idx", "pred"), path, ["doc_id", "cand_idx"], ["pred"])
    done = spark.read.schema("doc_id bigint, cand_idx int, pred boolean").parquet(path)
    return jn.pending(todo, done, ["doc_id", "cand_idx"])


@query(with_tables(st.CAND, """
SELECT doc_id, cand_idx, 'I say false' AS response FROM cand_long WHERE gen IS NOT NULL"""))
def resume_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Judging in two runs: the second one handles the files that came after the first."""
    source, target, log = (fresh_path(spark, name) for name in ("stream-in", "stream-out", "stream-log"))
    rows = st.cand_long(spark, sf).filter(F.col("gen").isNotNull()).select("doc_id", "cand_idx", "prompt", "gen")
    for wave in range(2):
        rows.filter(F.col("doc_id") % 2 == wave).write.mode("append").parquet(source)
        run_incrementally(spark, source, rows.schema, target, log, lambda df: op.judge(
            df, refusing_judge, "[text]", n=10).select("doc_id", "cand_idx", "response"))
    return spark.read.schema("doc_id bigint, cand_idx int, response string").parquet(target)


def refusing_judge(questions: Sequence[str]) -> list[str]:
    """Stands in for a model."""
    return ["I say false"] * len(questions)


@query(with_tables(st.CAND, "SELECT doc_id, prompt, gen_0, gen_1, gen_2, 'b' AS judge FROM cand"))
def candidates_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Long candidates back to columns, with the run they belong to."""
    wide = rs.widen_candidates(st.cand_long(spark, sf), ["doc_id", "prompt"], 3)
    return wr.with_run(wide, {"judge": "b"})


@query(with_tables(st.CAND, """
SELECT 'raw' AS stage, count(*) AS n_rows FROM documents UNION ALL
SELECT 'melted', count(*) FROM cand_long UNION ALL SELECT 'kept', count(*) FROM cand_long WHERE gen IS NOT NULL"""))
def row_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per stage."""
    rows = st.cand_long(spark, sf)
    return fl.row_report({"raw": table(spark, sf, "documents"), "melted": rows, "kept": fl.nonnull(rows, "gen")})


@query("""
WITH u AS (SELECT 'd' || doc_id AS id, text AS prompt FROM documents UNION ALL
  SELECT 'p' || page_id, html FROM pages),
r AS (SELECT *, row_number() OVER (ORDER BY md5(id || ':42'), id) AS rn, count(*) OVER () AS n FROM u)
SELECT id, prompt, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def union_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt files joined, shuffled and saved per split."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("prompt"))
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("prompt"))
    path = fresh_path(spark, "union")
    wr.write_splits(sp.split_exact(fl.union_all([docs, pages]), "id"), path, format="parquet")
    return spark.read.schema("id string, prompt string, split string").parquet(path)


@query(with_tables(st.LABELLED, """
SELECT text, (NOT (quality = 1 AND toxic = 0))::INTEGER AS label FROM labelled
WHERE NOT (quality = 1 AND toxic = 1)"""))
def quoted_id_join(spark: SparkSession, sf: str) -> DataFrame:
    """Many text files and one level file, joined on ids in quotes."""
    quoted = F.concat(F.lit("'"), F.col("doc_id").cast("string"), F.lit("'")).alias("tweet_id")
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("choose_one_category"), quoted, F.col("text").alias("tweet_text"), "lang")
    levels = table(spark, sf, "labels").select(quoted, (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), recipes.NOT_URGENT)
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), recipes.URGENT[0])
        .when(F.col("quality") == 0, recipes.URGENT[1]).otherwise("unclear")).alias("urgency"))
    parts = [docs.filter(F.col("lang") == "en").drop("lang"), docs.filter(F.col("lang") != "en").drop("lang")]
    return recipes.urgency(parts, levels)


@query(with_tables(st.CLAIMS, f"""
, picked AS (
  SELECT c.claim, list_filter([k.abstract[1], k.abstract[3]], lambda s: s IS NOT NULL) AS s
  FROM claims c JOIN corpus k ON c.evidence_doc_id = k.doc_id::VARCHAR WHERE c.evidence_label = 'CONTRADICT')
SELECT DISTINCT '{jn.EVIDENCE_MARKER}' || trim(array_to_string(s, ' '), {st.SPACE}) || '{jn.CLAIM_MARKER}' || claim
  AS prompt FROM picked"""))
def evidence_join(spark: SparkSession, sf: str) -> DataFrame:
    return recipes.claims_with_sentences([st.claims(spark, sf)], st.corpus(spark, sf))


@query(with_tables(st.LABELLED, f"""
SELECT DISTINCT '{jn.EVIDENCE_MARKER}' || p.html || '{jn.CLAIM_MARKER}' || d.text || '{jn.EVIDENCE_SUFFIX}' AS prompt
FROM labelled d JOIN pages p ON p.page_id = d.doc_id WHERE d.quality = 1"""))
def evidence_prompts(spark: SparkSession, sf: str) -> DataFrame:
    claims = st.labelled(spark, sf).select(
        F.col("text").alias("claim"), F.when(F.col("quality") == 1, recipes.REFUTED).otherwise("SUPPORTS").alias("label"),
        F.col("doc_id").cast("string").alias("evidence_wiki_url"))
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    return recipes.claims_with_pages(claims, pages)


@query("SELECT DISTINCT text AS prompt FROM documents")
def distinct_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return fl.distinct_prompts(table(spark, sf, "documents").withColumnRenamed("text", "prompt"))


@query("""
SELECT toxic AS grp, round(avg((quality = 1 - toxic)::INTEGER::DOUBLE), 6) AS accuracy,
  round((avg((quality = 1 - toxic)::INTEGER::DOUBLE) + avg(quality::DOUBLE)) / 2, 6) AS combined, count(*) AS n_samples
FROM labels GROUP BY toxic""")
def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per group, and the mean of two metric values."""
    rows = table(spark, sf, "labels").select(
        F.col("toxic").alias("grp"), F.col("quality").alias("pred"), (1 - F.col("toxic")).alias("label"))
    right = mt.accuracy(rows, "pred", "label", "grp")
    share = rows.groupBy("grp").agg(F.avg("pred").alias("share"))
    combined = mt.combined_score(F.col("accuracy"), F.col("share"))
    return right.join(share, "grp").select(
        "grp", F.round("accuracy", 6).alias("accuracy"), F.round(combined, 6).alias("combined"), "n_samples")


@query("""
SELECT l_returnflag, round(avg(pow(l_tax - l_discount, 2)), 6) AS mse, count(*) AS n_samples
FROM lineitem GROUP BY l_returnflag""")
def mse_report(spark: SparkSession, sf: str) -> DataFrame:
    report = mt.mse(table(spark, sf, "lineitem"), "l_tax", "l_discount", "l_returnflag")
    return report.withColumn("mse", F.round("mse", 6))


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey LIMIT 10500""")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sp.seeded_sample(rows, "o_orderkey", 10_500, seed=7)


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS rn,
    count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sp.split_exact(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS i,
    floor(count(*) OVER () * 0.7::DOUBLE) AS t, floor(count(*) OVER () * 0.15::DOUBLE) AS v FROM documents)
SELECT doc_id, 'train' AS split FROM r WHERE i <= t UNION ALL
SELECT doc_id, 'validation' FROM r WHERE i BETWEEN t AND t + v UNION ALL SELECT doc_id, 'test' FROM r""")
def split_legacy_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id")
    return sp.split_exact(rows, "doc_id", legacy_bounds=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 12000")
def head_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sp.head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 12_000, "o_orderkey")


@query(with_tables(st.SPLIT_TRAIN, """
, v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM parts
  WHERE split = 'validation')
SELECT p.doc_id, CASE WHEN v.i <= v.n - 2 THEN 'train' ELSE p.split END AS split
FROM parts p LEFT JOIN v USING (doc_id)"""))
def carve_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.labelled(spark, sf).select("doc_id")
    return sp.carve_validation(sp.split_exact(rows, "doc_id"), "doc_id")


@query(with_tables(st.CAND, f"""
, base AS (
  SELECT *, prompt || ' ' || gen AS text, -length(gen)::DOUBLE / 1000 AS base_score,
    len({st.words_sql("prompt || ' ' || gen")}) AS n,
    trim(trim(prompt || ' ' || gen, {st.SPACE}), {"'" + r'!"#$%&' + "''" + r'()*+,-./:;<=>?@[\]^_`{|}~' + "'"}) AS core
  FROM cand_long WHERE gen IS NOT NULL),
scored AS (
  SELECT doc_id, cand_idx, gen, round(base_score + 0.2 * (
      2.0 * CASE WHEN n BETWEEN 40 AND 80 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 80, 40 - n) + 1) END
      + 0.5 * (starts_with(core, 'The')::INTEGER + ends_with(core, 's')::INTEGER) / 2.0::DOUBLE), 6) AS score FROM base)
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cand_idx) = 1"""))
def rerank_top1(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate per prompt by base score plus merged constraints over prompt and candidate."""
    merged = cs.Merged([cs.StructRange(weight=2.0, lower=40, upper=80),
                        cs.StartEnd(weight=0.5, start="The", end="s")], use_prompt=True)
    rows = st.cand_long(spark, sf).filter(F.col("gen").isNotNull())
    rows = rows.withColumn("base_score", -F.length("gen").cast("double") / 1000)
    best = sp.reranked(rows, "doc_id", F.col("base_score"), merged.score(F.col("gen"), F.col("prompt")), "cand_idx")
    return best.select("doc_id", "cand_idx", "gen", "score")


@query(with_tables(st.LABELLED, f"""
, raw AS (
  SELECT doc_id AS row_id, text, (NOT (quality = 1 AND toxic = 0))::INTEGER AS label FROM labelled
  WHERE NOT (quality = 1 AND toxic = 1)),
r AS (SELECT *, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) AS rn, count(*) OVER () AS n FROM raw)
SELECT row_id, text, label, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r"""))
def recipe_constraint(spark: SparkSession, sf: str) -> DataFrame:
    """A constraint corpus end to end: files, join, levels, nulls, exact split."""
    quoted = F.concat(F.lit("'"), F.col("doc_id").cast("string"), F.lit("'")).alias("tweet_id")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("choose_one_category"), quoted,
        F.col("text").alias("tweet_text"))
    levels = table(spark, sf, "labels").select(quoted, (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), recipes.NOT_URGENT)
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), recipes.URGENT[0])
        .when(F.col("quality") == 0, recipes.URGENT[1]).otherwise("unclear")).alias("urgency"))
    raw = recipes.RECIPES["urgency"]([docs], levels)
    return recipes.finish(raw, "urgency", "row_id")


@query("""
SELECT doc_id AS row_id, text AS prompt, source AS target,
  CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END AS split FROM documents""")
def recipe_presplit(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus that comes split, written as it is and read back."""
    part = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "validation").otherwise("test")
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("document"), F.col("source").alias("summary"),
        part.alias("split"))
    path = fresh_path(spark, "presplit")
    recipes.finish(recipes.RECIPES["gigaword"](raw), "gigaword", "row_id", path=path)
    return rd.read_csv(spark, path, "row_id bigint, prompt string, target string, split string")


@query("""
SELECT 'weather' AS constraint_type, 'constraint' AS kind, doc_id, text, lang AS label FROM documents WHERE lang = 'en'
UNION ALL SELECT NULL, 'task', doc_id, text, lang FROM documents WHERE lang <> 'en'""")
def catalog_files(spark: SparkSession, sf: str) -> DataFrame:
    """Local files find their kind by folder and path markers; one is comma-, the other tab-separated."""
    root = fresh_path(spark, "catalog")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    paths = [(f"{root}/weather/own.csv", ",", F.col("label") == "en"), (f"{root}/roc-stories/own_too.csv", "\t", F.col("label") != "en")]
    catalog, out = cat.Catalog(spark), []
    for path, sep, chosen in paths:
        docs.filter(chosen).write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        found = catalog.register_file(path, "doc_id bigint, text string, label string", sep)
        out.append(catalog.load(found.name).select(
            F.lit(found.constraint_type).cast("string").alias("constraint_type"), F.lit(found.kind).alias("kind"),
            "doc_id", "text", "label"))
    return fl.union_all(out)


@query("""
WITH r AS (SELECT doc_id, n_chars % 7 / 2.0::DOUBLE AS k, nullif(lang, 'es') AS l FROM documents),
a AS (SELECT 'k' AS "order", k, NULL AS l FROM r ORDER BY k LIMIT 40),
b AS (SELECT 'l', NULL, l FROM r ORDER BY l NULLS FIRST LIMIT 90)
SELECT "order", k, l, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def head_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Heads by a repeated number, and by a text that is often null."""
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 7 / 2.0).alias("k"), F.nullif("lang", F.lit("es")).alias("l"))
    by_number = sp.head(rows, 40, "k").select(F.lit("k").alias("order"), "k", F.lit(None).cast("string").alias("l"))
    by_text = sp.head(rows, 90, "l").select(F.lit("l").alias("order"), F.lit(None).cast("double").alias("k"), "l")
    return by_number.unionByName(by_text).groupBy("order", "k", "l").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables(st.STRIPPED, f"""
SELECT doc_id, 'continuation' AS output, array_to_string(string_split(article, ' ')[1:15], ' ') AS prompt,
  NULL AS target FROM stripped UNION ALL
SELECT doc_id, 'summary', array_to_string(string_split(article, '.')[1:8], '.') || '{recipes.SUMMARY_SUFFIX}',
  highlights FROM stripped"""))
def recipe_task(spark: SparkSession, sf: str) -> DataFrame:
    """A news corpus to its two task tables."""
    raw = st.news(spark, sf).withColumnRenamed("doc_id", "row_id")
    outputs = [
        recipes.RECIPES["cnn_dailymail"](raw).withColumn("output", F.lit("continuation")),
        recipes.RECIPES["cnn_dailymail_summ"](raw).withColumn("output", F.lit("summary")),
    ]
    return fl.union_all(outputs).withColumnRenamed("row_id", "doc_id")


@query("""
SELECT doc_id, unnest([0, 1, 2])::INTEGER AS cand_idx, array_to_string(string_split(text, ' ')[1:15], ' ') AS prompt
FROM documents WHERE lang <> 'es'""")
def gen_truncate_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts without text drop, long ones are cut, and each gets three candidate slots."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("prompt"))
    return op.fan_out(docs, 3, max_words=tx.LEAD_WORDS)


