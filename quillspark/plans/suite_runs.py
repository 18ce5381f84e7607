"""Registered queries: bounded grouping, tags, quotas, routed scans, runs that are repeated, models of order three."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import constraints as cs, opaque as op, reshape as rs, tagging as tg
from quillspark.operators.kneser_ney import KneserNey
from quillspark.operators.language_model import BigramModel
from quillspark.operators.sampling import split_exact
from quillspark.operators.similarity import greedy_match_pruned
from quillspark.plans import standins as st
from quillspark.plans.registry import query
from quillspark.plans.standins import table, with_tables
from quillspark.plans.suite_models import half_words
from quillspark.session import fresh_path
from quillspark.sources import catalog as cat
from quillspark.sources.finished import FinishedRows

TOP_TARGETS = 20


@query(f"""
WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'everything' ELSE source || '/' || lang END AS context,
  doc_id::VARCHAR AS target, n_chars // 100 AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY k, target) AS i FROM c)
SELECT context, string_agg(target, ',' ORDER BY i) AS targets, count(*) AS n FROM r WHERE i <= {TOP_TARGETS} GROUP BY context""")
def group_context_top(spark: SparkSession, sf: str) -> DataFrame:
    """The first targets of every context; one context holds a third of the rows, and orders tie."""
    context = F.when(F.col("doc_id") % 3 == 0, "everything").otherwise(F.concat("source", F.lit("/"), "lang"))
    rows = table(spark, sf, "documents").select(
        context.alias("context"), F.col("doc_id").cast("string").alias("target"), F.expr("n_chars div 100").alias("k"))
    grouped = rs.group_targets(rows, "context", "target", "k", max_targets=TOP_TARGETS)
    return grouped.select("context", F.array_join("targets", ",").alias("targets"), F.size("targets").cast("bigint").alias("n"))


def _values(rows: list[tuple]) -> str:
    def cell(value: str | int) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


TRANSITION_ROWS = [(before, tag, cost) for (before, tag), cost in st.TRANSITIONS.items()]


@query(f"""
WITH RECURSIVE lex(token, tag, cost) AS (VALUES {_values(st.TAG_COSTS)}),
unk(tag, cost) AS (VALUES {_values(st.UNKNOWN_TAGS)}),
trans(before, tag, cost) AS (VALUES {_values(TRANSITION_ROWS)}),
sent AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS sentence FROM (SELECT doc_id, {st.SENT} AS s FROM documents)),
word AS (SELECT doc_id, sentence, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, sentence, {st.words_sql('text')} AS w FROM sent)),
opt AS (
  SELECT doc_id, sentence, i, l.tag, l.cost FROM word JOIN lex l ON l.token = lower(word) UNION ALL
  SELECT doc_id, sentence, i, u.tag, u.cost FROM word, unk u WHERE lower(word) NOT IN (SELECT token FROM lex)),
way AS (
  SELECT doc_id, sentence, i, opt.tag, opt.cost + coalesce(t.cost, {tg.OTHER_TRANSITION}) AS cost, opt.tag AS path
  FROM opt LEFT JOIN trans t ON t.before = '' AND t.tag = opt.tag WHERE i = 1
  UNION ALL
  SELECT doc_id, sentence, i, tag, best.c + cost, best.p || ' ' || tag
  FROM (
    SELECT o.doc_id, o.sentence, o.i, o.tag, o.cost,
      list_sort(list({{'c': y.cost + coalesce(t.cost, {tg.OTHER_TRANSITION}), 'b': y.tag, 'p': y.path}}))[1] AS best
    FROM way y JOIN opt o ON o.doc_id = y.doc_id AND o.sentence = y.sentence AND o.i = y.i + 1
    LEFT JOIN trans t ON t.before = y.tag AND t.tag = o.tag
    GROUP BY o.doc_id, o.sentence, o.i, o.tag, o.cost)),
size AS (SELECT doc_id, sentence, max(i) AS n, string_agg(word, ' ' ORDER BY i) AS tokens FROM word GROUP BY ALL)
SELECT z.doc_id, z.sentence::INTEGER AS sentence, z.tokens, list_sort(list({{'c': way.cost, 't': way.tag, 'p': way.path}}))[1].p AS tags
FROM size z JOIN way ON way.doc_id = z.doc_id AND way.sentence = z.sentence AND way.i = z.n
GROUP BY z.doc_id, z.sentence, z.tokens""")
def tag_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest tags of every sentence, by a lexicon in which words have several tags."""
    lexicon = spark.createDataFrame(st.TAG_COSTS, "token string, tag string, cost int")
    tagged = tg.tag_tokens(st.texts(spark, sf), "doc_id", "text", lexicon, st.TRANSITIONS, st.UNKNOWN_TAGS)
    return tagged.select("doc_id", "sentence", F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"))


@query("SELECT doc_id, len(string_split(text, ' ')) / 2.0::DOUBLE AS score FROM documents")
def scored_under_quota(spark: SparkSession, sf: str) -> DataFrame:
    """All texts scored by a service whose quota the tasks share."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return op.scored_under_quota(docs, half_words, "text", quota=10**9, keep=["doc_id"])


MERGED_SQL = st.SPLIT_TRAIN + f""",
train AS (SELECT {st.words_lower_sql('text')} AS t FROM parts WHERE split = 'train'),
tok AS (SELECT unnest(list_concat(['<s>'], t[1:len(t) - 1])) AS v, unnest(t) AS w FROM train WHERE len(t) > 0),
c AS (SELECT v, w, count(*) AS n FROM tok GROUP BY v, w),
cv AS (SELECT v, sum(n) AS n_v FROM c GROUP BY v),
nv AS (SELECT count(DISTINCT w) AS nv FROM c),
{st.CAND.strip()},
x AS (SELECT doc_id, prompt || ' ' || gen_0 AS text FROM cand WHERE gen_0 IS NOT NULL),
big AS (SELECT doc_id, unnest(list_concat(['<s>'], t[1:len(t) - 1])) AS v, unnest(t) AS w
  FROM (SELECT doc_id, {st.words_lower_sql('text')} AS t FROM x) WHERE len(t) > 0),
flu AS (SELECT doc_id, avg(ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(cv.n_v, 0) + nv + 1)::DOUBLE)) AS fluency
  FROM big LEFT JOIN c USING (v, w) LEFT JOIN cv USING (v), nv GROUP BY doc_id),
e AS (SELECT vec_id // 10 AS doc_id, vec_id % 2 AS side, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
m AS (SELECT p.doc_id, p.vec_id AS p, r.vec_id AS r, list_cosine_similarity(p.e, r.e) AS s
  FROM e p JOIN e r ON p.doc_id = r.doc_id WHERE p.side = 0 AND r.side = 1),
pr AS (SELECT doc_id, avg(b) AS v FROM (SELECT doc_id, p, max(s) AS b FROM m GROUP BY doc_id, p) GROUP BY doc_id),
re AS (SELECT doc_id, avg(b) AS v FROM (SELECT doc_id, r, max(s) AS b FROM m GROUP BY doc_id, r) GROUP BY doc_id),
sim AS (SELECT doc_id, 2 * pr.v * re.v / (pr.v + re.v) AS f1 FROM pr JOIN re USING (doc_id)),
n AS (SELECT doc_id, len({st.words_sql('text')}) AS n FROM x)"""


@query(with_tables(MERGED_SQL, """
SELECT doc_id, round(coalesce(fluency, -20) + 0.5 * coalesce(f1, 0)
  + 2 * CASE WHEN n BETWEEN 40 AND 80 THEN 1 ELSE 1.0::DOUBLE / (greatest(n - 80, 40 - n) + 1) END, 6) AS score
FROM n LEFT JOIN flu USING (doc_id) LEFT JOIN sim USING (doc_id)"""))
def merged_relational(spark: SparkSession, sf: str) -> DataFrame:
    """Fluency, similarity of candidate and prompt, and a word range in one score."""
    train = split_exact(st.labelled(spark, sf), "doc_id").filter(F.col("split") == "train")
    vectors = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("doc_id"), (F.col("vec_id") % 2).alias("side"), F.col("vec_id").alias("at"),
        F.col("embedding").alias("vector"))
    merged = cs.Merged([
        cs.Fluency(model=BigramModel.fit(train, "text"), missing=-20.0), cs.PairMatch(weight=0.5, vectors=vectors),
        cs.StructRange(weight=2.0, lower=40, upper=80)], use_prompt=True)
    rows = st.cand(spark, sf).filter(F.col("gen_0").isNotNull())
    scored = merged.scored(rows, "doc_id", F.col("gen_0"), F.col("prompt"))
    return scored.select("doc_id", F.round("score", 6).alias("score"))


FILES_PER_SPLIT = 34


@query("""
SELECT CASE doc_id % 3 WHEN 0 THEN 'ag_news' WHEN 1 THEN 'sms_spam' ELSE 'plain-prompts' END AS dataset,
  CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, doc_id, text,
  CASE WHEN doc_id % 3 < 2 THEN lang END AS label FROM documents""")
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """About 200 files of three datasets in three formats, with names of their own for their columns: one scan per format."""
    root, catalog = fresh_path(spark, "corpora"), cat.Catalog(spark)
    layouts = [("ag_news", "csv", ("body", "topic")), ("sms_spam", "json", ("sms", "kind")), ("plain-prompts", "parquet", ("prompt", None))]
    docs = table(spark, sf, "documents")
    for number, (name, form, (text, label)) in enumerate(layouts):
        for split, chosen in (("train", F.col("lang") == "en"), ("test", F.col("lang") != "en")):
            rows = docs.filter((F.col("doc_id") % 3 == number) & chosen).select(
                F.col("doc_id").alias("id"), F.col("text").alias(text), *([F.col("lang").alias(label)] if label else []))
            writer = rows.repartition(FILES_PER_SPLIT).write
            if form == "csv":
                writer = writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            writer.format(form).save(f"{root}/{name}/{split}")
            fields = {"doc_id": ("id", "bigint"), "text": (text, "string")} | ({"label": (label, "string")} if label else {})
            catalog.register_files(cat.Files(name, form, f"{root}/{name}/{split}/part-*", fields, split))
    return catalog.scan(["doc_id", "text", "label"])


@query(with_tables(st.CAND, """
, t AS (SELECT doc_id, cand_idx, doc_id % 2 + 1 AS batch, doc_id IN (SELECT doc_id FROM labels) AS done FROM cand_long WHERE gen IS NOT NULL)
SELECT doc_id, cand_idx, CASE WHEN done THEN batch END AS batch FROM t"""))
def resume_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates judged in two batches, one of which runs twice; failed ones stay pending, without a batch."""
    todo = st.cand_long(spark, sf).filter(F.col("gen").isNotNull()).select("doc_id", "cand_idx")
    judged = todo.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "cand_idx", (F.col("toxic") == 1).alias("pred"))
    finished = FinishedRows(spark, fresh_path(spark, "judged"), judged.schema, ["doc_id", "cand_idx"], buckets=8)
    for batch in (1, 2, 1):
        finished.write(judged.filter(F.col("doc_id") % 2 + 1 == batch), batch, required=["pred"])
    pending = finished.pending(todo).select("doc_id", "cand_idx", F.lit(None).cast("bigint").alias("batch"))
    return finished.read().select("doc_id", "cand_idx", "batch").unionByName(pending)


@query("""
WITH t AS (SELECT vec_id % 3 AS pair, vec_id // 3 % 2 AS side, vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS e
  FROM embeddings),
m AS (SELECT p.pair, p.vec_id AS p, r.vec_id AS r, list_cosine_similarity(p.e, r.e) AS s
  FROM t p JOIN t r ON p.pair = r.pair WHERE p.side = 0 AND r.side = 1),
pr AS (SELECT pair, avg(b) AS v FROM (SELECT pair, p, max(s) AS b FROM m GROUP BY pair, p) GROUP BY pair),
re AS (SELECT pair, avg(b) AS v FROM (SELECT pair, r, max(s) AS b FROM m GROUP BY pair, r) GROUP BY pair)
SELECT pair, round(pr.v, 6) AS precision, round(re.v, 6) AS recall, round(2 * pr.v * re.v / (pr.v + re.v), 6) AS f1
FROM pr JOIN re USING (pair)""")
def greedy_match_pruned_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Long sequences of vectors with few components, without the block pairs that can't hold a best match."""
    scored, _ = _pruned(spark, sf)
    return scored.select("pair", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def greedy_match_visits(spark: SparkSession, sf: str) -> DataFrame:
    """How many block pairs that takes, of how many; this depends on the blocks, which SQL doesn't make."""
    return _pruned(spark, sf)[1]


def _pruned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 3).alias("pair"), F.expr("vec_id div 3 % 2").alias("side"), "vec_id",
        F.slice("embedding", 1, 3).alias("vector"))
    return greedy_match_pruned(vectors, "pair", "side", "vec_id", "vector", block=16)


def _kn_sql(texts: str) -> str:
    return st.SPLIT_TRAIN + f""",
train AS (SELECT {st.words_lower_sql('text')} AS t FROM parts WHERE split = 'train'),
g AS (SELECT unnest(list_concat(['<s>', '<s>'], t)[1:len(t)]) AS u, unnest(list_concat(['<s>'], t)[1:len(t)]) AS v, unnest(t) AS w
  FROM train WHERE len(t) > 0),
c3 AS (SELECT u, v, w, count(*) AS n FROM g GROUP BY ALL), x3 AS (SELECT u, v, sum(n) AS n, count(*) AS k FROM c3 GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS n FROM c3 GROUP BY ALL), x2 AS (SELECT v, sum(n) AS n, count(*) AS k FROM c2 GROUP BY ALL),
c1 AS (SELECT w, count(*) AS n FROM c2 GROUP BY ALL),
d3 AS (SELECT count(*) FILTER (n = 1) / (count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2))::DOUBLE AS d3 FROM c3),
d2 AS (SELECT count(*) FILTER (n = 1) / (count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2))::DOUBLE AS d2 FROM c2),
d1 AS (SELECT count(*) FILTER (n = 1) / (count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2))::DOUBLE AS d1, count(*) AS nw, sum(n) AS np FROM c1),
h AS (SELECT doc_id, unnest(list_concat(['<s>', '<s>'], t)[1:len(t)]) AS u, unnest(list_concat(['<s>'], t)[1:len(t)]) AS v, unnest(t) AS w
  FROM (SELECT doc_id, {st.words_lower_sql('text')} AS t FROM {texts}) WHERE len(t) > 0),
p1 AS (SELECT h.*, greatest(coalesce(c1.n, 0) - d1, 0) / np + d1 * nw / np / (nw + 1) AS p1 FROM h LEFT JOIN c1 USING (w), d1),
p2 AS (SELECT p1.*, CASE WHEN x2.n IS NULL THEN p1 ELSE greatest(coalesce(c2.n, 0) - d2, 0) / x2.n + d2 * x2.k / x2.n * p1 END AS p2
  FROM p1 LEFT JOIN c2 USING (v, w) LEFT JOIN x2 USING (v), d2),
p3 AS (SELECT p2.*, CASE WHEN x3.n IS NULL THEN p2 ELSE greatest(coalesce(c3.n, 0) - d3, 0) / x3.n + d3 * x3.k / x3.n * p2 END AS p3
  FROM p2 LEFT JOIN c3 USING (u, v, w) LEFT JOIN x3 USING (u, v), d3)"""


@query(with_tables(_kn_sql("documents"), """
SELECT doc_id, round(f, 6) AS fluency, round(exp(-f), 4) AS perplexity
FROM documents LEFT JOIN (SELECT doc_id, avg(ln(p3)) AS f FROM p3 GROUP BY doc_id) USING (doc_id)"""))
def lm_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    """Fluency and perplexity of all texts under a trigram model of the training part."""
    train = split_exact(st.labelled(spark, sf), "doc_id").filter(F.col("split") == "train")
    scored = KneserNey.fit(train, "text").fluency(st.texts(spark, sf), "doc_id", "text")
    return scored.select("doc_id", F.round("fluency", 6).alias("fluency"), F.round(F.exp(-F.col("fluency")), 4).alias("perplexity"))


@query(with_tables(st.CONV_PAIRS, """
, j AS (
  SELECT conv_id, turn, 0 AS cand_idx, asked || ' ' || replied AS text, CASE (conv_id + turn) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label FROM conv_pairs
  UNION ALL SELECT conv_id, turn, 1, asked || '  No. ' || asked, (conv_id % 2 = 0)::INTEGER FROM conv_pairs),
w AS (SELECT *, string_split(text, ' ') AS w FROM j WHERE label IS NOT NULL),
n AS (SELECT *, unnest(range(1, len(w))) AS n_words FROM w)
SELECT conv_id, turn, cand_idx, label, n_words::INTEGER AS n_words, array_to_string(w[1:n_words], ' ') AS prefix
FROM n WHERE regexp_matches(array_to_string(w[1:n_words], ' '), '\\S')"""))
def unravel_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Judged candidates, and every prefix of prompt and candidate with the candidate's label."""
    number = F.col("conv_id") + F.col("turn")
    wide = st.conv_pairs(spark, sf).select(
        "conv_id", "turn", F.col("asked").alias("prompt"), F.col("replied").alias("gen_0"),
        F.concat(F.lit(" No. "), "asked").alias("gen_1"),
        F.when(number % 3 == 0, True).when(number % 3 == 1, False).alias("pred_0"), (F.col("conv_id") % 2 == 0).alias("pred_1"))
    return rs.unravel_prefixes(wide, fresh_path(spark, "prefixes")).read()
