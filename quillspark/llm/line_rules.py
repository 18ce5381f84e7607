"""Lines that too many documents of a host share, and documents that consist of them.

Lines are normalised (words joined by one space, A-Z in lower case) and hashed to 64
bits. Per host and line the distinct documents are counted: copies of one text
count once, as copying a document doesn't make its lines boilerplate. A line is above the
limit if more than ``least_docs`` documents of the host hold it, however large the host: a bound that grew
with the host would spare the boilerplate of the largest ones. A document is rejected if fewer than
``least_words`` words or less than ``least_kept`` of its words remain without such lines.

Built-in functions only. Texts are read once: a row leaves the scan as its counts and a
list of line hashes, and this narrow table is written and feeds the counts, which are summed
map-side, and the joins, which adaptive execution may split.

Defined cases: a null or empty text has no words and fails the base rule; null hosts form a
host of their own; rows with one id are judged row by row; an empty table gives no rows;
columns other than doc_id, text and the host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.tokens import bind
from quillspark.llm.common import free
from quillspark.session import materialize

# What words are made of, symbols, and the base rule's bounds.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the array, first occurrence included.

    Windows are compared by 96 bits of hash inside one row: sorted, equal ones are neighbours.
    """

    def covered(held: Column) -> Column:
        def at(i: Column) -> Column:
            window = [F.get(held, i + k) for k in range(size)]
            return F.struct(F.xxhash64(*window).alias("a"), F.hash(*window).alias("b"), i.alias("i"))

        def repeats(ordered: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                other = F.get(ordered, j)
                return F.coalesce((other["a"] == x["a"]) & (other["b"] == x["b"]), F.lit(False))

            return F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))

        places = F.sort_array(F.transform(
            bind(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(held) - size), at)), repeats), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(
            places, start,
            lambda sofar, i: F.struct(
                (sofar["n"] + F.least(F.lit(size), i - sofar["last"])).alias("n"), i.alias("last")),
            lambda sofar: sofar["n"])

    return bind(words, lambda held: F.when(F.size(held) >= size, covered(held)).otherwise(F.lit(0))).cast("long")


def line_hash(words: Column) -> Column:
    return F.xxhash64(F.translate(F.array_join(words, " "), UPPER, LOWER))


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row per document: base counts and its lines as ``lines: array<struct<h, n>>``. Written to the shared folder."""
    read = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda line: F.struct(
            line.alias("line"), F.regexp_extract_all(line, F.lit(WORD), F.lit(0)).alias("w"))),
        lambda line: F.size(line["w"]) > 0)
    parts = read.select("*", lines.alias("parts"))
    rows = parts.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n_chars"),
        F.flatten("parts.w").alias("w"),
        F.length(_without(F.col("text"), SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("parts") - F.size(F.array_distinct("parts.line"))).cast("long").alias("n_dup_lines"),
        F.transform("parts", lambda p: F.struct(
            line_hash(p["w"]).alias("h"), F.size(p["w"]).alias("n"))).alias("lines"),
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("row_id"), *[c for c in rows.columns if c != "w"],
        F.size("w").cast("long").alias("n_words"), repeated_words(F.col("w")).alias("n_repeat_words"))
    return materialize(rows, "line-rules")


def lines_above_limit(stats: DataFrame, least_docs: int) -> DataFrame:
    """``host, h``: lines that more than ``least_docs`` distinct documents of the host hold."""
    texts = stats.groupBy("host", "text_hash", "n_chars").agg(
        F.any_value(F.array_distinct("lines.h")).alias("hashes"))
    counts = texts.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs"))
    return counts.where(F.col("docs") > least_docs).select("host", "h")


def judged(docs: DataFrame, host: str = "source", *, least_docs: int = 20, least_words: int = 10,
           least_kept: float = 0.3) -> DataFrame:
    """Base counts, ``removed_words`` (in lines above the limit), ``base_failed`` and ``kept`` for each row."""
    stats = statistics(docs, host)
    bad = lines_above_limit(stats, least_docs)
    lines = stats.select("row_id", "host", F.inline("lines"))
    hits = lines.join(bad, lines["host"].eqNullSafe(bad["host"]) & (lines["h"] == bad["h"]), "left_semi")
    removed = hits.groupBy("row_id").agg(F.sum("n").alias("removed"))
    rows = stats.join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return rows.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (left >= least_words) & (left >= F.col("n_words") * least_kept)).alias("kept"),
        F.col("removed_words").cast("long").alias("removed_words"), "host",
    )


def cleaned(docs: DataFrame, host: str = "source", *, least_docs: int = 20, **limits) -> DataFrame:
    """The documents kept, with all their columns, and without the lines above the limit.

    Rows find their verdict by id, host and text hash, so equal rows need no further key.
    """
    own, of, digest, row, drop = free(docs, "_id", "_host", "_hash", "_row", "_drop")
    verdicts = judged(docs, host, least_docs=least_docs, **limits).where("kept").select(
        "doc_id", "host", "text_hash").distinct().toDF(own, of, digest)
    bad = lines_above_limit(statistics(docs, host), least_docs)
    found = (
        F.col("doc_id").eqNullSafe(F.col(own)) & F.col(host).eqNullSafe(F.col(of))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(digest)))
    kept = docs.join(verdicts, found, "left_semi").withColumn(row, F.monotonically_increasing_id())
    kept = materialize(kept, "line-rules")
    lines = kept.select(
        F.col(row).alias("row"), F.col(host).alias("host"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn(
        "h", line_hash(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))))
    hits = lines.join(bad, lines["host"].eqNullSafe(bad["host"]) & (lines["h"] == bad["h"]), "left_semi")
    # At most the lines of one text.
    gone = hits.groupBy("row").agg(F.collect_set("at").alias("at")).toDF(row, drop)
    rest = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(drop), i))
    return kept.join(gone, row, "left").withColumn(
        "text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))).drop(row, drop)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), g AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), p AS (
  SELECT r, i FROM g WHERE w4 IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r
), l AS (
  SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d
), lw AS (
  SELECT r, source, t, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l
), ln AS (
  SELECT r, source, t, line, len(ws) AS n,
         translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM lw WHERE len(ws) > 0
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r
), bad AS (
  SELECT source, norm FROM ln GROUP BY source, norm HAVING count(DISTINCT t) > 20
), gone AS (
  SELECT ln.r, sum(ln.n) AS n FROM ln JOIN bad b ON ln.source IS NOT DISTINCT FROM b.source AND ln.norm = b.norm GROUP BY ln.r
), nw AS (
  SELECT r, count(*) AS n FROM w GROUP BY r
), s AS (
  SELECT d.doc_id, coalesce(nw.n, 0)::BIGINT AS n_words,
         length(translate(d.t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(d.t) - length(translate(d.t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN nw USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= n_words * 0.3 AS kept,
       removed_words
FROM f
"""
