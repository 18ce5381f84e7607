"""Secrets in texts, and how widely each is held: copied examples against credentials of one owner.

Four patterns give candidates: assignments to a secret's name, access keys, runs of hex digits
and, as the kind of this method, bare values: runs of letters and digits of mixed case that
stand alone. Every candidate's value is hashed, and per hash the distinct repositories
(documents) and owners (sources) are counted over the whole corpus. A value that more owners
or repositories hold than the limits is a copied example. A value of few owners that looks
drawn at random is taken to be live. The patterns' own spans are always reported; of the
bare values only live ones outside those spans are.

Built-in functions only. Texts are read once. A pattern's matches come from one extraction;
splitting the text at the same pattern gives the gaps between them, so a match's place is the sum of the
lengths in front of it. Only texts with a match are split. What leaves the scan are lengths
and hashes, one narrow row per document, written to the shared folder. Places are sums over a
document's matches. Repositories and owners are counted in two steps, (hash, owner, repository)
first, so that an example in a third of all documents is summed up map-side.

Defined cases: a null or empty text has no spans; rows with one id are judged row by row and
are one repository; rows without an id are one repository of their owner, and rows without an owner
belong to one owner of their own; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.tokens import bind
from quillspark.session import materialize

# The kinds in their order, their patterns, and the least length of what they match.
# An access key or a run of hex digits is found whole, so its length may stand in the pattern. A match of the
# first pattern that is too short still takes its characters away from later ones, so it is dropped afterwards.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12

# This method's own kind: a whole run of at least 20 letters and digits, with both cases and a digit among them.
BARE = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]*[0-9])(?=[A-Za-z0-9_]*[a-z])(?=[A-Za-z0-9_]*[A-Z])[A-Za-z0-9_]{20,}"

KINDS = ("assign", "access", "hex", "bare")

# Words of values that stand for a secret.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|redacted|your_|x{6,}|0{6,}|123456|abcdef"


def _matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """The pattern's matches in order: ``gap`` (characters since the last match), ``size``, ``said``."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        return F.when(F.size(found) > 0, F.zip_with(
            F.slice(gaps, 1, F.size(found)), found,
            lambda gap, said: F.struct(gap.alias("gap"), F.length(said).alias("size"), said.alias("said"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = bind(found, placed)
    return made if gate is None else F.when(gate, made)


def _value(kind: str, said: Column) -> Column:
    return F.regexp_extract(said, ASSIGN, 1) if kind == "assign" else said


def random_looking(value: Column) -> Column:
    """At least 16 characters, 8 of them different, with a letter and a digit, and no word of a placeholder."""
    return (
        (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8))


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """One narrow row per document: ``row_id, doc_id, repository, owner`` and the matches of each kind. Written."""
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")
    found = {
        "assign": _matches(body, ASSIGN, F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))),
        "access": _matches(body, ACCESS, F.contains(body, F.lit("AKIA"))),
        "hex": _matches(body, HEX), "bare": _matches(body, BARE),
    }
    kept = [_narrow(kind, matches).alias(kind) for kind, matches in found.items()]
    return materialize(read.select("row_id", "doc_id", "repository", "owner", *kept), "secrets")


def _narrow(kind: str, matches: Column) -> Column:
    """Matches without their text: ``gap, size, kept, looks, hash``."""

    def one(match: Column) -> Column:
        return bind(_value(kind, match["said"]), lambda value: F.struct(
            match["gap"].alias("gap"), match["size"].alias("size"),
            (F.length(value) >= (LEAST_ASSIGNED if kind == "assign" else 0)).alias("kept"),
            random_looking(value).alias("looks"), F.md5(value).alias("hash")))

    return F.transform(matches, one)


def placed(found: DataFrame) -> DataFrame:
    """One row per match: ``row_id, kind, start, end, hash, looks``; kinds by number, matches that are too short left out."""
    parts = []
    for number, kind in enumerate(KINDS):
        part = found.where(F.size(kind) > 0).select(
            "row_id", "repository", "owner", F.lit(number).alias("kind"), F.posexplode(kind).alias("at", "m"))
        parts.append(part.select("row_id", "repository", "owner", "kind", "at", "m.*"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    sofar = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(sofar)
    rows = rows.withColumn("end", end).where("kept")
    return rows.select("row_id", "repository", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash", "looks")


def holders(spans: DataFrame) -> DataFrame:
    """``hash, owners, repositories``: the distinct owners of a value, and their distinct repositories."""
    held = spans.select("hash", "owner", "repository").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def findings(found: DataFrame, max_owners: int = 2, max_repositories: int = 10) -> DataFrame:
    """Spans to report: ``row_id, kind, start, end, hash, owners, repositories, status`` (live, example or plain).

    ``found`` as of ``candidates``.
    """
    spans = materialize(placed(found), "secrets")
    held = holders(spans).withColumnRenamed("hash", "of")
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    status = F.when(~few, F.lit("example")).when(F.col("looks"), F.lit("live")).otherwise(F.lit("plain"))
    judged = spans.join(held, F.col("hash") == F.col("of")).select(
        "row_id", "kind", "start", "end", "hash", "owners", "repositories", status.alias("status"))
    # A bare value counts where no span of another kind touches it.
    base, order = F.col("kind") < KINDS.index("bare"), Window.partitionBy("row_id").orderBy("start", "end", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    alone = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(behind >= F.col("end"), F.lit(True))
    marked = judged.withColumn("alone", alone)
    return marked.where(base | ((F.col("status") == "live") & F.col("alone"))).drop("alone")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` in order of start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scanned(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", **limits) -> DataFrame:
    """Counts, spans and how many of them are live or examples, for each row of ``docs``."""
    found = candidates(docs, repository, owner, text)
    spans = findings(found, **limits)
    place = F.struct("start", "kind", "end")
    base = F.col("kind") < KINDS.index("bare")
    rows = spans.groupBy("row_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.collect_list(F.when(base, place)).alias("base"), F.collect_list(place).alias("all"),
        F.count_if(F.col("status") == "live").alias("n_live"), F.count_if(F.col("status") == "example").alias("n_example"))
    counts = [f"n_{name}" for name in KINDS] + ["n_live", "n_example"]
    ids = found.select("row_id", "doc_id")
    joined = ids.join(rows, "row_id", "left")
    return joined.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.sha2(F.coalesce(_listed(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"))


# DuckDB: the same patterns; its engine has no look-around, so a bare value is a whole run that is tested afterwards.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), pat AS (
  SELECT * FROM (VALUES
    (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'bare', '[A-Za-z0-9_]+')) AS v(k, kind, p)
), m AS (
  SELECT r, doc_id, source, k, kind, regexp_extract_all(t, p) AS hits, string_split_regex(t, p) AS gaps FROM d, pat
), h AS (
  SELECT r, doc_id, source, k, kind, unnest(hits) AS said, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM m
), s AS (
  SELECT *, sum(length(gap) + length(said)) OVER (PARTITION BY r, k ORDER BY i) AS e,
         CASE WHEN k = 0 THEN regexp_extract(said, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE said END AS val
  FROM h
), c AS (
  SELECT r, doc_id, source, k, kind, e - length(said) AS b, e, val,
         length(val) >= 16 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(str_split(val, ''))) >= 8
         AND NOT regexp_matches(val, '(?i)example|sample|dummy|changeme|placeholder|redacted|your_|x{6,}|0{6,}|123456|abcdef') AS looks
  FROM s
  WHERE (k = 0 AND length(val) >= 12) OR (k = 1 AND length(said) >= 18) OR (k = 2 AND length(said) >= 16)
     OR (k = 3 AND length(said) >= 20 AND regexp_matches(said, '[0-9]') AND regexp_matches(said, '[a-z]') AND regexp_matches(said, '[A-Z]'))
), o AS (
  SELECT val, count(DISTINCT coalesce('+' || source, '-')) AS owners,
         count(DISTINCT coalesce('+' || source, '-') || chr(10) || coalesce('+' || doc_id, '-')) AS repos
  FROM c GROUP BY val
), j AS (
  SELECT c.*, CASE WHEN owners > 2 OR repos > 10 THEN 'example' WHEN looks THEN 'live' ELSE 'plain' END AS status
  FROM c JOIN o USING (val)
), keep AS (
  SELECT * FROM j WHERE k < 3 OR (status = 'live' AND NOT EXISTS (
    SELECT 1 FROM j x WHERE x.r = j.r AND x.k < 3 AND x.b < j.e AND x.e > j.b))
), agg AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         count(*) FILTER (k = 3) AS n_bare, count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'example') AS n_example,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans
  FROM keep GROUP BY r
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_bare, 0)::BIGINT AS n_bare, coalesce(n_live, 0)::BIGINT AS n_live,
       coalesce(n_example, 0)::BIGINT AS n_example, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (r)
"""
