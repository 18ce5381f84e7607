"""A manifest of a dataset: a Merkle tree per group of rows, a tree over the groups, and a proof for each row.

A row's leaf is the digest of its fields. A group's leaves, in the order of the row key, are
reduced by runs of ``FANOUT`` until one digest is left, the group's subroot; the subroots, in
the order of the groups, are reduced to the root in the same way.

Trees are worked through forward in time, from leaves to root. A node's label is (last leaf
below it, level), which is larger than its children's labels. A child's digest is a message
for its parent and waits in a priority queue ordered by labels; when the sweep has passed
the parent's last leaf, its messages stand at the front of the queue. Within a block of
leaves the queue is a heap with at most ``FANOUT`` messages a level. Between blocks
it is external: the blocks' digests are written, shuffled by the labels' blocks and sorted,
and become the leaves of the next round. The reversed sweep starts at the root: by falling
labels, every node hands its children their siblings together with the suffix of the proof
that it was handed itself. So a task holds one block and the heap, however large a group is;
a table of N rows takes log(N) to the base of a block's leaves rounds.

Defined cases: null fields are marked in the leaf; rows without a key come first in their
group, and rows without a group are a group of their own, in front of the others; rows that
share a key are ordered by their leaves, and equal rows have equal leaves, so their order
makes no difference; an empty table gives no rows and has no root; columns that are not
named are not read. A row without a key is not tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import grouped
from quillspark.operators.ranking import numbered
from quillspark.session import materialize, shuffle_width

# Children of a node, and the fields of a leaf in their order.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Levels that one task works through at once: a block has ``FANOUT ** LEVELS`` leaves.
LEVELS = 3

# Proofs of a block that a task holds at once.
PROOFS_AT_ONCE = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "tree string, pos long, n long, digest string"
HEADERS = "tree string, block long, suffix string, subroot string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int, most: int) -> int:
    """Levels above ``n`` nodes that are worked through in one round."""
    levels = 0
    while levels < most and FANOUT**levels < n:
        levels += 1
    return levels


def forward(leaves: Sequence[str], levels: int) -> list[list[str]]:
    """The digests of a block, level by level from its leaves."""
    found: list[list[str]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, str]] = []

    def deliver(level: int, index: int, made: str) -> None:
        found[level].append(made)
        if level < levels:
            last = min((index // FANOUT + 1) * FANOUT ** (level + 1), len(leaves)) - 1
            heappush(queue, (last, level + 1, index, made))

    for place, leaf in enumerate(leaves):
        deliver(0, place, leaf)
        while queue and queue[0][0] <= place:
            label, index, children = queue[0][:2], queue[0][2] // FANOUT, []
            while queue and queue[0][:2] == label:
                children.append(heappop(queue)[3])
            deliver(label[1], index, digest("".join(children)))
    return found


def backward(found: list[list[str]], suffix: str) -> Iterator[tuple[int, str]]:
    """The place and the proof of every leaf of a block whose top has the proof ``suffix``, from the last leaf on.

    A proof holds for each level ``left|right;``, the digests before and behind the own one.
    """
    n = len(found[0])
    queue = [(1 - n, 1 - len(found), 0, suffix)]
    while queue:
        _, level, index, suffix = heappop(queue)
        if level == 0:
            yield index, suffix
            continue
        below = -level - 1
        first = index * FANOUT
        run = found[below][first : first + FANOUT]
        for k in range(len(run)):
            last = min((first + k + 1) * FANOUT**below, n) - 1
            heappush(queue, (-last, -below, first + k, f"{''.join(run[:k])}|{''.join(run[k + 1:])};{suffix}"))


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and its siblings give."""
    for level in proof.split(";")[:-1]:
        left, right = level.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, ``:`` and the value, or ``-`` if it is null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _blocks(nodes: DataFrame, levels: int, *columns: str) -> DataFrame:
    return nodes.select(
        "tree", F.shiftright("pos", 4 * levels).alias("block"), "pos", "n", "digest", *columns)


def _dealt(rows: DataFrame) -> DataFrame:
    """Each block in one task, in order."""
    width = shuffle_width(rows.sparkSession)
    return rows.repartition(width, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _tops(levels: int) -> Callable:
    """The digest above each block, as a node of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["tree", "block"]):
            n = part["n"][0].as_py()
            top = forward(part["digest"].to_pylist(), depth(n, levels))[-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([part["tree"][0].as_py()], pa.string()), pa.array([part["block"][0].as_py()], pa.int64()),
                pa.array([-(-n // FANOUT**levels)], pa.int64()), pa.array(top, pa.string())],
                names=["tree", "pos", "n", "digest"])

    return run


@dataclass
class Forest:
    """Trees after the forward sweep: for each round the nodes it starts from, and each tree's last digest."""

    rounds: list[DataFrame]  # tree, pos, n, digest
    tops: DataFrame  # tree, digest
    levels: int


def climbed(nodes: DataFrame, levels: int) -> Forest:
    """The forward sweep over trees of nodes (tree, pos, n of the tree, digest)."""
    rounds = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        above = _dealt(_blocks(rounds[-1].where("n > 1"), levels)).mapInArrow(_tops(levels), NODES)
        rounds.append(materialize(above, "merkle"))
        largest = -(-largest // FANOUT**levels)
    tops = rounds[0].where("n = 1")
    for nodes_of in rounds[1:]:
        tops = tops.unionByName(nodes_of.where("n = 1"), allowMissingColumns=True)
    return Forest(rounds, tops.select("tree", "digest"), levels)


def _handed(rows: DataFrame, headers: DataFrame, levels: int, emit: Callable, schema: str, *columns: str) -> DataFrame:
    """The reversed sweep of one round: ``emit(block's rows, header, proofs)`` makes the batch of a block.

    A block's header, the suffix for its top, travels once and sorts in front of the block's rows.
    """
    empty = {c: F.lit(None).cast(rows.schema[c].dataType) for c in columns}
    fronts = headers.select(
        "tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("string").alias("digest"), *[value.alias(c) for c, value in empty.items()], "suffix", "subroot")
    body = _blocks(rows, levels, *columns).withColumns({
        "suffix": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["tree", "block"]):
            front, inner = part.slice(0, 1), part.slice(1)
            if not inner.num_rows:
                continue
            found = forward(inner["digest"].to_pylist(), depth(inner["n"][0].as_py(), levels))
            proofs, high = [""] * inner.num_rows, inner.num_rows
            # Proofs are long: some hundred rows of a block leave at a time.
            for place, proof in backward(found, front["suffix"][0].as_py()):
                proofs[place] = proof
                if place % PROOFS_AT_ONCE == 0:
                    yield emit(inner.slice(place, high - place), front["subroot"][0].as_py(), proofs[place:high])
                    proofs[place:high] = [""] * (high - place)
                    high = place

    return _dealt(body.unionByName(fronts)).mapInArrow(run, schema)


def _suffixes(part: pa.Table, subroot: str | None, proofs: list[str]) -> pa.RecordBatch:
    """Headers of the blocks below."""
    return pa.RecordBatch.from_arrays([
        part["tree"].combine_chunks(), part["pos"].combine_chunks(), pa.array(proofs, pa.string()),
        pa.array([subroot] * len(proofs), pa.string())], names=["tree", "block", "suffix", "subroot"])


def descended(forest: Forest, tops: DataFrame) -> DataFrame:
    """Headers (tree, block, suffix, subroot) of the first round's blocks, from those of the trees (tree, suffix, subroot)."""
    headers = None
    for k in range(len(forest.rounds) - 1, -1, -1):
        nodes = forest.rounds[k]
        last = nodes.where("n = 1").select(F.col("tree").alias("of")).join(
            tops, F.col("of").eqNullSafe(F.col("tree"))).select("tree", F.lit(0).cast("long").alias("block"), "suffix", "subroot")
        headers = last if headers is None else headers.unionByName(last)
        if k > 0:
            headers = materialize(_handed(nodes, headers, forest.levels, _suffixes, HEADERS), "merkle")
    return headers


@dataclass
class Manifest:
    """The written trees of a table."""

    rows: DataFrame  # tree, pos, n, digest, key, changed
    groups: DataFrame  # tree, suffix, subroot
    headers: DataFrame
    root: str | None
    levels: int

    @property
    def subroots(self) -> DataFrame:
        return self.groups.select("tree", "subroot")


def manifest(docs: DataFrame, *, group: str = "source", key: str = "doc_id", fields: Sequence[str] = FIELDS,
             changed: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The trees of ``docs``; a task works through ``levels`` levels at once.

    ``changed`` replaces fields in rows for which ``where`` holds: those rows also get the digest of
    their changed fields, which plays no part in the trees.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(F.lit(True) if where is None else where, leaf_digest([changed.get(c, F.col(c)) for c in fields]))
    leaves = materialize(docs.select(
        F.col(group).cast("string").alias("tree"), F.col(key).cast("long").alias("key"), leaf.alias("digest"),
        other.alias("changed"), F.monotonically_increasing_id().alias("row")), "merkle")
    ranked = numbered(leaves, ["tree", "key", "digest", "row"])
    sizes = ranked.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    sizes = sizes.withColumnRenamed("tree", "of")
    rows = materialize(ranked.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("rank") - F.col("first")).alias("pos"), "n", "digest", "key", "changed"), "merkle")
    trees = climbed(rows, levels)
    tops = materialize(trees.tops, "merkle")
    names = numbered(tops, ["tree"])
    count = names.count()
    spark = docs.sparkSession
    whole = climbed(names.select(
        F.lit(None).cast("string").alias("tree"), F.col("rank").alias("pos"), F.lit(count).cast("long").alias("n"), "digest"), levels)
    found = whole.tops.first()
    root = found["digest"] if found else None
    above = spark.createDataFrame([(None, "", root)], "tree string, suffix string, subroot string")
    fronts = descended(whole, above)
    placed = _handed(whole.rounds[0], fronts, levels, _suffixes, HEADERS).select(F.col("block").alias("rank"), "suffix")
    groups = materialize(names.join(placed, "rank").select("tree", "suffix", F.col("digest").alias("subroot")), "merkle")
    return Manifest(rows, groups, descended(trees, groups), root, levels)


def proofs(docs: DataFrame, **options) -> DataFrame:
    """``key, leaf, subroot, root, proof`` for each row; ``folded(leaf, proof)`` is the root."""
    made = manifest(docs, **options)
    root = made.root

    def emit(part: pa.Table, subroot: str, found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            part["key"].combine_chunks(), part["digest"].combine_chunks(), pa.array([subroot] * len(found), pa.string()),
            pa.array([root] * len(found), pa.string()), pa.array(found, pa.string())],
            names=["key", "leaf", "subroot", "root", "proof"])

    return _handed(made.rows, made.headers, made.levels, emit, "key long, leaf string, subroot string, root string, proof string", "key")


AUDIT = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def audited(docs: DataFrame, **options) -> DataFrame:
    """Each row's digests, the digest of its proof, and what its changed (else its own) leaf folds to.

    Proofs are made, hashed and folded in one task and don't leave it.
    """
    made = manifest(docs, **options)
    root = made.root

    def emit(part: pa.Table, subroot: str, found: list[str]) -> pa.RecordBatch:
        leaves = part["digest"].to_pylist()
        given = [new or old for new, old in zip(part["changed"].to_pylist(), leaves)]
        roots = [folded(leaf, proof) for leaf, proof in zip(given, found)]
        siblings = [digest(proof.replace("|", "").replace(";", "")) for proof in found]
        return pa.RecordBatch.from_arrays([
            part["key"].combine_chunks(), part["digest"].combine_chunks(), pa.array([subroot] * len(found), pa.string()),
            pa.array([root] * len(found), pa.string()), pa.array(siblings, pa.string()), pa.array(roots, pa.string()),
            pa.array([made_root == root for made_root in roots], pa.bool_())],
            names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _handed(made.rows, made.headers, made.levels, emit, AUDIT, "key", "changed")


def tampered(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 5, **options) -> DataFrame:
    """``audited`` with A-Z of the text in lower case in rows whose key's checksum ``one_in`` divides."""
    chosen = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(one_in)) == 0
    lowered = F.translate(F.col(text), UPPER, LOWER)
    return audited(docs, key=key, changed={text: lowered}, where=chosen, **options)


# DuckDB: levels by repeated grouping; proofs by a join of each level with the siblings.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_transform(str_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
           lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
             lambda s, z: xor(s >> 1, (s & 1) * 3988292384::UBIGINT), xor(a, b)), 4294967295::UBIGINT) AS crc
  FROM documents
), f AS (
  SELECT r, doc_id, source, coalesce(xor(crc, 4294967295::UBIGINT) % 5 = 0, false) AS bad,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, low
  FROM d
), l AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN bad THEN sha256(head || coalesce(strlen(low) || ':' || low, '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS given
  FROM f
), p AS (
  SELECT r, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM l
), up AS (
  SELECT 0 AS level, source, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, source, pos // 16, n
), subs AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 16, n
), sib AS (
  SELECT a.level, a.source, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lhs,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rhs
  FROM up a JOIN up b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY a.level, a.source, a.pos
), topsib AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lhs,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rhs
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY a.level, a.pos
), path AS (
  SELECT p.r, 0 AS step, sib.lhs, sib.rhs, sib.level FROM p
  JOIN sib ON sib.source IS NOT DISTINCT FROM p.source AND sib.pos = p.pos // (16 ** sib.level)::BIGINT
  UNION ALL
  SELECT l.r, 1, t.lhs, t.rhs, t.level FROM l JOIN subs ON subs.source IS NOT DISTINCT FROM l.source
  JOIN topsib t ON t.pos = subs.pos // (16 ** t.level)::BIGINT
), whole AS (
  SELECT r, string_agg(lhs || rhs, '' ORDER BY step, level) AS proof, list({'l': lhs, 'r': rhs} ORDER BY step, level) AS steps
  FROM path GROUP BY r
), done AS (
  SELECT l.doc_id, l.leaf, subs.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
         sha256(coalesce(whole.proof, '')) AS proof_sha256,
         list_reduce([l.given] || coalesce(list_transform(whole.steps, lambda s: s.l || '|' || s.r), []),
           lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM l JOIN subs ON subs.source IS NOT DISTINCT FROM l.source LEFT JOIN whole ON whole.r = l.r
)
SELECT *, folded_root = root AS verified FROM done
"""
