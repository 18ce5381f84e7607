"""Repair of conversation structure by weighted parsing of row intervals.

A conversation's role initials should form ``(s?(ua)+)?``. Its cheapest repair keeps, re-roles
and deletes rows and inserts empty ones. The grammar is in Chomsky normal form: a symbol (p, q)
stands for edited rows that lead from state p to state q of the role order, (p, q) -> (p, r) (r, q)
joins two neighbouring spans, and (p, q) -> row is a single row with its edit. A cell of a span
holds for each symbol the least (cost, audit), where the audit is the initials of the edits.

* Insertion closure: a row's cell takes in the insertions in front of it, as few as lead from one
  state to another; insertions behind the last row belong to the end mark, a terminal of its own.
  So a row's audit is a word ``I*[DKR]``. These words are a prefix code: of two different audits of one
  span neither starts with the other, so joining least audits gives least audits, and cells are exact.
* As the states on both sides are part of a symbol, every split of a span gives the same cell.
  One split is enough, and spans are combined bottom-up by length: 1, 2, 4 and so on. The chart
  has as many cells as rows, not as many as pairs of rows.

Tasks take runs of the order (conversation, turn), so a conversation of very many rows is parsed
by many tasks, each of which leaves one cell for its span; spans of spans are combined in rounds,
``SPANS`` of them at once. A task keeps one cell for each length, not its rows. Only narrow rows
(turn, role, digest of the text) are parsed. Texts move once, when the edits are applied: they
stream past in order and are never held. The one thing that can't be spread is the digest of a
repaired conversation, as sha256 takes its bytes one after the other; it holds no rows.

Defined cases: null roles and texts are one space; rows without a conv_id are a conversation
of their own; rows without a turn come first; rows of one turn are ordered by role and then by
the md5 of the text, and equal rows are repeats; a role without a first character, or with another
initial than s, u and a, can't be kept; texts of any length; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import SPACE
from quillspark.session import materialize, shuffle_width

# The role order as states (start, after s, after u, after a) and the edits' costs.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Spans of one conversation that a round combines.
SPANS = 16

Cell = list[dict[int, tuple[int, str]]]  # by the first state, then by the last: (cost, audit)


def _insertions() -> list[dict[int, int]]:
    """From each state, the states that insertions lead to, and how many it takes."""
    out = []
    for start in range(4):
        reached, front, n = {start: 0}, [start], 0
        while front:
            n += 1
            front = [q for p in front for r in ROLES if (q := STEP.get((p, r))) is not None and q not in reached]
            reached |= {q: n for q in front}
        out.append(reached)
    return out


INSERTIONS = _insertions()


def _offer(cell: Cell, p: int, q: int, cost: int, audit: str) -> None:
    if q not in cell[p] or (cost, audit) < cell[p][q]:
        cell[p][q] = (cost, audit)


def row_cell(initial: str, gone: bool, truncated: bool) -> Cell:
    """The cell of one row; ``gone`` if it must be deleted."""
    cell: Cell = [{} for _ in range(4)]
    for p, reached in enumerate(INSERTIONS):
        for r, n in reached.items():
            cost, audit = INSERT * n, "I" * n
            _offer(cell, p, r, cost + DELETE, audit + "D")
            if gone:
                continue
            cost += TRUNCATED * truncated
            if (q := STEP.get((r, initial))) is not None:
                _offer(cell, p, q, cost, audit + "K")
            for role in ROLES:
                if (q := STEP.get((r, role))) is not None:
                    _offer(cell, p, q, cost + REROLE, audit + "R")
    return cell


def end_cell() -> Cell:
    """Insertions behind the last row, up to a legal end."""
    return [{q: (INSERT * n, "I" * n) for q, n in reached.items() if q in LEGAL} for reached in INSERTIONS]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    cell: Cell = [{} for _ in range(4)]
    for p, found in enumerate(left):
        for r, (cost, audit) in found.items():
            for q, (more, rest) in right[r].items():
                _offer(cell, p, q, cost + more, audit + rest)
    return cell


class Chart:
    """Spans of neighbouring rows: one cell for each length that is a power of two."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, length: int = 1) -> None:
        spans = self.spans
        spans.append((length, cell))
        while len(spans) > 1 and spans[-2][0] <= spans[-1][0]:
            (n, left), (m, right) = spans[-2:]
            spans[-2:] = [(n + m, joined(left, right))]

    def whole(self) -> Cell:
        """The cell of all rows so far."""
        cell = self.spans[-1][1]
        for _, left in reversed(self.spans[:-1]):
            cell = joined(left, cell)
        return cell


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a conversation of such rows."""
    found = joined(cell, end_cell())
    return min(found[0][q] for q in LEGAL if q in found[0])


def damaged(convs: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or re-roled by the checksum of their key, one in twenty each."""
    rows = _filled(convs)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(
        F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _filled(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def _same(left: str, right: str = "conv_id") -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows ``conv_id, turn, role, digest, blank, truncated, n, fresh``, equal ones counted, written.

    ``fresh`` if the first of the n rows is the first of its role and text in the conversation.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    counts = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n"))
    counts = materialize(counts, "conversations")
    first = counts.groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first"))
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("as"), F.col("digest").alias("said"), "unnumbered", "first")
    fresh = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    marked = counts.join(first, _same("of") & (F.col("as") == F.col("role")) & (F.col("said") == F.col("digest")))
    return materialize(marked.select(*counts.columns, fresh.alias("fresh")), "conversations")


def counted(marked: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` of each conversation."""
    single = F.when(F.col("fresh") & ~F.col("blank"), 1).otherwise(0)
    # In decimals, as the distance of two turns may be no long; more than a long holds is the largest long.
    wide = F.max("turn").cast("decimal(20)") - F.min("turn").cast("decimal(20)") + 1 - F.count_distinct("turn")
    return marked.groupBy("conv_id").agg(
        F.coalesce(F.when(wide > 2**63 - 1, F.lit(2**63 - 1)).otherwise(wide), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - single)).alias("duplicate"),
        F.sum(F.when(F.col("truncated"), single).otherwise(0)).alias("truncated"))


SPAN = "conv_id {}, part int, heads string, tails string, illegal long, costs array<long>, audits array<string>"


class _Spans:
    """Spans as batches of some hundred rows."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, conv, part: int, heads: str, tails: str, illegal: int, cell: Cell) -> None:
        found = [cell[p].get(q) for p in range(4) for q in range(4)]
        self.rows.append((conv, part, heads, tails, illegal, [f and f[0] for f in found], [f and f[1] for f in found]))

    def batches(self, names: pa.DataType, least: int) -> Iterator[pa.RecordBatch]:
        """What is held, if it is ``least`` rows or more."""
        if len(self.rows) >= max(1, least):
            kinds = [names, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(zip(*self.rows), kinds)],
                names=["conv_id", "part", "heads", "tails", "illegal", "costs", "audits"])
            self.rows = []


def _cell(costs: list, audits: list) -> Cell:
    return [{q: (costs[4 * p + q], audits[4 * p + q]) for q in range(4) if costs[4 * p + q] is not None} for p in range(4)]


def _illegal(left: str, right: str) -> bool:
    return left + right not in LEGAL_PAIRS


def _leaf_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One span for each conversation's rows in the task; they are sorted."""
    known: dict[tuple, Cell] = {}

    def cell_of(initial: str, gone: bool, truncated: bool) -> Cell:
        key = (initial if initial in "sua" else "", gone, truncated)
        if key not in known:
            known[key] = row_cell(*key)
        return known[key]

    chart, conv, part, head, tail, illegal, names, spans = None, None, 0, "", "", 0, None, _Spans()
    for batch in batches:
        names = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "part", "role", "blank", "truncated", "n", "fresh"))):
            of, at, role, blank, truncated, n, fresh = row
            initial = role[:1]
            if chart is None or of != conv:
                if chart is not None:
                    spans.add(conv, part, head, tail, illegal, chart.whole())
                chart, conv, part, head, tail, illegal = Chart(), of, at, initial, None, 0
            illegal += tail is not None and _illegal(tail, initial)
            illegal += (n - 1) * _illegal(initial, initial)
            tail = initial
            chart.add(cell_of(initial, blank or not fresh, truncated))
            for _ in range(n - 1):
                chart.add(cell_of(initial, True, truncated))
        yield from spans.batches(names, 200)
    if chart is not None:
        spans.add(conv, part, head, tail, illegal, chart.whole())
        yield from spans.batches(names, 1)


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One span for each conversation and group of neighbouring spans; they are sorted."""
    chart, key, head, tail, illegal, names, spans = None, None, "", "", 0, None, _Spans()
    for batch in batches:
        names = batch.schema.field("conv_id").type
        for of, at, heads, tails, wrong, costs, audits in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "part", "heads", "tails", "illegal", "costs", "audits"))):
            if chart is None or (of, at // SPANS) != key:
                if chart is not None:
                    spans.add(*key, head, tail, illegal, chart.whole())
                chart, key, head, tail, illegal = Chart(), (of, at // SPANS), heads, None, 0
            illegal += wrong + (tail is not None and _illegal(tail, heads))
            tail = tails
            chart.add(_cell(costs, audits))
        yield from spans.batches(names, 200)
    if chart is not None:
        spans.add(*key, head, tail, illegal, chart.whole())
        yield from spans.batches(names, 1)


def _bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [best(_cell(c, a)) for c, a in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist())]
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id"), batch.column("illegal"), pa.array([f[0] for f in found], pa.int64()),
            pa.array([f[1] for f in found], pa.string())], names=["conv_id", "illegal", "cost", "audit"])


def parsed(marked: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of each conversation with rows."""
    spark, order = marked.sparkSession, ["conv_id", "turn", "role", "digest"]
    width, of = shuffle_width(spark), marked.schema["conv_id"].dataType.simpleString()
    spans = (
        marked.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id())
        .sortWithinPartitions(*order).mapInArrow(_leaf_spans, SPAN.format(of)))
    spans = materialize(spans, "conversations")
    done = None
    while True:
        pieces = spans.groupBy("conv_id").agg(F.count("*").alias("pieces")).withColumnRenamed("conv_id", "of")
        several = materialize(pieces.where("pieces > 1"), "conversations")
        single = spans.join(several, _same("of"), "left_anti")
        done = single if done is None else done.unionByName(single)
        if several.isEmpty():
            return done.mapInArrow(_bests, f"conv_id {of}, illegal long, cost long, audit string")
        rest = spans.join(several, _same("of"), "left_semi")
        group = F.floor(F.col("part") / SPANS)
        rest = rest.repartition(width, F.col("conv_id"), group).sortWithinPartitions("conv_id", "part")
        spans = materialize(rest.mapInArrow(_joined_spans, SPAN.format(of)), "conversations")


def audits(convs: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per conversation.

    ``originals`` names conversations that are to have a row even if ``convs`` has none of their rows.
    """
    marked = faults(_filled(convs))
    stats = counted(marked).withColumnRenamed("conv_id", "of")
    found = parsed(marked).withColumnRenamed("conv_id", "parse_of")
    ids = (convs if originals is None else originals).select("conv_id").distinct()
    rows = ids.join(stats, _same("of"), "left").join(found, _same("parse_of"), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                       F.coalesce("audit", F.lit("")).alias("audit"))


class _Repair:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, 0, 0

    def _put(self, initial: str, role: str, text: str, edit: str) -> tuple[int, str, str, str]:
        self.state = STEP[self.state, initial]
        self.place += 1
        return self.place - 1, role, text, edit

    def _next(self) -> str:
        return "a" if self.state == 2 else "u"

    def _inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            initial = self._next()
            yield self._put(initial, ROLES[initial], "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._put(role[:1], role, text, edit)
        elif edit == "R":
            initial = self._next()
            yield self._put(initial, ROLES[initial], text, edit)

    end = _inserted


def _in_order(convs: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and, behind it, its rows in order, in one task."""
    rows = _filled(convs)
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text")
    return heads.unionByName(body).repartition(shuffle_width(convs.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, repaired row) in order, and (conv_id, None) behind each conversation."""
    repair, conv = None, None
    for batch in batches:
        for of, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if kind == 0:
                if repair:
                    yield from ((conv, row) for row in repair.end())
                    yield conv, None
                repair, conv = _Repair(text), of
            else:
                yield from ((conv, row) for row in repair.row(role, text))
    if repair:
        yield from ((conv, row) for row in repair.end())
        yield conv, None


def repaired(convs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit`` (K, R or I)."""
    found = materialize(audits(convs), "conversations") if found is None else found
    kind = convs.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = None, [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [names, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                              names=["conv_id", "place", "role", "text", "edit"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal names
            for batch in batches:
                names = batch.schema.field("conv_id").type
                yield batch

        for conv, row in _events(seen()):
            if row is not None:
                held.append((conv, *row))
                size += len(row[2])
                if len(held) >= 1000 or size > 1 << 22:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return _in_order(convs, found).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def digested(convs: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of the repaired rows ``role:text``, joined by line breaks."""
    kind = convs.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], names), pa.array([r[1] for r in rows], pa.string())],
                names=["conv_id", "repaired_sha256"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal names
            for batch in batches:
                names = batch.schema.field("conv_id").type
                yield batch

        made = hashlib.sha256()
        for conv, row in _events(seen()):
            if row is not None:
                place, role, text, _ = row
                made.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                continue
            held.append((conv, made.hexdigest()))
            made = hashlib.sha256()
            if len(held) >= 1000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return _in_order(convs, found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def audited(convs: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """``audits`` with the digest of each repaired conversation."""
    found = materialize(audits(convs, originals), "conversations")
    signed = digested(convs, found).withColumnRenamed("conv_id", "of")
    return found.join(signed, _same("of")).drop("of")


# DuckDB: the least repair from the last row back to the first, one row of all conversations a step.
ORACLE = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(list_transform(
           str_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT),
           lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
             lambda s, z: xor(s >> 1, (s & 1) * 3988292384::UBIGINT), xor(a, b)), 4294967295::UBIGINT) AS crc
  FROM conversations
), bad AS (
  SELECT conv_id, turn, role, text, xor(crc, 4294967295::UBIGINT) % 20 AS k FROM src
), dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM bad WHERE k <> 0
), num AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS ini,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS trunc
  FROM dam
), flt AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM num
), edge AS (
  SELECT conv_id, i, n, ini, blank OR dup AS gone, CASE WHEN trunc AND NOT blank AND NOT dup THEN 3 ELSE 0 END AS extra FROM flt
), dp AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0, 'a': ''} AS f0, {'c': 6, 'a': 'II'} AS f1, {'c': 3, 'a': 'I'} AS f2, {'c': 0, 'a': ''} AS f3
  FROM edge
  UNION ALL
  SELECT conv_id, i,
         list_sort([e0, {'c': e2.c + 3, 'a': 'I' || e2.a}, {'c': e3.c + 6, 'a': 'II' || e3.a}])[1],
         list_sort([e1, {'c': e2.c + 3, 'a': 'I' || e2.a}, {'c': e3.c + 6, 'a': 'II' || e3.a}])[1],
         list_sort([e2, {'c': e3.c + 3, 'a': 'I' || e3.a}])[1],
         list_sort([e3, {'c': e2.c + 3, 'a': 'I' || e2.a}])[1]
  FROM (
    SELECT e.conv_id, e.i,
           list_sort([{'c': f0.c + 4, 'a': 'D' || f0.a},
             {'c': CASE WHEN gone OR ini <> 's' THEN 999999999 ELSE f1.c + extra END, 'a': 'K' || f1.a},
             {'c': CASE WHEN gone OR ini <> 'u' THEN 999999999 ELSE f2.c + extra END, 'a': 'K' || f2.a},
             {'c': CASE WHEN gone THEN 999999999 ELSE f2.c + extra + 3 END, 'a': 'R' || f2.a}])[1] AS e0,
           list_sort([{'c': f1.c + 4, 'a': 'D' || f1.a},
             {'c': CASE WHEN gone OR ini <> 'u' THEN 999999999 ELSE f2.c + extra END, 'a': 'K' || f2.a},
             {'c': CASE WHEN gone THEN 999999999 ELSE f2.c + extra + 3 END, 'a': 'R' || f2.a}])[1] AS e1,
           list_sort([{'c': f2.c + 4, 'a': 'D' || f2.a},
             {'c': CASE WHEN gone OR ini <> 'a' THEN 999999999 ELSE f3.c + extra END, 'a': 'K' || f3.a},
             {'c': CASE WHEN gone THEN 999999999 ELSE f3.c + extra + 3 END, 'a': 'R' || f3.a}])[1] AS e2,
           list_sort([{'c': f3.c + 4, 'a': 'D' || f3.a},
             {'c': CASE WHEN gone OR ini <> 'u' THEN 999999999 ELSE f2.c + extra END, 'a': 'K' || f2.a},
             {'c': CASE WHEN gone THEN 999999999 ELSE f2.c + extra + 3 END, 'a': 'R' || f2.a}])[1] AS e3
    FROM dp JOIN edge e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i - 1
  )
), best AS (
  SELECT conv_id, f0.c AS cost, f0.a AS audit FROM dp WHERE i = 1
), ops AS (
  SELECT conv_id, audit, unnest(str_split(audit, '')) AS op, generate_subscripts(str_split(audit, ''), 1) AS k
  FROM best WHERE audit <> ''
), put AS (
  SELECT conv_id, op, k, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS o
  FROM ops WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), txt AS (
  SELECT p.conv_id, p.op, p.o, f.role, CASE WHEN p.op = 'I' THEN '' ELSE f.text END AS text,
         bool_or(p.o = 1 AND p.op = 'K' AND f.ini = 's') OVER (PARTITION BY p.conv_id) AS has_s
  FROM put p LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.op <> 'D'
), rep AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role
           WHEN (o - CASE WHEN has_s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS body
  FROM txt GROUP BY conv_id
), st AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (dup)::BIGINT AS duplicate,
         count(*) FILTER (trunc AND NOT blank AND NOT dup)::BIGINT AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM flt GROUP BY conv_id
)
SELECT o.conv_id, coalesce(st.gaps, 0)::BIGINT AS gaps, coalesce(st.blank, 0)::BIGINT AS blank,
       coalesce(st.duplicate, 0)::BIGINT AS duplicate, coalesce(st.truncated, 0)::BIGINT AS truncated,
       coalesce(st.illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(rep.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id
"""
