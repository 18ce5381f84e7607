"""Conversation repair against search over all edits and against a plain suffix table."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import brute
from quillspark.llm import conversations as cv

LEGAL = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def order(row):
    conv, turn, role, text = row
    import hashlib
    return (turn is not None, turn or 0, role.encode(), hashlib.md5(text.encode()).hexdigest())


def flagged(rows):
    """(role, text, must go, truncated) in order, with the counts."""
    out, seen, counts = [], set(), Counter()
    for _, _, role, text in sorted(rows, key=order):
        left = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def suffixes(rows):
    """The least (cost, audit), from the last row back."""
    n, table = len(rows), {}
    for i in range(n, -1, -1):
        edits = {}
        for p in range(4):
            options = []
            if i == n:
                options += [(0, "")] if p in cv.LEGAL else []
            else:
                role, _, gone, cut = rows[i]
                cost, rest = table[i + 1, p]
                options.append((cost + 4, "D" + rest))
                if not gone:
                    steps = [("K", 0, cv.STEP.get((p, role[:1])))] + [("R", 3, cv.STEP.get((p, r))) for r in "ua"]
                    options += [(table[i + 1, q][0] + 3 * cut + c, e + table[i + 1, q][1]) for e, c, q in steps if q is not None]
            edits[p] = min(options, default=(10**9, ""))
        for p in range(4):
            options, front = [edits[p]], [(p, "")]
            for _ in range(3):
                front = [(q, a + "I") for s, a in front for r in "ua" if (q := cv.STEP.get((s, r))) is not None]
                options += [(edits[q][0] + 3 * len(a), a + edits[q][1]) for q, a in front]
            table[i, p] = min(options)
    return table[0, 0]


def everything(rows, most=2):
    """The least (cost, audit) of all edits with at most ``most`` insertions in a row."""
    def inserted():
        for n in range(most + 1):
            yield from itertools.product("ua", repeat=n)

    def edits(row):
        role, _, gone, cut = row
        yield 4, "D", ""
        if not gone:
            if role:
                yield 3 * cut, "K", role[:1]
            for r in "ua":
                yield 3 + 3 * cut, "R", r

    best = None
    front = [(0, "", "")]
    for row in rows:
        front = [(c + 3 * len(ins) + ec, a + "I" * len(ins) + e, out + "".join(ins) + r)
                 for c, a, out in front for ins in inserted() for ec, e, r in edits(row)
                 if re.fullmatch(r"s?(ua)*u?", out + "".join(ins) + r)]
    for c, a, out in front:
        for ins in inserted():
            if LEGAL.fullmatch(out + "".join(ins)):
                found = (c + 3 * len(ins), a + "I" * len(ins))
                best = found if best is None else min(best, found)
    return best


def applied(rows, audit):
    out, i = [], 0
    for op in audit:
        after = out[-1][0][:1] if out else ""
        other = "assistant" if after == "u" else "user"
        if op == "I":
            out.append((other, ""))
            continue
        role, text, _, _ = rows[i]
        i += 1
        if op == "K":
            out.append((role, text))
        elif op == "R":
            out.append((other, text))
    return out


def plain(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    made = []
    for conv, held in groups.items():
        kept = []
        for _, turn, role, text in held:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        flags, counts = flagged(kept)
        cost, audit = suffixes(flags) if kept else (0, "")
        turns = {t for _, t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:]))
        body = "\n".join(f"{r}:{t}" for r, t in applied(flags, audit))
        made.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, brute.sha(body)))
    return Counter(made)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three", " \t", "", "Four? ", "Five words without an end", None]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.1:
                turn = rng.choice([None, turn + 3])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         rng.choice(texts) if rng.random() < 0.5 else f"Own text {rng.random()}."))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def table(llm, rows):
    data = [(*r, "x", 1, 2, "y") for r in rows]
    return llm.createDataFrame(
        data, "conv_id long, turn long, role string, text string, digest string, part int, kind int, audit string").repartition(3)


def found(llm, rows):
    given = table(llm, rows)
    return Counter(tuple(r[c] for c in COLUMNS) for r in cv.audited(cv.damaged(given), given).collect())


def test_cells_are_least():
    """Spans against search over all edits, and against the suffix table for longer rows."""
    rng = random.Random(3)
    kinds = [(r, "t", g, t and not g) for r in ("system", "user", "assistant", "tool", "") for g in (False, True) for t in (False, True)]
    for n in (1, 2, 3):
        for _ in range(60 if n == 3 else 100):
            rows = [rng.choice(kinds) for _ in range(n)]
            chart = cv.Chart()
            for role, _, gone, cut in rows:
                chart.add(cv.row_cell(role[:1], gone, cut))
            assert cv.best(chart.whole()) == everything(rows) == suffixes(rows)
    for n in (7, 16, 45, 130):
        for _ in range(40):
            rows = [rng.choice(kinds) for _ in range(n)]
            chart = cv.Chart()
            for role, _, gone, cut in rows:
                chart.add(cv.row_cell(role[:1], gone, cut))
            assert cv.best(chart.whole()) == suffixes(rows)


def test_any_split_gives_the_same_cell():
    rng = random.Random(4)
    cells = [cv.row_cell(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(9)]
    spans = {(i, i + 1): c for i, c in enumerate(cells)}
    for length in range(2, 10):
        for i in range(10 - length):
            made = [cv.joined(spans[i, k], spans[k, i + length]) for k in range(i + 1, i + length)]
            assert all(cell == made[0] for cell in made)
            spans[i, i + length] = made[0]
    chart = cv.Chart()
    for cell in cells:
        chart.add(cell)
    assert chart.whole() == spans[0, 9]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_conversations(llm, seed):
    rows = random_rows(seed, [*range(60), None], 9)
    assert found(llm, rows) == plain(rows)


def test_a_conversation_over_many_tasks(llm):
    """One conversation of 3,000 rows: its spans meet in rounds."""
    rows = random_rows(5, range(20), 6)
    rng = random.Random(6)
    rows += [(777, t, rng.choice(["user", "assistant"]), f"Turn {t}." if rng.random() < 0.9 else "Same end") for t in range(3000)]
    before = llm.conf.get("spark.sql.shuffle.partitions")
    llm.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert found(llm, rows) == plain(rows)
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", before)


def test_repaired_rows(llm):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "And more."), (1, 2, "assistant", ""), (2, 5, "system", "Be brief."),
            (2, 6, "assistant", "Yes."), (3, 0, "user", " ")]
    made = cv.repaired(table(llm, rows)).collect()
    by_conv = defaultdict(list)
    for r in sorted(made, key=lambda r: (r.conv_id, r.place)):
        by_conv[r.conv_id].append((r.role, r.text, r.edit))
    assert by_conv[1] == [("user", "Hello.", "K"), ("assistant", "And more.", "R")]
    assert by_conv[2] == [("user", "", "I"), ("assistant", "Yes.", "K")] or by_conv[2] == [
        ("system", "Be brief.", "K"), ("user", "", "I"), ("assistant", "Yes.", "K")]
    assert 3 not in by_conv


def test_far_turns_and_no_rows(llm):
    rows = [(1, -(2**63), "user", "One."), (1, 2**63 - 1, "assistant", "Two.")]
    assert cv.audits(table(llm, rows)).first().gaps == 2**63 - 1
    empty = table(llm, rows).limit(0)
    assert cv.audited(cv.damaged(empty), empty).count() == 0 and cv.repaired(empty).count() == 0
