"""Reading a judge's reply."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.text import icontains

# Scores given when a reply holds no digit.
SCORE_YES = 0.7
SCORE_NO = 0.3


def parse_cot(reply: Column) -> Column:
    """The part after ``|`` when there is exactly one, else the whole reply."""
    parts = F.split(reply, "[|]")
    return F.when(F.size(parts) == 2, F.element_at(parts, 2)).otherwise(reply)


def parse_verdict(reply: Column, strict: bool = False) -> Column:
    """True or False when exactly one of the two words occurs, else null."""
    if strict:
        low = F.lower(reply)
        yes, no = low.rlike(r"\btrue\b"), low.rlike(r"\bfalse\b")
    else:
        yes, no = icontains(reply, "true"), icontains(reply, "false")
    return F.when(yes & ~no, F.lit(True)).when(no & ~yes, F.lit(False))


def parse_score(reply: Column, strict: bool = False) -> Column:
    """The largest of 10..0 that occurs, over ten; then yes/true, no/false; else null.

    By default digits and words count wherever they occur, also inside longer
    numbers and words; ``strict`` asks for whole numbers and whole words.
    """
    low = F.lower(reply)

    def has_number(n: int) -> Column:
        return reply.rlike(rf"(^|[^0-9]){n}([^0-9]|$)") if strict else reply.contains(str(n))

    def has_word(word: str) -> Column:
        return low.rlike(rf"\b{word}\b") if strict else low.contains(word)

    score = F.when(has_number(10), F.lit(1.0))
    for n in range(9, -1, -1):
        score = score.when(has_number(n), F.lit(n / 10))
    score = score.when(has_word("yes") | has_word("true"), F.lit(SCORE_YES))
    return score.when(has_word("no") | has_word("false"), F.lit(SCORE_NO))


def judge_score(verdict: Column, desired_class: int = 1) -> Column:
    """Verdict as a constraint value; a failed reply counts as zero."""
    value = verdict.cast("double")
    flipped = value if desired_class == 1 else 1.0 - value
    return F.coalesce(flipped, F.lit(0.0))
