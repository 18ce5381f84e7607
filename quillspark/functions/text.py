"""Text expressions for building prompts and targets."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from quillspark.functions.tokens import bind, pieces, strip

# News boilerplate.
BYLINE_PIECE = "By "
BOILERPLATE_MARKERS = ("Last updated", "EST", "PUBLISHED", "UPDATED", "|")

# Default lengths.
LEAD_WORDS = 15
LEAD_SENTENCES = 8
MAX_CONTEXT_SENTENCES = 10
STORY_SENTENCES = 3

TEXT_SLOT = "[text]"


def first_parts(text: Column, delimiter: str, n: int | Column) -> Column:
    """The text up to the n-th delimiter, or all of it when there are fewer."""
    count = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("substring_index", text, F.lit(delimiter), count)


def lead_words(text: Column, n: int = LEAD_WORDS) -> Column:
    return first_parts(text, " ", n)


def lead_sentences(text: Column, n: int = LEAD_SENTENCES) -> Column:
    return first_parts(text, ".", n)


def strip_boilerplate(text: Column, markers: Sequence[str] = BOILERPLATE_MARKERS) -> Column:
    """Drop a leading byline, then every leading piece that holds a marker."""

    def without_byline(parts: Column) -> Column:
        rest = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.when(F.element_at(parts, 1) == BYLINE_PIECE, rest).otherwise(parts)

    def is_boilerplate(piece: Column) -> Column:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | piece.contains(marker)
        return hit

    def from_first_kept(parts: Column) -> Column:
        first = F.array_position(F.transform(parts, is_boilerplate), False).cast("int")
        return bind(first, lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.array_join(F.slice(parts, k, F.size(parts)), ".")))

    return bind(bind(F.split(strip(text), "[.]"), without_byline), from_first_kept)


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"\[.*?\]", ""))


def strip_ends(text: Column) -> Column:
    """Trim whitespace, then ASCII punctuation, at both ends."""
    return F.btrim(strip(text), F.lit(string.punctuation))


def icontains(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def fill(template: Column | str, text: Column, slot: str = TEXT_SLOT) -> Column:
    """Put the text into the template's slot, literally."""
    source = F.lit(template) if isinstance(template, str) else template
    return F.replace(source, F.lit(slot), text)


def concept_prompt(concepts: Column) -> Column:
    return F.concat(F.array_join(concepts, " "), F.lit(" "))


def story_prompt(sentences: Sequence[Column], k: int = STORY_SENTENCES) -> Column:
    """The first k sentences, each after a space; null when one is missing."""
    if k > len(sentences):
        raise ValueError(f"{len(sentences)} sentence columns, asked for {k}")
    parts: list[Column] = []
    for sentence in list(sentences)[:k]:
        parts += [F.lit(" "), sentence]
    return F.concat(*parts)


def with_instruction(text: Column, suffix: str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), text, F.lit(suffix))


def evidence_prompt(evidence: Column, claim: Column, evidence_marker: str, claim_marker: str,
                    suffix: str = "") -> Column:
    return F.concat(F.lit(evidence_marker), evidence, F.lit(claim_marker), claim, F.lit(suffix))


def translation(pair: Column, language: str) -> Column:
    return F.element_at(pair, F.lit(language))


def scored_text(prompt: Column, gen: Column, include_prompt: bool = True) -> Column:
    """Prompt and candidate joined by a space; null when either is null."""
    return F.concat(prompt, F.lit(" "), gen) if include_prompt else gen


def clean_id(raw: Column) -> Column:
    """Quoted id to number."""
    return F.btrim(raw, F.lit("'")).cast("bigint")


def numeric_id(raw: Column) -> Column:
    """The id as a number where it is all digits, else null."""
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint"))


def split_count(text: Column, delimiter_pattern: str = "[.]") -> Column:
    return F.size(F.split(text, delimiter_pattern))


def pad_ids(ids: Column, length: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def mask_pad(ids: Column, pad: int, ignored: int = -100) -> Column:
    """Training labels: padding positions get the ignored value."""
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(ignored)).otherwise(x))


def piece_count(text: Column) -> Column:
    return F.size(pieces(text))
