"""Licence statements in texts: ordered signature rules behind a keyword gate.

Texts are reduced to lower-case words with one space between them. Every rule is a regular
expression over such words with a priority (0 first), a label, a confidence, and keywords
all of which must occur before the expression is tried. Of the detections, one is
suppressed if another of the same or an earlier priority spans it; of two with the same span
the earlier rule stays. What is left gives the labels and, as the largest confidence, the score.

Some 140 rules are sentences of licence texts and notices (``licence_passages``), written one by one. The others
are built from families (name, versions, short name) and the forms in which licences are stated, so
every family is recognised in each form; a name alone, or behind "under" without the word licence, is none of them.
The base phrases are counted apart from the rules and always give their label.

Defined cases: a null or empty text has no words, no labels (empty strings) and score 0; null
and repeated ids pass through row by row; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import ALNUM, LOWER, arrow_rows, raw_texts
from quillspark.llm.licence_passages import PASSAGES

# The phrases of the contract and their labels.
BASE = [(b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved")]

# Letter case and separators in one table: A-Z to a-z, every byte outside words to a space.
_FOLD = bytes(LOWER[b] if ALNUM[LOWER[b]] else 32 for b in range(256))

# Families. Label, name as words, known versions, short name.
FAMILIES = [
    ("apache", "apache", ("1 0", "1 1", "2 0"), "apache"),
    ("mit", "mit", (), "mit"),
    ("gpl", "gnu general public", ("1", "2", "3"), "gpl"),
    ("lgpl", "gnu lesser general public", ("2 1", "3"), "lgpl"),
    ("lgpl", "gnu library general public", ("2",), "lgpl"),
    ("agpl", "gnu affero general public", ("1", "3"), "agpl"),
    ("gfdl", "gnu free documentation", ("1 1", "1 2", "1 3"), "gfdl"),
    ("mpl", "mozilla public", ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", "eclipse public", ("1 0", "2 0"), "epl"),
    ("cddl", "common development and distribution", ("1 0", "1 1"), "cddl"),
    ("cpl", "common public", ("1 0",), "cpl"),
    ("eupl", "european union public", ("1 0", "1 1", "1 2"), "eupl"),
    ("bsd-2-clause", "bsd 2 clause", (), "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", (), "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", (), "bsd 4 clause"),
    ("bsd", "bsd", (), "bsd"),
    ("isc", "isc", (), "isc"),
    ("zlib", "zlib", (), "zlib"),
    ("unlicense", "unlicense", (), "unlicense"),
    ("wtfpl", "do what the fuck you want to public", ("2",), "wtfpl"),
    ("artistic", "artistic", ("1 0", "2 0"), "artistic"),
    ("boost", "boost software", ("1 0",), "bsl"),
    ("ofl", "sil open font", ("1 0", "1 1"), "ofl"),
    ("ms-pl", "microsoft public", (), "ms pl"),
    ("ms-rl", "microsoft reciprocal", (), "ms rl"),
    ("osl", "open software", ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0"), "afl"),
    ("python", "python software foundation", ("2",), "psf"),
    ("ruby", "ruby", (), "ruby"),
    ("php", "php", ("3 0", "3 01"), "php"),
    ("postgresql", "postgresql", (), "postgresql"),
    ("openssl", "openssl", (), "openssl"),
    ("x11", "x11", (), "x11"),
    ("ncsa", "university of illinois ncsa open source", (), "ncsa"),
    ("w3c", "w3c software", (), "w3c"),
    ("upl", "universal permissive", ("1 0",), "upl"),
    ("odbl", "open database", ("1 0",), "odbl"),
    ("odc-by", "open data commons attribution", ("1 0",), "odc by"),
    ("pddl", "public domain dedication and", ("1 0",), "pddl"),
    ("cecill", "cecill", ("1 0", "2 0", "2 1"), "cecill"),
    ("openrail", "openrail", (), "openrail"),
    ("busl", "business source", ("1 0", "1 1"), "busl"),
    ("sspl", "server side public", ("1",), "sspl"),
    ("elastic", "elastic", ("2 0",), "elastic"),
]

# The parts of Creative Commons names, short and in words.
CC_PARTS = [
    ("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s(?: works)?"),
    ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
]
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def _rule(priority: int, label: str, confidence: float, keywords: tuple[str, ...], body: str) -> Rule:
    return Rule(priority, label, confidence, tuple(k.encode() for k in keywords),
                re.compile(rb"(?<![^ ])(?:" + body.encode() + rb")(?![^ ])"))


def rules() -> list[Rule]:
    """All rules in order: exact versions first, then names, then short forms and statements."""
    out = []
    license_word = r"licen[sc]e"
    # Only "licensed" says by itself that a licence is meant; other verbs need the word behind the name.
    under = r"under (?:the )?(?:terms of )?(?:the )?"
    granted = rf"(?:{license_word}d {under}{{0}}(?: {license_word})?|(?:released|distributed|available|published|covered) {under}{{0}} {license_word})"
    for label, name, versions, short in FAMILIES:
        gate = (name.split()[-1] if name.split()[-1] not in ("public", "software", "and") else name,)
        for version in versions:
            tail = rf"(?: {license_word})?(?: v| version)? ?{version}"
            out.append(_rule(0, f"{label}-{version.replace(' ', '.')}", 1.0, gate, rf"(?:the )?{name}{tail}(?: or (?:any )?later(?: version)?)?"))
            out.append(_rule(0, f"{label}-{version.replace(' ', '.')}", 1.0, ("spdx",), rf"spdx license identifier {short} {version}(?: (?:only|or later))?"))
            out.append(_rule(0, f"{label}-{version.replace(' ', '.')}", 0.9, (short,), rf"{short} ?v?{version}(?: (?:only|or later))?"))
        out.append(_rule(1, label, 0.95, gate, granted.format(name)))
        out.append(_rule(1, label, 0.95, ("spdx",), rf"spdx license identifier {short}"))
        out.append(_rule(2, label, 0.8, gate, rf"(?:the )?{name} {license_word}"))
        out.append(_rule(2, label, 0.7, (short, "under"), rf"under (?:the )?{short} {license_word}"))
    for short, words in CC_PARTS:
        name = f"cc-{short.replace(' ', '-')}"
        for version in CC_VERSIONS:
            label = f"{name}-{version.replace(' ', '.')}"
            out.append(_rule(0, label, 1.0, ("cc",), rf"cc {short} {version}(?: \w\w)?"))
            out.append(_rule(0, label, 1.0, ("creative commons",), rf"creative commons {words}(?: {version}| {version} \w+|(?: \w+)? {license_word} {version})"))
        out.append(_rule(1, name, 0.9, ("cc",), rf"cc {short}"))
        out.append(_rule(1, name, 0.9, ("creative commons",), rf"creative commons {words}(?: {license_word})?"))
    out += [_rule(*x) for x in PASSAGES]
    return sorted(out, key=lambda r: r.priority)


def surviving(starts: np.ndarray, ends: np.ndarray, order: np.ndarray, priorities: np.ndarray) -> np.ndarray:
    """Which detections no other of the same or an earlier priority spans; of equal spans the first in ``order`` stays."""
    keep = np.ones(len(starts), dtype=bool)
    for level in np.unique(priorities):
        group = np.flatnonzero(priorities <= level)
        group = group[np.lexsort((order[group], -ends[group], starts[group]))]
        reach = np.maximum.accumulate(ends[group])
        spanned = np.zeros(len(group), dtype=bool)
        spanned[1:] = reach[:-1] >= ends[group][1:]
        keep[group[spanned & (priorities[group] == level)]] = False
    return keep


class Scanner:
    """Finds licence statements in one text at a time."""

    def __init__(self, given: list[Rule] | None = None):
        self.rules = rules() if given is None else given
        keywords = sorted({k for r in self.rules for k in r.keywords})
        place = {k: i for i, k in enumerate(keywords)}
        self.keywords = keywords
        self.gates = [tuple(place[k] for k in r.keywords) for r in self.rules]

    def detections(self, folded: bytes) -> list[tuple[int, int, Rule]]:
        """Start and end bytes in the folded text, and the rule."""
        present = [k in folded for k in self.keywords]
        found = []
        for number, (rule, gate) in enumerate(zip(self.rules, self.gates)):
            if all(present[g] for g in gate):
                found += [(m.start(), m.end(), number) for m in rule.pattern.finditer(folded)]
        if not found:
            return []
        starts, ends, numbers = (np.array(x, dtype=np.int64) for x in zip(*found))
        keep = surviving(starts, ends, numbers, np.array([self.rules[n].priority for n in numbers]))
        return [(int(s), int(e), self.rules[n]) for s, e, n in zip(starts[keep], ends[keep], numbers[keep])]

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
        """Words, base places, first and last base word, base labels, labels, score, detections."""
        words = raw.translate(_FOLD).split()
        folded = b" ".join(words)
        places, base = [], set()
        padded = b" " + folded + b" "
        for phrase, label in BASE:
            at = padded.find(b" " + phrase + b" ")
            while at >= 0:
                places.append(at)
                base.add(label)
                at = padded.find(b" " + phrase + b" ", at + 1)
        found = self.detections(folded)
        labels = base | {rule.label for _, _, rule in found}
        score = max([0.9 * bool(places), *(rule.confidence for _, _, rule in found)])
        spans = []
        done, word = 0, 0
        for start, end, rule in sorted(found, key=lambda x: (x[0], x[1])):
            word += folded.count(b" ", done, start)  # spaces in front are words in front
            done = start
            spans.append({"label": rule.label, "first": word, "last": word + folded.count(b" ", start, end)})
        first = last = None
        if places:
            # Byte p of the padded text is byte p - 1 of the folded one; the space at p ends the word before.
            first, last = (padded.count(b" ", 0, p + 1) - 1 for p in (min(places), max(places)))
        return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans)


_held: list[Scanner] = []


def scanned(docs: DataFrame) -> DataFrame:
    """Counts, labels, score and ``detections`` (label, first and last word) for each row of ``docs``; no row moves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _held:
            _held.append(Scanner())
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        rows = arrow_rows([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("detections", span)])
        for batch in batches:
            found = [_held[0].scan(raw) for raw in raw_texts(batch)]
            if found:
                yield rows(batch.column("doc_id"), *zip(*found))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, detections array<struct<label: string, first: long, last: long>>")
