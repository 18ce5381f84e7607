"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def space_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def alnum_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(LOWER))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def fold(doc_id, by=5):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % by


def line_rules(rows, least_docs):
    """(doc_id, host, text) to counts and verdicts."""
    texts = defaultdict(set)

    def lines(text):
        return [(line, ws) for line in (text or "").split("\n") if (ws := space_words(line))]

    def norm(ws):
        return b" ".join(ws).translate(LOWER)

    for _, host, text in rows:
        for _, ws in lines(text):
            texts[host, norm(ws)].add(text or "")
    out = []
    for doc_id, host, text in rows:
        words = space_words(text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        found = lines(text)
        removed = sum(
            len(ws) for _, ws in found if len(texts[host, norm(ws)]) > least_docs)
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        left = len(words) - removed
        out.append((doc_id, len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")),
                    len(found) - len({line for line, _ in found}), len(inside), failed,
                    not failed and left >= 10 and left >= 0.3 * len(words), removed))
    return out


def near(texts, size=5, threshold=0.8):
    """Pairs of places whose shingle sets reach the threshold."""
    sets = []
    for text in texts:
        words = space_words(text)
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return {
        (i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and sets[i] and sets[j]
        and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9
    }


def groups(n, pairs):
    """The smallest place in each one's component."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[j] < label[i]:
                label[i], changed = label[j], True
    return label


def repeats(texts, window=35):
    """Kept words of each text."""
    words = [space_words(t) for t in texts]
    count = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = []
    for ws in words:
        gone = {i + k for i in range(len(ws) - window + 1) if count[tuple(ws[i : i + window])] > 1 for k in range(window)}
        out.append([w for i, w in enumerate(ws) if i not in gone])
    return out


def contamination(texts, items, window=13):
    """(words, hit words, item ids) of each text."""
    runs = defaultdict(set)
    for item_id, text in items:
        ws = alnum_words(text)
        n = min(len(ws), window)
        for i in range(len(ws) - n + 1 if ws else 0):
            runs[tuple(ws[i : i + n])].add("" if item_id is None else str(item_id))
    sizes = {len(r) for r in runs}
    out = []
    for text in texts:
        ws = alnum_words(text)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if found := runs.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((len(ws), len(hit), sorted(ids)))
    return out


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def word_base(rows):
    """(doc_id, text) to tokens, known tokens, training tokens and base score."""

    def tokens(text):
        return (text or "").encode().translate(LOWER).split() + [None]

    counts = Counter()
    for doc_id, text in rows:
        if fold(doc_id) != 1:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [
        (doc_id, fold(doc_id) == 1, len(ts := tokens(text)), sum(counts[t] > 0 for t in ts), n,
         sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        for doc_id, text in rows
    ]
