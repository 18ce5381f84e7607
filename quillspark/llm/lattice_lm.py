"""Likelihood of texts under a unigram model of subword pieces, summed over all segmentations.

The pieces are those of an existing vocabulary; their scores start from its order and are fitted to
the training words by rounds of expectation maximisation. A word, with the word-start mark in front,
is a lattice of pieces: a log-space forward recursion adds up all ways to write it. A character can
also be written as its UTF-8 bytes, so every text has a probability. A text is its words and one end.

Words are counted over all documents, added up in each task before they are shuffled, and the
lattice is walked once per distinct word. Frequent words, those that make up at least a
``head``-th of the training tokens each (so at most ``head`` of them), travel to all tasks; a document's
other words meet their counts and scores in a join.

Defined cases: a null or empty text is its end alone; a null doc_id counts as the empty text in the fold,
so it is a training row; rows with one id stay rows of their own; without training rows N and V are 0,
no token is known, and the base score of a token is log10(0.5 / 0.5); an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import arrow_rows, lowered, raw_texts, remainder
from quillspark.session import materialize

MARK = "▁"
LONGEST_HEAD = 64  # characters of a word that may travel to all tasks


class Lattice:
    """Pieces with log probabilities (natural); many words are walked at once.

    ``scores`` follow ``pieces``, ``byte_scores`` the byte values. Pieces are found by 64-bit hashes of their
    prefixes: from every character of every word the walk goes on as long as some piece begins so.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    GROUP = 8000  # words walked together
    CHARACTERS = 200_000  # and characters, as a character takes some hundred bytes; a longer word is walked alone
    SHORT = 32  # longer words are walked apart, as a group takes as many steps as its longest word

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_scores: np.ndarray):
        self.scores, self.byte_scores = scores, byte_scores
        prefixes: dict[str, int] = {}
        for k, piece in enumerate(pieces):
            for end in range(1, len(piece)):
                prefixes.setdefault(piece[:end], -1)
            prefixes[piece] = k
        hashes = np.zeros(len(prefixes), dtype=np.uint64)
        for k, prefix in enumerate(prefixes):
            value = 0
            for character in prefix:
                value = (value * int(self.BASE) + ord(character) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = value
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.found = np.array(list(prefixes.values()), dtype=np.int64)[order]

    def groups(self, words: list[str]) -> Iterator[np.ndarray]:
        """Places of words that are walked together."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= self.SHORT).sum())
        for part in (order[:short], order[short:]):
            running, at = np.cumsum(lengths[part]), 0
            while at < len(part):
                before = running[at - 1] if at else 0
                full = int(np.searchsorted(running, before + self.CHARACTERS, "right"))
                end = max(at + 1, min(at + self.GROUP, full))
                yield part[at:end]
                at = end

    def _edges(self, words: list[str]) -> dict[str, np.ndarray]:
        """Edges (start and end node, piece or -1, log probability) of a group; word w's nodes are ``base[w]`` and on."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        limit = np.repeat(np.cumsum(lengths), lengths)
        characters, which = np.unique(codes, return_inverse=True)
        spelled = np.array([
            self.byte_scores[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in characters.tolist()])
        alive = np.arange(len(codes))
        hashes = np.zeros(len(codes), dtype=np.uint64)
        starts, ends = [alive], [alive + 1]
        pieces, scores = [np.full(len(codes), -1, dtype=np.int64)], [spelled[which]]
        step = 0
        while len(alive):
            inside = alive + step < limit[alive]
            alive, hashes = alive[inside], hashes[inside]
            hashes = hashes * self.BASE + codes[alive + step].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            match = self.hashes[at] == hashes
            alive, hashes, piece = alive[match], hashes[match], self.found[at[match]]
            step += 1
            whole = piece >= 0
            starts.append(alive[whole])
            ends.append(alive[whole] + step)
            pieces.append(piece[whole])
            scores.append(self.scores[piece[whole]])
        start, end = np.concatenate(starts), np.concatenate(ends)
        of = word[start]
        base = np.cumsum(lengths) - lengths
        return {
            "start": start + of, "end": end + of, "from": start - base[of], "to": end - base[of], "word": of,
            "piece": np.concatenate(pieces), "score": np.concatenate(scores), "character": which[start],
            "first": base + np.arange(len(words)), "last": base + lengths + np.arange(len(words)),
            "characters": characters,
        }

    @staticmethod
    def _sweep(into: np.ndarray, level: np.ndarray, source: np.ndarray, score: np.ndarray, size: int,
               begin: np.ndarray) -> np.ndarray:
        """Log sums along edges, level by level: each node ``into`` from its ``source`` nodes, which come earlier."""
        total = np.full(size, -np.inf)
        total[begin] = 0.0
        order = np.lexsort((into, level))
        into, source, score = into[order], source[order], score[order]
        bounds = np.flatnonzero(np.diff(level[order])) + 1
        for low, high in zip(np.append(0, bounds), np.append(bounds, len(order))):
            if low == high:
                continue
            node = into[low:high]
            heads = np.append(0, np.flatnonzero(np.diff(node)) + 1)
            values = total[source[low:high]] + score[low:high]
            top = np.maximum.reduceat(values, heads)
            spread = np.repeat(top, np.diff(np.append(heads, len(node))))
            total[node[heads]] = top + np.log(np.add.reduceat(np.exp(values - spread), heads))
        return total

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (none may be empty), over all its segmentations."""
        out = np.zeros(len(words))
        for places in self.groups(words):
            e = self._edges([words[k] for k in places])
            alpha = self._sweep(e["end"], e["to"], e["start"], e["score"], int(e["last"][-1]) + 1, e["first"])
            out[places] = alpha[e["last"]]
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of pieces and of bytes in ``weights`` occurrences of the words."""
        pieces, spelled = np.zeros(len(self.scores)), np.zeros(256)
        for places in self.groups(words):
            e = self._edges([words[k] for k in places])
            size = int(e["last"][-1]) + 1
            alpha = self._sweep(e["end"], e["to"], e["start"], e["score"], size, e["first"])
            beta = self._sweep(e["start"], -e["from"], e["end"], e["score"], size, e["last"])
            share = np.exp(alpha[e["start"]] + e["score"] + beta[e["end"]] - alpha[e["last"]][e["word"]])
            share *= weights[places][e["word"]]
            whole = e["piece"] >= 0
            pieces += np.bincount(e["piece"][whole], weights=share[whole], minlength=len(pieces))
            by_character = np.bincount(e["character"][~whole], weights=share[~whole], minlength=len(e["characters"]))
            for c, x in zip(e["characters"].tolist(), by_character.tolist()):
                for b in chr(c).encode("utf-8", "surrogatepass"):
                    spelled[b] += x
        return pieces, spelled


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = Lattice.GROUP) -> Iterator[pa.Table]:
    """Batches of at least ``rows`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece file, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    order = sorted(plain, key=lambda k: (-model.get_score(k) if model.get_score(k) > -1e8 else k, k))
    return [model.id_to_piece(k) for k in order]


def normalised(weights: np.ndarray, byte_weights: np.ndarray, ends: float,
               smoothing: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Log probabilities of pieces, bytes and the end, from expected counts."""
    total = weights.sum() + byte_weights.sum() + ends + smoothing * (len(weights) + 257)
    return (np.log((weights + smoothing) / total), np.log((byte_weights + smoothing) / total),
            math.log((ends + smoothing) / total))


def _words(raw: bytes) -> list[bytes]:
    return lowered(raw).split()


def word_counts(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """``word, c`` over all documents: training occurrences of each distinct word (0 if only held out). Written."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("word", pa.binary()), ("c", pa.int64())])
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for at in range(0, len(items), 20_000):
                yield rows(*zip(*items[at : at + 20_000]))
            held.clear()

        for batch in batches:
            for raw, train in zip(raw_texts(batch), batch.column("train").to_pylist()):
                if train:
                    held.update(_words(raw))
                else:
                    for word in set(_words(raw)):
                        held.setdefault(word, 0)
                if len(held) > limit:
                    yield from flush()
        yield from flush()

    seen = docs.select("text", (remainder("doc_id") != 1).alias("train")).mapInArrow(counted, "word binary, c long")
    return materialize(seen.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def trained(counts: DataFrame, ends: int, pieces: list[str], rounds: int,
            smoothing: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Scores of pieces, bytes and the end after ``rounds`` of expectation maximisation over all training words.

    A round sends the scores of the vocabulary to the tasks and gets one expected count per piece back.
    """
    spark = counts.sparkSession
    size = len(pieces)
    scores = normalised(1.0 / (np.arange(size) + 10.0), np.full(256, 1e-4), 0.05, 1e-6)
    words = counts.where("c > 0")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, scores[0], scores[1]))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(*sent.value), np.zeros(size + 256)
            for table in _gathered(batches):
                marked = [MARK + w.decode() for w in table.column("word").to_pylist()]
                sums += np.concatenate(lattice.expected(marked, table.column("c").to_numpy().astype(np.float64)))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["piece", "x"])

        found = words.mapInArrow(expect, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(size + 256)
        for row in found:
            sums[row["piece"]] = row["x"]
        scores = normalised(sums[:size], sums[size:], float(ends), smoothing)
    return scores


def scored(docs: DataFrame, model: str, *, rounds: int = 2, smoothing: float = 0.1, head: int = 500_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = word_counts(read)
    totals = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = read.where(remainder("doc_id") != 1).count()
    n = (totals["n"] or 0) + ends
    v = (totals["v"] or 0) + (1 if ends else 0)
    pieces = vocabulary(model)
    logs, byte_logs, end_log = trained(counts, ends, pieces, rounds, smoothing)
    log10 = math.log(10.0)
    sent = spark.sparkContext.broadcast((pieces, logs, byte_logs))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        rows = arrow_rows([("word", pa.binary()), ("c", pa.int64()), ("lp", pa.float64())])
        for table in _gathered(batches):
            lp = lattice.log_probabilities([MARK + w.decode() for w in table.column("word").to_pylist()]) / log10
            yield rows(table.column("word").combine_chunks(), table.column("c").combine_chunks(), lp)

    def base(c: float) -> float:
        return math.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    walked = materialize(counts.mapInArrow(walk, "word binary, c long, lp double"), "word-scores")
    frequent = walked.where((F.col("c") * head >= n) & (F.col("c") > 0) & (F.length("word") <= LONGEST_HEAD))
    known = spark.sparkContext.broadcast({bytes(r["word"]): (base(r["c"]), r["lp"]) for r in frequent.collect()})
    end_base, end_lp, end_known = base(ends), end_log / log10, int(ends > 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a document's frequent words on its first row, and one row per other word."""
        heads = known.value
        rows = arrow_rows([
            ("row_id", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("n_tokens", pa.int64()),
            ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])
        out: list[tuple] = []
        for batch in batches:
            for row_id, doc_id, raw in zip(
                    batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), raw_texts(batch)):
                words = _words(raw)
                sums, found, rest = [end_base], [end_lp], []
                hits = end_known
                for word, tf in Counter(words).items():
                    scores = heads.get(word)
                    if scores is None:
                        rest.append((word, tf))
                    else:
                        hits += tf
                        sums.append(tf * scores[0])
                        found.append(tf * scores[1])
                # A stand-in word with a space, which no word holds, spreads documents without other words.
                word, tf = rest[0] if rest else (b" %d" % row_id, 0)
                out.append((row_id, doc_id, word, tf, len(words) + 1, hits, math.fsum(sums), math.fsum(found)))
                out += [(row_id, None, w, k, 0, 0, 0.0, 0.0) for w, k in rest[1:]]
                if len(out) >= 10_000:
                    yield rows(*zip(*out))
                    out = []
        if out:
            yield rows(*zip(*out))

    # The row number is made and used in one job, in which a task made again reads the same split.
    parts = read.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
        split, "row_id long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, lp double")
    rare = walked.where(~((F.col("c") * head >= n) & (F.col("c") > 0) & (F.length("word") <= LONGEST_HEAD))).select(
        "word", "c", F.col("lp").alias("word_lp"))
    c = F.coalesce("c", F.lit(0))
    word_base = F.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    tail = F.col("tf") > 0
    joined = parts.join(rare, "word", "left").select(
        "row_id", "doc_id", "n_tokens",
        (F.col("n_known") + F.when(tail & (c > 0), F.col("tf")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(tail, F.col("tf") * word_base).otherwise(0.0)).alias("base"),
        (F.col("lp") + F.when(tail, F.col("tf") * F.col("word_lp")).otherwise(0.0)).alias("lp"),
    )
    sums = joined.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "lp")])
    return sums.select(
        "doc_id", (remainder("doc_id") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"))
