"""Near-duplicate documents by a MinHash LSH forest, every candidate verified exactly.

A text is the set of its runs of ``words`` consecutive words (a shorter text is one run). Texts with
one set form a class and go on as one. Each of ``trees`` trees sorts the classes by a signature of ``deepest``
MinHash values. In the sorted order the classes that share a prefix are neighbours, so one pass over it
that notes how many values a class has in common with the one before it is the tree's prefix trie: written are
links to the first class of the longest run that a class belongs to, with the length of the run's prefix.

Prefixes are matched from the deepest up. At each length the classes linked so far are candidates, whole
components of them are compared by their whole sets, and the links found tell what is missing: a link of similarity
s is met at length d with probability p = 1 - (1 - s^d)^trees, so each one found stands for 1 / p of them. While the links
found are a smaller share of this estimate than ``recall``, the prefix is shortened to the longest one that is to meet that
share, or to ``shortest`` if the links are too few to tell. How short it gets so depends on the documents: copies with few
changes are met at the deepest prefix. ``shortest`` ends it: there a link at the threshold is met with
probability ``recall`` whatever the documents. Only components that a shorter prefix has changed are compared again,
in pairs of blocks of bounded size, one task each, which return the number of
linked documents per class and a spanning forest of the links, but no pairs.

Defined cases: a text without words (null, empty, white space) is linked to nothing and is its own class;
rows with one doc_id are told apart by their texts, equal rows are copies; class_id is the smallest doc_id of
the group (null if none has an id); an empty table gives no rows; columns named like the
operator's own do not meet them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import WordHashes, arrow_rows, components, free, gram_hashes, grouped, keyed, mixed, raw_texts
from quillspark.session import materialize, shuffle_width

SEED = 20_240_229


# Bytes of a signature's value; values that agree by chance only add candidates.
VALUE = 2
# Links an estimate of the recall takes at least, each counted from both sides; with fewer the shortest prefix is matched.
TRUSTED = 2000


def prefix_length(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix, from ``deepest`` down, at which a pair at the threshold is met with at least this probability."""
    length = deepest
    while length > 1 and 1.0 - (1.0 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(memo: WordHashes, raw: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the text's runs of words; none for a text without words."""
    held = memo.of(raw.split())
    return np.unique(gram_hashes(held, min(words, len(held)))) if len(held) else held


class Signer:
    """MinHash signatures of shingle sets, one per tree."""

    def __init__(self, trees: int, length: int):
        random = np.random.default_rng(SEED)
        self.trees, self.length = trees, length
        self.a = random.integers(0, 1 << 63, (trees * length, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 1 << 63, (trees * length, 1), dtype=np.uint64)

    def signatures(self, found: np.ndarray) -> bytes:
        """``length`` values of ``VALUE`` bytes for each tree, one tree behind the other."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(found), 1024):
            values = self.a * found[None, at : at + 1024]
            values += self.b
            np.minimum(least, values.min(axis=1), out=least)
        return mixed(least).astype(">u2").tobytes()


def signed(docs: DataFrame, words: int, trees: int, length: int) -> DataFrame:
    """``_k1, _k2, doc_id, n_shingles, set_hash, signatures`` of every row; written, as several joins read it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, signer = WordHashes(), Signer(trees, length)
        rows = arrow_rows([("_k1", pa.int64()), ("_k2", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                           ("set_hash", pa.binary()), ("signatures", pa.binary())])
        last: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for k1, k2, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("_k1", "_k2", "doc_id")), raw_texts(batch)):
                found = shingles(memo, raw, words)
                if not len(found):
                    out.append((k1, k2, doc_id, 0, None, None))
                    continue
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest not in last:
                    if len(last) >= 10_000:
                        last.clear()
                    last[digest] = signer.signatures(found)  # copies are met again and again
                out.append((k1, k2, doc_id, len(found), digest, last[digest]))
            if out:
                yield rows(*zip(*out))

    read = docs.select("_k1", "_k2", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(read.mapInArrow(
        sign, "_k1 long, _k2 long, doc_id long, n_shingles long, set_hash binary, signatures binary"), "signatures")


def linked(sets: list[np.ndarray], sides: np.ndarray, inside: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets reach the threshold, a symmetric matrix, only across ``sides`` unless ``inside``; and how similar all are."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(at, [low, low + 4096]))
        chunk = np.zeros((len(sets), 4096), dtype=np.float32)
        chunk[row[part], at[part] - low] = 1.0
        common += chunk @ chunk.T
    found = common * (1.0 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(found, False)
    alike = common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1.0)
    return (found if inside else found & (sides[:, None] != sides[None, :])), alike


def _roots(found: np.ndarray) -> np.ndarray:
    """The smallest index in each one's component."""
    labels = np.arange(len(found))
    while True:
        after = np.minimum(labels, np.where(found, labels[None, :], len(found)).min(axis=1, initial=len(found)))
        after = after[after]
        if (after == labels).all():
            return labels
        labels = after


def verified(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """``cls, linked, root, alike`` per class and block pair: documents linked to it there and the root of its links. One row
    of a block pair also has its links counted by hundredths of similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        rows = arrow_rows([("cls", pa.int64()), ("linked", pa.int64()), ("root", pa.int64()), ("alike", pa.list_(pa.int64()))])
        for group in grouped(batches, ["comp", "low", "high"]):
            classes = group.column("cls").to_numpy()
            _, once = np.unique(classes, return_index=True)  # equal rows bring a class twice
            classes = classes[once]
            copies = group.column("copies").to_numpy()[once]
            sides = group.column("block").to_numpy()[once]
            raw = group.column("text").cast(pa.binary()).take(pa.array(once)).to_pylist()
            sets = [shingles(memo, r or b"", words) for r in raw]
            inside = group.column("low")[0].as_py() == group.column("high")[0].as_py()
            found, alike = linked(sets, sides, inside, threshold)
            some = np.flatnonzero(found.any(axis=1))
            if len(some):
                levels = np.bincount((alike[found] * 100).astype(np.int64), minlength=101)
                yield rows(classes[some], (found[some] @ copies), classes[_roots(found)[some]], [levels, *[None] * (len(some) - 1)])

    width = shuffle_width(members.sparkSession)
    dealt = members.repartition(width, "comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    return dealt.mapInArrow(compare, "cls long, linked long, root long, alike array<long>")


def trie(classes: DataFrame, trees: int, deepest: int, shortest: int) -> DataFrame:
    """``a, b, depth``: links of classes to the first one of a run with a common prefix of ``depth`` values, written.

    The links of ``d`` and more values connect the runs of prefixes of ``d`` values, whole and alone.
    """
    size = VALUE * deepest

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("tree", pa.int32()), ("signature", pa.binary()), ("cls", pa.int64())])
        number = np.arange(trees, dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held = part.column("signatures").to_pylist()
                pieces = [own[k : k + size] for own in held for k in range(0, size * trees, size)]
                yield rows(np.tile(number, len(held)), pieces, np.repeat(part.column("cls").to_numpy(), trees))

    def common(one: bytes, other: bytes) -> int:
        n = 0
        while n < deepest and one[VALUE * n : VALUE * (n + 1)] == other[VALUE * n : VALUE * (n + 1)]:
            n += 1
        return n

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside the task, and its first and last row, which may belong to runs of its neighbours."""
        rows = arrow_rows([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), ("part", pa.int32()),
                           ("tree", pa.int32()), ("signature", pa.binary())])
        last, heads, links, ends = None, [0] * (deepest + 1), [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "tree", "signature", "cls"))):
                part, tree, signature, cls = row
                if last is None:
                    ends.append(row)
                depth = common(signature, last[2]) if last is not None and last[1] == tree else 0
                for d in range(depth + 1, deepest + 1):
                    heads[d] = cls
                if depth >= shortest:
                    links.append((cls, heads[depth], depth, None, None, None))
                last = row
            if links:
                yield rows(*zip(*links))
                links = []
        if last is not None:
            ends.append(last)
            yield rows(*zip(*[(cls, cls, 0, part, tree, signature) for part, tree, signature, cls in ends]))

    spark, width = classes.sparkSession, shuffle_width(classes.sparkSession)
    rows = classes.select("cls", "signatures").mapInArrow(split, "tree int, signature binary, cls long")
    order = ["tree", "signature", "cls"]
    walked = materialize(
        rows.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
        .mapInArrow(walk, "a long, b long, depth int, part int, tree int, signature binary"), "trie")
    # Two rows per task: the last of one and the first of the next may share a prefix.
    edges, previous, across = walked.where("part IS NOT NULL").collect(), None, []
    for row in sorted(edges, key=lambda r: (r["part"], r["tree"], bytes(r["signature"]), r["a"])):
        if previous is not None and previous["part"] != row["part"] and previous["tree"] == row["tree"]:
            depth = common(bytes(previous["signature"]), bytes(row["signature"]))
            if depth >= shortest:
                across.append((row["a"], previous["a"], depth))
        previous = row
    joints = spark.createDataFrame(across, "a long, b long, depth int")
    return walked.where("part IS NULL").select("a", "b", "depth").unionByName(joints)


def met(similarity: float, depth: int, trees: int) -> float:
    """The probability that a link is met at a prefix of this length."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def estimated_recall(levels: list[int], depth: int, trees: int, at: int | None = None) -> float:
    """The share of all links that is met at length ``at`` (else ``depth``), by the numbers of those found at ``depth`` at
    hundredths of similarity; 0 if they are too few to tell."""
    if sum(levels) < TRUSTED:
        return 0.0
    # Each link found stands for 1 / p of them.
    whole = [(k / 100, count / met(k / 100, depth, trees)) for k, count in enumerate(levels) if count]
    return sum(n * met(s, at or depth, trees) for s, n in whole) / sum(n for _, n in whole)


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 8,
                    recall: float = 0.9999, block_docs: int = 256, block_shingles: int = 250_000,
                    told: list[tuple[int, float]] | None = None) -> DataFrame:
    """``_k1, _k2, doc_id, class_id, n_links, n_copies, keeper`` for every row of ``docs`` (doc_id, text).

    Rows of one group share ``class_id``. ``n_links`` counts the other rows with a similarity of
    at least the threshold, copies included; ``n_copies`` the rows with the same set. ``keeper`` marks the one text of
    the group that stays (all equal rows of it). ``told`` receives the prefix lengths gone through, with the recall estimated at each.
    """
    read = keyed(docs.select("doc_id", "text"))
    rows = signed(read, words, trees, deepest)
    with_words = rows.where("set_hash IS NOT NULL")
    # One row per set. Its number is fixed by writing it.
    classes = materialize(with_words.groupBy("set_hash").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "_k1", "_k2")).alias("rep"),
        F.any_value("signatures").alias("signatures"),
    ).withColumn("cls", F.monotonically_increasing_id()), "classes")
    shortest = prefix_length(threshold, trees, deepest, recall)
    runs = trie(classes, trees, deepest, shortest)
    links, depth = None, deepest
    while True:
        # A component is named by its smallest class; its size tells whether it is the one of the longer prefix.
        candidates = components(runs.where(F.col("depth") >= depth).select("a", "b").distinct(), "candidates")
        sized = candidates.join(classes.select(F.col("cls").alias("node"), "n_shingles"), "node").groupBy("comp").agg(
            F.count("*").alias("size"), F.sum("n_shingles").alias("volume"))
        sized = materialize(sized, "candidate-sizes")
        compared = sized if links is None else sized.join(done, ["comp", "size"], "left_anti")
        fresh = _compared(read, classes, candidates, compared, words, threshold, block_docs, block_shingles)
        if links is not None:
            # A component that has grown is compared as a whole, so what its parts gave is void.
            parts = candidates.join(compared.select("comp"), "comp", "left_semi").select(F.col("node").alias("cls"))
            fresh = fresh.unionByName(links.join(parts, "cls", "left_anti"))
        links, done = materialize(fresh, "links"), sized.select("comp", "size")
        levels = links.select(F.posexplode("alike").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        levels = [next((r["n"] for r in levels if r["at"] == k), 0) for k in range(101)]
        share = estimated_recall(levels, depth, trees)
        if told is not None:
            told.append((depth, share))
        if share >= recall or depth <= shortest:
            break
        # The longest of the shorter prefixes that is to meet the share, by what was found.
        depth = next((d for d in range(depth - 1, shortest, -1) if estimated_recall(levels, depth, trees, d) >= recall), shortest)
    counts = links.groupBy("cls").agg(F.sum("linked").alias("linked"))
    groups = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), "groups").select(
        F.col("node").alias("cls"), "comp")
    named = classes.join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    first = named.groupBy("comp").agg(
        F.min("class_id").alias("class_id"), F.min("rep").alias("keeper"))
    final = (
        named.drop("class_id").join(first, "comp").join(counts, "cls", "left")
        .select("set_hash", "class_id", F.col("copies"), F.coalesce("linked", F.lit(0)).alias("linked"), "keeper")
    )
    return rows.join(final, "set_hash", "left").select(
        "_k1", "_k2", "doc_id",
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("set_hash").isNull() | ((F.col("keeper._k1") == F.col("_k1")) & (F.col("keeper._k2") == F.col("_k2"))))
        .alias("keeper"),
    )


def _compared(read: DataFrame, classes: DataFrame, candidates: DataFrame, sized: DataFrame, words: int, threshold: float,
              block_docs: int, block_shingles: int) -> DataFrame:
    """All pairs inside the components ``sized``, compared by blocks."""
    blocks = sized.select("comp", F.greatest(
        F.ceil(F.col("size") / block_docs), F.ceil(F.col("volume") / block_shingles)).alias("blocks"))
    members = (
        candidates.join(blocks, "comp").withColumnRenamed("node", "cls")
        .join(classes.select("cls", "copies", "rep._k1", "rep._k2"), "cls")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    )
    placed = (
        read.select("_k1", "_k2", "text").join(members.hint("shuffle_hash"), ["_k1", "_k2"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                "cls", "copies", "block", "text")
    )
    return verified(placed, words, threshold)


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group: the text with the smallest doc_id, rows without words all stay."""
    keys = free(docs, "_k1", "_k2")
    found = near_duplicates(docs, **settings).where("keeper").select("_k1", "_k2").distinct().toDF(*keys)
    kept = keyed(docs, *keys).join(found, keys, "left_semi")
    # Equal rows are one document.
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    once = kept.where(~wordless).dropDuplicates(keys)
    return once.unionByName(kept.where(wordless)).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT a, b, c, x.n AS na, y.n AS nb FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b
  WHERE 10 * c >= 8 * (x.n + y.n - c)
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), grp AS (
  SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a
), cnt AS (
  SELECT a AS r, count(*) AS n, sum((c = na AND c = nb)::INT) AS same FROM links GROUP BY a
)
SELECT doc_id, class_id, coalesce(cnt.n, 0)::BIGINT AS n_links, (1 + coalesce(cnt.same, 0))::BIGINT AS n_copies
FROM d JOIN grp USING (r) LEFT JOIN cnt USING (r)
"""
