"""Queries of the operators in this folder over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import (
    common, conversations, fm_index, lattice_lm, licences, line_rules, lsh_forest, merkle, packing, quadratic, secret_scan,
    superkmers, token_counts, token_store,
)
from quillspark.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the ids read back from token files."""
    path = fresh_path(common.prepared(spark), "tokens")
    token_store.write_tokens(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return token_store.checksums(token_store.read_tokens(spark, path))


@query
def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line-frequency verdict."""
    return line_rules.judged(common.table(spark, sf_dir, "documents")).drop("text_hash", "host")


ORACLES["op2_line_rules"] = line_rules.ORACLE


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    docs = common.table(spark, sf_dir, "documents")
    return packing.with_checksums(packing.pack(docs, public_tokenizers.path(BYTE_BPE)))


@query
def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all texts under the word base and under the piece lattice."""
    return lattice_lm.scored(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts."""
    return quadratic.scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the 32k model."""
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all texts."""
    return licences.scanned(common.table(spark, sf_dir, "documents")).drop("detections")


@query
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents and each document's links."""
    found = lsh_forest.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


ORACLES["op8_lsh_forest"] = lsh_forest.ORACLE


@query
def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all texts."""
    found = fm_index.scanned(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash", "spans")


ORACLES["op9_fm_index"] = fm_index.ORACLE


@query
def op10_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated runs of 35 words."""
    found = superkmers.removals(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op10_superkmers"] = superkmers.ORACLE


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, subroots, root and proofs of all documents, some of them tampered with."""
    return merkle.tampered(common.table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


ORACLES["op11_merkle"] = merkle.ORACLE


@query
def op12_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations after damage."""
    rows = common.prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.audited(conversations.damaged(rows), rows)


ORACLES["op12_interval_repair"] = conversations.ORACLE


@query
def op13_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all texts, with what the method adds."""
    return secret_scan.scanned(common.table(spark, sf_dir, "documents"))


ORACLES["op13_secret_owners"] = secret_scan.ORACLE
