"""Token ids in Parquet files that can be read in part.

Every file holds the documents of one range of ids in ascending order: one row per
document, its ids as a list column. List values are dictionary coded (a vocabulary
of 50,000 ids packs into 16 bits or fewer), ids and counts delta coded; row groups and
pages are small enough that the page index of ``doc_id`` leads a reader to a few
pages. Metadata are columns of their own and are read without touching a token.

Defined cases: a null text counts as empty and gives the end id alone; a null id sorts
first; rows with one id stay rows of their own, ordered by a hash of the text; an
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.bpe import encoder
from quillspark.llm.common import arrow_rows, id_checksums, id_lists, in_order, running_start

FILE_COLUMNS = "shard int, doc_id long, shard_start long, n_tokens long, token_ids array<int>"

WRITER = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#token_ids.list.element": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, *, shards: int | None = None,
                 row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 500) -> None:
    """Encode ``docs`` (doc_id, text) into files under ``path``, in ascending order of doc_id."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        rows = arrow_rows([("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()),
                           ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
        start = 0
        for batch in batches:
            found = codec.encode_batch(batch.column("text"), end_id)
            starts = start + np.cumsum(found.counts) - found.counts
            start += int(found.counts.sum())
            yield rows(batch.column("shard"), batch.column("doc_id"), starts, found.counts, id_lists(found.ids, found.counts))

    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", shards)
    (
        ordered.mapInArrow(encoded, FILE_COLUMNS).write
        .options(**WRITER)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``shard, doc_id, n_tokens, start``: where each document stands in the whole sequence; no token is read."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path)
    return _placed(rows.drop("token_ids"), rows)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with ids from ``first`` to ``last``: the bounds reach the files' page indexes."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path)
    asked = rows
    if first is not None:
        asked = asked.where(F.col("doc_id") >= first)
    if last is not None:
        asked = asked.where(F.col("doc_id") <= last)
    return _placed(asked, rows)


def _placed(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``start``. The table of shard offsets has one row per file, so it is broadcast."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    offsets = running_start(totals, "shard", "total")
    return (
        asked.join(F.broadcast(offsets), "shard")
        .withColumn("start", F.col("before") + F.col("shard_start"))
        .drop("before", "shard_start")
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows read back."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                           ("ids_crc32", pa.int64())])
        for batch in batches:
            yield rows(batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), id_checksums(batch.column("token_ids")))

    return tokens.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(
        summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
