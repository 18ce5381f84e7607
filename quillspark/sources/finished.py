"""Finished rows of a run, in batches that can be written again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.session import configure, make_folder, remove

COMMITS = "batch bigint, n_rows bigint"


@dataclass
class FinishedRows:
    """A table of finished rows by batch number, laid out by key for the resume join.

    * A batch is a partition and is replaced as a whole when it is written again: running it twice
      leaves its rows once.
    * A batch counts when its commit is written, after its rows. Readers skip rows of a
      batch without one, which a run that died has left, and the next run of that batch replaces them.
    * Rows of a batch lie in ``buckets`` files by a hash of the keys, the same in every batch. ``pending``
      so moves the rows that are to be checked and none of the finished ones.

    ``path`` is a folder that all executors see. The table is declared in the session's
    catalog under ``name`` when it is first used; another session finds the rows by the path.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str]
    buckets: int = 64
    name: str = ""
    _declared: bool = field(default=False, repr=False)

    def __post_init__(self):
        configure(self.spark)
        unknown = [k for k in self.keys if k not in self.schema.names]
        if unknown or not self.keys or "batch" in self.schema.names:
            raise ValueError(f"keys {list(self.keys)} must be columns of the rows, and batch must not")
        self.name = self.name or "finished_" + "".join(c if c.isalnum() else "_" for c in self.path)

    def _table(self) -> str:
        """The declared table, with the partitions that are there now."""
        if not self._declared:
            make_folder(self.spark, f"{self.path}/rows")
            columns = StructType([*self.schema.fields, StructField("batch", LongType())])
            listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS `{self.name}` ({listed}) USING parquet PARTITIONED BY (batch) "
                f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
            self._declared = True
            self._refresh()
        return self.name

    def _refresh(self) -> None:
        """The catalog finds the partitions that are in the folder now."""
        self.spark.sql(f"ALTER TABLE `{self.name}` RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(f"`{self.name}`")

    def write(self, rows: DataFrame, batch: int, required: Sequence[str] = ()) -> int:
        """Write or replace a batch; rows that lack a key or a required value failed and stay pending. How many were written."""
        done = rows.dropna(subset=[*self.keys, *required]).select(*self.schema.names)
        table = self._table()
        # From here to the end the batch doesn't count.
        self._commit(batch, None)
        remove(self.spark, f"{self.path}/rows/batch={batch}")
        # Rows go to their bucket's task first, so a batch has at most one file per bucket.
        dealt = done.withColumn("batch", F.lit(batch).cast("bigint")).repartition(self.buckets, *self.keys)
        dealt.write.mode("append").insertInto(table)
        self._refresh()
        count = self.spark.table(table).where(F.col("batch") == batch).count()
        self._commit(batch, count)
        return count

    def _commit(self, batch: int, n_rows: int | None) -> None:
        """Replace a batch's commit: one small file in a folder of the batch; without a count it is open."""
        row = self.spark.createDataFrame([(batch, n_rows)], COMMITS).coalesce(1)
        row.write.mode("overwrite").json(f"{self.path}/commits/{batch}")

    def committed(self) -> DataFrame:
        """``batch, n_rows`` of the batches that count; one row per batch."""
        try:
            # Folders are named one by one, so a commit that is just being replaced hides no other.
            found = self.spark.read.schema(COMMITS).json(f"{self.path}/commits/*")
        except Exception as error:  # no batch has been written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], COMMITS)
        return found.filter(F.col("n_rows").isNotNull())

    def read(self) -> DataFrame:
        """The rows of all batches that count, with ``batch``.

        Batch numbers, one per run, become a filter on the partitions.
        """
        batches = [r["batch"] for r in self.committed().select("batch").collect()]
        return self.spark.table(self._table()).filter(F.col("batch").isin(batches) if batches else F.lit(False))

    def pending(self, todo: DataFrame) -> DataFrame:
        """Rows whose keys are in no batch that counts. Finished rows are read bucket by bucket and not shuffled."""
        done = self.read().select(*self.keys).hint("merge")
        return todo.join(done, list(self.keys), "left_anti")
