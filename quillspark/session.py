"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on. None of them fixes a partition
# count: that stays with the cluster, and adaptive execution resizes it.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Partitions seen to be small are hashed instead of sorted in a join.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Masters whose executors run on other machines; local and local-cluster are one machine.
CLUSTERS = ("spark://", "yarn", "k8s://")

# Paths given out by ``fresh_path``, in order.
_written: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "quillspark", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", folder: str | None = None) -> SparkSession:
    """A session for tests and the bench, with its folder for written tables; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    settings = RUNTIME_SETTINGS | ({"spark.checkpoint.dir": folder} if folder else {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for work that costs far more than its input bytes show.

    A given number is not merged by adaptive execution, which looks at bytes only.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can see, named by ``spark.checkpoint.dir``.

    Only a session that runs in one process may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _refuse_own_disk(spark, folder)
    return folder.rstrip("/")


def _refuse_own_disk(spark: SparkSession, folder: str) -> None:
    """A cluster's executors don't see a temporary folder of the driver's machine.

    Only the usual places of such folders are known to be a machine's own: a ``file:`` path may be a
    mount that all machines share.
    """
    path = re.sub(r"^file:(//[^/]*)?", "", folder)
    own = {tempfile.gettempdir(), "/tmp", "/var/tmp", "/dev/shm"}
    local = "://" not in folder or folder.startswith("file:")
    inside = any(path == top or path.startswith(f"{top.rstrip('/')}/") for top in own)
    if local and inside and spark.sparkContext.master.startswith(CLUSTERS):
        raise ValueError(f"spark.checkpoint.dir is {folder}, which executors on other machines don't see")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what this process wrote to the shared folder from number ``since`` on; how much that was.

    Results that still read these tables can't be used any more.
    """
    paths = _written[since:]
    del _written[since:]
    for path in paths:
        remove(spark, path)
    return len(paths)


def _store(spark: SparkSession, path: str):
    """The store of a path, and the path in it; any store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    store, target = _store(spark, path)
    store.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder, if it is not there."""
    store, target = _store(spark, path)
    store.mkdirs(target)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used for count tables that several later joins read. The written table
    outlives lost executors, cuts the lineage, and gives the planner true sizes,
    so that it broadcasts the table only while it is small.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
