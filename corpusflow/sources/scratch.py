"""Shared scratch space: tables that cut lineage and are read again by any executor."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on a single machine, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share. Without it a
    cluster has no such folder, and the job fails instead of losing tables."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return DEFAULT_DIR


_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below scratch_root(); nothing is ever written twice to one path."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this application wrote below scratch_root() and returns the number of folders.
    For when its results are stored elsewhere: DataFrames that read scratch tables fail afterwards."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store it is; none need be there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting to drop the shuffle files of an execution once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: And that for the folders which a task writes at once, so that rows needn't be sorted by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_HELD = {CLEANUP: "true", WRITERS: "4"}
_lock, _depth, _before = threading.Lock(), 0, {}


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on from the first writer's start to the last one's end, however many threads
    write; then it is what it was, as is WRITERS."""
    global _depth, _before
    with _lock:
        if not _depth:
            _before = {k: spark.conf.get(k, None) for k in _HELD}
            for k, v in _HELD.items():
                spark.conf.set(k, v)
        _depth += 1
    try:
        yield
    finally:
        with _lock:
            _depth -= 1
            if not _depth:
                for k, v in _before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str = "table", row_group: int = 0, by: str = "") -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns the table read back. Tables with
    large rows name the bytes of a row group, which else holds at least 100 rows, and which a
    task holds whole while it writes or reads. by: a column with few values, each of which gets a
    folder, for drop_part().

    The result has the file statistics of a real table, no lineage to recompute, and
    survives lost executors because its files are outside them. Nothing reads the write's
    shuffle files again, so they go when it ends and disks hold one step's at a time.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with dropping_shuffles(spark):
        writer = df.write
        if row_group:
            writer = writer.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 1)
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_part(df: DataFrame, by: str, value: str) -> None:
    """Deletes the rows with a value of materialize()'s by from disk: df reads the others only."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.endswith(f"/{by}={value}"):
            delete_path(df.sparkSession, path)
