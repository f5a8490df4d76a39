"""Bounds the batches in which Spark hands rows to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark's setting for the bytes of such a batch; by itself only rows and far larger sizes bound one.
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What functions over texts work on at a time is smaller.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of the session hold BATCH_BYTES at most, or one row, unless the session sets another
    bound. An executor holds a batch several times for each core: while its buffers grow, as what
    is sent, and in Python."""
    if spark.conf.get(SETTING, None) is None:
        spark.conf.set(SETTING, str(BATCH_BYTES))
