"""Incremental ingest and de-duplication of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusflow.operators.ingest import classify_changes, last_arrival, merge_manifest
from corpusflow.sources import snapshots
from corpusflow.sources.scratch import materialize

MANIFEST = "document_id string, canonical_url string, title string, content_hash string, retrieved_at timestamp, file_name string"


KEY = ["document_id"]


def read_manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The manifest after the last batch (or the last before a given one); empty at first."""
    return snapshots.read(spark, snapshots.pointer(spark, root, before).get("manifest", []), KEY, MANIFEST)


def ingest_batch(incoming: DataFrame, batch: int, root: str) -> None:
    """Writes the changes of one batch, and its documents' rows of the manifest beside the rows that
    are there. A replayed batch overwrites itself; its pointer is the last write."""
    spark = incoming.sparkSession
    latest = materialize(last_arrival(incoming, "retrieved_at"), "stream-batch")
    held = snapshots.pointer(spark, root, batch).get("manifest", [])
    manifest = materialize(snapshots.known(spark, held, KEY, latest, KEY, MANIFEST), "stream-known")
    classify_changes(manifest, latest).select("document_id", "change").write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
    after = merge_manifest(manifest, latest)
    made = snapshots.write_changes(after, root, "manifest") if held else snapshots.write_base(after, root, "manifest", KEY)
    snapshots.publish(spark, root, batch, {"manifest": [*held, made]})


def compact_manifest(spark: SparkSession, root: str, batch: int) -> None:
    """The same manifest as one base, published as a batch of its own, between two runs."""
    snapshots.compact(spark, root, batch, {"manifest": KEY})


def stream_ingest_changes(pages: DataFrame, root: str, checkpoint: str, first_batch: int = 0) -> StreamingQuery:
    """Classifies and merges each micro-batch of pages (MANIFEST's columns but file_name).
    first_batch: number of this stream's first batch, where another stream came before."""
    writer = pages.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch + first_batch, root))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Drops repeats of a key that come within the delay; state older than it is dropped. A
    time without zone is taken as the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """A stream of Parquet files, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
