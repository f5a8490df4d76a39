"""The vector index: profiles, documents, chunks and embeddings, maintained batch by batch.

The tables are bucketed by their keys, and a batch adds its changes (see sources.snapshots for how a
version is published at once): it writes in proportion to its own rows, and where it looks known
rows up by their key, the index isn't moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.integrity import check_unique
from corpusflow.sources import snapshots
from corpusflow.sources.scratch import materialize

TABLES = ("profiles", "documents", "chunks", "embeddings")
#: Keys of the tables, which a batch must not repeat or leave null.
KEYS = {
    "profiles": ["profile_key"], "documents": ["document_id"], "chunks": ["chunk_id"],
    "embeddings": ["chunk_id", "profile_key"]
}


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming rows replace existing ones of the same keys; all other rows stay. Keys must be
    distinct and not null, as apply_index_batch checks."""
    return existing.join(incoming.select(*keys).hint("merge"), keys, "left_anti").unionByName(incoming)


def upsert_profiles(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["profile_key"])


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By document_id. created_at of a known document stays; updated_at is the batch's."""
    old = existing.select("document_id", F.col("created_at").alias("__created"))
    stamped = incoming.join(old.hint("merge"), "document_id", "left").withColumn(
        "created_at", F.coalesce("__created", "updated_at")
    ).drop("__created")
    return upsert(existing, stamped.select(*existing.columns), ["document_id"])


def delete_stale_chunks(existing: DataFrame, batch_documents: DataFrame, current: DataFrame) -> DataFrame:
    """existing without those chunks of the batch's documents that aren't current."""
    stale = existing.join(
        batch_documents.select("document_id").hint("merge"), "document_id", "left_semi"
    ).join(current.select("chunk_id").hint("merge"), "chunk_id", "left_anti")
    return existing.join(stale.select("chunk_id").hint("merge"), "chunk_id", "left_anti")


def upsert_chunks(existing: DataFrame, batch_documents: DataFrame, current: DataFrame) -> DataFrame:
    return upsert(delete_stale_chunks(existing, batch_documents, current), current, ["chunk_id"])


def cascade_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings of any profile whose chunk still exists."""
    return embeddings.join(chunks.select("chunk_id").hint("merge"), "chunk_id", "left_semi")


def upsert_embeddings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["chunk_id", "profile_key"])


def next_snapshot(old: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a batch; documents that it doesn't hold stay untouched."""
    chunks = upsert_chunks(old["chunks"], batch["documents"], batch["chunks"])
    return {
        "profiles": upsert_profiles(old["profiles"], batch["profiles"]),
        "documents": upsert_documents(old["documents"], batch["documents"]),
        "chunks": chunks,
        "embeddings": upsert_embeddings(cascade_embeddings(old["embeddings"], chunks), batch["embeddings"]),
    }


def read_snapshot(spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables as last published."""
    found = snapshots.pointer(spark, root)
    return {t: snapshots.read(spark, found.get(t, []), KEYS[t], (schemas or {}).get(t)) for t in TABLES}


def publish_snapshot(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], version: int,
    bucket_bytes: int = snapshots.BUCKET_BYTES
) -> None:
    """Publishes whole tables as a version: bases with a bucket for each bucket_bytes."""
    parts = {t: [snapshots.write_base(tables[t], root, t, KEYS[t], bucket_bytes)] for t in TABLES}
    snapshots.publish(spark, root, version, parts)


def apply_index_batch(
    spark: SparkSession, root: str, batch: dict[str, DataFrame], violations: list[DataFrame], version: int
) -> None:
    """Publishes the version after a batch, which adds folders of changes: the batch's rows, and the
    keys of its documents' chunks that aren't current, with their embeddings. With any violation, or
    a key that repeats or is null, nothing is published."""
    rows = [check_unique(batch[t], keys, f"repeated_{t}") for t, keys in KEYS.items()]
    rows += [
        batch[t].where(" or ".join(f"{k} is null" for k in keys)).select(
            F.lit(f"null_{t}").alias("rule"), F.lit(None).cast("string").alias("key"),
            F.lit(None).cast("string").alias("detail")
        ) for t,
        keys in KEYS.items()
    ]
    first = reduce(DataFrame.unionByName, [*violations, *rows]).limit(1).collect()
    if first:
        raise ValueError(f"batch rejected: {first[0].rule} {first[0].key}")
    found = snapshots.pointer(spark, root)
    if not found:
        return publish_snapshot(spark, root, batch, version)
    known = lambda t, some, by: snapshots.known(spark, found[t], KEYS[t], some, by)
    documents = batch["documents"]
    old = known("documents", documents, ["document_id"]).select("document_id", F.col("created_at").alias("__created"))
    stamped = documents.join(old.hint("merge"), "document_id", "left").withColumn(
        "created_at", F.coalesce("__created", "updated_at")
    ).select(*documents.columns)
    stale = known("chunks", documents, ["document_id"]).select("chunk_id").join(
        batch["chunks"].select("chunk_id").hint("merge"), "chunk_id", "left_anti"
    )
    stale = materialize(stale, "stale-chunks")
    lost = known("embeddings", stale, ["chunk_id"]).select(*KEYS["embeddings"]).join(
        batch["embeddings"].select(*KEYS["embeddings"]).hint("merge"), KEYS["embeddings"], "left_anti"
    )
    made = {
        "profiles": snapshots.write_changes(batch["profiles"], root, "profiles"),
        "documents": snapshots.write_changes(stamped, root, "documents"),
        "chunks": snapshots.write_changes(batch["chunks"], root, "chunks", stale),
        "embeddings": snapshots.write_changes(batch["embeddings"], root, "embeddings", lost),
    }
    snapshots.publish(spark, root, version, {t: [*found[t], made[t]] for t in TABLES})


def compact_index(spark: SparkSession, root: str, version: int) -> None:
    """A version with the same rows and no changes beside the bases."""
    snapshots.compact(spark, root, version, KEYS)
