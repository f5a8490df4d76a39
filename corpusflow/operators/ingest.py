"""Identity of pages and the incremental core: what changed since the last manifest.

Manifest rows: document_id, canonical_url, title, content_hash, file_name, retrieved_at.
Documents with a null id or hash are classified as New; an empty manifest makes all New.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_identity(
    pages: DataFrame, url: str = "url", content: str = "html", optional: dict[str, Column] | None = None
) -> DataFrame:
    """Adds document_id and content_hash (lower-case hex SHA-256 of URL and content) and a
    metadata map; optional entries appear only where they aren't null."""
    fixed = [F.lit("source"), F.col(url), F.lit("contentType"), F.lit("text/html")]
    entries = [x for k, v in (optional or {}).items() for x in (F.lit(k), v.cast("string"))]
    metadata = F.map_filter(F.create_map(*fixed, *entries), lambda k, v: v.isNotNull())
    return pages.withColumns(
        {
            "document_id": F.sha2(F.col(url), 256), "content_hash": F.sha2(F.col(content), 256),
            "canonical_url": F.col(url), "metadata": metadata
        }
    )


def classify_changes(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with `change`: New, Updated or Unchanged, hashes compared in any case."""
    old = manifest.select("document_id", F.lower("content_hash").alias("__old"), F.lit(True).alias("__known"))
    change = F.when(F.col("__known").isNull(), "New").when(
        F.col("__old") == F.lower("content_hash"), "Unchanged"
    ).otherwise("Updated")
    return incoming.join(old, "document_id", "left").withColumn("change", change).drop("__old", "__known")


def last_arrival(incoming: DataFrame, order: str) -> DataFrame:
    """One row an id: the last by `order`; equal ones by the larger hash."""
    window = Window.partitionBy("document_id").orderBy(F.desc(order), F.desc("content_hash"))
    return incoming.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def merge_manifest(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next manifest: entries of incoming replace or join the old ones, also where the
    content is unchanged; the file name stays once given. incoming has one row an id."""
    names = ["canonical_url", "title", "content_hash", "retrieved_at"]
    new = incoming.select("document_id", *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__in"))
    merged = manifest.join(new, "document_id", "full")
    fresh = {c: F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)) for c in names}
    fresh["file_name"] = F.coalesce("file_name", F.concat("document_id", F.lit(".html")))
    return merged.withColumns(fresh).select("document_id", *names, "file_name")


def changed_content(changes: DataFrame) -> DataFrame:
    """Rows whose content must be written again."""
    return changes.where(F.col("change").isin("New", "Updated"))


def ingest_summary(changes: DataFrame) -> DataFrame:
    """One row: retrieved, new, updated and unchanged; an error if nothing was retrieved."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    sums = changes.agg(
        F.count(F.lit(1)).alias("n"), count("New").alias("new"), count("Updated").alias("updated"),
        count("Unchanged").alias("unchanged")
    )
    retrieved = F.when(F.col("n") > 0, F.col("n")).otherwise(
        F.raise_error(F.lit("no documents were retrieved")).cast("long")
    )
    return sums.select(retrieved.alias("retrieved"), "new", "updated", "unchanged")


def missing_content(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """Manifest entries without content."""
    return manifest.join(
        raw.where("content is not null").select("document_id").hint("merge"), "document_id", "left_anti"
    )


def exact_duplicates(docs: DataFrame, key: str, content_hash: Column) -> DataFrame:
    """key, keeper (the least key with the same content), n_copies and is_duplicate of every row.

    Copies find their keeper by a join with one row a content, not within a window per content:
    a content that a third of all rows share stays spread over its keys."""
    hashed = docs.select(key, content_hash.alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("n_copies"))
    return hashed.join(groups.hint("merge"), "content_hash").select(
        key, "keeper", "n_copies", (F.col(key) != F.col("keeper")).alias("is_duplicate")
    )
