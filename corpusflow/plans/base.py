"""Registration of queries, and the tables that they derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with DuckDB SQL for the same rows if there is any."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with identity: document_id, canonical_url, content_hash, content, title."""
    from corpusflow.operators.ingest import document_identity

    pages = document_identity(table(spark, sf_dir, "pages"))
    return pages.select(
        "document_id", "canonical_url", "content_hash", F.col("html").alias("content"),
        F.lit("new title").alias("title"), F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("retrieved_at")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier manifest: pages over https, of which those with a query had other content."""
    pages = raw_pages(spark, sf_dir).where(F.col("canonical_url").startswith("https://"))
    old = F.when(
        F.col("canonical_url").contains("?"), F.sha2(F.concat(F.lit("old"), "content"), 256)
    ).otherwise(F.upper("content_hash"))
    return pages.select(
        "document_id", "canonical_url", F.lit("old title").alias("title"), old.alias("content_hash"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("retrieved_at"),
        F.concat(F.lit("f-"), "document_id").alias("file_name")
    )


RAW = "raw AS (SELECT page_id, url AS canonical_url, html AS content, sha256(url) AS document_id, sha256(html) AS content_hash FROM pages)"
MANIFEST = f"{RAW}, manifest AS (SELECT document_id, canonical_url, 'old title' AS title, CASE WHEN canonical_url LIKE '%?%' THEN sha256('old' || content) ELSE upper(content_hash) END AS content_hash, 'f-' || document_id AS file_name FROM raw WHERE canonical_url LIKE 'https://%')"


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as processed ones: document_id, title, version, canonical_url, content, hash."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    url = F.concat(
        F.lit("https://corpus.example/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")
    )
    return docs.select(
        name.alias("document_id"), F.col("source").alias("title"), F.lit("1").alias("version"),
        url.alias("canonical_url"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash")
    )


TOKENS = r"regexp_extract_all(text, '[^\s\x{00A0}\x{0085}\p{Z}]+')"
DOCS = f"docs AS (SELECT 'doc-' || doc_id AS document_id, source AS title, 'https://corpus.example/' || source || '/' || doc_id || '.html' AS canonical_url, text AS content, sha256(text) AS content_hash, {TOKENS} AS w FROM documents)"


def fixed_sql(size: int, stride: int, stop: str) -> str:
    """Window chunks as a CTE chain that ends in `chunks`."""
    return f"""{DOCS}, starts AS (
  SELECT document_id, w, canonical_url, title, content_hash, unnest(range(0, {stop} + 1, {stride})) AS off FROM docs WHERE len(w) > 0
), chunks AS (
  SELECT document_id, canonical_url, title, content_hash, (off // {stride})::INTEGER AS ordinal, array_to_string(w[off + 1 : off + {size}], ' ') AS content, least({size}, len(w) - off)::INTEGER AS approximate_token_count FROM starts
)"""
