"""Scans and sinks of corpora, artifacts, question sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.integrity import check_artifacts, check_headers, check_manifest
from corpusflow.sources.scratch import delete_path, dropping_shuffles

ARTIFACT_COLUMNS = [
    "chunk_id", "document_id", "source_url", "document_title", "version", "processed_content_hash", "section",
    "ordinal", "approximate_token_count", "content"
]
QUESTION_FILE = "version int, questions array<struct<id:string,language:string,category:string,text:string,expectedStatus:string,requiresMultipleSources:boolean,expectedSourceUrls:array<string>,expectedFacts:array<string>>>"


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages: a Parquet table, or else one file a page."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def load_corpus(manifest: DataFrame, raw: DataFrame, strict: bool = False, version: int = 1) -> DataFrame:
    """Manifest entries with their content and `violation`: MissingContent, HashMismatch (any
    case) or null. In strict mode a manifest that breaks a rule is rejected before any content is read,
    and a violation fails the job."""
    if strict:
        _reject(check_manifest(manifest, version), "manifest")
    rows = manifest.join(raw.select("document_id", "content").hint("merge"), "document_id", "left")
    bad = F.when(F.col("content").isNull(), "MissingContent").when(
        F.lower("content_hash") != F.sha2("content", 256), "HashMismatch"
    )
    if strict:
        bad = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(" "), F.col("document_id")))).cast("string")
    return rows.withColumn("violation", bad)


def denormalise(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk rows of the artifact: each with its document's URL, title, version and hash."""
    theirs = documents.select(
        "document_id", F.col("canonical_url").alias("source_url"), F.col("title").alias("document_title"), "version",
        F.col("content_hash").alias("processed_content_hash")
    )
    return chunks.join(theirs.hint("merge"), "document_id").select(*ARTIFACT_COLUMNS)


def _reject(violations: DataFrame, what: str = "artifacts") -> None:
    with dropping_shuffles(violations.sparkSession):
        found = violations.limit(1).collect()
    if found:
        raise ValueError(f"invalid {what}: {found[0].rule} {found[0].key} {found[0].detail}")


def _denormalised_in_order(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """denormalise of chunks that all have one document, sorted by document and ordinal: texts are shuffled
    once, by ranges of documents, each of which stands before its chunks and is then left out. A chunk
    without document stays, with nulls."""
    taken = {"source_url": "canonical_url", "document_title": "title", "version": "version", "processed_content_hash": "content_hash"}
    heads = documents.select("document_id", F.struct(*(F.col(d).alias(c) for c, d in taken.items())).alias("head"))
    both = chunks.withColumn("is_chunk", F.lit(True)).unionByName(heads.withColumn("is_chunk", F.lit(False)), allowMissingColumns=True)
    in_order = Window.partitionBy("document_id").orderBy("is_chunk", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.repartitionByRange("document_id").withColumn("head", F.first("head").over(in_order)).where("is_chunk")
    return rows.select("*", "head.*").select(*ARTIFACT_COLUMNS).sortWithinPartitions("document_id", "ordinal")


def write_artifacts(documents: DataFrame, chunks: DataFrame, header: dict[str, int], root: str) -> None:
    """Documents, denormalised chunks (both sorted) and either one's header, below a new folder.
    Artifacts that break a rule of integrity don't stay: chunks are checked as written, pairing too, and
    deleted before anything else is there, where a rule is broken."""
    spark = documents.sparkSession
    values = [F.lit(v).alias(k) for k, v in header.items()]
    heads = spark.range(1).select(*values)
    _reject(check_headers(heads, heads))
    with dropping_shuffles(spark):
        _denormalised_in_order(documents, chunks).write.mode("errorifexists").parquet(f"{root}/chunks", compression="zstd")
    try:
        _reject(check_artifacts(documents, spark.read.parquet(f"{root}/chunks")))
    except BaseException:
        delete_path(spark, f"{root}/chunks")
        raise
    with dropping_shuffles(spark):
        documents.repartitionByRange("document_id").sortWithinPartitions("document_id").write.mode("errorifexists").parquet(f"{root}/documents", compression="zstd")
    for side in ("documents", "chunks"):
        heads.write.mode("errorifexists").json(f"{root}/header-{side}")


def read_artifacts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and header as written, in order of document and ordinal; artifacts that
    break a rule, or whose headers differ, are rejected."""
    documents, chunks = spark.read.parquet(f"{root}/documents"), spark.read.parquet(f"{root}/chunks")
    mine, theirs = (spark.read.json(f"{root}/header-{side}") for side in ("documents", "chunks"))
    _reject(check_headers(mine, theirs))
    _reject(check_artifacts(documents, chunks))
    return documents.orderBy("document_id"), chunks.orderBy("document_id", "ordinal"), mine


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question file: one row a question, position from 0."""
    rows = spark.read.schema(QUESTION_FILE).json(path, multiLine=True).select(
        "version", F.posexplode("questions").alias("position", "q")
    )
    q = lambda name: F.col(f"q.{name}")
    return rows.select(
        "version", q("id").alias("question_id"), "position", q("language").alias("language"), q("category").alias("category"), q("text").alias("text"), q("expectedStatus").alias("expected_status"),
        q("requiresMultipleSources").alias("requires_multiple_sources"), q("expectedSourceUrls").alias("expected_urls"), q("expectedFacts").alias("expected_facts"),
    )


def write_new_report(report: DataFrame, path: str) -> None:
    """Writes JSON lines to a path that must not exist yet."""
    report.write.mode("errorifexists").json(path)


def save_snapshot(run: DataFrame, path: str) -> None:
    """Appends a measurement; readers take the latest."""
    run.write.mode("append").parquet(path)
