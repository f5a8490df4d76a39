"""A training corpus in five stages: quality rules, language identification, near-duplicate
groups, benchmark decontamination and the source mix.

Each stage takes all documents that the one before it kept, as a table read back from the
shared folder. All but the last return the columns of documents; the last adds `taken`, the
words the mix takes of a document, and leaves out documents of which it takes none.

Defined results: documents with null or empty texts, or under 50 words, leave with the first stage;
rows that repeat, or differ in their id alone, are one group of copies; a null id stays, once a
text; an empty table passes all stages; other columns, whatever their names, are passed on (a
column named taken is replaced by the last stage).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontamination, jaccard_join, language_id, mixing, quality_rules
from corpusflow.sources.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified beyond the margin of rejection."""
    return language_id.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group (5-word n-grams, 0.8 or more)."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each, repeats counted. Rows are told
    apart by a number, so null and repeated ids keep each row's own `taken`."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    taken = mixing.mix(numbered, keep=("__row",)).where("taken > 0").select("__row", F.col("taken").alias("__taken"))
    found = numbered.join(materialize(taken, "mix-taken").hint("merge"), "__row")
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c != "taken"), F.col("__taken").alias("taken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: SQL can't express compression; tests hold each stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
