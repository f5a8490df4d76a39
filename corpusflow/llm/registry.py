"""Queries of the llm operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    from corpusflow.llm import language_id

    return language_id.predict_held_out(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to seekable WARC bundles and read back."""
    from corpusflow.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with suffix sums."""
    from corpusflow.llm import token_counts

    return token_counts.length_histogram(token_counts.count_tokens(table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: 3-word n-grams, similarity of 0.9 or more."""
    from corpusflow.llm import jaccard_join

    return jaccard_join.groups(table(spark, sf_dir, "documents"), jaccard_join.Join(words=3, percent=90))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features and verdict of every document."""
    from corpusflow.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    from corpusflow.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from corpusflow.llm import html_extraction

    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learned outside the held-out fold."""
    from corpusflow.llm import lm_scoring

    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from corpusflow.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    from corpusflow.llm import decontamination

    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of every 64-component vector after ten rounds."""
    from corpusflow.llm import centroids

    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    from corpusflow.llm import lexical_search

    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    from corpusflow.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op5_quality_rules that SQL can express."""
    return op5_quality_rules(spark, sf_dir).drop("kept", "class_distance", "word_distance")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(own.items(), key=lambda kv: int(kv[0][2:].split("_")[0]))) | {
        "quality_base_columns": quality_base_columns, "pipeline": pipeline
    }


def oracle_sql() -> dict:
    return dict(sql.ORACLES)
