"""Retrieval and answer metrics over tables of ranked results.

questions: question_id, position, category, expected_status, expected_urls; ranked: question_id,
rank, url. Only questions expected to be answered have metrics, others have null.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (3, 5, 10, 20)


def per_question(questions: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """question_id, reciprocal_rank and for each k hit, coverage, all_hit and precision, from
    one group-by. Repeated URLs keep their ranks but count once for coverage."""
    answered = questions.where(F.col("expected_status") == "Answered")
    expected = answered.select("question_id", F.array_distinct("expected_urls").alias("expected"))
    rows = expected.join(ranked.hint("merge"), "question_id", "left").withColumn(
        "hit", F.coalesce(F.array_contains("expected", F.col("url")), F.lit(False))
    )
    found = [F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.max(F.size("expected")).alias("n")]
    for k in ks:
        inside = F.col("rank") <= k
        found += [
            F.countDistinct(F.when(F.col("hit") & inside, F.col("url"))).alias(f"c{k}"),
            F.avg(F.when(inside, F.col("hit").cast("int"))).alias(f"p{k}")
        ]
    sums = rows.groupBy("question_id").agg(*found)
    out = sums.select(
        "question_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        *(c for k in ks for c in (
            F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_{k}"), F.round(
                F.try_divide(F.col(f"c{k}"), F.col("n")), 6
            ).alias(f"coverage_{k}"),
            F.when(F.col(f"c{k}") == F.col("n"), 1.0).otherwise(0.0).alias(f"all_hit_{k}"), F.round(F.coalesce(f"p{k}", F.lit(0.0)), 6).alias(f"precision_{k}"))),
    )
    return questions.select("question_id").join(out.hint("merge"), "question_id", "left")


def summarize(metrics: DataFrame) -> DataFrame:
    """One row: questions, answered, and the mean of every metric; null if none is answered."""
    names = [c for c in metrics.columns if c != "question_id"]
    return metrics.agg(
        F.count(F.lit(1)).alias("questions"), F.count("reciprocal_rank").alias("answered"),
        *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names)
    )


def metrics_by_k(
    metrics: DataFrame, names: tuple[str, ...] = ("hit", "coverage", "all_hit", "precision"), ks: tuple[int, ...] = KS
) -> DataFrame:
    """k, and the mean of each metric at k: the sweep over K from one retrieval."""
    rows = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}_{k}").alias(n) for n in names)) for k in ks))
    return metrics.select(F.inline(rows)).groupBy("k").agg(*(F.round(F.avg(n), 6).alias(f"mean_{n}") for n in names))


def status_match_rate(results: DataFrame) -> DataFrame:
    """One row: the share of rows whose status is the expected one; null without rows."""
    return results.agg(
        F.round(F.avg((F.col("status") == F.col("expected_status")).cast("int")), 6).alias("status_match_rate")
    )


def ask_report(results: DataFrame) -> DataFrame:
    """category, count, matched, rate, and the position where the category is first seen."""
    match = (F.col("status") == F.col("expected_status")).cast("int")
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(match).alias("matched"), F.round(F.avg(match), 6).alias("rate"),
        F.min("position").alias("first_position")
    )


def fingerprint(questions: DataFrame) -> DataFrame:
    """One row: a hash of all ids in order, order-sensitive through their positions, taken as
    sums of row hashes so that no list of ids is gathered."""
    row = F.sha2(F.concat_ws("\n", F.col("position").cast("string"), "question_id"), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("long")).cast("string")
    return questions.agg(
        F.sha2(
            F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(1), part(9), part(17), part(25)), 256
        ).alias("fingerprint")
    )


def checkpoint_identity(questions: DataFrame, config: dict, output: str) -> str:
    """A hash of what a run depends on: the ids in order, the configuration and the output's path."""
    settings = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    return hashlib.sha256("|".join([fingerprint(questions).first().fingerprint, settings, output]).encode()).hexdigest()


def resume_remaining(
    questions: DataFrame, done: DataFrame, saved: str | None = None, config: dict | None = None, output: str = ""
) -> DataFrame:
    """Questions after the completed ones, which must be a prefix of known questions. saved: the
    identity that the completed run was started with; if it isn't today's, nothing is resumed."""
    if saved is not None and saved != checkpoint_identity(questions, config or {}, output):
        raise ValueError("the questions, the configuration or the output path aren't those of the saved run")
    state = done.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("position") + 1, F.lit(0)).alias("stop")).first()
    strangers = done.join(questions.hint("merge"), ["question_id", "position"], "left_anti").limit(1).count()
    if state.n != state.stop or strangers:
        raise ValueError("completed questions aren't a prefix of the question set")
    return questions.join(done.select("question_id").hint("merge"), "question_id", "left_anti")


def append_completed(done: DataFrame, batch: DataFrame) -> DataFrame:
    """done and batch as one table, if they still are a prefix."""
    merged = done.unionByName(batch)
    state = merged.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"),
        F.coalesce(F.max("position") + 1, F.lit(0)).alias("stop")
    ).first()
    if not state.n == state.d == state.stop:
        raise ValueError("completed questions aren't a prefix of the question set")
    return merged


def compare_runs(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """question_id and b - a of each metric, for questions of either run."""
    right = b.select("question_id", *(F.col(n).alias(f"__{n}") for n in names))
    return a.select("question_id", *names).join(right.hint("merge"), "question_id", "full").select(
        "question_id", *(F.round(F.col(f"__{n}") - F.col(n), 6).alias(f"delta_{n}") for n in names)
    )
