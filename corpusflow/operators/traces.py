"""Model-run comparison and trace roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fan_out_models(evidence: DataFrame, gated: DataFrame, models: list[str]) -> DataFrame:
    """The same evidence once for each model (a short list, exploded); refusals get none."""
    open_questions = gated.where("status = 'Eligible'").select("question_id")
    return evidence.join(
        open_questions.hint("merge"), "question_id", "left_semi"
    ).withColumn("model", F.explode(F.array(*map(F.lit, models))))


def model_outcomes(runs: DataFrame) -> DataFrame:
    """runs (run_id, model, status, seconds) with a status for failed ones and no negative time."""
    return runs.select(
        "run_id", "model", F.coalesce("status", F.lit("Failed")).alias("status"),
        F.greatest(F.lit(0.0), F.coalesce("seconds", F.lit(0.0))).alias("seconds")
    )


def faster_model(outcomes: DataFrame) -> DataFrame:
    """run_id, faster and ratio (slower / faster time) of runs with exactly two successes; the
    ratio is null if a time is 0. Equal times go to the first model by name."""
    good = outcomes.where("status = 'Answered'")
    sums = good.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seconds", "model")).alias("best"), F.max("seconds").alias("worst")
    )
    ratio = F.when(F.col("best.seconds") > 0, F.round(F.try_divide("worst", F.col("best.seconds")), 6))
    return sums.where("n = 2").select("run_id", F.col("best.model").alias("faster"), ratio.alias("ratio"))


def trace_rollup(results: DataFrame) -> DataFrame:
    """Per trace and stage: rows, distinct sources, best and worst similarity; no content."""
    return results.groupBy("trace_id", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.max("similarity").alias("best"),
        F.min("similarity").alias("worst")
    )


def similarity_by_rank(results: DataFrame, most: int = 20) -> DataFrame:
    """trace_id, stage, position (from 1) and similarity of each stage's `most` best results; equal
    ones by source. The cap is the report's own."""
    best = Window.partitionBy("trace_id", "stage").orderBy(F.desc("similarity"), "source")
    ranked = results.select(
        "trace_id", "stage", "source", "similarity"
    ).withColumn("position", F.row_number().over(best))
    return ranked.where(F.col("position") <= most).select("trace_id", "stage", "position", "similarity")


def stage_counts(results: DataFrame, stages: list[str]) -> DataFrame:
    """One row a trace: how many results each of the named stages had (candidates, results, evidence,
    citations), and in all."""
    counts = [F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in stages]
    return results.groupBy("trace_id").agg(*counts, F.count(F.lit(1)).alias("n"))


def sample_traces(traces: DataFrame, rate: float, parts: int = 10_000) -> DataFrame:
    """The traces whose id hashes below the rate: the same ids on every run."""
    bucket = F.conv(F.substring(F.md5(F.col("trace_id").cast("string")), 1, 8), 16, 10).cast("long") % parts
    return traces.where(bucket < F.lit(int(rate * parts)))


def latest_run(runs: DataFrame) -> DataFrame:
    """The last completed measurement of each run."""
    return runs.groupBy("run_id").agg(
        F.max_by(F.struct("model", "seconds", "status"), F.struct("completed_at", "event_id")).alias("r"),
        F.max("completed_at").alias("completed_at")
    ).select("run_id", "r.*", "completed_at")


def stage_durations(spans: DataFrame) -> DataFrame:
    """Spans (stage, status, started, duration) by stage and day: n, n_failed (status other than ok),
    total, least and longest duration, and a mergeable KLL sketch of the durations. Rows without a
    duration count, but are in no sum or sketch; a null status counts as failed."""
    took = F.col("duration").cast("double")
    return spans.groupBy("stage", F.to_date("started").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("status") == "ok", F.lit(False))).alias("n_failed"),
        F.sum(took).alias("total"), F.min(took).alias("least"), F.max(took).alias("longest"),
        F.kll_sketch_agg_double(took).alias("sketch")
    )


def duration_quantiles(daily: DataFrame, keys: list[str]) -> DataFrame:
    """stage_durations summed up by keys (any of stage and day) without going back to the spans: n,
    n_failed, total, least, longest, and p50 and p95 from the merged sketches, whose ranks are off by
    under 2 % of n (for the sketches' usual size; exact for small groups)."""
    at = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(q))
    merged = daily.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("n", "n_failed", "total")), F.min("least").alias("least"),
        F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch").alias("s")
    )
    known = F.kll_sketch_get_n_double("s") > 0
    return merged.withColumns({"p50": F.when(known, at(0.5)), "p95": F.when(known, at(0.95))}).drop("s")
