"""Paired evaluation: every task runs once in each mode; a family counts once however many tasks it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("compactions", "compaction_attempts", "compaction_failures", "model_invocations", "model_responses", "model_errors", "context_overflows", "attempt_errors", "input_tokens")


def problems(rows: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """(task_id, reason) for tasks that break the pairing, and (null, reason) for what concerns the whole; empty if sound."""
    bad_counter = F.lit(False)
    for c in COUNTERS:
        bad_counter = bad_counter | F.coalesce(F.col(c) < 0, F.lit(True))
    tasks = rows.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("mode").alias("modes"),
        F.sum(F.coalesce(F.col("mode").isin(*modes), F.lit(False)).cast("int")).alias("known"),
        F.count_distinct(F.coalesce("family", F.lit(""))).alias("families"),
        F.max((F.col("task_success").isNull() | F.col("protocol_valid").isNull() | bad_counter).cast("int")).alias("bad"),
        F.sum(F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)).cast("int")).alias("allowed"),
    )
    reason = (
        F.when(F.col("known") < F.col("n"), "unknown mode")
        .when(F.col("n") > F.col("modes"), "repeated mode")
        .when(F.col("modes") < len(modes), "missing mode")
        .when(F.col("families") > 1, "family changes")
        .when(F.col("bad") > 0, "bad value")
        .when(F.col("allowed") < F.col("n"), "training case")
    )
    each = tasks.select(F.col("task_id").cast("string").alias("task_id"), reason.alias("reason"))
    whole = rows.agg(F.count_distinct("split").alias("s"), F.count_distinct("checkpoint").alias("c"), F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("n") == 0, "no rows").when(F.col("s") != 1, "more than one split").when(F.col("c") != 1, "more than one checkpoint")
    return each.union(whole.select(F.lit(None).cast("string").alias("task_id"), said.alias("reason"))).where("reason is not null")


def by_mode(rows: DataFrame) -> DataFrame:
    """One row for each mode: counts, rates over all its tasks, means, and the mean of its families' success rates."""

    def some(c: str) -> Column:
        return F.sum((F.col(c) > 0).cast("long"))

    success, valid = F.col("task_success").cast("long"), F.col("protocol_valid").cast("long")
    parts = rows.groupBy("mode", "family").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum(success).alias("successes"),
        F.sum(valid).alias("valid"),
        *[some(c).alias(f"some_{c}") for c in COUNTERS[:-1]],
        *[F.sum(c).alias(f"sum_{c}") for c in COUNTERS],
        F.min((F.col("execution") == "verified_environment").cast("int")).alias("verified"),
    )
    n = F.sum("tasks")
    return parts.groupBy("mode").agg(
        n.alias("tasks"),
        F.sum("successes").alias("successes"),
        (n - F.sum("successes")).alias("task_failures"),
        (F.sum("successes") / n).alias("task_success"),
        F.avg(F.col("successes") / F.col("tasks")).alias("macro_family_success"),
        (F.sum("valid") / n).alias("protocol_valid"),
        (n - F.sum("valid")).alias("protocol_failures"),
        F.sum("some_compactions").alias("compaction_exercised_tasks"),
        (F.sum("some_compactions") / n).alias("compaction_exercised"),
        F.sum("some_compaction_attempts").alias("compaction_attempt_tasks"),
        F.sum("some_compaction_failures").alias("compaction_failure_tasks"),
        F.sum("some_model_invocations").alias("model_invocation_tasks"),
        (F.sum("some_model_invocations") / n).alias("model_invocation_coverage"),
        F.sum("sum_model_invocations").alias("model_invocations"),
        F.sum("sum_model_responses").alias("model_responses"),
        F.sum("some_model_errors").alias("model_error_tasks"),
        F.sum("some_context_overflows").alias("context_overflow_tasks"),
        F.sum("some_attempt_errors").alias("attempt_error_tasks"),
        (F.sum("sum_compactions") / n).alias("mean_compactions"),
        (F.sum("sum_input_tokens") / n).alias("mean_input_tokens"),
        (F.min("verified") == 1).alias("verified"),
    )


def overall(modes: DataFrame) -> DataFrame:
    """One row from `by_mode`: worst and mean of the modes' macro success, and whether every row is verified and covered."""
    return modes.agg(
        F.min("macro_family_success").alias("worst_mode_macro_success"),
        F.avg("macro_family_success").alias("mean_mode_macro_success"),
        F.min(F.col("verified") & (F.col("model_invocation_coverage") == 1)).alias("learned_model_score_verified"),
    )


def summarize(rows: DataFrame, modes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(`by_mode`, `overall`); ValueError with a first problem if the rows are not soundly paired."""
    first = problems(rows, modes).first()
    if first is not None:
        raise ValueError(f"{first.reason}: {first.task_id}")
    parts = by_mode(rows)
    return parts, overall(parts)
