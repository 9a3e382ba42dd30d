"""Scores of runs, their comparison, tiers of tasks and health of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JUDGE_CLASSES

TASK = ["scenario", "task_id"]


def preferred_verdicts(verdicts: DataFrame, modes: tuple[str, ...] = ("code", "sql")) -> DataFrame:
    """One verdict for each run of a task: of the modes given, the first that is there."""
    rank = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    first = F.row_number().over(Window.partitionBy("run", *TASK).orderBy(rank))
    return verdicts.where(rank > 0).withColumn("_no", first).where("_no = 1").drop("_no")


def run_scores(verdicts: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Verified rows, complete ones and score of each run; seconds for 100 verified tasks where elapsed is known.

    bad: files that could not be read (run, file): their number by run comes along, also of runs with no other file, whose
    score is 0.
    """
    total, done = F.count("*"), F.count_if(F.col("reward_type") == "complete")
    extra = [(F.max("elapsed_seconds") / total * 100).alias("seconds_per_100")] if "elapsed_seconds" in verdicts.columns else []
    got = verdicts.groupBy("run").agg(total.alias("total"), done.alias("complete"), F.when(total > 0, done / total).otherwise(0.0).alias("score"), *extra)
    if bad is None:
        return got
    rows = got.join(bad.groupBy("run").agg(F.count("*").alias("bad_files")), "run", "full")
    return rows.fillna(0, ["total", "complete", "bad_files"]).fillna(0.0, ["score"])


def reward_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("run", F.coalesce("reward_type", F.lit("unknown")).alias("reward_type")).agg(F.count("*").alias("n"))


def progress(verdicts: DataFrame, planned: DataFrame) -> DataFrame:
    """Verified, complete and score by (run, mode) and over the modes of a run (mode null), with what is pending, how
    many were judged, and how with each class; the share with an injected skill, where `skill_injected` is known."""
    n, done = F.count("*"), F.count_if(F.coalesce("judge_class", "reward_type") == "complete")
    classes = [F.count_if(F.col("judge_class") == c).alias(f"judge_{c}") for c in JUDGE_CLASSES]
    skill = [F.avg(F.col("skill_injected").cast("double")).alias("skill_injected_rate")] if "skill_injected" in verdicts.columns else []
    got = verdicts.groupingSets([["run", "mode"], ["run"]], "run", "mode").agg(n.alias("verified"), done.alias("complete"), (done / n).alias("score"), F.count("judge_class").alias("judged"), *classes, *skill)
    return got.join(planned, "run", "left").withColumn("pending", F.col("planned") - F.col("verified"))


def changed_rewards(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.select(*TASK, F.col("reward_type").alias("before"))
    return a.join(after.select(*TASK, F.col("reward_type").alias("after")), TASK).where("before <> after")


def mixed_outcomes(verdicts: DataFrame) -> DataFrame:
    """Tasks that were complete at least once and others at least once."""
    return verdicts.groupBy(*TASK).agg(F.count_if(F.col("reward_type") == "complete").alias("n_complete"), F.count_if(F.col("reward_type") == "others").alias("n_others")).where("n_complete > 0 and n_others > 0")


def overlay(allow: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A stronger run's verdicts on an allowlist: counts, missing ones, score over all and over verified rows."""
    rows = allow.select(*TASK).distinct().join(verdicts.select(*TASK, "reward_type"), TASK, "left")
    n, seen, done = F.count("*"), F.count("reward_type"), F.count_if(F.col("reward_type") == "complete")
    return rows.agg(n.alias("n"), seen.alias("verified"), (n - seen).alias("missing"), done.alias("complete"), (done / n).alias("score_all"), (done / seen).alias("score_verified"))


def tiers(complete: DataFrame, review: DataFrame, missing: DataFrame, rejected: DataFrame) -> DataFrame:
    """The union of three tiers without what is rejected; a task is in the first tier that has it."""
    rows = complete.select(*TASK, F.lit(1).alias("tier")).union(review.select(*TASK, F.lit(2))).union(missing.select(*TASK, F.lit(3)))
    return rows.groupBy(*TASK).agg(F.min("tier").alias("tier")).join(rejected.select(*TASK).distinct(), TASK, "left_anti")


def tier_counts(tiered: DataFrame) -> DataFrame:
    return tiered.rollup("tier").agg(F.count("*").alias("n"))


def protocol_totals(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy("run").agg(F.sum("list_tools_calls").alias("list_tools"), F.sum("tool_help_calls").alias("tool_help"), F.sum("reminders").alias("reminders"), F.sum(F.size("unhelped")).alias("unhelped"))


def training_health(rows: DataFrame) -> DataFrame:
    """Rates by run of rows with reward_type, judge_class, format_error, hallucinated, invalid_json and length, and blocked (by a
    fault of the environment) where it is known."""
    rate = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    r = F.col("reward_type")
    blocked = [rate(F.col("blocked")).alias("blocked_rate")] if "blocked" in rows.columns else []
    return rows.groupBy("run").agg(
        rate(F.col("format_error")).alias("format_error_rate"), rate(r == "server_error").alias("environment_error_rate"), rate(r == "complete").alias("completed_rate"),
        rate(r == "incomplete").alias("partial_rate"), rate(r == "agent_error").alias("agent_error_rate"), rate(F.col("hallucinated")).alias("hallucination_rate"),
        rate(F.col("invalid_json")).alias("invalid_json_rate"), F.avg("length").alias("mean_length"), rate(F.col("judge_class").isNotNull() & (F.col("judge_class") != r)).alias("disagreement_rate"), *blocked,
    )
