"""Failures over repeated runs: counters for each run of a task, then keep, review or reject."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calls import call_tool_name, has_split_arguments
from ..functions.text import error_class, is_mutating
from ..functions.vectorised import vectorised
from ..sources.tables import write_buckets

KEY = ["run", "scenario", "task_id"]
TASK = ["scenario", "task_id"]
TOP, EVIDENCE = 10, 12


@vectorised("string")
def two_digits(s: pd.Series) -> pd.Series:
    """A rate as text, rounded as Python rounds."""
    return s.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


def classified_calls(calls: DataFrame, flags: Column) -> DataFrame:
    """calls (run, scenario, task_id, iteration, call_pos, name, args, response) with tool, label and flags.

    Once a call of a step is an argument error of the agent, the later calls of that step keep that label.
    """
    tool = call_tool_name(F.col("args"))
    rows = calls.withColumn("tool", tool).withColumn("error", error_class(F.coalesce("response", F.lit("")))).withColumn("flags", flags)
    split = (F.col("name") == "call_tool") & (F.col("error") == "validation") & has_split_arguments(F.col("args"))
    seen = F.max(split).over(Window.partitionBy(*KEY, "iteration").orderBy("call_pos"))
    label = F.when(F.col("name") == "call_tool", F.when(F.coalesce(seen, F.lit(False)), "agent_argument_parse_error").otherwise(F.col("error")))
    return rows.withColumn("label", label)


def run_counters(classified: DataFrame) -> DataFrame:
    """One row for each (run, scenario, task_id): counters of calls, responses and errors, and whether
    its final step was seen, where calls tell (is_final)."""
    called, label = F.col("name") == "call_tool", F.col("label")
    full = called & label.isNull() & F.col("flags.non_empty")
    empty = called & label.isNull() & ~F.col("flags.non_empty") & F.col("flags.empty_signal")
    final = [F.coalesce(F.bool_or("is_final"), F.lit(False)).alias("final_seen")] if "is_final" in classified.columns else []
    labels = ("http_500", "timeout", "validation", "route_or_schema", "tool_error", "agent_argument_parse_error")
    return classified.groupBy(*KEY).agg(
        F.count("*").alias("tool_calls"), F.count_if(called).alias("call_tools"), F.count_if(F.col("name") == "list_tools").alias("list_tools"),
        F.count_if(called & is_mutating(F.col("tool"))).alias("mutating_calls"), F.count_if(full).alias("non_empty"), F.count_if(empty).alias("empty"),
        *[F.count_if(label == x).alias(f"n_{x}") for x in labels], *final,
    )


def error_signatures(classified: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` most frequent signatures of each run of a task (ties: the one seen first), with their counts."""
    bad = classified.where("label is not null")
    tool = F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("<unknown>"))
    sig = F.concat(tool, F.lit(":"), F.col("label"), F.lit(":"), F.substring("response", 1, 160))
    counts = bad.withColumn("signature", sig).groupBy(*KEY, "signature").agg(F.count("*").alias("n"), F.min(F.struct("iteration", "call_pos")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("n").desc(), "_first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).drop("_first")


def tools_in_error(classified: DataFrame, top: int = TOP) -> DataFrame:
    tool = F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("<unknown>")).alias("tool")
    counts = classified.where("label is not null").groupBy(*KEY, tool).agg(F.count("*").alias("n"), F.min(F.struct("iteration", "call_pos")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("n").desc(), "_first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).drop("_first")


def evidence(classified: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The first error or empty responses of each run of a task, responses cut to 500 characters."""
    kind = F.coalesce("label", F.when((F.col("name") == "call_tool") & ~F.col("flags.non_empty") & F.col("flags.empty_signal"), F.lit("empty_or_not_found")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("iteration", "call_pos"))
    rows = classified.withColumn("kind", kind).where("kind is not null").withColumn("rank", rank).where(F.col("rank") <= most)
    return rows.select(*KEY, "rank", "iteration", "tool", "kind", F.substring("response", 1, 500).alias("response"))


def repeated_errors(signatures: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """How many validation or routing signatures a key repeats, by the sums of the runs' top counts."""
    bad = F.col("signature").contains(":validation:") | F.col("signature").contains(":route_or_schema:")
    return signatures.groupBy(*keys, "signature").agg(F.sum("n").alias("n")).where(bad & (F.col("n") >= least)).groupBy(*keys).agg(F.count("*").alias("repeated"))


def run_rows(verdicts: DataFrame, counters: DataFrame) -> DataFrame:
    """Every run of a task with its reward, and zeros where it called nothing. verdicts: KEY, reward_type, and
    readable (false: the trajectory is missing or bad)."""
    rows = verdicts.join(counters, KEY, "left")
    names = [c for c in counters.columns if c not in KEY]
    return rows.fillna(0, names).fillna(False, names)


def _rate(errors: Column, calls: Column) -> Column:
    return F.when(calls > 0, errors / calls).otherwise(0.0)


def lenient_decisions(rows: DataFrame, signatures: DataFrame, rate: float = 0.30, repeats: int = 2, require_complete: bool = False) -> DataFrame:
    """(scenario, task_id, decision, reasons, error_rate) over all runs of a task; a hard reason rejects even a task
    that was completed."""
    ok = F.col("readable")
    sums = [F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c) for c in ("call_tools", "n_http_500", "n_timeout", "n_agent_argument_parse_error")]
    errors = sum(F.col(f"n_{x}") for x in ("http_500", "timeout", "validation", "route_or_schema", "tool_error"))
    runs = lambda c: F.count_if(ok & (F.col(c) > 0))
    t = rows.groupBy(*TASK).agg(F.count("*").alias("runs"), F.count_if(~ok).alias("bad"), F.coalesce(F.bool_or(F.col("reward_type") == "complete"), F.lit(False)).alias("completed"), *sums, F.sum(F.when(ok, errors).otherwise(0)).alias("errors"), runs("empty").alias("empty_runs"), runs("non_empty").alias("full_runs"), runs("mutating_calls").alias("mutating_runs"))
    t = t.join(repeated_errors(signatures, TASK, repeats), TASK, "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    t = t.withColumn("error_rate", _rate(F.col("errors"), F.col("call_tools")))
    n = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(f"{name}:"), F.col(c).cast("string")))
    high = (F.col("error_rate") >= rate) & (F.col("errors") > 0)
    only_empty = (F.col("empty_runs") == F.col("runs")) & (F.col("full_runs") == 0)
    never = ~F.col("completed") if require_complete else F.lit(False)
    hard = (F.col("bad") > 0) | (F.col("call_tools") == 0) | high | (F.col("n_http_500") > 0) | (F.col("n_timeout") > 0) | (F.col("repeated") > 0) | only_empty | never
    reasons = F.array_compact(F.concat(F.array_repeat(F.lit("missing_or_bad_trajectory"), F.col("bad").cast("int")), F.array(
        F.when(F.col("call_tools") == 0, "no_call_tool_path"), n("agent_argument_parse_error", "n_agent_argument_parse_error"),
        F.when(high, F.concat(F.lit("high_tool_error_rate:"), F.col("rate_text"))), n("http_500", "n_http_500"), n("timeout", "n_timeout"),
        n("repeated_schema_or_route_error", "repeated"), F.when(only_empty, "only_empty_or_not_found_tool_responses"),
        F.when(~F.col("completed") & (F.col("mutating_runs") == 0) & (F.col("call_tools") > 0), "no_successful_mutating_path_observed"), F.when(never, "never_completed"))))
    decision = F.when(hard, "reject").when(F.col("completed"), "keep").otherwise("review")
    return t.withColumn("rate_text", two_digits("error_rate")).select(*TASK, decision.alias("decision"), reasons.alias("reasons"), "error_rate")


def strict_decisions(rows: DataFrame, signatures: DataFrame, expected_runs: int, rate: float = 0.30, repeats: int = 2, require_complete: bool = False) -> DataFrame:
    """(scenario, task_id, decision, reasons): complete once keeps; fewer runs than expected, or a run without a hard
    reason, is for review; else rejected with the counts of the reasons."""
    errors = sum(F.col(f"n_{x}") for x in ("http_500", "timeout", "validation", "route_or_schema", "tool_error"))
    r = rows.join(repeated_errors(signatures, KEY, repeats), KEY, "left").withColumn("repeated", F.coalesce("repeated", F.lit(0))).withColumn("errors", errors)
    high = (_rate(F.col("errors"), F.col("call_tools")) >= rate) & (F.col("errors") > 0)
    names = F.array_compact(F.array(F.when(F.col("call_tools") == 0, "no_call_tool_path"), F.when(high, "high_tool_error_rate"), F.when(F.col("n_http_500") > 0, "http_500"), F.when(F.col("n_timeout") > 0, "timeout"), F.when(F.col("repeated") > 0, "repeated_schema_or_route_error"), F.when((F.col("call_tools") > 0) & (F.col("empty") > 0) & (F.col("non_empty") == 0), "only_empty_or_not_found_tool_responses"), F.when(F.lit(require_complete), "never_completed")))
    done = F.coalesce(F.col("reward_type") == "complete", F.lit(False))
    hard = F.when(done, F.array().cast("array<string>")).when(~F.col("readable"), F.array(F.lit("missing_or_bad_trajectory"))).otherwise(names)
    r = r.withColumn("hard", hard).withColumn("done", done)
    t = r.groupBy(*TASK).agg(F.bool_or("done").alias("done"), F.count("*").alias("runs"), F.bool_and(F.size("hard") > 0).alias("all_hard"), F.flatten(F.collect_list("hard")).alias("all"), F.sort_array(F.collect_list(F.concat("run", F.when(F.size("hard") > 0, ":hard").otherwise(":not_hard")))).alias("labels"))
    counted = F.transform(F.array_sort(F.array_distinct("all")), lambda x: F.concat(x, F.lit(":"), F.size(F.filter("all", lambda y: y == x)).cast("string")))
    short = F.col("runs") < expected_runs
    decision = F.when(F.col("done"), "keep").when(short, "review").when(F.col("all_hard"), "reject").otherwise("review")
    reasons = F.when(F.col("done"), F.array(F.lit("complete_in_at_least_one_run"))).when(short, F.array(F.concat(F.lit("missing_run_records:"), (expected_runs - F.col("runs")).cast("string")))).when(F.col("all_hard"), counted).otherwise(F.col("labels"))
    return t.select(*TASK, decision.alias("decision"), reasons.alias("reasons"))


def reason_families(decisions: DataFrame) -> DataFrame:
    """Tasks by decision and family of reason (what stands before the colon)."""
    return decisions.select("decision", F.explode("reasons").alias("r")).groupBy("decision", F.substring_index("r", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def safeguarded(decisions: DataFrame, source: DataFrame) -> DataFrame:
    """The allowlist (keep and review), and the source's tasks that were never analysed, marked as missing evidence."""
    kept = decisions.where("decision in ('keep', 'review')").select(*TASK, "decision")
    gone = source.select(*TASK).distinct().join(decisions.select(*TASK), TASK, "left_anti").withColumn("decision", F.lit("missing_evidence"))
    return kept.unionByName(gone)


def allowlist_job(verdicts: DataFrame, calls: DataFrame, flags: Column, source: DataFrame, path: str, expected_runs: int | None = None, **limits) -> dict[str, DataFrame]:
    """From runs to an allowlist: Parquet tables under path, given back as they are read again.

    runs: every run of a task with its counters; decisions: one folder for each decision; allowlist: keep and review, and
    the tasks of source that were never analysed; reasons: tasks by decision and family of reason; stats: one row of
    totals. Decisions are strict where the number of expected runs is given, else lenient; limits are theirs. No runs
    give empty tables and zeros.
    """
    spark, out = verdicts.sparkSession, {}

    def put(name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        if by:
            write_buckets(df, by, f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}").select(*df.columns)
        return out[name]

    known = classified_calls(calls, flags)
    runs, signatures = put("runs", run_rows(verdicts, run_counters(known))), error_signatures(known)
    decided = lenient_decisions(runs, signatures, **limits) if expected_runs is None else strict_decisions(runs, signatures, expected_runs, **limits)
    decided = put("decisions", decided, "decision")
    put("allowlist", safeguarded(decided, source))
    put("reasons", reason_families(decided))
    each = [F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("keep", "review", "reject")]
    put("stats", decided.agg(F.count("*").alias("tasks_analyzed"), *each).join(runs.agg(F.count("*").alias("run_task_records")), how="cross"))  # one row each
    return out
