"""Trajectories into compact traces, with the first reason for which each is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calls import normalized_call, response_after, steps_with_calls
from ..functions.jsonkit import json_facts, observation
from ..functions.text import has_error_phrase, quoted, task_key, trace_text
from ..sources.tables import write_buckets
from .scores import preferred_verdicts

KEY = ["run", "scenario", "task_id"]
STEP = "role string, content string, tool_calls array<string>, tool_response struct<content: string>"
REASONS = ("parse_error", "not_complete", "all_tool_calls_unparseable", "no_call_tool", "tool_error", "no_final_answer")


def with_calls(trajectories: DataFrame) -> DataFrame:
    """trajectories whose steps hold their calls: the structured ones, or, where there are none, the one in the text."""
    return trajectories.withColumn("steps", steps_with_calls(F.col("steps")))


def final_answer(steps: Column) -> Column:
    """The last assistant message with text and without calls (steps as with_calls() gives them)."""
    said = F.filter(steps, lambda s: (s["role"] == "assistant") & (F.trim(s["content"]) != "") & (F.size(s["calls"]) == 0))
    return F.trim(F.get(said, F.size(said) - 1)["content"])


def last_message(steps: Column) -> Column:
    """The last assistant message of any kind, as a verifier sees it."""
    said = F.filter(steps, lambda s: s["role"] == "assistant")
    return F.get(said, F.size(said) - 1)["content"]


def listed_calls(trajectories: DataFrame) -> DataFrame:
    """One row for each assistant call but list_tools, with its response; tool is null or empty where it has none.

    trajectories: KEY and steps, an array of structs (role, content, calls: array of JSON texts, response). The response
    is found inside the array.
    """
    rows = trajectories.select(*KEY, "steps", F.posexplode("steps").alias("entry_pos", "step")).where(F.col("step.role") == "assistant")
    rows = rows.select(*KEY, "entry_pos", response_after(F.col("steps"), F.col("entry_pos")).alias("response"), F.posexplode("step.calls").alias("call_pos", "call"))
    rows = rows.withColumn("c", normalized_call(F.col("call"))).where("c is not null")
    return rows.select(*KEY, "entry_pos", "call_pos", "response", "c.tool", "c.args", "c.args_parse_ok")


def kept_calls(listed: DataFrame) -> DataFrame:
    """The calls that have a tool, numbered from 1 in order."""
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("entry_pos", "call_pos"))
    return listed.where("tool is not null and tool <> ''").withColumn("step", number)


def cleaned(trajectories: DataFrame, verdicts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each trajectory: reason (null: kept), calls, tools in the order of the calls, trace and final answer,
    and the columns to carry.

    Reasons in order: not complete, no list of steps, calls without a tool only, no call at all, an error phrase in a
    response, no final answer. Calls in texts count where a step has no structured ones. A trajectory's calls meet in
    one row: they are bounded by the length of a run.
    """
    t = with_calls(trajectories)
    listed = listed_calls(t)
    lost = listed.where("coalesce(tool, '') = ''").groupBy(*KEY).agg(F.count("*").alias("lost"))
    calls = kept_calls(listed).withColumn("o", observation()("response")).withColumn("obs_error", has_error_phrase(F.col("response")))
    whole = (F.col("o.type") == "json") & ~F.exists("o.truncations", lambda x: x["type"] == "json_chars")
    obs = F.when(whole, F.col("o.content")).otherwise(quoted(F.col("o.content")))
    args = F.when(F.col("args_parse_ok"), F.col("args")).otherwise(quoted(F.col("args")))
    step = F.struct("step", "tool", args.alias("args"), obs.alias("obs"), "args_parse_ok", "obs_error")
    per = calls.groupBy(*KEY).agg(F.array_sort(F.collect_list(step)).alias("calls"), F.bool_or("obs_error").alias("failed"))
    base = t.select(*KEY, *[c for c in carry if c != "task"], "task", F.col("steps").isNull().alias("bad"), final_answer(F.col("steps")).alias("final"), F.length(F.to_json("steps")).alias("raw_chars"))
    rows = base.join(verdicts.select(*KEY, "reward_type"), KEY, "left").join(per, KEY, "left").join(lost, KEY, "left")
    none = F.col("calls").isNull()
    reason = F.when(F.coalesce(F.col("reward_type") != "complete", F.lit(True)), "not_complete").when(F.col("bad"), "parse_error").when(none & (F.col("lost") > 0), "all_tool_calls_unparseable").when(none, "no_call_tool").when(F.col("failed"), "tool_error").when(F.col("final").isNull(), "no_final_answer")
    trace = trace_text(F.col("task"), F.col("calls"), F.col("final"))
    return rows.select(*KEY, *carry, reason.alias("reason"), F.coalesce(F.size("calls"), F.lit(0)).alias("num_tool_calls"), F.transform("calls", lambda c: c["tool"]).alias("tools_used"), "calls", "final", trace.alias("trace"), "raw_chars")


def cleaning_stats(rows: DataFrame) -> DataFrame:
    """Counts by reason (kept: null), average calls, and characters of raw and clean text."""
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.avg("num_tool_calls").alias("avg_calls"), F.avg("raw_chars").alias("avg_raw_chars"), F.avg(F.length("trace")).alias("avg_clean_chars"))


def cleaning_totals(rows: DataFrame) -> DataFrame:
    """One row: matched, kept and rejected trajectories, average calls of the kept, and characters before and after."""
    kept = F.col("reason").isNull()
    clean = F.avg(F.when(kept, F.length("trace")))
    return rows.agg(F.count("*").alias("matched"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.avg(F.when(kept, F.col("num_tool_calls"))).alias("avg_calls"), F.avg("raw_chars").alias("avg_raw_chars"), clean.alias("avg_clean_chars"), (clean / F.avg("raw_chars")).alias("ratio"))


def top_tools(rows: DataFrame, most: int = 50) -> DataFrame:
    return rows.where("reason is null").select(F.explode("calls.tool").alias("tool")).groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tool").limit(most)


def read_trajectories(files: DataFrame) -> DataFrame:
    """Trajectory files (run, scenario_dir, task_id, file, body) as cleaned() takes them, with name, model and file_chars.

    Calls stay JSON texts; entries of the list that are no objects have no role and count for nothing. steps is null where
    the body has no list of them, and problem says why a body is not one JSON object.
    """
    facts = files.withColumn("_f", json_facts("body")).withColumn("problem", F.when(~F.coalesce("_f.ok", F.lit(False)), "not_json").when(F.col("_f.kind") != "object", "not_an_object"))
    said = F.get_json_object("body", "$.trajectory")
    made = lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["content"], F.lit("")).alias("content"), x["tool_calls"].alias("calls"), x["tool_response"]["content"].alias("response"))
    steps = F.transform(F.from_json(F.when(said.startswith("["), said), "array<string>"), lambda x: made(F.from_json(x, STEP)))
    text = lambda c: F.get_json_object("body", f"$.{c}")
    return facts.select("run", F.col("scenario_dir").alias("scenario"), F.col("task_id").cast("long").alias("task_id"), "file", "problem", text("scenario").alias("name"), F.coalesce(text("task"), F.lit("")).alias("task"), text("model").alias("model"), F.length("body").alias("file_chars"), F.when(F.col("problem").isNull(), steps).alias("steps"))


def read_verdicts(files: DataFrame) -> DataFrame:
    """The verdict of each run of a task from its verify files (run, scenario_dir, task_id, mode, body), code before sql;
    reward_type is null where the preferred file has none."""
    rows = files.select("run", F.col("scenario_dir").alias("scenario"), F.col("task_id").cast("long").alias("task_id"), "mode", F.get_json_object("body", "$.reward_type").alias("reward_type"))
    return preferred_verdicts(rows)


def cleaned_files(trajectories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each trajectory file of read_trajectories(): bucket (kept or rejected), reason, and the clean trajectory.
    A body that can't be read is rejected as parse_error before anything else."""
    carry = ("name", "model", "file", "file_chars")
    good = cleaned(trajectories.where("problem is null"), verdicts, (*carry, "task"))
    bad = trajectories.where("problem is not null").select(*KEY, *carry, F.lit(None).cast("string").alias("task"), F.lit("parse_error").alias("reason"))
    rows = good.drop("raw_chars").unionByName(bad, allowMissingColumns=True)
    row = F.struct("name", "task_id", "task", "model", "num_tool_calls", "tools_used", "calls", "final", "trace")
    kept = F.col("reason").isNull()
    return rows.withColumn("bucket", F.when(kept, "kept").otherwise("rejected")).withColumn("traj_id", task_key(F.col("name"), F.col("task_id"))).withColumn("clean_chars", F.when(kept, F.length(F.to_json(row))))


def file_totals(rows: DataFrame) -> DataFrame:
    """One row over the rows of cleaned_files(): matched, kept, rejected, average calls of the kept, average characters of
    all files and of the clean rows, and their ratio."""
    kept = F.col("bucket") == "kept"
    raw, clean = F.avg("file_chars"), F.avg("clean_chars")
    return rows.agg(F.count("*").alias("matched"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.avg(F.when(kept, F.col("num_tool_calls"))).alias("avg_calls"), raw.alias("avg_raw_chars"), clean.alias("avg_clean_chars"), (clean / raw).alias("ratio"))


def cleaning_job(files: DataFrame, path: str, most_tools: int = 50) -> dict[str, DataFrame]:
    """Run files (run, scenario_dir, task_id, kind, mode, file, body) into Parquet tables under path, given back as they
    are read again.

    rows: a folder for each bucket, kept and rejected, from one pass; reasons: rejected trajectories by reason; tools: the
    tools of the kept ones by calls; stats: one row of totals. No files give empty tables and zeros.
    """
    spark, out = files.sparkSession, {}
    rows = cleaned_files(read_trajectories(files.where("kind = 'trajectory'")), read_verdicts(files.where("kind = 'verify'")))
    write_buckets(rows, "bucket", f"{path}/rows")
    out["rows"] = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(*rows.columns)
    tables = {"reasons": out["rows"].where("bucket = 'rejected'").groupBy("reason").agg(F.count("*").alias("n")), "tools": top_tools(out["rows"], most_tools), "stats": file_totals(out["rows"])}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    return out
