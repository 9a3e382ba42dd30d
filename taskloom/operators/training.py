"""Training rows from conversations and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calls import normalized_call
from ..functions.text import reward_value
from ..functions.variants import strict_json

KEY = ["run", "scenario", "task_id"]
THOUGHT = r"(?s)<think>\s*[^\s<].*?</think>"


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, no, messages): an assistant message and what follows it up to the next one is a turn, from 1; turn 0 is
    what stands before the first. messages: (conv_id, turn, role, text)."""
    no = F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id").orderBy("turn"))
    said = F.struct("turn", "role", "text")
    return messages.select("conv_id", no.alias("no"), said.alias("said")).groupBy("conv_id", "no").agg(F.array_sort(F.collect_list("said")).alias("messages"))


def history_rows(messages: DataFrame, window: int = 3) -> DataFrame:
    """One row for each turn of the assistant: system text, first user text, the first exchange (its first turn with the
    answers to it), the last `window` turns before the target, oldest first, and the target, on which alone there is loss.

    The first exchange is not in the history again where it is among the last turns. first_user is null where no user has
    spoken yet. One shuffle by conversation; a conversation is bounded by the length of a run.
    """
    t = turns(messages)
    before = Window.partitionBy("conv_id").orderBy("no")
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["text"]
    so_far = before.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.first(c, True).over(so_far)
    rows = t.withColumn("system", first(said("system"))).withColumn("first_user", first(said("user"))).withColumn("first_exchange", first(F.when(F.col("no") == 1, F.col("messages"))))
    rows = rows.withColumn("history", F.collect_list(F.when(F.col("no") > 1, F.col("messages"))).over(before.rowsBetween(-window, -1)))
    target = F.get("messages", F.lit(0))
    return rows.where("no > 0").select("conv_id", target["turn"].alias("turn"), "system", "first_user", "first_exchange", "history", target["text"].alias("target"))


def calls_without_help(calls: DataFrame) -> DataFrame:
    """The first call with arguments of each tool in a trajectory that had no successful tool_help on it before.

    calls: (run, scenario, task_id, pos, name, tool, has_args, ok)."""
    group = ["run", "scenario", "task_id", "tool"]
    helped = F.max(F.when((F.col("name") == "tool_help") & F.col("ok"), 1).otherwise(0)).over(Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    bare = calls.withColumn("helped", F.coalesce(helped, F.lit(0))).where("name = 'call_tool' and has_args and helped = 0")
    return bare.groupBy(*group).agg(F.min("pos").alias("pos"))


def _call_problem(calls: Column, listed: Column, tools: Column | None) -> Column:
    """What is wrong with the calls of a step, the first of them first; listed: whether tools were listed in a step before."""
    name = lambda c: F.get_json_object(c, "$.name")
    again = F.size(F.filter(calls, lambda c: name(c) == "list_tools")) > F.when(listed, 0).otherwise(1)
    early = ~listed & F.exists(calls, lambda c: F.coalesce(name(c) != "list_tools", F.lit(True)))
    args = lambda c: F.get_json_object(c, "$.arguments")
    inner = lambda c: F.coalesce(F.get_json_object(args(c), "$.arguments"), F.lit("{}"))
    broken = F.exists(calls, lambda c: (name(c) == "call_tool") & ~(strict_json(F.coalesce(args(c), F.lit(""))) & strict_json(inner(c))))
    found = F.when(again, "list_tools_again").when(early, "tools_not_listed")
    if tools is not None:
        tool = lambda c: normalized_call(c)["tool"]
        found = found.when(F.exists(calls, lambda c: (name(c) == "call_tool") & ~F.coalesce(F.array_contains(tools, F.get_json_object(args(c), "$.tool_name")), F.lit(False))), "unknown_tool")
    return found.when(broken, "bad_arguments")


def format_violations(trajectories: DataFrame, think: bool = True) -> DataFrame:
    """(run, scenario, task_id, pos, violation): the first step of each rollout that breaks the protocol, if any does.

    An assistant step has to hold a thought that is not empty (think), tools are listed once and before any call, a tool
    that is called has to be among `tools` (where trajectories have that column), and its arguments are JSON. steps are as
    cleaning.with_calls() gives them.
    """
    known = "tools" in trajectories.columns
    rows = trajectories.select(*KEY, *(["tools"] if known else []), F.posexplode("steps").alias("pos", "step")).where(F.col("step.role") == "assistant")
    calls = F.coalesce("step.calls", F.array().cast("array<string>"))
    lists = F.exists(calls, lambda c: F.coalesce(F.get_json_object(c, "$.name") == "list_tools", F.lit(False)))
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_calls", calls).withColumn("_listed", F.coalesce(F.max(lists).over(before), F.lit(False)))
    silent = F.when(F.lit(think) & ~F.coalesce(F.col("step.content").rlike(THOUGHT), F.lit(False)), "no_thought")
    found = rows.withColumn("violation", F.coalesce(silent, _call_problem(F.col("_calls"), F.col("_listed"), F.col("tools") if known else None))).where("violation is not null")
    return found.groupBy(*KEY).agg(F.min(F.struct("pos", "violation")).alias("x")).select(*KEY, "x.pos", "x.violation")


def rollout_rows(trajectories: DataFrame, verdicts: DataFrame, window: int = 3, think: bool = True) -> DataFrame:
    """Training rows of rollouts: history_rows() of each, with the reward of its target.

    The reward of a rollout's verdict (reward_type, none: null) is that of all its steps. A rollout ends with the first step
    that breaks the protocol: that step has -1, and what comes after it is left out. A step's own response follows it as a
    message of the tool. trajectories: KEY and steps; pos is the step of the target, from 0.
    """
    steps = trajectories.select(*KEY, F.posexplode("steps").alias("pos", "step"))
    own = F.struct((2 * F.col("pos")).alias("turn"), F.col("step.role").alias("role"), F.col("step.content").alias("text"))
    answer = F.struct((2 * F.col("pos") + 1).alias("turn"), F.lit("tool").alias("role"), F.col("step.response").alias("text"))
    said = F.when(F.col("step.response").isNotNull(), F.array(own, answer)).otherwise(F.array(own))
    messages = steps.select(F.struct(*KEY).alias("conv_id"), F.explode(said).alias("m")).select("conv_id", "m.*")
    rows = history_rows(messages, window).withColumn("pos", F.expr("turn div 2").cast("int")).select("conv_id.*", "pos", "system", "first_user", "first_exchange", "history", "target")
    ends = format_violations(trajectories, think).select(*KEY, F.col("pos").alias("_end"), "violation")
    rows = rows.join(ends, KEY, "left").where("_end is null or pos <= _end").join(verdicts.select(*KEY, "reward_type"), KEY, "left")
    broke = F.coalesce(F.col("pos") == F.col("_end"), F.lit(False))
    return rows.withColumn("reward", F.when(broke, -1.0).otherwise(reward_value(F.col("reward_type")))).withColumn("violation", F.when(broke, F.col("violation"))).drop("_end")
