"""Generation in stages: responses of all attempts in one keyed table, what of them is accepted, and what is asked next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonkit import lenient_json
from .selection import error_digest, request_rows

#: The stages in their order; a stage is asked for once the one before it is accepted.
STAGES = ("scenario", "tasks", "schema", "sample", "spec", "env", "verifier")
#: Stages whose result is run elsewhere: what counts is the share of statements that fail.
MEASURED = ("schema", "sample")
KEY = ["stage", "scenario"]
ATTEMPTS, TASKS, ERROR_SHARE = 3, 10, 0.1


def _rules(j: Column, n_tasks: int, share: float) -> dict[str, Column]:
    has = lambda field: F.length(F.trim(F.get_json_object(j, f"$.{field}"))) > 0
    groups = F.from_json(F.get_json_object(j, "$.api_groups"), "array<struct<endpoints array<string>>>")
    endpoints = F.aggregate(groups, F.lit(0), lambda a, g: a + F.greatest(F.coalesce(F.size(g["endpoints"]), F.lit(0)), F.lit(0)))
    return {
        "scenario": has("name") & has("description"),
        "tasks": F.json_array_length(F.get_json_object(j, "$.tasks")) >= n_tasks,
        "spec": endpoints >= 1,
        "env": has("code"),
        "verifier": has("python_code"),
        **{stage: F.col("error_ratio") <= share for stage in MEASURED},
    }


def judged_attempts(attempts: DataFrame, most: int = ATTEMPTS, n_tasks: int = TASKS, share: float = ERROR_SHARE) -> DataFrame:
    """attempts (stage, scenario, attempt from 1, response, error_ratio) with parsed, ok and state.

    ok by the rule of the stage: an empty or unreadable response, an unknown stage and a null are not. The first ok attempt
    of a (stage, scenario) is accepted and later ones are extra. Without one, the attempts are to be tried again (retry),
    until there have been `most`: then the last one is given_up, and of a measured stage the one of the least error ratio,
    the earliest of equals, is accepted in its place (fallback).
    """
    j = F.col("_j")
    read = attempts.withColumn("_j", lenient_json("response")).withColumn("parsed", F.when(F.col("_j.ok") & (F.trim("response") != ""), F.col("_j.text"))).drop("_j")
    rules = _rules(F.col("parsed"), n_tasks, share)
    ok = reduce(lambda c, s: c.when((F.col("stage") == s) & F.col("parsed").isNotNull(), rules[s]), STAGES, F.when(F.lit(False), F.lit(False)))
    tasks = F.to_json(F.struct(F.slice(F.from_json(F.get_json_object("parsed", "$.tasks"), "array<string>"), 1, n_tasks).alias("tasks")))
    rows = read.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("parsed", F.when((F.col("stage") == "tasks") & F.col("ok"), tasks).otherwise(F.col("parsed")))
    key, measured = Window.partitionBy(*KEY), F.col("stage").isin(*MEASURED)
    first = F.min(F.when(F.col("ok"), F.col("attempt"))).over(key)
    last = F.max("attempt").over(key)
    least = F.min(F.when(measured & F.col("parsed").isNotNull() & F.col("error_ratio").isNotNull(), F.struct("error_ratio", "attempt"))).over(key)["attempt"]
    rows = rows.withColumn("_first", first).withColumn("_last", last).withColumn("_least", least)
    over = F.col("_first").isNull() & (F.col("_last") >= most)
    state = (
        F.when(F.col("attempt") == F.col("_first"), "accepted")
        .when(F.col("_first").isNotNull() & (F.col("attempt") > F.col("_first")), "extra")
        .when(over & (F.col("attempt") == F.col("_least")), "fallback")
        .when(over & (F.col("attempt") == F.col("_last")), "given_up")
        .otherwise("retry")
    )
    return rows.withColumn("state", state).drop("_first", "_last", "_least")


def stage_results(judged: DataFrame) -> DataFrame:
    """One row for each (stage, scenario) that was tried: status (accepted, fallback, retry or given_up), the attempts so
    far, and the attempt and payload that hold where there are any."""
    held = F.col("state").isin("accepted", "fallback")
    one = lambda c: F.max(F.when(held, F.col(c)))
    rows = judged.groupBy(*KEY).agg(F.max("attempt").alias("attempts"), one("state").alias("held"), one("attempt").alias("attempt"), one("parsed").alias("payload"), F.bool_or(F.col("state") == "given_up").alias("over"))
    return rows.select(*KEY, F.coalesce("held", F.when(F.col("over"), "given_up").otherwise("retry")).alias("status"), "attempts", "attempt", "payload")


def next_requests(scenarios: DataFrame, results: DataFrame, attempts: DataFrame, templates: dict[str, str], stages: tuple[str, ...] = STAGES, digest_chars: int = 64_000) -> DataFrame:
    """(stage, scenario, attempt, prompt): what to ask next, at most one row for each scenario and stage.

    A stage is open for a scenario if the stage before it holds (the first one: always) and it does not hold itself and
    was not given up. Its template has {scenario}, {payload} (of the stage before) and {errors} (the errors of the attempts
    so far, see error_digest()) filled. scenarios: (scenario); attempts: (stage, scenario, errors). A stage without a
    template is not asked for.
    """
    parts = []
    for i, stage in enumerate(stages):
        if stage not in templates:
            continue
        done = results.where(F.col("stage") == stage).select("scenario", "status", "attempts")
        ready = scenarios.select("scenario").distinct()
        if i:
            before = results.where((F.col("stage") == stages[i - 1]) & F.col("status").isin("accepted", "fallback")).select("scenario", F.col("payload"))
            ready = ready.join(before, "scenario")
        else:
            ready = ready.withColumn("payload", F.lit(None).cast("string"))
        rows = ready.join(done, "scenario", "left").where("status is null or status = 'retry'")
        digest = error_digest(attempts.where(F.col("stage") == stage), ["scenario"], digest_chars)
        rows = rows.join(digest, "scenario", "left")
        asked = request_rows(rows, templates[stage], {"scenario": F.col("scenario"), "payload": F.col("payload"), "errors": F.col("digest")})
        parts.append(asked.select(F.lit(stage).alias("stage"), "scenario", (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt"), "prompt"))
    return reduce(DataFrame.unionByName, parts)


def kept_by_answer(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates (batch, idx from 0) that the answer of their batch keeps: {"decisions": [{"index", "decision"}]}.

    Only indices whose decision is keep stay; those out of range mean nothing. A batch whose answer can't be read, or has no
    decisions, keeps all: the check failed and not the candidates. answers: (batch, response), one row a batch.
    """
    j = lenient_json("response")
    listed = F.from_json(F.get_json_object("_text", "$.decisions"), "array<struct<index int, decision string>>")
    read = answers.withColumn("_text", j["text"]).select("batch", F.when(F.get_json_object("_text", "$.decisions").startswith("["), listed).alias("_d"))
    rows = candidates.join(read, "batch", "left")
    keeps = F.exists(F.col("_d"), lambda d: F.coalesce((d["index"] == F.col("idx")) & (d["decision"] == "keep"), F.lit(False)))
    return rows.where(F.col("_d").isNull() | keeps).drop("_d")
