"""Examples, attempts, limits, request rows and the acceptance of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonkit import lenient_json
from ..functions.text import skill_warnings


def shortest_examples(rows: DataFrame, positives: int, auxiliaries: int) -> DataFrame:
    """By scenario: the successes with the fewest calls, and others not among them, failures first."""
    good = F.row_number().over(Window.partitionBy("scenario").orderBy("num_tool_calls", "task_id"))
    first = rows.where("reward_type = 'complete'").withColumn("rank", good).where(F.col("rank") <= positives).withColumn("part", F.lit("positive"))
    rest = rows.join(first.select("scenario", "task_id"), ["scenario", "task_id"], "left_anti")
    done = F.coalesce(F.col("reward_type") == "complete", F.lit(False))
    other = F.row_number().over(Window.partitionBy("scenario").orderBy(done, "num_tool_calls", "task_id"))
    return first.unionByName(rest.withColumn("rank", other).where(F.col("rank") <= auxiliaries).withColumn("part", F.lit("auxiliary")))


def covering_examples(rows: DataFrame, positives: int, negatives: int) -> DataFrame:
    """By scenario: successes in order of calls that add a tool (or are among the first two), filled up by task id; then
    others, failures first, that share most tools with them. rows: (scenario, task_id, reward_type, num_tool_calls,
    tools_used).

    The choice is a fold over a sorted array. Only rows that can be chosen reach it: of the rows of a scenario with one set
    of tools no more than the shortest few, and the successes of the smallest ids; so an array is bounded by the number of
    different sets of tools.
    """
    few = max(positives + negatives, 2)
    done = F.coalesce(F.col("reward_type") == "complete", F.lit(False))
    tools = F.array_sort(F.array_distinct(F.coalesce("tools_used", F.array().cast("array<string>"))))
    row = rows.select("scenario", F.col("task_id").cast("long").alias("task_id"), F.col("num_tool_calls").cast("long").alias("calls"), done.alias("done"), tools.alias("tools"))
    by = Window.partitionBy("scenario", "done", "tools")
    short = F.row_number().over(by.orderBy("calls", "task_id"))
    early = F.row_number().over(Window.partitionBy("scenario", "done").orderBy("task_id"))
    can = row.withColumn("_short", short).withColumn("_early", early).where((F.col("_short") <= few) | (F.col("done") & (F.col("_early") <= 2 * positives)))
    each = F.struct("calls", "task_id", "tools", "done")
    g = can.groupBy("scenario").agg(F.array_sort(F.collect_list(each)).alias("all"))
    good, ids = F.filter("all", lambda x: x["done"]), lambda a: F.transform(a, lambda x: x["task_id"])
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<string>").alias("tools"))

    def step(state: Column, x: Column) -> Column:
        n = F.size(state["taken"])
        take = (n < positives) & ((F.size(F.array_except(x["tools"], state["tools"])) > 0) | (n < min(2, positives)))
        more = F.struct(F.array_append(state["taken"], x["task_id"]).alias("taken"), F.array_union(state["tools"], x["tools"]).alias("tools"))
        return F.when(take, more).otherwise(state)

    g = g.withColumn("_s", F.aggregate(good, start, step))
    rest = F.array_sort(F.filter(ids(good), lambda t: ~F.array_contains(F.col("_s.taken"), t)))
    g = g.withColumn("_p", F.concat("_s.taken", F.slice(rest, F.lit(1), F.greatest(positives - F.size("_s.taken"), F.lit(0)))))
    others = F.filter("all", lambda x: ~F.array_contains(F.col("_p"), x["task_id"]))
    order = F.transform(others, lambda x: F.struct(x["done"].alias("done"), (-F.size(F.array_intersect(x["tools"], F.col("_s.tools")))).alias("shared"), x["calls"].alias("calls"), x["task_id"].alias("task_id")))
    g = g.withColumn("_n", ids(F.slice(F.array_sort(order), 1, negatives)))
    listed = lambda c, part: g.select("scenario", F.posexplode(c).alias("_at", "task_id"), F.lit(part).alias("part"))
    both = listed("_p", "positive").unionByName(listed("_n", "negative"))
    return both.select("scenario", "task_id", "part", (F.col("_at") + 1).alias("rank"))


def win_loss_examples(changed: DataFrame, most: int) -> DataFrame:
    """By scenario: wins (after = complete) for the larger half of `most`, losses for the smaller."""
    win = F.col("after") == "complete"
    rank = F.row_number().over(Window.partitionBy("scenario", win).orderBy("task_id"))
    rows = changed.withColumn("win", win).withColumn("rank", rank)
    return rows.where(F.col("rank") <= F.when(F.col("win"), (most + 1) // 2).otherwise(most // 2))


def scenario_subset(names: DataFrame, requested: list[str], first: int) -> tuple[DataFrame, DataFrame]:
    """(the first scenarios of those requested, by name; the requested ones that are missing)."""
    asked = names.sparkSession.createDataFrame([(x,) for x in requested], "scenario string")
    return names.join(asked, "scenario", "left_semi").orderBy("scenario").limit(first), asked.join(names, "scenario", "left_anti")


def best_attempt(attempts: DataFrame, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """The first attempt within the error threshold, else the one of the least error ratio, the earliest of equals."""
    ok = F.coalesce(F.col("error_ratio") <= threshold, F.lit(False))
    order = [ok.desc(), F.when(ok, F.lit(0.0)).otherwise(F.col("error_ratio")).asc_nulls_last(), "attempt"]
    return attempts.withColumn("accepted", ok).withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_no = 1").drop("_no")


def error_digest(attempts: DataFrame, keys: list[str], most: int = 64_000) -> DataFrame:
    """The distinct errors of all attempts in order as one text, its last `most` characters.

    Errors that stand before those characters are left out by a running length before any array is made, so no array has
    more than `most` of them, whatever the number of attempts.
    """
    found = attempts.select(*keys, F.explode("errors").alias("error")).where("error is not null").distinct()
    after = Window.partitionBy(*keys).orderBy(F.col("error").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumn("_after", F.coalesce(F.sum(F.length("error") + 1).over(after), F.lit(0))).where(F.col("_after") < most)
    text = F.array_join(F.array_sort(F.collect_list("error")), "\n")
    return near.groupBy(*keys).agg(F.right(text, F.lit(most)).alias("digest"))


def balanced_limit(tasks: DataFrame, limit: int, scenarios: int, order: str = "pos") -> DataFrame:
    """Per scenario at most max(limit // scenarios, 1) tasks, up to and with the scenario that reaches the limit.

    tasks: one row a scenario with its tasks and position. At most `limit` scenarios can be needed, so those come first
    by position before the running count.
    """
    each = max(limit // max(scenarios, 1), 1)
    head = tasks.where(F.size("tasks") > 0).orderBy(order).limit(limit).withColumn("tasks", F.slice("tasks", 1, each))
    so_far = F.coalesce(F.sum(F.size("tasks")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("_before", so_far).where(F.col("_before") < limit).drop("_before")


def few_shot(scenarios: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n scenarios over many primary categories: max(1, n // categories) of each in a seeded order, then the rest."""
    kinds = max(1, scenarios.select(F.get("categories", F.lit(0))).distinct().count())
    by = F.md5(F.concat(F.lit(f"{seed}:"), "name"))
    rank = F.row_number().over(Window.partitionBy(F.get("categories", F.lit(0))).orderBy(by, "name"))
    return scenarios.withColumn("_first", rank <= max(1, n // kinds)).orderBy(F.col("_first").desc(), by, "name").limit(n).drop("_first")


def request_rows(inputs: DataFrame, template: str, slots: dict[str, Column]) -> DataFrame:
    """inputs with `prompt`: the template with each {slot} filled. The template is the caller's."""
    text = F.lit(template)
    for name, value in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return inputs.withColumn("prompt", text)


def distillation_requests(examples: DataFrame, available: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """One request for each scenario of available: the template with {scenario}, {positives}, {others}, {tools} and
    {tables} filled, the ids of the chosen examples, how many there were to choose from, and which context is there.

    examples: (scenario, task_id, part, rank, trace), as they were chosen, a bounded number for a scenario; available:
    (scenario, reward_type); contexts: (scenario, tool_summary, db_summary), at most one row each.
    """
    shown = F.struct("rank", "task_id", F.coalesce("trace", F.lit("")).alias("trace"))
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, shown)))
    chosen = examples.groupBy("scenario").agg(side(F.col("part") == "positive").alias("_p"), side(F.col("part") != "positive").alias("_o"))
    totals = available.groupBy("scenario").agg(F.count_if(F.col("reward_type") == "complete").alias("num_positive_available"), F.count("*").alias("num_aux_available"))
    rows = totals.join(chosen, "scenario", "left").join(contexts, "scenario", "left")
    texts = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["trace"]), "\n\n"), F.lit(""))
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["task_id"]), F.array().cast("array<bigint>"))
    tools, db = F.coalesce("tool_summary", F.lit("(tool summary unavailable)")), F.coalesce("db_summary", F.lit("(database summary unavailable)"))
    rows = request_rows(rows, template, {"scenario": F.col("scenario"), "tools": tools, "tables": db, "positives": texts(F.col("_p")), "others": texts(F.col("_o"))})
    return rows.select("scenario", "prompt", ids(F.col("_p")).alias("positive_task_ids"), ids(F.col("_o")).alias("auxiliary_task_ids"), "num_positive_available", "num_aux_available", F.col("tool_summary").isNotNull().alias("has_tool_summary"), F.col("db_summary").isNotNull().alias("has_db_summary"))


def validated_skills(skills: DataFrame, max_words: int, strict: bool = False) -> DataFrame:
    """skills with their warnings; the repair set is where there are any. strict: words of the sources are banned too."""
    return skills.withColumn("warnings", skill_warnings(F.col("skill"), max_words, strict)).withColumn("ok", F.size("warnings") == 0)


def skill_stats(validated: DataFrame) -> DataFrame:
    """Skills by family of warning, and the good ones under "ok"."""
    rows = validated.select(F.explode(F.when(F.col("ok"), F.array(F.lit("ok"))).otherwise(F.col("warnings"))).alias("w"))
    return rows.groupBy(F.substring_index("w", ":", 1).alias("family")).agg(F.count("*").alias("n"))


def skill_manifest(requests: DataFrame, answers: DataFrame, max_words: int, strict: bool = False) -> DataFrame:
    """One row for each request (scenario): status (done; skipped without an answer), the skill, its warnings and
    quality_ok (null if skipped). The repair set is where quality_ok is false. answers: (scenario, skill)."""
    found = validated_skills(answers.select("scenario", "skill").where("trim(skill) <> ''"), max_words, strict)
    rows = requests.select("scenario").join(found, "scenario", "left")
    return rows.select("scenario", F.when(F.col("skill").isNull(), "skipped").otherwise("done").alias("status"), "skill", "warnings", F.col("ok").alias("quality_ok"))


def repair_requests(manifest: DataFrame, template: str, max_words: int) -> DataFrame:
    """(scenario, prompt) for each skill with warnings: the template with {skill}, {warnings} (one a line) and {max_words}."""
    rows = manifest.where("not quality_ok")
    return request_rows(rows, template, {"skill": F.col("skill"), "warnings": F.array_join("warnings", "\n"), "max_words": F.lit(str(max_words))}).select("scenario", "prompt")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: requested, done, skipped, of good quality, and to be repaired."""
    return manifest.agg(F.count("*").alias("requested"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if("quality_ok").alias("quality_ok"), F.count_if(~F.col("quality_ok")).alias("to_repair"))


def with_suitability(scenarios: DataFrame, answers: DataFrame) -> DataFrame:
    """Suitability from a classifier's answers (name, response); an answer that can't be read gives the defaults."""
    j = lenient_json("response")["text"]
    parsed = answers.select("name", F.get_json_object(j, "$.score").cast("int").alias("s"), F.get_json_object(j, "$.level").alias("l"), F.from_json(F.get_json_object(j, "$.categories"), "array<string>").alias("c"))
    out = scenarios.join(parsed, "name", "left")
    level = F.when(F.lower("l").isin("high", "medium", "low"), F.lower("l")).otherwise("medium")
    return out.select(*scenarios.columns, F.coalesce("s", F.lit(5)).alias("score"), level.alias("level"), F.coalesce("c", F.array().cast("array<string>")).alias("categories"))


def category_counts(scenarios: DataFrame, cap: int) -> DataFrame:
    """Scenarios by category, and whether there are more than the cap."""
    return scenarios.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > cap)
