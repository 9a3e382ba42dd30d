"""Keys, duplicates, allowlists and work units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_name, task_key


def one_by_key(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """The first or the last row of each key by an explicit order."""
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_no = 1").drop("_no")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def exploded_tasks(tasks: DataFrame) -> DataFrame:
    """(scenario, task_id from 0, task) of scenarios with arrays of tasks."""
    return tasks.select("scenario", F.posexplode("tasks").alias("task_id", "task"))


def restricted(rows: DataFrame, *lists: DataFrame, keys: tuple[str, ...] = ("scenario", "task_id")) -> DataFrame:
    """Rows whose key is in any of the allowlists; Spark broadcasts the keys when they are small."""
    allowed = reduce(lambda a, b: a.union(b), [x.select(*keys) for x in lists]).distinct()
    return rows.join(allowed, list(keys), "left_semi")


def checked_allowlist(allow: DataFrame, tasks: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, errors): unknown scenarios and task ids out of range are errors, the first of duplicates stays."""
    sizes = tasks.select("scenario", F.size("tasks").alias("n_tasks"))
    first = F.row_number().over(Window.partitionBy("scenario", "task_id").orderBy(order))
    rows = allow.join(sizes, "scenario", "left").withColumn("_first", first == 1)
    reason = F.when(F.col("n_tasks").isNull(), "unknown_scenario").when((F.col("task_id") < 0) | (F.col("task_id") >= F.col("n_tasks")), "task_id_out_of_range").when(~F.col("_first"), "duplicate")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select(*allow.columns), rows.where("reason is not null").select(*allow.columns, "reason")


def required_allowlist(allow: DataFrame, tasks: DataFrame, order: str) -> DataFrame:
    """What checked_allowlist() keeps; an error, with the numbers of the reasons, if nothing is left."""
    kept, errors = checked_allowlist(allow, tasks, order)
    if kept.isEmpty():
        reasons = ", ".join(f"{r.reason}: {r['count']}" for r in errors.groupBy("reason").count().orderBy("reason").collect())
        raise ValueError(f"no task of the allowlist is left ({reasons or 'it has no rows'})")
    return kept


def parsed_ids(text: str) -> list[int]:
    """The ids of a list like "0-5,7", in order and once each."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        out |= dict.fromkeys(range(int(a), int(b or a) + 1))
    return sorted(out)


def selected_tasks(tasks: DataFrame, ids: str) -> DataFrame:
    """Tasks with one of the given ids, where the scenario has it."""
    return exploded_tasks(tasks).where(F.col("task_id").isin(*parsed_ids(ids)))


def new_names(candidates: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Candidates whose name, lower-cased and trimmed, is not known; the first of a batch's equal names stays."""
    key = F.lower(F.trim("name"))
    fresh = candidates.withColumn("_key", key).join(known.select(key.alias("_key")).distinct(), "_key", "left_anti")
    return one_by_key(fresh, ["_key"], [order], "first").drop("_key")


def work_units(tasks: DataFrame) -> DataFrame:
    """One row for each distinct (scenario, task text), with the ids that share it."""
    return tasks.groupBy("scenario", "task").agg(F.sort_array(F.collect_list("task_id")).alias("task_ids"))


def environment_bundle(tables: dict[str, DataFrame], tasks: DataFrame, verifiers: DataFrame, order: str = "pos") -> DataFrame:
    """One row for each task with a flag for each scenario-level table and the verifier; only keys are joined.

    Names are normalised first, and the last row of a key counts.
    """
    name = normalized_name(F.col("scenario"))
    out = exploded_tasks(one_by_key(tasks.withColumn("scenario", name), ["scenario"], [order]))
    for t, df in tables.items():
        out = out.join(df.select(name.alias("scenario")).distinct().withColumn(f"has_{t}", F.lit(True)), "scenario", "left")
    v = verifiers.select(name.alias("scenario"), F.col("task_idx").alias("task_id")).distinct().withColumn("has_verifier", F.lit(True))
    out = out.join(v, ["scenario", "task_id"], "left")
    return out.select("scenario", "task_id", "task", task_key(F.col("scenario"), F.col("task_id")).alias("task_key"), *[F.coalesce(f"has_{t}", F.lit(False)).alias(f"has_{t}") for t in [*tables, "verifier"]])


def missing_sources(bundle: DataFrame) -> DataFrame:
    """bundle with `missing`: env, db_schema and sample that are missing, comma-joined in that order, else null."""
    gone = F.concat_ws(",", *[F.when(~F.col(f"has_{t}"), f"missing_{t}") for t in ("env", "db_schema", "sample")])
    return bundle.withColumn("missing", F.nullif(gone, F.lit("")))


def static_gate(bundle: DataFrame, checks: DataFrame, outcomes: DataFrame, known_bad: DataFrame) -> DataFrame:
    """(scenario, task_id, reason) with the first reason that fails each task, null where it is accepted.

    checks: (scenario, task_id, ok) of the verifier's code; outcomes: (scenario, task_id, db_error, execution_status,
    result) of a reset and of a run that does nothing, which has to end in success; known_bad: (scenario, task_id).
    """
    key = ["scenario", "task_id"]
    rows = missing_sources(bundle).join(known_bad.select(*key).distinct().withColumn("bad", F.lit(True)), key, "left")
    rows = rows.join(checks.select(*key, F.col("ok")), key, "left").join(outcomes, key, "left")
    reason = F.coalesce(
        F.when(F.col("bad"), F.lit("known_bad_task")), F.col("missing"), F.when(~F.col("has_verifier"), F.lit("missing_verifier")),
        F.when(~F.coalesce("ok", F.lit(False)), F.lit("bad_verifier_compile")), F.when(F.col("db_error").isNotNull(), F.lit("db_reset_error")),
        F.when(F.coalesce(F.col("execution_status") != "success", F.lit(True)), F.lit("noop_verifier_error")), F.when(F.col("result") == "complete", F.lit("noop_complete")),
    )
    return rows.select(*key, reason.alias("reason"))


def gate_totals(gate: DataFrame) -> DataFrame:
    """Tasks by reason (accepted: null reason as "accepted"), overall (scenario null) and by scenario."""
    return gate.withColumn("reason", F.coalesce("reason", F.lit("accepted"))).groupingSets([["scenario", "reason"], ["reason"]], "scenario", "reason").agg(F.count("*").alias("n"))


def contexts(envs: DataFrame, schemas: DataFrame) -> DataFrame:
    """(scenario, env_text, schema_text) of every scenario that either side has; a missing side is "unavailable"."""
    gone = F.lit("unavailable")
    return envs.join(schemas, "scenario", "full").select("scenario", F.coalesce("env_text", gone).alias("env_text"), F.coalesce("schema_text", gone).alias("schema_text"))


def profile(df: DataFrame, keys: list[str], measures: dict[str, Column], approximate: bool = False) -> DataFrame:
    """Rows, distinct keys, and average, least and greatest of each measure."""
    distinct = F.approx_count_distinct(F.struct(*keys)) if approximate else F.count_distinct(*keys)
    parts = [f(c).alias(f"{n}_{p}") for n, c in measures.items() for p, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return df.agg(F.count("*").alias("n_rows"), distinct.alias("n_keys"), *parts)


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
