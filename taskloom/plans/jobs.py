"""Queries of whole jobs: run trees, sinks, stages of generation, builds, history rows; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import jsonkit as J
from ..functions import text as T
from ..operators import attempts, build, cleaning, profile, rows, runtime, scores, selection, training
from ..sources.committed import append_committed, read_committed, summaries
from ..sources.runtree import run_tree, write_run_tree
from ..sources.tables import written
from ..streaming.stateful import released_runs
from .adapters import view
from .registry import CALLS, COMPACT, EX, STRICT_HARD, TRAJ, VERDICTS, examples, query, run_rows, table, trajectories, trajectory_verdicts, vectors


def folder(spark) -> str:
    """A new folder that all machines share."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/taskloom/{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------------------------------


def verdict_files(s, d):
    v = view(s, d, "verdicts")
    body = F.when(F.col("readable"), F.to_json(F.struct("reward_type"))).otherwise("{broken")
    return v.select("run", F.replace("scenario", F.lit(" "), F.lit("_")).alias("scenario_dir"), F.col("task_id").cast("int").alias("task_id"), F.lit("verify").alias("kind"), "mode", body.alias("body"))


@query("s2_s3_run_tree", f"""SELECT task_id, coalesce(CASE WHEN NOT readable THEN 'not_json' END, 'ok') AS problem, CASE WHEN readable THEN reward_type END AS reward_type, count(*) AS n
  FROM ({VERDICTS}) v WHERE run = 'run_1' GROUP BY ALL""")
def _(s, d):
    root = folder(s)
    write_run_tree(verdict_files(s, d), root)
    files = run_tree(s, root, run=["run_1"])
    return files.groupBy(F.col("task_id").cast("long").alias("task_id"), F.coalesce("problem", F.lit("ok")).alias("problem"), F.get_json_object("body", "$.reward_type").alias("reward_type")).agg(F.count("*").alias("n"))


@query("s5_s6_committed", f"""SELECT run, scenario, task_id, reward_type, (SELECT count(*) FROM ({VERDICTS}) w WHERE NOT readable) AS bad, (SELECT count(*) FROM ({VERDICTS}) w WHERE readable) AS total FROM ({VERDICTS}) v WHERE readable""")
def _(s, d):
    path, keys = folder(s), ["run", "scenario", "task_id"]
    v = view(s, d, "verdicts").select(*keys, "reward_type", F.when(~F.col("readable"), "not_json").alias("problem"))
    append_committed(v.where("task_id < 2"), path, keys, "a", "problem", "reward_type")
    append_committed(v.where("task_id < 3 and (problem is null or task_id = 2)"), path, keys, "b", "problem", "reward_type")
    append_committed(v.where("task_id = 3"), path, keys, "c", "problem", "reward_type")
    append_committed(v, path, keys, "c", "problem", "reward_type")  # the same batch again
    totals = summaries(s, path).agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    return read_committed(s, path).select(*keys, "reward_type").join(totals)  # one row


@query("c1_cleaning_job", f"SELECT conv_id AS task_id, CASE WHEN conv_id % 11 = 5 THEN 'rejected' WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS bucket, CASE WHEN conv_id % 11 = 5 THEN 'parse_error' ELSE reason END AS reason, CASE WHEN conv_id % 11 <> 5 THEN CAST(n AS INT) END AS num_tool_calls FROM ({TRAJ}) t")
def _(s, d):
    root = folder(s)
    call = "struct<name string, arguments struct<tool_name string, arguments string>>"
    t = trajectories(s, d)
    step = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.transform(x["calls"], lambda c: F.from_json(c, call)).alias("tool_calls"), F.when(x["response"].isNotNull(), F.struct(x["response"].alias("content"))).alias("tool_response"))
    body = F.to_json(F.struct(F.col("scenario"), F.col("task_id"), F.col("task"), F.lit("m").alias("model"), F.transform("steps", step).alias("trajectory")))
    broken = F.when(F.col("task_id") % 11 == 5, F.concat(F.lit("["), body)).otherwise(body)
    keys = [F.col("run"), F.col("scenario").alias("scenario_dir"), F.col("task_id").cast("int").alias("task_id")]
    files = t.select(*keys, F.lit("trajectory").alias("kind"), F.lit(None).cast("string").alias("mode"), broken.alias("body"))
    v = trajectory_verdicts(s, d).select(*keys, F.lit("verify").alias("kind"), F.lit("code").alias("mode"), F.to_json(F.struct("reward_type")).alias("body"))
    write_run_tree(files.unionByName(v), root)
    return cleaning.cleaning_job(run_tree(s, root), folder(s))["rows"].select("task_id", "bucket", "reason", "num_tool_calls")


@query("x4_released_runs", f"""SELECT run, n AS attempted, good AS verified, CASE WHEN run = 'run_1' THEN n * 2 ELSE n END AS expected
  FROM (SELECT run, count(*) AS n, count(*) FILTER (readable) AS good FROM ({VERDICTS}) v GROUP BY run) x WHERE run = 'run_0'""")
def _(s, d):
    v = view(s, d, "verdicts")
    plan = v.groupBy("run").agg((F.count("*") * F.when(F.col("run") == "run_1", 2).otherwise(1)).alias("expected")).withColumn("interrupted", F.col("run") == "run_2")
    return released_runs(v.select("run", F.col("scenario").alias("scenario_dir"), "task_id", F.when(F.col("readable"), F.col("reward_type")).alias("reward_type")), plan)


# --- scores, training -------------------------------------------------------------------------------------------


@query("a1_bad_files", f"""SELECT run, count(*) FILTER (readable) AS total, count(*) FILTER (readable AND reward_type = 'complete') AS complete, count(*) FILTER (readable AND reward_type = 'complete') / count(*) FILTER (readable) AS score,
  round(500.0 / count(*) FILTER (readable) * 100, 9) AS seconds_per_100, count(*) FILTER (NOT readable) AS bad_files FROM ({VERDICTS}) v GROUP BY run""")
def _(s, d):
    v = view(s, d, "verdicts")
    got = scores.run_scores(v.where("readable").withColumn("elapsed_seconds", F.lit(500.0)), v.where("not readable").select("run", F.col("scenario").alias("file")))
    return got.withColumn("seconds_per_100", F.round("seconds_per_100", 9))


HARD_NAMES = """list_filter([CASE WHEN call_tools = 0 THEN 'no_call_tool_path' END, CASE WHEN errors > 0 AND errors / call_tools >= 0.3 THEN 'high_tool_error_rate' END, CASE WHEN n_http_500 > 0 THEN 'http_500' END, CASE WHEN n_timeout > 0 THEN 'timeout' END,
  CASE WHEN coalesce(repeated, 0) > 0 THEN 'repeated_schema_or_route_error' END, CASE WHEN call_tools > 0 AND "empty" > 0 AND non_empty = 0 THEN 'only_empty_or_not_found_tool_responses' END], lambda x: x IS NOT NULL)"""


@query("a6_strict_reasons", f"""WITH h AS ({STRICT_HARD}), n AS (SELECT *, CASE WHEN reward_type = 'complete' THEN [] WHEN NOT readable THEN ['missing_or_bad_trajectory'] ELSE {HARD_NAMES} END AS names FROM h),
  c AS (SELECT scenario, task_id, string_agg(name || ':' || CAST(k AS VARCHAR), ' ' ORDER BY name) AS counted FROM (SELECT scenario, task_id, name, count(*) AS k FROM (SELECT scenario, task_id, unnest(names) AS name FROM n) u GROUP BY ALL) w GROUP BY ALL)
  SELECT n.scenario, n.task_id, CASE WHEN bool_or(reward_type = 'complete') THEN 'complete_in_at_least_one_run' WHEN count(*) < 3 THEN 'missing_run_records:' || CAST(3 - count(*) AS VARCHAR) WHEN min(len(names)) > 0 THEN any_value(counted)
    ELSE string_agg(run || CASE WHEN len(names) > 0 THEN ':hard' ELSE ':not_hard' END, ' ' ORDER BY run) END AS reasons FROM n LEFT JOIN c USING (scenario, task_id) GROUP BY ALL""")
def _(s, d):
    return runtime.strict_decisions(*run_rows(s, d), expected_runs=3).select("scenario", "task_id", F.array_join("reasons", " ").alias("reasons"))


RATES = ("format_error", "environment_error", "completed", "partial", "agent_error", "hallucination", "invalid_json", "disagreement", "blocked")


@query("a19_training_health", """SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run, round(avg(CAST(event_id % 5 = 0 AS INT)), 9) AS format_error_rate, round(avg(CAST(event_type = 'error' AS INT)), 9) AS environment_error_rate, round(avg(CAST(event_type = 'purchase' AS INT)), 9) AS completed_rate, round(avg(CAST(event_type = 'signup' AS INT)), 9) AS partial_rate, round(avg(CAST(event_type = 'view' AS INT)), 9) AS agent_error_rate,
  round(avg(CAST(event_id % 7 = 0 AS INT)), 9) AS hallucination_rate, round(avg(CAST(event_id % 11 = 0 AS INT)), 9) AS invalid_json_rate, round(avg(user_id), 6) AS mean_length, round(avg(CAST(event_id % 4 = 0 AND event_type <> 'purchase' AS INT)), 9) AS disagreement_rate, round(avg(CAST(event_id % 6 = 0 AS INT)), 9) AS blocked_rate FROM events GROUP BY 1""")
def _(s, d):
    kind = {"error": "server_error", "purchase": "complete", "signup": "incomplete", "view": "agent_error", "click": "judge_error"}
    e, mod = table(s, d, "events"), lambda k: F.col("event_id") % k == 0
    r = e.select(F.concat(F.lit("run_"), (F.col("event_id") % 3).cast("string")).alias("run"), F.create_map(*[F.lit(x) for p in kind.items() for x in p])[F.col("event_type")].alias("reward_type"), F.when(mod(4), "complete").alias("judge_class"), mod(5).alias("format_error"), mod(7).alias("hallucinated"), mod(11).alias("invalid_json"), F.col("user_id").alias("length"), mod(6).alias("blocked"))
    return scores.training_health(r).select("run", *[F.round(f"{c}_rate", 9).alias(f"{c}_rate") for c in RATES], F.round("mean_length", 6).alias("mean_length"))


@query("w8_history_rows", """WITH m AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
  t AS (SELECT conv_id, no, min(turn) AS turn, string_agg(role || ':' || text, '|' ORDER BY turn) AS said, arg_min(text, turn) FILTER (role = 'system') AS sys, arg_min(text, turn) FILTER (role = 'user') AS usr, arg_min(text, turn) AS target FROM m GROUP BY ALL)
  SELECT a.conv_id, a.turn, md5(a.target) AS target, md5(arg_min(b.sys, b.no) FILTER (b.sys IS NOT NULL)) AS system, md5(arg_min(b.usr, b.no) FILTER (b.usr IS NOT NULL)) AS first_user, md5(max(b.said) FILTER (b.no = 1)) AS first_exchange, count(*) FILTER (b.no > 1 AND b.no >= a.no - 3) AS n_history,
    md5(coalesce(string_agg(b.said, '||' ORDER BY b.no) FILTER (b.no > 1 AND b.no >= a.no - 3), '')) AS history FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.no < a.no WHERE a.no > 0 GROUP BY a.conv_id, a.turn, a.target""")
def _(s, d):
    said = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    h = training.history_rows(table(s, d, "conversations"))
    md5 = lambda c, name: F.md5(c).alias(name)
    return h.select("conv_id", "turn", md5(F.col("target"), "target"), md5(F.col("system"), "system"), md5(F.col("first_user"), "first_user"), md5(said("first_exchange"), "first_exchange"), F.size("history").cast("long").alias("n_history"), md5(F.array_join(F.transform("history", said), "||"), "history"))


# --- texts ------------------------------------------------------------------------------------------------------


@query("p10_p11_cuts", """SELECT o_orderkey, '{"items":[' || array_to_string(list_transform(range(least(10, o_orderkey % 25)), lambda x: CAST(x AS VARCHAR)), ',') || '],"s":"' || CASE WHEN o_custkey % 600 > 300 THEN repeat('é', 300) || '...[truncated ' || CAST(o_custkey % 600 - 300 AS VARCHAR) || ' chars]' ELSE repeat('é', o_custkey % 600) END || '"}' AS content,
  o_orderkey % 25 > 10 OR o_custkey % 600 > 300 AS truncated, array_to_string(list_filter([CASE WHEN o_orderkey % 25 > 10 THEN '$.items list ' || CAST(o_orderkey % 25 - 10 AS VARCHAR) END, CASE WHEN o_custkey % 600 > 300 THEN '$.s string 300' END], lambda x: x IS NOT NULL), '; ') AS cuts FROM orders""")
def _(s, d):
    o = table(s, d, "orders")
    items = F.expr("array_join(transform(slice(sequence(0, 24), 1, cast(o_orderkey % 25 as int)), x -> cast(x as string)), ', ')")
    text = F.concat(F.lit('{"items": ['), items, F.lit('], "s": "'), F.expr("repeat('é', cast(o_custkey % 600 as int))"), F.lit('"}'))
    cut = lambda x: F.concat_ws(" ", x["path"], x["type"], F.coalesce(x["omitted_count"], x["kept_chars"]).cast("string"))
    return o.select("o_orderkey", J.observation()(text).alias("o")).select("o_orderkey", "o.content", "o.truncated", F.array_join(F.transform("o.truncations", cut), "; ").alias("cuts"))


@query("p11_text_cuts", f"""SELECT doc_id, CASE WHEN length(c) > 800 THEN substr(c, 1, 800) || '...[truncated ' || CAST(length(c) - 800 AS VARCHAR) || ' chars]' ELSE c END AS content, length(c) > 800 AS truncated FROM (SELECT doc_id, {COMPACT} AS c FROM documents) x""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", J.observation()("text").alias("o")).select("doc_id", "o.content", "o.truncated")


STRICT_WORDS = ("", " It has Schemas", " A log of an example", " logs, EXAMPLES and a schema")


@query("p22_c5_repairs", r"""SELECT doc_id AS scenario, 'Mend: ' || w || chr(10) || 'to 400 words' AS prompt FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'banned_terms:\bschemas?\b' WHEN 2 THEN 'banned_terms:\bexamples?\b' || chr(10) || 'banned_terms:\blogs?\b' WHEN 3 THEN 'banned_terms:\bexamples?\b' || chr(10) || 'banned_terms:\blogs?\b' || chr(10) || 'banned_terms:\bschemas?\b' END AS w FROM documents) x WHERE doc_id % 4 <> 0""")
def _(s, d):
    good = "\n".join(T.SKILL_SECTIONS) + "\nConfidence: high"
    more = F.get(F.array(*map(F.lit, STRICT_WORDS)), (F.col("doc_id") % 4).cast("int"))
    skills = table(s, d, "documents").select(F.col("doc_id").alias("scenario"), F.concat(F.lit(good), more).alias("skill"))
    m = selection.skill_manifest(skills, skills, 400, strict=True)
    return selection.repair_requests(m, "Mend: {warnings}\nto {max_words} words", 400)


# --- tables -----------------------------------------------------------------------------------------------------


@query("j5_kept_allowlist", "SELECT 's' || CAST(o_custkey % 60 AS VARCHAR) AS scenario, o_orderkey % 6 AS task_id, min(o_orderkey) AS pos FROM orders WHERE o_custkey % 60 < 50 AND o_orderkey % 6 < 4 GROUP BY ALL")
def _(s, d):
    allow = table(s, d, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 60).cast("string")).alias("scenario"), (F.col("o_orderkey") % 6).alias("task_id"), F.col("o_orderkey").alias("pos"))
    t = table(s, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")).alias("scenario")).distinct().withColumn("tasks", F.array(*[F.lit("t")] * 4))
    return rows.required_allowlist(allow, t, "pos")


@query("a12_merged_profile", "SELECT count(*) AS n_rows, round(avg(l_quantity), 6) AS quantity_avg, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, true AS keys_near, true AS median_near FROM lineitem")
def _(s, d):
    t = table(s, d, "lineitem")
    parts = [profile.profile_sketch(t.where(f"l_orderkey % 4 = {k}"), ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity")}) for k in range(4)]
    kept = written(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    exact = t.agg(F.count_distinct("l_orderkey", "l_linenumber").alias("exact"), F.array_sort(F.collect_set("l_quantity")).alias("values"))  # fifty different quantities
    m = profile.merged_profile(kept, ["quantity"]).join(exact)  # one row each
    return m.select("n_rows", F.round("quantity_avg", 6).alias("quantity_avg"), "quantity_min", "quantity_max", (F.abs(F.col("n_keys") / F.col("exact") - 1) < 0.05).alias("keys_near"), (F.abs(F.array_position("values", F.col("quantity_p50")) / F.size("values") - 0.5) < 0.05).alias("median_near"))


# --- examples, stages -------------------------------------------------------------------------------------------


@query("t2_covering_examples", f"""WITH RECURSIVE e AS (SELECT x.*, t.tools FROM ({EX}) x JOIN (SELECT run || '/' || scenario AS scenario, task_id, list(DISTINCT full_tool) AS tools FROM ({CALLS}) c GROUP BY ALL) t USING (scenario, task_id)),
  g AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY num_tool_calls, task_id) AS rn FROM e WHERE reward_type = 'complete'),
  r AS (SELECT DISTINCT scenario, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS tools FROM e UNION ALL
    SELECT scenario, rn, CASE WHEN take THEN list_append(taken, task_id) ELSE taken END, CASE WHEN take THEN list_distinct(list_concat(tools, more)) ELSE tools END
    FROM (SELECT r.scenario, g.rn, g.task_id, r.taken, r.tools, g.tools AS more, len(r.taken) < 3 AND (len(list_filter(g.tools, lambda x: NOT list_contains(r.tools, x))) > 0 OR len(r.taken) < 2) AS take FROM r JOIN g ON g.scenario = r.scenario AND g.rn = r.rn + 1) z),
  f AS (SELECT scenario, arg_max(taken, rn) AS taken, arg_max(tools, rn) AS tools FROM r GROUP BY 1),
  p AS (SELECT scenario, unnest(taken) AS task_id, generate_subscripts(taken, 1) AS rank FROM f UNION ALL
    SELECT scenario, task_id, n + k FROM (SELECT g.scenario, g.task_id, len(f.taken) AS n, row_number() OVER (PARTITION BY g.scenario ORDER BY g.task_id) AS k FROM g JOIN f USING (scenario) WHERE NOT list_contains(f.taken, g.task_id)) y WHERE n + k <= 3),
  o AS (SELECT e.scenario, e.task_id, row_number() OVER (PARTITION BY e.scenario ORDER BY reward_type = 'complete', -len(list_filter(e.tools, lambda x: list_contains(f.tools, x))), num_tool_calls, e.task_id) AS place FROM e JOIN f USING (scenario) LEFT JOIN p ON p.scenario = e.scenario AND p.task_id = e.task_id WHERE p.task_id IS NULL QUALIFY place <= 2)
  SELECT scenario, task_id, 'positive' AS part, CAST(rank AS INT) AS rank FROM p UNION ALL SELECT scenario, task_id, 'negative', CAST(place AS INT) FROM o""")
def _(s, d):
    tools = view(s, d, "calls").withColumn("scenario", F.concat("run", F.lit("/"), "scenario")).groupBy("scenario", "task_id").agg(F.collect_set("full_tool").alias("tools_used"))
    return selection.covering_examples(examples(s, d).join(tools, ["scenario", "task_id"]), 3, 2)


#: A good response of each stage; of the tasks, two are asked for.
GOOD = {"scenario": '{"name":"n","description":"d"}', "tasks": '{"tasks":["a","b","c"]}', "schema": '{"tables":[]}', "sample": '{"tables":[]}', "spec": '{"api_groups":[{"endpoints":[]},{"endpoints":[{"path":"/a"}]}]}', "env": '{"code":"x = 1"}', "verifier": '{"python_code":"def v(): pass"}'}
STAGE_NAMES = "[" + ", ".join(f"'{x}'" for x in attempts.STAGES) + "]"
TRIED = f"""SELECT o_orderkey, {STAGE_NAMES}[o_custkey % 7 + 1] AS stage, o_custkey // 7 AS scenario, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, (o_orderkey % 10) / 20.0 AS error_ratio, CASE WHEN o_custkey % 7 IN (2, 3) THEN o_orderkey % 10 <= 2 ELSE o_orderkey % 3 = 0 END AS ok FROM orders"""
STATES = f"""SELECT *, CASE WHEN attempt = f THEN 'accepted' WHEN attempt > f THEN 'extra' WHEN l >= 3 AND f IS NULL AND attempt = b THEN 'fallback' WHEN l >= 3 AND f IS NULL AND attempt = l THEN 'given_up' ELSE 'retry' END AS state
  FROM (SELECT *, min(attempt) FILTER (ok) OVER w AS f, max(attempt) OVER w AS l, CASE WHEN stage IN ('schema', 'sample') THEN arg_min(attempt, error_ratio * 100000 + attempt) OVER w END AS b FROM ({TRIED}) t WINDOW w AS (PARTITION BY stage, scenario)) x"""
RESULTS = f"""SELECT stage, scenario, coalesce(max(state) FILTER (state IN ('accepted', 'fallback')), CASE WHEN bool_or(state = 'given_up') THEN 'given_up' ELSE 'retry' END) AS status, max(attempt) AS attempts, max(attempt) FILTER (state IN ('accepted', 'fallback')) AS attempt FROM ({STATES}) z GROUP BY ALL"""


def tried(s, d):
    o = table(s, d, "orders")
    at = (F.col("o_custkey") % 7).cast("int")
    good = F.get(F.array(*[F.lit(f"Here: {GOOD[x]}" if x == "tasks" else GOOD[x]) for x in attempts.STAGES]), at)
    bad = F.get(F.array(*map(F.lit, ("", '{"tasks": [', '{"name": "n", "tasks": ["a"], "api_groups": [{"endpoints": []}], "code": " "}', None))), (F.col("o_orderkey") % 4).cast("int"))
    response = F.when(at.isin(2, 3) | (F.col("o_orderkey") % 3 == 0), good).otherwise(bad)
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select("o_orderkey", F.get(F.array(*map(F.lit, attempts.STAGES)), at).alias("stage"), F.expr("o_custkey div 7").alias("scenario"), number.alias("attempt"), response.alias("response"), ((F.col("o_orderkey") % 10) / 20).alias("error_ratio"), F.array(F.concat(F.lit("e"), (F.col("o_orderkey") % 4).cast("string"))).alias("errors"))


@query("c7_attempt_states", f"SELECT o_orderkey, stage, state, CASE WHEN stage = 'tasks' AND ok THEN '{{\"tasks\":[\"a\",\"b\"]}}' END AS tasks FROM ({STATES}) s")
def _(s, d):
    j = attempts.judged_attempts(tried(s, d), n_tasks=2)
    return j.select("o_orderkey", "stage", "state", F.when((F.col("stage") == "tasks") & F.col("ok"), F.col("parsed")).alias("tasks"))


@query("c7_stage_results", RESULTS)
def _(s, d):
    return attempts.stage_results(attempts.judged_attempts(tried(s, d), n_tasks=2)).select("stage", "scenario", "status", F.col("attempts").cast("long").alias("attempts"), F.col("attempt").cast("long").alias("attempt"))


PAYLOADS = "[" + ", ".join(f"'{GOOD[x]}'" if x != "tasks" else "'{\"tasks\":[\"a\",\"b\"]}'" for x in attempts.STAGES) + "]"


@query("c6_next_requests", f"""WITH r AS ({RESULTS}), s AS (SELECT DISTINCT scenario FROM ({TRIED}) t), g AS (SELECT unnest({STAGE_NAMES}) AS stage, unnest(range(1, 8)) AS no),
  e AS (SELECT stage, scenario, string_agg(DISTINCT 'e' || CAST(o_orderkey % 4 AS VARCHAR), chr(10) ORDER BY 'e' || CAST(o_orderkey % 4 AS VARCHAR)) AS errors FROM ({TRIED}) t GROUP BY ALL)
  SELECT g.stage, s.scenario, CAST(coalesce(r.attempts, 0) + 1 AS INT) AS attempt, g.stage || ' of ' || CAST(s.scenario AS VARCHAR) || ' from ' || CASE WHEN no > 1 THEN {PAYLOADS}[no - 1] ELSE '' END || ' but ' || coalesce(e.errors, '') AS prompt
  FROM s JOIN g ON true LEFT JOIN r ON r.stage = g.stage AND r.scenario = s.scenario LEFT JOIN e ON e.stage = g.stage AND e.scenario = s.scenario
  WHERE coalesce(r.status, 'retry') = 'retry' AND (no = 1 OR EXISTS (SELECT 1 FROM r q WHERE q.scenario = s.scenario AND q.stage = {STAGE_NAMES}[no - 1] AND q.status IN ('accepted', 'fallback')))""")
def _(s, d):
    t = written(tried(s, d).withColumn("scenario", F.col("scenario").cast("string")))
    results = written(attempts.stage_results(attempts.judged_attempts(t, n_tasks=2)))
    asked = attempts.next_requests(t.select("scenario"), results, t, {x: x + " of {scenario} from {payload} but {errors}" for x in attempts.STAGES})
    return asked.withColumn("scenario", F.col("scenario").cast("long"))


@query("c7_kept_by_answer", "SELECT doc_id FROM documents WHERE (doc_id // 10) % 4 <> 0 OR doc_id % 10 = 0")
def _(s, d):
    c = table(s, d, "documents").select("doc_id", F.expr("doc_id div 10").alias("batch"), (F.col("doc_id") % 10).cast("int").alias("idx"))
    text = F.get(F.array(F.lit('So: {"decisions": [{"index": 0, "decision": "keep"}, {"index": 3, "decision": "reject"}, {"index": 99, "decision": "keep"}, {}]}'), F.lit("no idea"), F.lit('{"x": 1}')), (F.col("batch") % 4).cast("int"))
    return attempts.kept_by_answer(c, c.select("batch").distinct().select("batch", text.alias("response")).where("response is not null")).select("doc_id")


# --- builds -----------------------------------------------------------------------------------------------------


def _step(k: int) -> str:
    """Batch k of a build: what is new and diverse, one candidate after another."""
    return f"""c{k} AS (SELECT *, row_number() OVER (ORDER BY id) AS no FROM (SELECT * FROM v WHERE id % 4 = {k + 1} AND name NOT IN (SELECT name FROM p{k}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1) x),
  n{k} AS (SELECT c.id, c.no, any_value(c.e) AS e, any_value(CASE WHEN c.label IN (SELECT label FROM p{k} GROUP BY label HAVING count(*) >= 16) THEN 0.35 ELSE 0.45 END) AS most, greatest(0, max(list_cosine_similarity(c.e, p.e))) AS near FROM c{k} c, p{k} p GROUP BY c.id, c.no),
  r{k} AS (SELECT CAST(0 AS BIGINT) AS no, CAST(-1 AS BIGINT) AS id, false AS ok, CAST([] AS DOUBLE[][]) AS stay UNION ALL
    SELECT no, id, ok, CASE WHEN ok THEN list_append(stay, e) ELSE stay END FROM (SELECT n.no, n.id, n.e, r.stay, n.near <= n.most AND coalesce(list_max([list_cosine_similarity(x, n.e) for x in r.stay]), -1) <= n.most AS ok FROM r{k} r JOIN n{k} n ON n.no = r.no + 1) z),
  p{k + 1} AS (SELECT * FROM p{k} UNION ALL SELECT * FROM v WHERE id IN (SELECT id FROM r{k} WHERE ok))"""


@query("j13_c8_build", f"""WITH RECURSIVE v AS (SELECT vec_id AS id, 'name ' || CAST(vec_id % 400 AS VARCHAR) AS name, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p0 AS (SELECT * FROM v WHERE id % 4 = 0),
  {_step(0)}, {_step(1)}, {_step(2)} SELECT id, name FROM p3 WHERE id % 4 <> 0""")
def _(s, d):
    v = vectors(s, d).withColumn("name", F.concat(F.when(F.col("id") % 2 == 0, "name ").otherwise(" NAME "), (F.col("id") % 400).cast("string")))
    path = folder(s)
    batch = lambda k: v.where(f"id % 4 = {k + 1}") if k < 3 else None
    rules = build.Rules(sim=0.45, warn=0.35, cap=16)
    base = v.where("id % 4 = 0")
    build.build_diverse(base, lambda k: batch(k) if k < 1 else None, path, 10**9, rules)  # stops after a batch
    build.build_diverse(base, batch, path, 10**9, rules)  # and goes on
    return build.built(base, path).select("id", F.lower(F.trim("name")).alias("name"))


@query("c10_rollout_rows", """WITH m AS (SELECT *, role = 'assistant' AND (conv_id + turn) % 3 <> 0 AS called FROM conversations),
  x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, min(turn) FILTER (called) OVER (PARTITION BY conv_id) AS stop FROM m)
  SELECT conv_id AS task_id, CAST(pos AS INT) AS pos, CASE WHEN turn = stop THEN 'tools_not_listed' END AS violation, CASE WHEN turn = stop THEN -1.0 WHEN conv_id % 5 <> 0 THEN 1.0 ELSE 0.0 END AS reward FROM x WHERE role = 'assistant' AND (stop IS NULL OR turn <= stop)""")
def _(s, d):
    t = cleaning.with_calls(trajectories(s, d))
    return training.rollout_rows(t, trajectory_verdicts(s, d), think=False).select("task_id", "pos", "violation", "reward")
