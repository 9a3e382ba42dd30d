"""Queries over the driver tables, and their SQL. Each applies one operator of the library to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import code as K
from ..functions import jsonkit as J
from ..functions import text as T
from ..functions import variants as V
from ..operators import cleaning, diversity, rows, runtime, scores, selection, state, training
from ..sources.tables import written
from ..streaming import live
from .adapters import over, view, view_sql

CALLS, VERDICTS = view_sql("calls"), view_sql("verdicts")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified calls; saved, as counters and signatures both read them."""
    return runtime.classified_calls(run_calls(spark, sf_dir), V.payload_flags("response"))


def run_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "calls").withColumn("is_final", F.col("iteration") % 50 == 0)


def run_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = classified(spark, sf_dir)
    return runtime.run_rows(view(spark, sf_dir, "verdicts"), runtime.run_counters(c)), runtime.error_signatures(c)


# --- scalar functions -------------------------------------------------------------------------------------------

NAME = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g')"


@query("p1_p4_names", f"""SELECT c_custkey, trim({NAME.format(c="c_name || ' / ' || c_mktsegment")}, '_') AS name,
  trim(regexp_replace(c_name || '?/' || c_mktsegment, '[^a-zA-Z0-9_.-]+', '_', 'g'), '_') AS file, c_mktsegment AS run, c_name || '/task_' || CAST(c_nationkey AS VARCHAR) AS task FROM customer""")
def _(s, d):
    both = F.concat("c_name", F.lit("?/"), "c_mktsegment")
    return table(s, d, "customer").select("c_custkey", T.normalized_name(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("name"), T.file_safe(both).alias("file"), T.run_component(both).alias("run"), T.task_key(F.col("c_name"), F.col("c_nationkey")).alias("task"))


COMPACT = r"trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"


@query("p5_truncated", rf"""SELECT doc_id, CASE WHEN length(c) > 300 THEN substr(c, 1, 300) || '...[truncated ' || CAST(length(c) - 300 AS VARCHAR) || ' chars]' ELSE c END AS short FROM (SELECT doc_id, {COMPACT} AS c FROM documents) x""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.truncated(T.compact_space(F.col("text")), 300).alias("short"))


ERROR = """CASE WHEN response LIKE 'Error:%' THEN CASE WHEN regexp_matches(response, '(?i)\\b(500|internal server error)\\b') THEN 'http_500' WHEN regexp_matches(response, '(?i)\\b(timeout|timed out)\\b') THEN 'timeout'
  WHEN regexp_matches(response, '(?i)(input validation error|required property|validationerror|invalid)') THEN 'validation' WHEN regexp_matches(response, '(?i)(not found|404|no route|unknown tool|unexpected keyword|missing .*argument)') THEN 'route_or_schema' ELSE 'tool_error' END END"""
SPLIT = "(args LIKE '%\"id\": 1}')"
LABEL = f"CASE WHEN name = 'call_tool' THEN CASE WHEN {ERROR} = 'validation' AND {SPLIT} THEN 'agent_argument_parse_error' ELSE {ERROR} END END"
CALLED = f"""SELECT *, substr(full_tool, 10) AS tool, {ERROR} AS error, {LABEL} AS label, response NOT LIKE 'Error:%' AND response <> '{{"items": []}}' AS full_, response = '{{"items": []}}' OR (response LIKE 'Error:%' AND regexp_matches(response, '(?i)\\b(no .*found|not found|empty|does not exist|not available|unavailable)\\b')) OR response = 'item does not exist' AS empty_ FROM ({CALLS}) c"""


@query("p9_p15_call_facts", f"""SELECT iteration, tool, error, {SPLIT} AS split, regexp_matches(tool, '(^|_)(create|update|delete|set)_') AS mutating,
  lower(response) LIKE '%timeout%' OR lower(response) LIKE '%server error%' OR lower(response) LIKE '%traceback%' AS phrase FROM ({CALLED}) x""")
def _(s, d):
    c = view(s, d, "calls")
    tool = C.call_tool_name(F.col("args"))
    return c.select("iteration", tool.alias("tool"), T.error_class(F.col("response")).alias("error"), C.has_split_arguments(F.col("args")).alias("split"), T.is_mutating(tool).alias("mutating"), T.has_error_phrase(F.col("response")).alias("phrase"))


@query("p14_payload_flags", f"""SELECT iteration, response NOT LIKE 'Error:%' AND response <> 'item does not exist' AS json_like, full_ AS non_empty, empty_ AS empty_signal FROM ({CALLED}) x""")
def _(s, d):
    return view(s, d, "calls").select("iteration", V.payload_flags("response").alias("f")).select("iteration", "f.*")


@query("p10_p11_observations", """SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END AS type, replace(props, ': ', ':') AS content FROM events""")
def _(s, d):
    return table(s, d, "events").select("event_id", J.observation()("props").alias("o")).select("event_id", "o.type", "o.content")


@query("p16_p17_judge", """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CASE event_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'agent_error' ELSE 'judge_error' END ELSE 'judge_error' END AS class FROM events""")
def _(s, d):
    said = F.expr("""CASE WHEN event_id % 5 < 4 THEN 'Well: {"classification": "' || CASE event_id % 3 WHEN 0 THEN ' Complete' WHEN 1 THEN 'agent_error' ELSE 'fine' END || '"} so' ELSE 'no json {' END""")
    return table(s, d, "events").select("event_id", J.judge_class(said).alias("class"))


@query("p6_p8_calls_in_text", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'get_item' ELSE 'find' END AS tool, '{"id":' || CAST(turn AS VARCHAR) || '}' AS args, true AS args_parse_ok FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 <> 0""")
def _(s, d):
    inner = F.concat(F.lit('{\\"id\\":'), F.col("turn").cast("string"), F.lit("}"))
    call = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"name": "call_tool", "arguments": {"tool_name": "get_item", "arguments": "'), inner, F.lit('"}}'))).otherwise(F.concat(F.lit('{"name": "find", "arguments": {"id":'), F.col("turn").cast("string"), F.lit("}}")))
    text = F.when(((F.col("conv_id") + F.col("turn")) % 3 != 0), F.concat("text", F.lit("<tool_call> "), call, F.lit(" </tool_call><tool_call>{}</tool_call>"))).otherwise(F.concat("text", F.lit("<tool_call>[1]</tool_call>")))
    none = F.lit(None).cast("array<string>")
    step = F.array(F.struct(F.col("role"), text.alias("content"), none.alias("calls"), F.lit("").alias("response")))
    m = table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(C.steps_with_calls(step)[0]["calls"]).alias("call"))
    return m.withColumn("c", C.normalized_call(F.col("call"))).select("conv_id", "turn", "c.*")


@query("p18_verifier_code", """SELECT p_partkey, p_partkey % 4 = 0 AS ok, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'too_short' WHEN 2 THEN 'syntax_error' ELSE 'no_verify_function' END AS reason, CASE WHEN p_partkey % 4 = 0 THEN 'verify_' || CAST(p_partkey AS VARCHAR) ELSE 'verify_task' END AS function FROM part""")
def _(s, d):
    code = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'def verify_' || p_partkey || '(a, b):\\n    return {}' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'def broken(:\\n    pass' ELSE 'def other(a, b):\\n    return 1' END")
    return table(s, d, "part").select("p_partkey", K.verifier_check(code).alias("v"), K.verifier_name(code, "verify_task").alias("function")).select("p_partkey", "v.*", "function")


@query("p19_p21_ddl_summary", """SELECT p_partkey, '- `part' || CAST(p_partkey AS VARCHAR) || '` columns: id pk important, name required, ' || CASE WHEN p_partkey % 3 = 0 THEN 'status unique default important, ' ELSE '' END || 'size' || chr(10) || '  constraints: CHECK (size > ' || CAST(p_size AS VARCHAR) || ')'
  || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '  indexes: CREATE INDEX i ON part (name)' ELSE '' END AS summary FROM part""")
def _(s, d):
    ddl = F.expr("'CREATE TABLE part (id INTEGER PRIMARY KEY, name TEXT NOT NULL, ' || CASE WHEN p_partkey % 3 = 0 THEN 'status TEXT UNIQUE DEFAULT (1), ' ELSE '' END || 'size NUMERIC(10, 2), CHECK  (size > ' || p_size || '))'")
    indexes = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("CREATE  INDEX i ON part (name)"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "part").select("p_partkey", K.table_summary(F.concat(F.lit("part"), F.col("p_partkey").cast("string")), K.ddl_columns(ddl), indexes).alias("summary"))


@query("p20_endpoints", """WITH e AS (SELECT p_partkey AS k, p_size, p_brand, unnest(range(2)) AS no FROM part)
  SELECT 's' || CAST(k AS VARCHAR) AS scenario, CAST(no AS INT) AS no, CASE no WHEN 0 THEN 'GET' ELSE 'POST' END AS method, CASE no WHEN 0 THEN '/parts/' || CAST(p_size AS VARCHAR) ELSE '/parts' END AS path, CASE no WHEN 0 THEN p_brand END AS summary, CASE no WHEN 1 THEN 'Adds' END AS description,
  CASE no WHEN 0 THEN 'read' ELSE 'add' END AS function, CASE no WHEN 0 THEN 'part_id' ELSE 'body,dry' END AS parameters, CASE no WHEN 0 THEN 'int' ELSE 'Part,bool' END AS kinds, k % 5 <> 0 AS parsed FROM e""")
def _(s, d):
    code = F.expr("""'@app.get("/parts/' || p_size || '", summary="' || p_brand || '")\\nasync def read(part_id: int):\\n    return 1\\n@mock.patch("x")\\ndef test(a):\\n    pass\\n' ||
      '@app.post(\\n    "/parts",\\n    description="Adds")\\ndef add(request, body: Part, *, dry: bool = False):\\n    return 2\\n' || CASE WHEN p_partkey % 5 = 0 THEN 'def broken(:' ELSE '' END""")
    t = K.endpoint_table(table(s, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("scenario"), code.alias("full_code")))
    return t.withColumn("parameters", F.array_join("parameters", ",")).withColumn("kinds", F.array_join("kinds", ","))


@query("p27_input_schema", """SELECT 't' || CAST(p_partkey AS VARCHAR) AS tool, path, type, path = 'id' AS required, CASE WHEN path = 'id' THEN CAST(p_size AS VARCHAR) END AS "default" FROM part, (VALUES ('id', 'integer'), ('box', 'object'), ('box.w', 'number')) v(path, type)""")
def _(s, d):
    schema = F.expr("""'{"required": ["id"], "properties": {"id": {"type": "integer", "default": ' || p_size || '}, "box": {"type": "object", "properties": {"w": {"type": "number"}}}}}'""")
    return V.flat_schema(table(s, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("tool"), schema.alias("schema"))).select("tool", "path", "type", "required", "default")


@query("p22_c5_skill_stats", """SELECT family, count(*) AS n FROM (SELECT doc_id, unnest(['missing_sections', 'confidence_count'] || CASE WHEN w > 400 THEN ['too_long'] ELSE [] END) AS family FROM (SELECT doc_id, len(string_split(""" + COMPACT + """, ' ')) AS w FROM documents) y) x GROUP BY family""")
def _(s, d):
    return selection.skill_stats(selection.validated_skills(table(s, d, "documents").select("doc_id", F.col("text").alias("skill")), 400))


@query("p21_schema_text", """SELECT n_regionkey, 'Database Schema (SQLite3):' || chr(10) || chr(10) || string_agg('CREATE TABLE ' || n_name || ' (id)' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || 'CREATE INDEX i' || CAST(n_nationkey AS VARCHAR) ELSE '' END, chr(10) || chr(10) ORDER BY n_name) AS text FROM nation GROUP BY 1""")
def _(s, d):
    indexes = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit(" CREATE INDEX i"), F.col("n_nationkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    t = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("CREATE TABLE "), "n_name", F.lit(" (id)\n")).alias("ddl"), indexes.alias("indexes"))
    return table(s, d, "nation").groupBy("n_regionkey").agg(T.schema_text(F.array_sort(F.collect_list(t))).alias("text"))


@query("p21_tool_summary", """SELECT p_partkey, '- `mcp_tool_mcp_server_read`: GET /p/' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '; args: id, ' || p_brand ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '; ' || p_name ELSE '' END AS text FROM part""")
def _(s, d):
    names = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("id"), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    e = F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/p/"), F.col("p_size").cast("string")).alias("path"), F.lit("").alias("summary"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("description"), F.lit("read").alias("function"), names.alias("parameters"))
    return table(s, d, "part").select("p_partkey", T.tool_summary(F.array(e)).alias("text"))


@query("p23_scenario_text", """SELECT doc_id, coalesce(source, '') || ': ' || coalesce(substr(text, 1, 500), '') || ' Categories: ' || concat_ws(', ', lang, source) || '. Features: ' || coalesce(lang, '') AS text FROM documents""")
def _(s, d):
    r = table(s, d, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("description"), F.array("lang", "source").alias("categories"), F.array("lang").alias("simulatable_features"))
    return r.select("doc_id", T.scenario_text().alias("text"))


@query("p25_valid_results", f"SELECT run, mode, count(*) AS n FROM ({VERDICTS}) v WHERE task_id <> 1 GROUP BY ALL")
def _(s, d):
    v = view(s, d, "verdicts").withColumn("verdict", F.when(F.col("task_id") != 1, F.lit("{}")))
    return v.where(T.is_valid_result("code", F.col("mode"), F.col("reward_type"), F.col("verdict"))).groupBy("run", "mode").agg(F.count("*").alias("n"))


@query("t4_scenario_subset", "SELECT 'Supplier#' AS kind, CAST(n AS VARCHAR) AS scenario FROM (SELECT s_suppkey AS n FROM supplier WHERE s_suppkey IN (1, 2, 3, 5)) x ORDER BY scenario LIMIT 3")
def _(s, d):
    names = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("scenario"))
    return selection.scenario_subset(names, ["1", "2", "3", "5", "none"], 3)[0].select(F.lit("Supplier#").alias("kind"), "scenario")


@query("j2_missing_sources", f"SELECT scenario, task_id, CASE WHEN NOT has_env THEN 'missing_env' WHEN NOT has_db_schema THEN 'missing_db_schema' WHEN NOT has_sample THEN 'missing_sample' END AS missing FROM ({{bundle}}) b")
def _(s, d):
    return rows.missing_sources(bundle(s, d)).select("scenario", "task_id", "missing")


@query("p26_tool_description", """SELECT doc_id, array_to_string([trim(x, ' ') for x in string_split(text, chr(10)) if trim(x, ' ') <> ''], chr(10)) AS short FROM documents""")
def _(s, d):
    stop = F.element_at(F.array(*map(F.lit, T.DESCRIPTION_STOPS)), (F.col("doc_id") % len(T.DESCRIPTION_STOPS) + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", T.tool_description(F.concat("text", F.lit("\r\n  "), stop, F.lit(" x\nmore"))).alias("short"))


@query("p28_rewards", f"""SELECT run, reward_type, CASE reward_type WHEN 'complete' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, count(*) AS n FROM ({VERDICTS}) v GROUP BY ALL""")
def _(s, d):
    return view(s, d, "verdicts").groupBy("run", "reward_type", T.reward_value(F.col("reward_type")).alias("value")).agg(F.count("*").alias("n"))


# --- repeated runs ----------------------------------------------------------------------------------------------

COUNTERS = f"""SELECT run, scenario, task_id, count(*) AS tool_calls, count(*) FILTER (name = 'call_tool') AS call_tools, count(*) FILTER (name = 'list_tools') AS list_tools, bool_or(iteration % 50 = 0) AS final_seen,
  count(*) FILTER (name = 'call_tool' AND regexp_matches(tool, '(^|_)(create|update|set)_')) AS mutating_calls, count(*) FILTER (name = 'call_tool' AND label IS NULL AND full_) AS non_empty,
  count(*) FILTER (name = 'call_tool' AND label IS NULL AND NOT full_ AND empty_) AS "empty",
  {', '.join(f"count(*) FILTER (label = '{x}') AS n_{x}" for x in ('http_500', 'timeout', 'validation', 'route_or_schema', 'tool_error', 'agent_argument_parse_error'))} FROM ({CALLED}) x GROUP BY run, scenario, task_id"""
SIGS = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, scenario, task_id ORDER BY n DESC, f) AS rank FROM (SELECT run, scenario, task_id, tool || ':' || label || ':' || substr(response, 1, 160) AS signature, count(*) AS n, min(iteration) AS f FROM ({CALLED}) x WHERE label IS NOT NULL GROUP BY ALL) y) z WHERE rank <= 10"""
RUNS = f"""SELECT v.*, c.* EXCLUDE (run, scenario, task_id), n_http_500 + n_timeout + n_validation + n_route_or_schema + n_tool_error AS errors FROM ({VERDICTS}) v JOIN ({COUNTERS}) c USING (run, scenario, task_id)"""
REPEAT = f"""SELECT scenario, task_id, count(*) AS repeated FROM (SELECT scenario, task_id, signature, sum(n) AS n FROM ({SIGS}) s GROUP BY ALL) t WHERE n >= 2 AND (signature LIKE '%:validation:%' OR signature LIKE '%:route_or_schema:%') GROUP BY ALL"""
LENIENT = f"""SELECT scenario, task_id, CASE WHEN bad > 0 OR call_tools = 0 OR (errors > 0 AND error_rate >= 0.3) OR h > 0 OR t > 0 OR repeated > 0 OR (er = runs AND fr = 0) THEN 'reject' WHEN completed THEN 'keep' ELSE 'review' END AS decision, error_rate, bad, call_tools, h, t, repeated
  FROM (SELECT *, CASE WHEN call_tools > 0 THEN errors / call_tools ELSE 0.0 END AS error_rate FROM (SELECT scenario, task_id, count(*) AS runs, count(*) FILTER (NOT readable) AS bad, bool_or(reward_type = 'complete') AS completed, coalesce(sum(call_tools) FILTER (readable), 0) AS call_tools, coalesce(sum(errors) FILTER (readable), 0) AS errors, coalesce(sum(n_http_500) FILTER (readable), 0) AS h, coalesce(sum(n_timeout) FILTER (readable), 0) AS t,
  count(*) FILTER (readable AND "empty" > 0) AS er, count(*) FILTER (readable AND non_empty > 0) AS fr FROM ({RUNS}) r GROUP BY ALL) a LEFT JOIN ({REPEAT}) p USING (scenario, task_id)) b"""
LENIENT = LENIENT.replace("OR repeated > 0", "OR coalesce(repeated, 0) > 0")


@query("a4_run_counters", COUNTERS)
def _(s, d):
    return runtime.run_counters(classified(s, d))


@query("a4_error_signatures", f"SELECT run, scenario, task_id, signature, n, rank FROM ({SIGS}) q")
def _(s, d):
    return runtime.error_signatures(classified(s, d)).select("run", "scenario", "task_id", "signature", "n", "rank")


@query("a4_tools_in_error", f"""SELECT run, scenario, task_id, tool, n, row_number() OVER (PARTITION BY run, scenario, task_id ORDER BY n DESC, f) AS rank FROM (SELECT run, scenario, task_id, tool, count(*) AS n, min(iteration) AS f FROM ({CALLED}) x WHERE label IS NOT NULL GROUP BY ALL) y""")
def _(s, d):
    return runtime.tools_in_error(classified(s, d))


@query("w4_evidence", f"""SELECT * FROM (SELECT run, scenario, task_id, row_number() OVER (PARTITION BY run, scenario, task_id ORDER BY iteration) AS rank, iteration, tool, kind, substr(response, 1, 500) AS response FROM (SELECT *, coalesce(label, CASE WHEN name = 'call_tool' AND NOT full_ AND empty_ THEN 'empty_or_not_found' END) AS kind FROM ({CALLED}) x) y WHERE kind IS NOT NULL) z WHERE rank <= 12""")
def _(s, d):
    return runtime.evidence(classified(s, d))


@query("c2_runtime_allowlist", f"SELECT scenario, task_id, decision, round(error_rate, 9) AS error_rate FROM ({LENIENT}) q")
def _(s, d):
    r, sig = run_rows(s, d)
    return runtime.lenient_decisions(r, sig).select("scenario", "task_id", "decision", F.round("error_rate", 9).alias("error_rate"))


REASONS = f"""SELECT q.scenario, q.task_id, decision, error_rate, list_concat(list_concat([CASE WHEN q.call_tools = 0 THEN 'no_call_tool_path' END, CASE WHEN e.ap > 0 THEN 'agent_argument_parse_error:' || CAST(e.ap AS VARCHAR) END, CASE WHEN e.errors > 0 AND error_rate >= 0.3 THEN 'high_tool_error_rate:' || printf('%.2f', error_rate) END],
  [CASE WHEN h > 0 THEN 'http_500:' || CAST(h AS VARCHAR) END, CASE WHEN t > 0 THEN 'timeout:' || CAST(t AS VARCHAR) END, CASE WHEN repeated > 0 THEN 'repeated_schema_or_route_error:' || CAST(repeated AS VARCHAR) END]), [CASE WHEN e.er = e.runs AND e.fr = 0 THEN 'only_empty_or_not_found_tool_responses' END, CASE WHEN NOT e.completed AND e.mr = 0 AND q.call_tools > 0 THEN 'no_successful_mutating_path_observed' END]) AS all_, bad
  FROM ({LENIENT}) q JOIN (SELECT scenario, task_id, count(*) AS runs, bool_or(reward_type = 'complete') AS completed, coalesce(sum(n_agent_argument_parse_error) FILTER (readable), 0) AS ap, coalesce(sum(errors) FILTER (readable), 0) AS errors, count(*) FILTER (readable AND "empty" > 0) AS er, count(*) FILTER (readable AND non_empty > 0) AS fr, count(*) FILTER (readable AND mutating_calls > 0) AS mr FROM ({RUNS}) r GROUP BY ALL) e USING (scenario, task_id)"""
REASONS = f"SELECT scenario, task_id, decision, error_rate, list_concat([CASE WHEN i < bad THEN 'missing_or_bad_trajectory' END for i in range(bad)], [x for x in all_ if x IS NOT NULL]) AS reasons FROM ({REASONS}) z"


@query("a5_lenient_reasons", f"SELECT scenario, task_id, decision, array_to_string(reasons, ' ') AS reasons, round(error_rate, 9) AS error_rate FROM ({REASONS}) w")
def _(s, d):
    return runtime.lenient_decisions(*run_rows(s, d)).withColumn("reasons", F.array_join("reasons", " ")).withColumn("error_rate", F.round("error_rate", 9))


STRICT_HARD = f"""SELECT r.*, p.repeated, CASE WHEN reward_type = 'complete' THEN 0 WHEN NOT readable THEN 1 WHEN call_tools = 0 OR (errors > 0 AND errors / call_tools >= 0.3) OR n_http_500 > 0 OR n_timeout > 0 OR coalesce(repeated, 0) > 0 OR (call_tools > 0 AND "empty" > 0 AND non_empty = 0) THEN 1 ELSE 0 END AS hard FROM ({RUNS}) r
  LEFT JOIN (SELECT run, scenario, task_id, count(*) AS repeated FROM ({SIGS}) s WHERE n >= 2 AND (signature LIKE '%:validation:%' OR signature LIKE '%:route_or_schema:%') GROUP BY ALL) p USING (run, scenario, task_id)"""


@query("a6_strict_decisions", f"""SELECT scenario, task_id, CASE WHEN bool_or(reward_type = 'complete') THEN 'keep' WHEN count(*) < 3 THEN 'review' WHEN min(hard) = 1 THEN 'reject' ELSE 'review' END AS decision FROM ({STRICT_HARD}) h GROUP BY ALL""")
def _(s, d):
    return runtime.strict_decisions(*run_rows(s, d), expected_runs=3).select("scenario", "task_id", "decision")


@query("a7_reason_families", f"SELECT decision, split_part(r, ':', 1) AS reason, count(*) AS n FROM (SELECT decision, unnest(reasons) AS r FROM ({REASONS}) w) u GROUP BY ALL")
def _(s, d):
    return runtime.reason_families(runtime.lenient_decisions(*run_rows(s, d)))


@query("j15_u1_safeguard", f"""SELECT scenario, task_id, decision FROM ({LENIENT}) q WHERE decision <> 'reject' UNION ALL SELECT DISTINCT 'Scenario ' || CAST(c_custkey AS VARCHAR), c_nationkey % 4, 'missing_evidence' FROM customer WHERE ('Scenario ' || CAST(c_custkey AS VARCHAR), c_nationkey % 4) NOT IN (SELECT (scenario, task_id) FROM ({CALLS}) c)""")
def _(s, d):
    source = table(s, d, "customer").select(F.concat(F.lit("Scenario "), F.col("c_custkey").cast("string")).alias("scenario"), (F.col("c_nationkey") % 4).cast("long").alias("task_id"))
    return runtime.safeguarded(runtime.lenient_decisions(*run_rows(s, d)), source)


@query("j4_restricted", f"""SELECT run, scenario, task_id, reward_type FROM ({VERDICTS}) v WHERE (scenario, task_id) IN (SELECT ('Scenario ' || CAST(c_custkey AS VARCHAR), CAST(c_nationkey % 4 AS BIGINT)) FROM customer)""")
def _(s, d):
    allow = table(s, d, "customer").select(F.concat(F.lit("Scenario "), F.col("c_custkey").cast("string")).alias("scenario"), (F.col("c_nationkey") % 4).cast("long").alias("task_id"))
    return rows.restricted(view(s, d, "verdicts"), allow).select("run", "scenario", "task_id", "reward_type")


# --- scores -----------------------------------------------------------------------------------------------------


@query("a1_run_scores", f"SELECT run, count(*) AS total, count(*) FILTER (reward_type = 'complete') AS complete, count(*) FILTER (reward_type = 'complete') / count(*) AS score FROM ({VERDICTS}) v GROUP BY run")
def _(s, d):
    return scores.run_scores(view(s, d, "verdicts"))


@query("a1_reward_counts", f"SELECT run, reward_type, count(*) AS n FROM ({VERDICTS}) v GROUP BY ALL")
def _(s, d):
    return scores.reward_counts(view(s, d, "verdicts"))


BOTH = f"SELECT run, scenario, task_id, reward_type, CASE WHEN task_id % 2 = 0 THEN 'sql' ELSE 'code' END AS mode FROM ({VERDICTS}) v UNION ALL SELECT run, scenario, task_id, 'incomplete', 'code' FROM ({VERDICTS}) v WHERE task_id = 2"


def both_modes(s, d):
    v = view(s, d, "verdicts").select("run", "scenario", "task_id", "reward_type")
    return v.withColumn("mode", F.when(F.col("task_id") % 2 == 0, "sql").otherwise("code")).unionByName(v.where("task_id = 2").withColumn("reward_type", F.lit("incomplete")).withColumn("mode", F.lit("code")))


@query("a2_progress", f"""SELECT run, mode, count(*) AS verified, count(*) FILTER (reward_type = 'complete') AS complete, count(*) FILTER (reward_type = 'complete') / count(*) AS score, any_value(p) AS planned, any_value(p) - count(*) AS pending, count(*) FILTER (mode = 'sql') AS judged, count(*) FILTER (mode = 'sql' AND reward_type = 'complete') AS judge_complete, count(*) FILTER (mode = 'sql' AND reward_type <> 'complete') AS judge_incomplete, CAST(0 AS BIGINT) AS judge_server_error, CAST(0 AS BIGINT) AS judge_agent_error, CAST(0 AS BIGINT) AS judge_judge_error, avg(CAST(task_id < 2 AS INT)) AS skill_injected_rate FROM ({BOTH}) b JOIN (SELECT run, count(*) * 2 AS p FROM ({VERDICTS}) v GROUP BY run) q USING (run) GROUP BY GROUPING SETS ((run, mode), (run))""")
def _(s, d):
    planned = view(s, d, "verdicts").groupBy("run").agg((F.count("*") * 2).alias("planned"))
    judged = F.when(F.col("mode") == "sql", F.when(F.col("reward_type") == "complete", "complete").otherwise("incomplete"))
    return scores.progress(both_modes(s, d).withColumn("judge_class", judged).withColumn("skill_injected", F.col("task_id") < 2), planned)


@query("j7_preferred_verdicts", f"SELECT run, scenario, task_id, reward_type, mode FROM (SELECT *, row_number() OVER (PARTITION BY run, scenario, task_id ORDER BY mode) AS r FROM ({BOTH}) b) x WHERE r = 1")
def _(s, d):
    return scores.preferred_verdicts(both_modes(s, d))


@query("j14_changed_rewards", f"SELECT scenario, task_id, a.reward_type AS before, b.reward_type AS after FROM ({VERDICTS}) a JOIN ({VERDICTS}) b USING (scenario, task_id) WHERE a.run = 'run_0' AND b.run = 'run_1' AND a.reward_type <> b.reward_type")
def _(s, d):
    v = view(s, d, "verdicts")
    return scores.changed_rewards(v.where("run = 'run_0'"), v.where("run = 'run_1'"))


@query("a14_mixed_outcomes", f"SELECT scenario, task_id, count(*) FILTER (reward_type = 'complete') AS n_complete, count(*) FILTER (reward_type = 'others') AS n_others FROM ({VERDICTS}) v GROUP BY ALL HAVING n_complete > 0 AND n_others > 0")
def _(s, d):
    return scores.mixed_outcomes(view(s, d, "verdicts"))


@query("j17_overlay", f"SELECT count(*) AS n, count(b.reward_type) AS verified, count(*) - count(b.reward_type) AS missing, count(*) FILTER (b.reward_type = 'complete') AS complete, count(*) FILTER (b.reward_type = 'complete') / count(*) AS score_all, count(*) FILTER (b.reward_type = 'complete') / count(b.reward_type) AS score_verified FROM (SELECT DISTINCT scenario, task_id FROM ({VERDICTS}) v WHERE run = 'run_0') a LEFT JOIN (SELECT * FROM ({VERDICTS}) v WHERE run = 'run_2') b USING (scenario, task_id)")
def _(s, d):
    v = view(s, d, "verdicts")
    return scores.overlay(v.where("run = 'run_0'"), v.where("run = 'run_2'"))


@query("u2_tiers", f"SELECT tier, count(*) AS n FROM (SELECT scenario, task_id, min(CASE reward_type WHEN 'complete' THEN 1 WHEN 'others' THEN 2 ELSE 3 END) AS tier FROM ({VERDICTS}) v WHERE (scenario, task_id) NOT IN (SELECT (scenario, task_id) FROM ({LENIENT}) q WHERE decision = 'reject') GROUP BY ALL) t GROUP BY ROLLUP (tier)")
def _(s, d):
    v, gone = view(s, d, "verdicts"), runtime.lenient_decisions(*run_rows(s, d)).where("decision = 'reject'")
    return scores.tier_counts(scores.tiers(v.where("reward_type = 'complete'"), v.where("reward_type = 'others'"), v.where("reward_type = 'judge_error'"), gone))


@query("u3_common_keys", f"SELECT scenario, task_id FROM ({VERDICTS}) v WHERE run = 'run_0' INTERSECT SELECT scenario, task_id FROM ({VERDICTS}) v WHERE run = 'run_1'")
def _(s, d):
    v = view(s, d, "verdicts")
    return rows.common_keys(v.where("run = 'run_0'"), v.where("run = 'run_1'"), ["scenario", "task_id"])


@query("a15_protocol_totals", "SELECT 'run_' || CAST(conv_id % 3 AS VARCHAR) AS run, CAST(sum(turn % 2) AS BIGINT) AS list_tools, CAST(sum(turn % 3) AS BIGINT) AS tool_help, CAST(sum(turn % 4) AS BIGINT) AS reminders, CAST(sum(1) AS BIGINT) AS unhelped FROM conversations GROUP BY 1")
def _(s, d):
    c = table(s, d, "conversations")
    return scores.protocol_totals(c.select(F.concat(F.lit("run_"), (F.col("conv_id") % 3).cast("string")).alias("run"), (F.col("turn") % 2).alias("list_tools_calls"), (F.col("turn") % 3).alias("tool_help_calls"), (F.col("turn") % 4).alias("reminders"), F.array("role").alias("unhelped")))


# --- tables of environments --------------------------------------------------------------------------------------

SUPP = "'Supplier-' || CAST(s_suppkey // 2 AS VARCHAR)"


def supplier_tasks(s, d):
    t = table(s, d, "supplier")
    name = F.concat(F.lit("Supplier-"), F.expr("s_suppkey div 2").cast("string"))
    return t.select(name.alias("scenario"), F.slice(F.array("s_name", F.concat("s_name", F.lit("-b")), F.lit("same"), F.lit("same")), F.lit(1), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("tasks"), F.col("s_suppkey").alias("pos"))


LAST = f"SELECT s_suppkey AS pos, 'supplier_' || CAST(s_suppkey // 2 AS VARCHAR) AS scenario, list_slice([s_name, s_name || '-b', 'same', 'same'], 1, s_suppkey % 4 + 1) AS tasks FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey // 2 ORDER BY s_suppkey DESC) = 1"
LONG = f"SELECT scenario, i - 1 AS task_id, tasks[i] AS task FROM ({LAST}) l, unnest(range(1, len(tasks) + 1)) u(i)"


@query("w3_last_wins", "SELECT s_nationkey, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1")
def _(s, d):
    return rows.one_by_key(table(s, d, "supplier"), ["s_nationkey"], ["s_suppkey"]).select("s_nationkey", "s_suppkey")


@query("a13_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return rows.duplicate_keys(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


BUNDLE = f"""SELECT scenario, CAST(task_id AS INT) AS task_id, task, scenario || '/task_' || CAST(task_id AS VARCHAR) AS task_key, no % 50 <> 3 AS has_env, no % 50 <> 4 AS has_db_schema, no % 50 <> 5 AS has_sample, task_id <> 1 AS has_verifier
  FROM (SELECT *, CAST(substr(scenario, 10) AS INT) AS no FROM ({LONG}) x) y"""


ORACLE["j2_missing_sources"] = ORACLE["j2_missing_sources"].replace("{bundle}", BUNDLE)


def bundle(s, d):
    t = supplier_tasks(s, d)
    no = lambda k: t.where(f"(pos div 2) % 50 <> {k}").select("scenario")
    verifiers = t.select("scenario", F.explode(F.array(*map(F.lit, (0, 2, 3)))).alias("task_idx"))
    return rows.environment_bundle({"env": no(3), "db_schema": no(4), "sample": no(5)}, t, verifiers)


@query("j1_p3_bundle", BUNDLE)
def _(s, d):
    return bundle(s, d)


GATE = f"""SELECT scenario, task_id, CASE WHEN task_id = 3 AND scenario LIKE '%1' THEN 'known_bad_task' WHEN NOT has_env THEN 'missing_env' WHEN NOT has_db_schema THEN 'missing_db_schema' WHEN NOT has_sample THEN 'missing_sample' WHEN NOT has_verifier THEN 'missing_verifier'
  WHEN task_id = 2 THEN 'bad_verifier_compile' WHEN scenario LIKE '%8' THEN 'db_reset_error' WHEN NOT coalesce(status = 'success', false) THEN 'noop_verifier_error' WHEN task_id = 0 AND scenario LIKE '%7' THEN 'noop_complete' END AS reason
  FROM (SELECT *, CASE WHEN task_id <> 0 THEN 'success' WHEN scenario LIKE '%2' THEN 'error' WHEN scenario LIKE '%4' THEN 'timeout' WHEN scenario LIKE '%6' THEN NULL ELSE 'success' END AS status FROM ({BUNDLE}) b) c"""


def gate(s, d):
    b = bundle(s, d)
    checks = b.select("scenario", "task_id", (F.col("task_id") != 2).alias("ok"))
    ends = lambda x: F.col("scenario").endswith(x)
    status = F.when(F.col("task_id") != 0, "success").when(ends("2"), "error").when(ends("4"), "timeout").when(ends("6"), None).otherwise("success")
    noop = b.select("scenario", "task_id", F.when(ends("8"), "no such table").alias("db_error"), status.alias("execution_status"), F.when((F.col("task_id") == 0) & ends("7"), "complete").otherwise("others").alias("result"))
    return rows.static_gate(b, checks, noop, b.where((F.col("task_id") == 3) & ends("1")))


@query("c3_static_gate", GATE)
def _(s, d):
    return gate(s, d)


@query("a8_gate_totals", f"SELECT scenario, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM ({GATE}) g GROUP BY GROUPING SETS ((scenario, coalesce(reason, 'accepted')), (coalesce(reason, 'accepted')))")
def _(s, d):
    return rows.gate_totals(gate(s, d))


@query("j6_selected_tasks", f"SELECT scenario, task_id, task FROM (SELECT {SUPP} AS scenario, i - 1 AS task_id, t[i] AS task FROM (SELECT *, list_slice([s_name, s_name || '-b', 'same', 'same'], 1, s_suppkey % 4 + 1) AS t FROM supplier) s, unnest(range(1, len(t) + 1)) u(i)) x WHERE task_id IN (0, 1, 3)")
def _(s, d):
    return rows.selected_tasks(supplier_tasks(s, d), "0-1,3")


@query("j5_checked_allowlist", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 60 >= 50 THEN 'unknown_scenario' WHEN o_orderkey % 6 >= 4 THEN 'task_id_out_of_range' WHEN row_number() OVER (PARTITION BY o_custkey % 60, o_orderkey % 6 ORDER BY o_orderkey) > 1 THEN 'duplicate' END AS reason FROM orders) x WHERE reason IS NOT NULL GROUP BY 1")
def _(s, d):
    allow = table(s, d, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 60).cast("string")).alias("scenario"), (F.col("o_orderkey") % 6).alias("task_id"), F.col("o_orderkey").alias("pos"))
    t = table(s, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")).alias("scenario")).distinct().withColumn("tasks", F.array(*[F.lit("t")] * 4))
    return rows.checked_allowlist(allow, t, "pos")[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("j9_new_names", "SELECT lower(trim(c_mktsegment)) || CAST(c_nationkey AS VARCHAR) AS name, min(c_custkey) AS pos FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1")
def _(s, d):
    n = table(s, d, "nation").select("n_nationkey").join(table(s, d, "supplier").where("s_suppkey % 3 = 0"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    segments = table(s, d, "customer").select("c_mktsegment").distinct()
    known = n.crossJoin(F.broadcast(segments)).select(F.concat(F.upper("c_mktsegment"), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("name"))  # nations by segments: a fixed few
    c = table(s, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.col("c_custkey").alias("pos"))
    return rows.new_names(c, known, "pos").select(F.lower(F.trim("name")).alias("name"), "pos")


@query("a18_work_units", f"SELECT scenario, task, len(list(task_id)) AS n, min(task_id) AS first FROM ({LONG}) x GROUP BY ALL")
def _(s, d):
    last = rows.one_by_key(supplier_tasks(s, d).withColumn("scenario", T.normalized_name(F.col("scenario"))), ["scenario"], ["pos"])
    return rows.work_units(rows.exploded_tasks(last)).select("scenario", "task", F.size("task_ids").cast("long").alias("n"), F.col("task_ids")[0].cast("long").alias("first"))


@query("a12_profile", "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, round(avg(l_quantity), 6) AS quantity_avg, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max FROM lineitem")
def _(s, d):
    return rows.profile(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity")}).withColumn("quantity_avg", F.round("quantity_avg", 6))


@query("j3_contexts", "SELECT 'n' || CAST(coalesce(a, b) AS VARCHAR) AS scenario, coalesce(CAST(na AS VARCHAR), 'unavailable') AS env_text, coalesce(CAST(nb AS VARCHAR), 'unavailable') AS schema_text FROM (SELECT c_custkey % 40 AS a, count(*) AS na FROM customer WHERE c_custkey % 40 < 30 GROUP BY 1) x FULL JOIN (SELECT c_custkey % 40 AS b, count(*) AS nb FROM customer WHERE c_custkey % 40 > 10 GROUP BY 1) y ON a = b")
def _(s, d):
    t = table(s, d, "customer").groupBy((F.col("c_custkey") % 40).alias("k")).agg(F.count("*").cast("string").alias("n"))
    side = lambda cond, name: t.where(cond).select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("scenario"), F.col("n").alias(name))
    return rows.contexts(side("k < 30", "env_text"), side("k > 10", "schema_text"))


# --- trajectories -----------------------------------------------------------------------------------------------


def trajectories(s, d):
    m = table(s, d, "conversations")
    calls = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 != 0)
    call = F.concat(F.lit('{"name":"call_tool","arguments":{"tool_name":"tool_'), (F.col("turn") % 4).cast("string"), F.lit('","arguments":"{\\"t\\":'), F.col("turn").cast("string"), F.lit('}"}}'))
    none = F.array().cast("array<string>")
    response = F.when(calls, F.when(F.col("conv_id") % 7 == 0, "500 Internal Server Error").otherwise(F.concat(F.lit('{"ok": '), F.col("turn").cast("string"), F.lit("}"))))
    in_text = calls & (F.col("conv_id") % 4 == 1)  # in a quarter of the runs, calls stand in the text
    said = F.when(in_text, F.concat("text", F.lit("<tool_call>"), call, F.lit("</tool_call>"))).otherwise(F.col("text"))
    step = F.struct("turn", "role", said.alias("content"), F.when(calls & ~in_text, F.array(call)).otherwise(none).alias("calls"), response.alias("response"))
    steps = F.transform(F.array_sort(F.collect_list(step)), lambda x: x.dropFields("turn"))
    return m.groupBy("conv_id").agg(steps.alias("steps")).select((F.col("conv_id") % 3).cast("string").alias("run"), F.concat(F.lit("s"), (F.col("conv_id") % 20).cast("string")).alias("scenario"), F.col("conv_id").alias("task_id"), F.lit("do it").alias("task"), "steps")


def trajectory_verdicts(s, d):
    return trajectories(s, d).select("run", "scenario", "task_id", F.when(F.col("task_id") % 5 != 0, "complete").otherwise("others").alias("reward_type"))


TRAJ = """SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'not_complete' WHEN n = 0 THEN 'no_call_tool' WHEN conv_id % 7 = 0 THEN 'tool_error' WHEN NOT said THEN 'no_final_answer' END AS reason, n FROM (SELECT conv_id, count(*) FILTER (role = 'assistant' AND (conv_id + turn) % 3 <> 0) AS n, bool_or(role = 'assistant' AND (conv_id + turn) % 3 = 0 AND trim(text) <> '') AS said FROM conversations GROUP BY 1) x"""


TOOLS = "SELECT conv_id, string_agg('tool_' || CAST(turn % 4 AS VARCHAR), ',' ORDER BY turn) AS tools, string_agg(CAST(no AS VARCHAR) || '. Call tool_' || CAST(turn % 4 AS VARCHAR) || ' with {\"t\":' || CAST(turn AS VARCHAR) || '}; observe {\"ok\":' || CAST(turn AS VARCHAR) || '}.', chr(10) ORDER BY turn) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 <> 0) c GROUP BY 1"


@query("c1_cleaned", f"SELECT t.conv_id AS task_id, reason, CAST(n AS INT) AS num_tool_calls, coalesce(tools, '') AS tools_used FROM ({TRAJ}) t LEFT JOIN ({TOOLS}) u USING (conv_id)")
def _(s, d):
    return cleaning.cleaned(trajectories(s, d), trajectory_verdicts(s, d)).select("task_id", "reason", "num_tool_calls", F.coalesce(F.array_join("tools_used", ","), F.lit("")).alias("tools_used"))


@query("a3_cleaning_totals", f"SELECT count(*) AS matched, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected, round(avg(t.n) FILTER (reason IS NULL), 9) AS avg_calls FROM ({TRAJ}) t")
def _(s, d):
    return cleaning.cleaning_totals(cleaning.cleaned(trajectories(s, d), trajectory_verdicts(s, d))).select("matched", "kept", "rejected", F.round("avg_calls", 9).alias("avg_calls"))


@query("a3_cleaning_stats", f"SELECT reason, count(*) AS n, round(avg(n), 9) AS avg_calls FROM ({TRAJ}) t GROUP BY reason".replace("avg(n)", "avg(t.n)"))
def _(s, d):
    return cleaning.cleaning_stats(cleaning.cleaned(trajectories(s, d), trajectory_verdicts(s, d))).select("reason", "n", F.round("avg_calls", 9).alias("avg_calls"))


@query("a3_top_tools", f"SELECT 'tool_' || CAST(turn % 4 AS VARCHAR) AS tool, count(*) AS n FROM conversations c JOIN ({TRAJ}) t USING (conv_id) WHERE reason IS NULL AND role = 'assistant' AND (conv_id + turn) % 3 <> 0 GROUP BY 1")
def _(s, d):
    return cleaning.top_tools(cleaning.cleaned(trajectories(s, d), trajectory_verdicts(s, d)))


FINAL = "SELECT conv_id, trim(max_by(text, turn)) AS final FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND (conv_id + turn) % 3 = 0 GROUP BY 1"


@query("w1_p24_traces", f"SELECT CAST(conv_id % 3 AS VARCHAR) AS run, 's' || CAST(conv_id % 20 AS VARCHAR) AS scenario, conv_id AS task_id, tools AS tools_used, 'Task: do it' || chr(10) || 'Steps:' || chr(10) || steps || chr(10) || 'Final: ' || final AS trace, final FROM ({TRAJ}) t JOIN ({TOOLS}) u USING (conv_id) JOIN ({FINAL}) f USING (conv_id) WHERE reason IS NULL")
def _(s, d):
    return cleaning.cleaned(trajectories(s, d), trajectory_verdicts(s, d)).where("reason is null").select("run", "scenario", "task_id", F.array_join("tools_used", ",").alias("tools_used"), "trace", "final")


@query("j8_w5_answers", "SELECT conv_id AS task_id, trim(max_by(text, turn) FILTER (role = 'assistant' AND trim(text) <> '' AND (conv_id + turn) % 3 = 0)) AS final, max_by(text || CASE WHEN (conv_id + turn) % 3 <> 0 AND conv_id % 4 = 1 THEN '<tool_call>{\"name\":\"call_tool\",\"arguments\":{\"tool_name\":\"tool_' || CAST(turn % 4 AS VARCHAR) || '\",\"arguments\":\"{\\\"t\\\":' || CAST(turn AS VARCHAR) || '}\"}}</tool_call>' ELSE '' END, turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1")
def _(s, d):
    return cleaning.with_calls(trajectories(s, d)).select("task_id", cleaning.final_answer(F.col("steps")).alias("final"), cleaning.last_message(F.col("steps")).alias("last"))


@query("j16_without_help", f"SELECT run, scenario, task_id, full_tool AS tool, min(iteration) AS pos FROM (SELECT *, max(CASE WHEN iteration % 3 = 1 AND response NOT LIKE 'Error:%' THEN 1 ELSE 0 END) OVER (PARTITION BY run, scenario, task_id, full_tool ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS helped FROM ({CALLS}) c) x WHERE coalesce(helped, 0) = 0 AND iteration % 3 <> 1 GROUP BY ALL")
def _(s, d):
    c = view(s, d, "calls").select("run", "scenario", "task_id", F.col("iteration").alias("pos"), F.when(F.col("iteration") % 3 == 1, "tool_help").otherwise("call_tool").alias("name"), F.col("full_tool").alias("tool"), F.lit(True).alias("has_args"), (~F.col("response").startswith("Error:")).alias("ok"))
    return training.calls_without_help(c)


# --- examples, attempts, requests -------------------------------------------------------------------------------

EX = f"SELECT run || '/' || scenario AS scenario, task_id, reward_type, tool_calls AS num_tool_calls FROM ({COUNTERS}) c JOIN ({VERDICTS}) v USING (run, scenario, task_id)"


def examples(s, d):
    c = runtime.run_counters(classified(s, d))
    met = c.select("run", "scenario", "task_id", F.col("tool_calls").alias("num_tool_calls")).join(view(s, d, "verdicts"), ["run", "scenario", "task_id"])
    return met.select(F.concat("run", F.lit("/"), "scenario").alias("scenario"), "task_id", "reward_type", "num_tool_calls")


@query("t1_shortest_examples", f"""WITH e AS ({EX}), g AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY num_tool_calls, task_id) AS rank FROM e WHERE reward_type = 'complete' QUALIFY rank <= 2)
  SELECT scenario, task_id, rank, 'positive' AS part FROM g UNION ALL SELECT scenario, task_id, row_number() OVER (PARTITION BY scenario ORDER BY reward_type = 'complete', num_tool_calls, task_id) AS rank, 'auxiliary' FROM e WHERE (scenario, task_id) NOT IN (SELECT (scenario, task_id) FROM g) QUALIFY rank <= 2""")
def _(s, d):
    return selection.shortest_examples(examples(s, d), 2, 2).select("scenario", "task_id", "rank", "part")


@query("t3_win_loss", f"SELECT scenario, task_id, after = 'complete' AS win FROM (SELECT scenario, task_id, b.reward_type AS after FROM ({VERDICTS}) a JOIN ({VERDICTS}) b USING (scenario, task_id) WHERE a.run = 'run_0' AND b.run = 'run_1' AND a.reward_type <> b.reward_type) x QUALIFY row_number() OVER (PARTITION BY scenario, after = 'complete' ORDER BY task_id) <= CASE WHEN after = 'complete' THEN 2 ELSE 1 END")
def _(s, d):
    v = view(s, d, "verdicts")
    return selection.win_loss_examples(scores.changed_rewards(v.where("run = 'run_0'"), v.where("run = 'run_1'")), 3).select("scenario", "task_id", "win")


ATT = "SELECT o_custkey AS scenario, o_orderkey AS attempt, (o_orderkey % 10) / 20.0 AS error_ratio, ['e' || CAST(o_orderkey % 4 AS VARCHAR)] AS errors FROM orders"


def attempts(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("scenario"), F.col("o_orderkey").alias("attempt"), ((F.col("o_orderkey") % 10) / 20).alias("error_ratio"), F.array(F.concat(F.lit("e"), (F.col("o_orderkey") % 4).cast("string"))).alias("errors"))


@query("w2_best_attempt", f"SELECT scenario, attempt, error_ratio <= 0.1 AS accepted FROM ({ATT}) a QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY error_ratio <= 0.1 DESC, CASE WHEN error_ratio <= 0.1 THEN 0 ELSE error_ratio END, attempt) = 1")
def _(s, d):
    return selection.best_attempt(attempts(s, d), ["scenario"]).select("scenario", "attempt", "accepted")


@query("a17_error_digest", "SELECT o_custkey AS scenario, string_agg(DISTINCT 'e' || CAST(o_orderkey % 4 AS VARCHAR), chr(10) ORDER BY 'e' || CAST(o_orderkey % 4 AS VARCHAR)) AS digest FROM orders GROUP BY 1")
def _(s, d):
    return selection.error_digest(attempts(s, d), ["scenario"])


@query("w6_balanced_limit", f"SELECT scenario, pos, tasks FROM (SELECT *, coalesce(sum(len(tasks)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT {SUPP} AS scenario, s_suppkey AS pos, list_slice([s_name, s_name || '-b', 'same', 'same'], 1, least(2, s_suppkey % 4 + 1)) AS tasks FROM supplier ORDER BY s_suppkey LIMIT 40) x) y WHERE b < 40")
def _(s, d):
    return selection.balanced_limit(supplier_tasks(s, d), 40, 20).select("scenario", "pos", "tasks")


@query("c4_c6_request_rows", "SELECT p_partkey, 'Part ' || p_name || ' of size ' || CAST(p_size AS VARCHAR) || '.' AS prompt FROM part")
def _(s, d):
    return selection.request_rows(table(s, d, "part"), "Part {name} of size {size}.", {"name": F.col("p_name"), "size": F.col("p_size").cast("string")}).select("p_partkey", "prompt")


ASKED = "Learn {scenario}. Tools: {tools} Tables: {tables} Good: {positives} Others: {others}"


@query("c4_distillation_requests", f"""WITH e AS ({EX}), g AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY num_tool_calls, task_id) AS rank FROM e WHERE reward_type = 'complete' QUALIFY rank <= 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY reward_type = 'complete', num_tool_calls, task_id) AS rank FROM e WHERE (scenario, task_id) NOT IN (SELECT (scenario, task_id) FROM g) QUALIFY rank <= 2),
  p AS (SELECT scenario, string_agg('task ' || CAST(task_id AS VARCHAR), chr(10) || chr(10) ORDER BY rank) AS t, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM g GROUP BY 1), q AS (SELECT scenario, string_agg('task ' || CAST(task_id AS VARCHAR), chr(10) || chr(10) ORDER BY rank) AS t, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM o GROUP BY 1)
  SELECT s.scenario, 'Learn ' || s.scenario || '. Tools: ' || CASE WHEN s.scenario LIKE '%1' THEN '- tools of ' || s.scenario ELSE '(tool summary unavailable)' END || ' Tables: (database summary unavailable) Good: ' || coalesce(p.t, '') || ' Others: ' || coalesce(q.t, '') AS prompt, coalesce(p.ids, '') AS positives, coalesce(q.ids, '') AS others, n_good, n_all, s.scenario LIKE '%1' AS has_tools
  FROM (SELECT scenario, count(*) FILTER (reward_type = 'complete') AS n_good, count(*) AS n_all FROM e GROUP BY 1) s LEFT JOIN p USING (scenario) LEFT JOIN q USING (scenario)""")
def _(s, d):
    e = examples(s, d)
    chosen = selection.shortest_examples(e, 2, 2).withColumn("trace", F.concat(F.lit("task "), F.col("task_id").cast("string")))
    contexts = e.select("scenario").distinct().where("scenario like '%1'").select("scenario", F.concat(F.lit("- tools of "), "scenario").alias("tool_summary"), F.lit(None).cast("string").alias("db_summary"))
    t = selection.distillation_requests(chosen, e, contexts, ASKED)
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return t.select("scenario", "prompt", ids("positive_task_ids").alias("positives"), ids("auxiliary_task_ids").alias("others"), F.col("num_positive_available").alias("n_good"), F.col("num_aux_available").alias("n_all"), F.col("has_tool_summary").alias("has_tools"))


@query("c5_skill_manifest", "SELECT count(*) AS requested, count(*) FILTER (doc_id % 10 <> 0) AS done, count(*) FILTER (doc_id % 10 = 0) AS skipped, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 4 = 0) AS quality_ok, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 4 <> 0) AS to_repair FROM documents")
def _(s, d):
    good = F.lit("\n".join(T.SKILL_SECTIONS) + "\nConfidence: high")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("scenario"), F.when(F.col("doc_id") % 10 != 0, F.when(F.col("doc_id") % 4 == 0, good).otherwise(F.concat(F.lit("Skill "), "text"))).alias("skill"))
    return selection.manifest_totals(selection.skill_manifest(docs, docs, 400))


@query("a10_suitability", "SELECT c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 5 END AS score, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'medium' END AS level FROM customer")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("name"))
    a = c.select("name", F.when(F.col("name") % 3 == 0, '{"score": 8, "level": "High", "categories": ["a"]}').when(F.col("name") % 3 == 1, "none").alias("response")).where("response is not null")
    return selection.with_suitability(c, a).select("name", "score", "level")


@query("a9_category_counts", "SELECT category, count(*) AS n, count(*) > 200 AS over FROM (SELECT unnest([c_mktsegment, 'n' || CAST(c_nationkey AS VARCHAR)]) AS category FROM customer) x GROUP BY 1")
def _(s, d):
    return selection.category_counts(table(s, d, "customer").select(F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("categories")), 200)


@query("w7_few_shot", "SELECT c_name AS name, [c_mktsegment] AS categories FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0:' || c_name), c_name) <= greatest(1, 20 // (SELECT count(DISTINCT c_mktsegment) FROM customer)) AS f FROM customer) x ORDER BY f DESC, md5('0:' || c_name), c_name LIMIT 20")
def _(s, d):
    return selection.few_shot(table(s, d, "customer").select(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("categories")), 20).select("name", "categories")


# --- similarity -------------------------------------------------------------------------------------------------


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.array(F.col("label").cast("string")).alias("categories"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("j10_nearest", f"SELECT a.vec_id AS id, round(max({COS}), 6) AS similarity, arg_max(b.vec_id, {COS}) AS neighbour FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1")
def _(s, d):
    v = vectors(s, d).select("id", "embedding")
    return diversity.nearest(v, v, own=False).withColumn("similarity", F.round("similarity", 6))


@query("j11_similar_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} > 0.45")
def _(s, d):
    return diversity.similar_pairs(vectors(s, d).select("id", "embedding"), 0.45).withColumn("similarity", F.round("similarity", 6))


@query("a11_pairwise_stats", f"SELECT count(*) AS n_pairs, round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS greatest, round(stddev_pop(c), 6) AS deviation, count(*) FILTER (c > 0.45) AS n_above FROM (SELECT {COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) x")
def _(s, d):
    t = diversity.pairwise_stats(vectors(s, d).select("id", "embedding"), 0.45)
    return t.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "least", "greatest", "deviation")], "n_above")


@query("a11_global_check", f"WITH e AS (SELECT * FROM embeddings ORDER BY md5('0:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 200) SELECT 'ok' AS status, (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM e) AS n_sample, count(*) AS n_pairs, round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS greatest, round(stddev_pop(c), 6) AS deviation, count(*) FILTER (c > 0.45) AS n_above FROM (SELECT {COS} AS c FROM e a JOIN e b ON a.vec_id < b.vec_id) x")
def _(s, d):
    t = diversity.global_check(vectors(s, d), 0.45)
    return t.select("status", "n_rows", "n_sample", "n_pairs", *[F.round(c, 6).alias(c) for c in ("mean", "least", "greatest", "deviation")], "n_above")


#: One candidate after another, with the vectors of those that stayed.
DIVERSE = """WITH RECURSIVE pool AS (SELECT CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 5 = 0),
  c AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS no, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN label IN (SELECT label FROM pool GROUP BY label HAVING count(*) >= 12) THEN 0.35 ELSE 0.45 END AS most FROM embeddings WHERE vec_id % 5 <> 0),
  k AS (SELECT c.id, c.no, any_value(c.e) AS e, any_value(c.most) AS most, greatest(0, max(list_cosine_similarity(c.e, p.e))) AS near FROM c, pool p GROUP BY c.id, c.no),
  r AS (SELECT CAST(0 AS BIGINT) AS no, CAST(-1 AS BIGINT) AS id, false AS kept, CAST([] AS DOUBLE[][]) AS stay
    UNION ALL SELECT no, id, ok, CASE WHEN ok THEN list_append(stay, e) ELSE stay END FROM (SELECT k.no, k.id, k.e, r.stay, k.near <= k.most AND coalesce(list_max([list_cosine_similarity(x, k.e) for x in r.stay]), -1) <= k.most AS ok FROM r JOIN k ON k.no = r.no + 1) n)
  SELECT id, kept FROM r WHERE no > 0"""


@query("j12_c8_diverse", DIVERSE)
def _(s, d):
    v = vectors(s, d)
    pool = v.where("id % 5 = 0")
    counts = pool.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return diversity.diverse(v.where("id % 5 <> 0"), pool.select("id", "embedding"), counts, sim=0.45, warn=0.35, cap=12, save=written)


# --- states of tables -------------------------------------------------------------------------------------------


def after_orders(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = o.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, None).otherwise(F.col("o_totalprice")))
    return o, kept.unionByName(o.where("o_orderkey % 101 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


@query("j18_snapshot_diff", "SELECT o_orderkey, 'deleted' AS change, '' AS columns FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, 'updated', 'o_totalprice' FROM orders WHERE o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0 UNION ALL SELECT -o_orderkey - 1, 'inserted', '' FROM orders WHERE o_orderkey % 101 = 0")
def _(s, d):
    return state.snapshot_diff(*after_orders(s, d), ["o_orderkey"]).select("o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


@query("j18_unmet_expectations", "SELECT o_orderkey, 'updated' AS change, 'o_totalprice' AS \"column\" FROM orders WHERE o_orderkey % 50 = 0 AND NOT (o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0)")
def _(s, d):
    diff = state.snapshot_diff(*after_orders(s, d), ["o_orderkey"])
    wanted = table(s, d, "orders").where("o_orderkey % 50 = 0").select("o_orderkey", F.lit("updated").alias("change"), F.lit("o_totalprice").alias("column"), F.lit(None).cast("string").alias("expected"))
    return state.unmet_expectations(diff, wanted, ["o_orderkey"]).select("o_orderkey", "change", "column")


@query("j19_constraints", """SELECT "check", n_failed, round(n_failed / n, 9) AS ratio, n_failed / n <= 0.1 AS ok FROM (SELECT 'duplicate:l_orderkey' AS "check", CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS n_failed, count(*) AS n FROM lineitem UNION ALL SELECT 'not_null:l_partkey', count(*) FILTER (l_partkey IS NULL), count(*) FROM lineitem
  UNION ALL SELECT 'foreign_key:l_orderkey', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)), count(*) FROM lineitem) x""")
def _(s, d):
    return state.constraint_failures(table(s, d, "lineitem"), ["l_orderkey"], ["l_partkey"], {"l_orderkey": (table(s, d, "orders").where("o_orderkey % 10 <> 0"), "o_orderkey")}).select("check", "n_failed", F.round("ratio", 9).alias("ratio"), "ok")


# --- watched runs (the batch form of the stream's transformations; tests run the streams) -------------------------


def landed(s, d):
    return over(s, d, f"SELECT c.run, c.scenario AS scenario_dir, c.task_id, 'code' AS mode, c.reward_type, c.landed FROM (SELECT 'run_' || CAST(event_id % 3 AS STRING) AS run, CAST(user_id AS STRING) AS scenario, event_id AS task_id, CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'others' END AS reward_type, ts AS landed FROM events) c")


@query("x1_live_scores", "SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run, 'code' AS mode, count(*) AS verified, count(*) FILTER (event_type = 'purchase') AS complete, count(*) FILTER (event_type = 'purchase') / count(*) AS score FROM events GROUP BY 1")
def _(s, d):
    return live.live_scores(landed(s, d))


@query("x2_throughput", "SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run, time_bucket(INTERVAL '10 minutes', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return live.throughput(landed(s, d))


@query("x3_stalls", "SELECT run, max(ts) AS last, max(ts) + INTERVAL 1 HOUR AS stalled_at, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY ts, event_id) AS s FROM (SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_id % 3 ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY run, s")
def _(s, d):
    return live.stalls(landed(s, d))


@query("x4_completion_gate", "SELECT run, n >= floor((n + CASE run WHEN 'run_0' THEN 0 ELSE n END) * 0.995) AS done FROM (SELECT 'run_' || CAST(event_id % 3 AS VARCHAR) AS run, count(*) AS n FROM events GROUP BY 1) x")
def _(s, d):
    sc = live.live_scores(landed(s, d))
    expected = sc.select("run", (F.col("verified") * F.when(F.col("run") == "run_0", 1).otherwise(2)).alias("expected"), F.lit(False).alias("interrupted"))
    return live.completion_gate(sc, expected).select("run", "done")


def queries() -> dict:
    from . import jobs  # noqa: F401  adds its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import jobs  # noqa: F401

    return dict(ORACLE)
