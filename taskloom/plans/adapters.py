"""The driver tables seen as run logs: the same SQL for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TOOL = "CASE event_type WHEN 'purchase' THEN 'mcp_tool_create_order' WHEN 'signup' THEN 'mcp_tool_update_user' WHEN 'click' THEN 'mcp_tool_get_item' WHEN 'view' THEN 'mcp_tool_list_items' ELSE 'mcp_tool_set_status' END"

VIEWS = {
    # One row for each call of a run of a task; some argument texts are split, some responses are errors or empty.
    "calls": f"""SELECT 'run_' || CAST(event_id % 3 AS STRING) AS run, 'Scenario ' || CAST(user_id AS STRING) AS scenario,
        CAST(floor(event_id / 3) AS BIGINT) % 4 AS task_id, event_id AS iteration, 0 AS call_pos,
        CASE WHEN event_id % 13 = 0 THEN 'list_tools' ELSE 'call_tool' END AS name, {TOOL} AS full_tool,
        CASE WHEN event_type = 'error' AND event_id % 10 = 2 THEN '{{"tool_name": "' || {TOOL} || '", "arguments": "{{", "id": 1}}' ELSE '{{"tool_name": "' || {TOOL} || '", "arguments": "{{}}"}}' END AS args,
        CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Error: 500 Internal Server Error' WHEN 1 THEN 'Error: request timed out' WHEN 2 THEN 'Error: Input validation error: id is a required property' WHEN 3 THEN 'Error: unknown tool' ELSE 'Error: odd' END
             WHEN event_type = 'view' AND event_id % 2 = 0 THEN '{{"items": []}}' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'item does not exist' ELSE props END AS response
        FROM events""",
    "verdicts": """SELECT run, scenario, task_id, CASE WHEN count(CASE WHEN full_tool = 'mcp_tool_create_order' THEN 1 END) >= 2 THEN 'complete' WHEN count(*) % 11 = 0 THEN 'judge_error' ELSE 'others' END AS reward_type, 'code' AS mode, count(*) % 9 <> 4 AS readable FROM calls GROUP BY run, scenario, task_id""",
}


def view_sql(name: str) -> str:
    """The view over the driver tables as one statement."""
    return VIEWS[name].replace("FROM calls", f"FROM ({VIEWS['calls']}) c")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return over(spark, sf_dir, view_sql(name))


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement on the driver tables; they are named by position in the text, so sessions are not littered with views."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}} AS {t}", text)
    return spark.sql(text, **frames)
