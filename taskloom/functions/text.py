"""Columns over names, texts, errors and skill documents; all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the run logs: vocabularies and patterns that results are compared by.
REWARD_TYPES = ("complete", "others", "judge_error", "incomplete", "server_error", "agent_error")
JUDGE_CLASSES = ("complete", "incomplete", "server_error", "agent_error", "judge_error")
ERROR_PHRASES = ("traceback", "timeout", "500 internal server error", "server error", "internal server error")
ERROR_LABELS = (
    ("http_500", r"\b(500|internal server error)\b"),
    ("timeout", r"\b(timeout|timed out)\b"),
    ("validation", r"(input validation error|required property|validationerror|invalid)"),
    ("route_or_schema", r"(not found|404|no route|unknown tool|unexpected keyword|missing .*argument)"),
)
EMPTY_PATTERN = r"\b(no .*found|not found|empty|does not exist|not available|unavailable)\b"
MUTATING_PATTERN = r"(^|_)(create|update|delete|cancel|book|reserve|add|remove|assign|mark|set|submit|approve|reject|complete|close)_"
SKILL_SECTIONS = ("## Use When", "## Planning Hints", "## Tool Guardrails", "## State Checks", "## Avoid", "## Evidence")
#: Words a strict skill text does not have.
SKILL_STRICT = (r"\bschemas?\b", r"\blogs?\b", r"\bexamples?\b")
SKILL_BANNED = (r"\bdatasets?\b", r"\btrajector(?:y|ies)\b", r"\btraining\b", r"\bthinking process\b", r"\banalyze the request\b", r"\bdrafting the content\b")
SKILL_WILDCARD = r"mcp_tool_[a-zA-Z0-9_]+\*|mcp_tool_[a-zA-Z0-9_]+_\b|\b(?:list|get|create|update|delete)_\*"
DESCRIPTION_STOPS = ("### Responses", "## Responses", "**200**", "**201**", "**400**", "**401**", "**403**", "**404**", "**422**", "Content-Type:", "**Example Response:**", "Example Response:", "Example:", "```")
SCHEMA_HEADER = "Database Schema (SQLite3):"
IMPORTANT_COLUMN = r"(status|state|type|role|priority|category|method|mode|frequency|interval|currency|amount|total|balance|price|cost|quantity|qty|count|is_|has_|default|primary|active|created_at|updated_at|date|time|id$)"
TOOL_PREFIX = "mcp_tool_mcp_server_"
REWARD_VALUES = (("complete", 1.0), ("incomplete", 0.1), ("agent_error", 0.0), ("server_error", 0.0), ("judge_error", 0.0), ("others", 0.0), ("format_error", -1.0))


def normalized_name(c: Column) -> Column:
    """Scenario names as they are matched: lower case, anything but a-z, 0-9 and _ becomes one _, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_"), F.lit("_"))


def file_safe(c: Column, fallback: str = "item") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_"), F.lit("_")), F.lit("")), F.lit(fallback))


def run_component(c: Column, fallback: str = "run") -> Column:
    """The last part of a path as a folder name."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(last, "[^a-zA-Z0-9_.-]+", "_"), F.lit("._-")), F.lit("")), F.lit(fallback))


def task_key(scenario: Column, task_id: Column) -> Column:
    return F.concat(scenario, F.lit("/task_"), task_id.cast("string"))


def compact_space(c: Column) -> Column:
    """White space as Python sees it, runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def truncated(c: Column, most: int, before: str = "") -> Column:
    """At most `most` characters, then a mark with the number that went; `before` stands before the mark."""
    if most < 0:
        raise ValueError("most must not be negative")
    n = F.char_length(c)
    return F.when(n > most, F.concat(F.substring(c, 1, most), F.lit(f"{before}...[truncated "), (n - most).cast("string"), F.lit(" chars]"))).otherwise(c)


def has_error_phrase(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in ERROR_PHRASES])


def error_class(c: Column) -> Column:
    """Null unless the text starts with "Error:"; else the first label whose pattern is found, or tool_error."""
    label = reduce(lambda w, x: w.when(c.rlike(f"(?i){x[1]}"), x[0]), ERROR_LABELS[1:], F.when(c.rlike(f"(?i){ERROR_LABELS[0][1]}"), ERROR_LABELS[0][0]))
    return F.when(c.startswith("Error:"), label.otherwise("tool_error"))


def is_mutating(tool: Column) -> Column:
    return F.coalesce(tool.rlike(f"(?i){MUTATING_PATTERN}"), F.lit(False))


def scenario_text(name: str = "name", description: str = "description", categories: str = "categories", features: str = "simulatable_features") -> Column:
    """What a scenario is embedded by: its name, 500 characters of description, categories and five features, in one
    line; missing parts are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(part(F.col(name)), F.lit(": "), part(F.substring(F.col(description), 1, 500)), F.lit(" Categories: "), part(F.array_join(categories, ", ")), F.lit(". Features: "), part(F.array_join(F.slice(F.col(features), 1, 5), ", ")))


def quoted(c: Column) -> Column:
    """A text as a JSON string; null as null."""
    both = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substr(both, F.lit(2), F.char_length(both) - 2))


def trace_text(task: Column, steps: Column, final: Column) -> Column:
    """Numbered steps (structs with step, tool, and args and obs as JSON texts) and the final answer as one text."""
    lines = F.transform(steps, lambda s: F.concat(s["step"].cast("string"), F.lit(". Call "), s["tool"], F.lit(" with "), F.coalesce(s["args"], F.lit("null")), F.lit("; observe "), F.coalesce(s["obs"], F.lit("null")), F.lit(".")))
    return F.concat(F.lit("Task: "), F.coalesce(task, F.lit("")), F.lit("\nSteps:\n"), F.array_join(lines, "\n"), F.lit("\nFinal: "), F.coalesce(final, F.lit("")))


def tool_description(c: Column, stops: tuple[str, ...] = DESCRIPTION_STOPS) -> Column:
    """The non-empty lines before the first one that begins with a stop."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
    lines = F.filter(lines, lambda x: x != "")
    is_stop = F.transform(lines, lambda x: reduce(lambda a, b: a | b, [x.startswith(s) for s in stops]))
    at = F.array_position(is_stop, F.lit(True))
    return F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), at.cast("int") - 1)).otherwise(lines), "\n")


def word_total(c: Column) -> Column:
    t = compact_space(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def skill_warnings(c: Column, max_words: int, strict: bool = False) -> Column:
    """Warnings on a skill text, in order; an empty array is a good one. strict: each word that names where the skill comes
    from is a warning of its own, and warnings are sorted."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(~c.contains(s), F.lit(s)) for s in SKILL_SECTIONS])), ",")
    banned = F.array_join(F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(p)) for p in SKILL_BANNED])), ",")
    words, sure = word_total(c), F.regexp_count(c, F.lit(r"(?i)Confidence:\s*(high|medium|low)\b"))
    found = F.array_compact(F.array(
        F.when(missing != "", F.concat(F.lit("missing_sections:"), missing)),
        F.when(words > max_words, F.concat(F.lit("too_long:"), words.cast("string"), F.lit(f">{max_words}"))),
        F.when(c.rlike(SKILL_WILDCARD), F.lit("wildcard_or_placeholder_tool_name")),
        F.when(banned != "", F.concat(F.lit("banned_terms:"), banned)),
        F.when(c.contains("```"), F.lit("code_fence")),
        F.when(sure != 1, F.concat(F.lit("confidence_count:"), sure.cast("string"))),
    ))
    if not strict:
        return found
    more = F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(f"banned_terms:{p}")) for p in SKILL_STRICT]))
    return F.array_sort(F.array_distinct(F.concat(found, more)))


def reward_value(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in REWARD_VALUES for x in kv])[c]


def is_valid_result(mode: str, mode_c: Column, reward: Column, verdict: Column) -> Column:
    """Whether a stored verdict counts as done: its mode, a known reward type and a verdict at all."""
    return F.coalesce((mode_c == mode) & reward.isin(*REWARD_TYPES) & verdict.isNotNull(), F.lit(False))


def schema_text(tables: Column) -> Column:
    """DDL and index statements of all tables (structs of name, ddl, indexes) under a header; a blank line follows each
    DDL and each table's indexes, and none ends the text."""
    def lines(t: Column) -> Column:
        ddl, indexes = F.btrim(F.coalesce(t["ddl"], F.lit("")), F.lit(" \t\n\r")), F.coalesce(t["indexes"], F.array().cast("array<string>"))
        plain = F.filter(F.transform(indexes, lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x != "")
        none = F.array().cast("array<string>")
        return F.concat(F.when(ddl != "", F.array(ddl, F.lit(""))).otherwise(none), plain, F.when(F.size(indexes) > 0, F.array(F.lit(""))).otherwise(none))

    whole = F.concat(F.array(F.lit(SCHEMA_HEADER), F.lit("")), F.flatten(F.transform(tables, lines)))
    return F.regexp_replace(F.array_join(whole, "\n"), r"\n+$", "")


def tool_summary(endpoints: Column) -> Column:
    """One line for each endpoint (structs of method, path, summary, description, function, parameters: names)."""
    def line(e: Column) -> Column:
        said = compact_space(F.coalesce(F.nullif(e["summary"], F.lit("")), e["description"], F.lit("")))
        args = F.array_join(F.slice(e["parameters"], 1, 12), ", ")
        return F.concat(F.lit(f"- `{TOOL_PREFIX}"), F.coalesce(e["function"], F.lit("")), F.lit("`: "), e["method"], F.lit(" "), e["path"], F.when(args != "", F.concat(F.lit("; args: "), args)).otherwise(""), F.when(said != "", F.concat(F.lit("; "), F.substring(said, 1, 180))).otherwise(""))

    return F.when(F.size(endpoints) > 0, F.array_join(F.transform(endpoints, line), "\n")).otherwise("(tool summary unavailable)")


def database_summary(lines: Column, most: int) -> Column:
    """The summaries of the first `most` tables, and how many more there are."""
    more = F.size(lines) - most
    return F.when(F.size(lines) > 0, F.concat_ws("\n", F.array_join(F.slice(lines, 1, most), "\n"), F.when(more > 0, F.concat(F.lit("- ... "), more.cast("string"), F.lit(" more tables omitted"))))).otherwise("(database summary unavailable)")
