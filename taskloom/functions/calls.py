"""Tool calls in run logs: extraction, normal form, and the response that belongs to a call."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonkit import json_facts, loads
from .vectorised import vectorised

CALL_BLOCK = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"


def all_calls(content: Column) -> Column:
    """Every <tool_call> block that is JSON, as an agent reads them: a list gives its first element, and a tool of the
    server's own name becomes a call_tool of it."""
    first = lambda j: F.when(j.startswith("["), F.get_json_object(j, "$[0]")).otherwise(j)
    blocks = F.transform(F.regexp_extract_all(content, F.lit(CALL_BLOCK), F.lit(1)), first)
    blocks = F.filter(blocks, lambda j: F.get_json_object(j, "$.name").isNotNull())

    def wrapped(j: Column) -> Column:
        name, args = F.get_json_object(j, "$.name"), F.coalesce(F.get_json_object(j, "$.arguments"), F.lit("{}"))
        inner = F.to_json(F.struct(name.alias("tool_name"), args.alias("arguments")))
        return F.when(name.startswith("mcp_tool_"), F.concat(F.lit('{"name":"call_tool","arguments":'), inner, F.lit("}"))).otherwise(j)

    return F.transform(blocks, wrapped)


@vectorised("array<string>")
def first_objects(s: pd.Series) -> pd.Series:
    """For each text of an array the first <tool_call> block, if it is a JSON object, else null."""
    block = re.compile(CALL_BLOCK)

    def one(text: str | None) -> str | None:
        found = block.search(text or "")
        return found[1] if found and isinstance(loads(found[1])[1], dict) else None

    return s.map(lambda texts: None if texts is None else [one(t) for t in texts])


def steps_with_calls(steps: Column) -> Column:
    """steps (structs: role, content, calls, response) with their calls: structured calls (JSON texts) win; a step
    without any has the one in its text. No shuffle."""
    none = F.array().cast("array<string>")
    texts = first_objects(F.transform(steps, lambda s: s["content"]))

    def filled(s: Column, said: Column) -> Column:
        own = F.coalesce(s["calls"], none)
        calls = F.when(F.size(own) > 0, own).when(said.isNotNull(), F.array(said)).otherwise(none)
        return F.struct(s["role"].alias("role"), s["content"].alias("content"), calls.alias("calls"), s["response"].alias("response"))

    return F.zip_with(steps, texts, filled)


def normalized_call(call: Column) -> Column:
    """struct(tool, args, args_parse_ok) of a call's JSON text, null for list_tools; call_tool is unwrapped: its
    inner arguments are a JSON text of their own, parsed with a flag; args is JSON text."""
    name, args = F.get_json_object(call, "$.name"), F.get_json_object(call, "$.arguments")
    inner = F.get_json_object(args, "$.arguments")
    outer_ok = args.startswith("{")
    made = lambda tool, a, ok: F.struct(tool.alias("tool"), a.alias("args"), ok.alias("args_parse_ok"))
    none = F.lit(None).cast("string")
    facts = json_facts(inner)
    wrapped = F.when(F.coalesce(outer_ok, F.lit(False)), made(F.get_json_object(args, "$.tool_name"), F.coalesce(facts["text"], inner), F.coalesce(facts["ok"], F.lit(False)))).otherwise(made(none, args, F.lit(False)))
    other = made(name, args, F.coalesce(args.startswith("{") | args.startswith("["), args.isNull()))
    return F.when(name == "list_tools", None).when(name == "call_tool", wrapped).otherwise(other)


def call_tool_name(args: Column) -> Column:
    """The tool a call_tool addresses, without the server's prefix; empty if args are no JSON object."""
    return F.coalesce(F.regexp_replace(F.get_json_object(args, "$.tool_name"), "^mcp_tool_", ""), F.lit(""))


def has_split_arguments(args: Column) -> Column:
    """Inner arguments that were not escaped, so that their parts became keys of the outer object."""
    inner = F.get_json_object(args, "$.arguments")
    return F.coalesce(F.trim(inner).startswith("{") & (F.size(F.json_object_keys(args)) > 2), F.lit(False))


def response_after(steps: Column, at: Column) -> Column:
    """The response of the calling step `at` (0-based) of steps (structs: role, content, calls, response): its own,
    else that of the next tool message before the next assistant step that calls. Array functions only, no shuffle."""
    step = F.get(steps, at)
    rest = F.slice(steps, at + 2, F.greatest(F.size(steps), F.lit(1)))
    kind = F.transform(rest, lambda s: F.when(s["role"] == "tool", 1).when((s["role"] == "assistant") & (F.size(s["calls"]) > 0), 2).otherwise(0))
    tool, caller = F.array_position(kind, F.lit(1)), F.array_position(kind, F.lit(2))
    found = F.when((tool > 0) & ((caller == 0) | (tool < caller)), F.get(rest, (tool - 1).cast("int"))["content"])
    return F.coalesce(step["response"], found)
