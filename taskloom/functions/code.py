"""Source code and DDL read by parsers; no code from data is ever run."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import IMPORTANT_COLUMN, compact_space
from .vectorised import vectorised

FIRST_CONSTRAINTS, FIRST_INDEXES = 6, 4


@vectorised("ok boolean, reason string")
def verifier_check(s: pd.Series) -> pd.DataFrame:
    """Whether a verifier's code can be used: long enough, parses, and defines a verify_ function at the top."""
    def one(code: str | None) -> tuple[bool, str | None]:
        if code is None or len(code.strip()) < 10:
            return False, "too_short"
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False, "syntax_error"
        named = any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("verify_") for n in tree.body)
        return named, None if named else "no_verify_function"

    return pd.DataFrame([one(x) for x in s], columns=["ok", "reason"])


def verifier_name(code: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, r"(?m)^\s*def (verify_\w+)\s*\(", 1), F.lit("")), F.lit(default))


def _parts(ddl: str) -> list[str]:
    """What stands between the outer parentheses, split at commas outside of inner ones and of quotes."""
    a, b = ddl.find("("), ddl.rfind(")")
    depth, quote, out, last = 0, "", [], a + 1
    for i in range(a + 1, b if a >= 0 else -1):
        c = ddl[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "," and depth == 0:
            out.append(ddl[last:i].strip())
            last = i + 1
        else:
            depth += (c == "(") - (c == ")")
    return [x for x in [*out, ddl[last:b].strip() if 0 <= a < b else ""] if x]


_PART = "array<struct<no int, name string, type string, is_constraint boolean, primary_key boolean, required boolean, is_unique boolean, has_default boolean, text string>>"


@vectorised(_PART)
def ddl_columns(s: pd.Series) -> pd.Series:
    """Columns and constraints of a CREATE TABLE statement, in order."""
    def one(ddl: str | None) -> list[dict]:
        rows = []
        for i, part in enumerate(_parts(ddl or "")):
            words, up = part.split(), part.upper()
            table_level = words[0].upper() in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT")
            rows.append({"no": i, "name": None if table_level else words[0].strip("\"`[]"), "type": words[1].upper() if len(words) > 1 and not table_level else None, "is_constraint": table_level, "primary_key": "PRIMARY KEY" in up, "required": "NOT NULL" in up, "is_unique": "UNIQUE" in up, "has_default": "DEFAULT" in up, "text": part})
        return rows

    return pd.Series([one(x) for x in s])


def table_summary(name: Column, parts: Column, indexes: Column, most: int = 24) -> Column:
    """A table in up to three lines: its first columns with marks, its first constraints and its first indexes."""
    cols = F.filter(parts, lambda p: ~p["is_constraint"])
    marks = lambda p: F.concat_ws(" ", p["name"], F.when(p["primary_key"], "pk"), F.when(p["required"], "required"), F.when(p["is_unique"], "unique"), F.when(p["has_default"], "default"), F.when(p["name"].rlike(f"(?i){IMPORTANT_COLUMN}"), "important"))
    text = F.coalesce(F.nullif(F.array_join(F.transform(F.slice(cols, 1, most), marks), ", "), F.lit("")), F.lit("(unparsed)"))
    rules = F.transform(F.slice(F.filter(parts, lambda p: p["is_constraint"]), 1, FIRST_CONSTRAINTS), lambda p: compact_space(p["text"]))
    found = F.transform(F.slice(F.coalesce(indexes, F.array().cast("array<string>")), 1, FIRST_INDEXES), compact_space)
    tail = lambda what, x: F.when(F.size(x) > 0, F.concat(F.lit(f"  {what}: "), F.array_join(x, "; ")))
    return F.concat_ws("\n", F.concat(F.lit("- `"), F.coalesce(name, F.lit("unknown_table")), F.lit("` columns: "), text), tail("constraints", rules), tail("indexes", found))


ENDPOINTS = "scenario string, no int, method string, path string, summary string, description string, function string, parameters array<string>, kinds array<string>, parsed boolean"
_METHODS = ("get", "post", "put", "patch", "delete")
#: Arguments that a server hands in by itself.
_GIVEN = ("request", "response")


def _said(call: ast.Call, name: str) -> str | None:
    return next((str(k.value.value) for k in call.keywords if k.arg == name and isinstance(k.value, ast.Constant)), None)


def _decorated(f: ast.AST, d: ast.AST) -> tuple | None:
    """The endpoint that a decorator of the object `app` makes of a function."""
    if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id == "app" and d.func.attr in _METHODS and d.args and isinstance(d.args[0], ast.Constant)):
        return None
    own = [a for a in [*f.args.args, *f.args.kwonlyargs] if a.arg not in _GIVEN]
    return d.func.attr.upper(), str(d.args[0].value), _said(d, "summary"), _said(d, "description"), f.name, [a.arg for a in own], [ast.unparse(a.annotation) if a.annotation else "" for a in own]


def _pieces(code: str) -> Iterator[str]:
    """Sources of the decorated functions of a text that does not parse as a whole: from a line with @app. to the
    function's head, each with an empty body."""
    lines, i = code.split("\n"), 0
    while i < len(lines):
        if lines[i].lstrip().startswith("@app."):
            for j in range(i + 1, min(i + 60, len(lines))):
                if re.match(r"\s*(async\s+)?def\s", lines[j]):
                    for k in range(j, min(j + 60, len(lines))):
                        if lines[k].rstrip().endswith(":"):
                            yield textwrap.dedent("\n".join(lines[i : k + 1])) + "\n    pass"
                            i = k
                            break
                    break
        i += 1


def _endpoints(code: str) -> tuple[bool, list[tuple]]:
    def of(source: str) -> list[tuple] | None:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        functions = sorted((f for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda f: f.lineno)
        return [e for f in functions for d in f.decorator_list if (e := _decorated(f, d))]

    whole = of(code)
    return (True, whole) if whole is not None else (False, [e for part in _pieces(code) for e in of(part) or []])


def endpoint_table(envs: DataFrame, most: int = 100) -> DataFrame:
    """Endpoints of server sources (scenario, full_code), in order; kinds are the parameters' annotations. A source that
    does not parse is read function by function (parsed is false)."""
    names = [c.split()[0] for c in ENDPOINTS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for scenario, code in zip(b["scenario"], b["full_code"]):
                ok, found = _endpoints(code or "")
                rows += [(scenario, i, *x, ok) for i, x in enumerate(found[:most])]
            yield pd.DataFrame(rows, columns=names)

    return envs.select("scenario", "full_code").mapInPandas(read, ENDPOINTS)
