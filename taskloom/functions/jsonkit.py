"""JSON that has no fixed shape: one small Arrow-batched function for each question."""

from __future__ import annotations

import json

import pandas as pd

from .text import JUDGE_CLASSES
from .vectorised import vectorised

KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def loads(text: str | None) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False, None


def dumps(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def outermost(text: str | None) -> tuple[bool, object]:
    """Strict JSON; else without control characters; else what stands between the outer braces, or brackets, then; an
    empty text is {}."""
    if text is None or not text.strip():
        return True, {}
    ok, value = loads(text)
    if not ok:  # bytes that JSON does not allow inside, then what stands around
        clean = "".join(c for c in text if c in "\t\n\r" or ord(c) >= 32)
        ok, value = loads(clean)
        for left, right in ("{}", "[]"):
            a, b = clean.find(left), clean.rfind(right)
            if not ok and 0 <= a < b:
                ok, value = loads(clean[a : b + 1])
    return ok, value


@vectorised("ok boolean, kind string, text string")
def json_facts(s: pd.Series) -> pd.DataFrame:
    """Whether a text is strict JSON, the kind of its root, and its compact form."""
    rows = [(ok, KINDS[type(v)] if ok else None, dumps(v) if ok else None) for ok, v in map(loads, s)]
    return pd.DataFrame(rows, columns=["ok", "kind", "text"])


@vectorised("ok boolean, text string")
def lenient_json(s: pd.Series) -> pd.DataFrame:
    rows = [(ok, dumps(v) if ok else None) for ok, v in map(outermost, s)]
    return pd.DataFrame(rows, columns=["ok", "text"])


@vectorised("string")
def judge_class(s: pd.Series) -> pd.Series:
    """The classification in a judge's answer; whatever is not one of the known ones is judge_error."""
    def one(text: str | None) -> str:
        ok, v = outermost(text)
        name = str(v.get("classification", "")).strip().lower() if ok and isinstance(v, dict) else ""
        return name if name in JUDGE_CLASSES else "judge_error"

    return pd.Series([one(x) for x in s])


CUTS = "array<struct<path string, type string, omitted_count long, original_chars long, kept_chars long>>"


def _cut(path: str, kind: str, **sizes: int) -> dict:
    return {"path": path, "type": kind, "omitted_count": None, "original_chars": None, "kept_chars": None} | sizes


def _shown(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[:most]}...[truncated {len(text) - most} chars]"


def shortened(value: object, items: int, chars: int) -> tuple[object, list[dict]]:
    """(value with long lists and strings cut, the cuts with their paths). Places wait on a stack, so depth costs no
    recursion; each place is a container of the new value and a key in it."""
    root, cuts = [value], []
    places = [(root, 0, "$")]
    while places:
        holder, key, path = places.pop()
        old = holder[key]
        if isinstance(old, str):
            holder[key] = _shown(old, chars)
            if len(old) > chars:
                cuts.append(_cut(path, "string", original_chars=len(old), kept_chars=chars))
        elif isinstance(old, (list, dict)):
            holder[key] = new = dict(old) if isinstance(old, dict) else old[:items]
            if len(new) < len(old):
                cuts.append(_cut(path, "list", omitted_count=len(old) - len(new)))
            inner = [(new, k, f"{path}.{k}") for k in new] if isinstance(new, dict) else [(new, k, f"{path}[{k}]") for k in range(len(new))]
            places += reversed(inner)
    return root[0], cuts


def observation(items: int = 10, chars: int = 300, json_chars: int = 2000, text_chars: int = 800):
    """A function of a response column: struct(type, content, truncated, parse_ok, truncations).

    type: none for null; json for objects and arrays, shortened and then cut as text if they are long still; else text,
    with its white space compacted. parse_ok is whether the text is JSON at all.
    """

    def of_json(value: object) -> tuple:
        small, cuts = shortened(value, items, chars)
        compact = dumps(small)
        if len(compact) > json_chars:
            cuts.append(_cut("$", "json_chars", original_chars=len(compact), kept_chars=json_chars))
        return "json", _shown(compact, json_chars), len(cuts) > 0, True, cuts

    def of_text(text: str, is_json: bool) -> tuple:
        plain = " ".join(text.split())
        return "text", _shown(plain, text_chars), len(plain) > text_chars, is_json, None

    def one(text: str | None) -> tuple:
        if text is None:
            return "none", None, False, None, None
        ok, value = loads(text)
        return of_json(value) if isinstance(value, (dict, list)) else of_text(text, ok)

    @vectorised(f"type string, content string, truncated boolean, parse_ok boolean, truncations {CUTS}")
    def summed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in s], columns=["type", "content", "truncated", "parse_ok", "truncations"])

    return summed
