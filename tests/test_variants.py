"""JSON inside the JVM against plain Python, on nested values."""

import json
import random
import re

from pyspark.sql import functions as F

from taskloom.functions import variants
from taskloom.functions.text import EMPTY_PATTERN

ODD = ['{"a":1} x', '{"a":1,"a":null}', "01", "1.", "NaN", '{"a": NaN}', "[-Infinity]", '"a\tb"', '{"a": "x\ny"}', "tru", "nulls", '{"a":1}}', "1],[2", '1,"x":2', '"\\q"', '"\\u12g4"', '{"k":"NaN, {}[]:null"}', '"', '{"":""}', '{"": null}', '{"a":""}', '{"a":{"":""},"b":[]}', "  {}  ", " [] ", "\x1c{}", "", " \n", None, "Error: not found", "no results found", "[]", "[[]]", '{"a":{"b":[]}}', '{"a":{"b":null}}', '{"a":{},"b":null}', "null", "3", '""', '{"a":0}', '{"a":false}', '{"a":1e5}', '"' + "x" * 100_000 + '"', '{"a":"' + "\\n" * 50_000 + '"}', "[" * 50 + "]" * 50]


def nested(r, depth):
    kind = r.randrange(9) if depth else r.randrange(6)
    if kind < 6:
        return [None, "", r.choice(["a", "x: {}", 'q"\\', "é[]", "null"]), 0, 1.5, False][kind]
    if kind == 6:
        return [nested(r, depth - 1) for _ in range(r.choice([0, 0, 1, 2]))]
    return {r.choice(["", "k", "S", 'a"b', "{"]) + str(i): nested(r, depth - 1) for i in range(r.choice([0, 1, 1, 2, 3]))}


def barren(r, depth):
    """Values that mostly hold nothing."""
    return r.choice([None, "", [], {}]) if not depth or r.random() < 0.3 else {f"k{i}": barren(r, depth - 1) for i in range(r.choice([1, 2]))}


def has_leaf(v):
    if isinstance(v, list):
        return len(v) > 0
    inner = [x for x in v.values() if isinstance(x, (list, dict))]
    return any(x not in (None, "") or x is False for x in v.values() if not isinstance(x, (list, dict))) or any(map(has_leaf, inner)) or (bool(v) and not inner)


def plain_flags(text):
    t = (text or "").strip()
    says = bool(re.search(EMPTY_PATTERN, t, re.I))
    if not t or t.startswith("Error:"):
        return False, False, says
    try:
        v = json.loads(t)
    except ValueError:
        return False, True, says
    like = isinstance(v, (list, dict))
    return like, like and has_leaf(v), like and not has_leaf(v)


def test_strict_json_and_payload_flags(spark):
    r = random.Random(7)
    texts = ODD + [json.dumps(make(r, 8), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for make in (nested, barren) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", variants.payload_flags("t").alias("f"), variants.strict_json(F.col("t")).alias("ok"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = []
    for row in df.collect():
        t = texts[row.i]
        try:
            json.loads(t)
            ok = True
        except (TypeError, ValueError):
            ok = False
        if (tuple(row.f), row.ok) != (plain_flags(t), ok):
            wrong.append((t[:80] if t else t, tuple(row.f), plain_flags(t), row.ok, ok))
    assert not wrong


def schema_of(r, depth):
    out = {"type": r.choice(["string", "object", ["string", "null"], None, ""])}
    if r.random() < 0.3:
        out["default"] = r.choice([0, "x", None, [1, "b"], True])
    if r.random() < 0.3:
        out["enum"] = ["a", 1]
    if r.random() < 0.5:
        out["description"] = r.choice(["some words", None])
    if depth:
        out["properties"] = {f"p{i}": r.choice([schema_of(r, depth - 1), "odd"] + [schema_of(r, depth - 1)] * 3) for i in range(r.randrange(3))}
        out["required"] = r.choice([["p0"], [], None])
        if r.random() < 0.4:
            out["items"] = schema_of(r, depth - 1)
    return out


def plain_rows(schema, prefix=""):
    compact = lambda v: None if v is None else json.dumps(v, separators=(",", ":"))
    for name, p in (schema.get("properties") or {}).items():
        if isinstance(p, dict):
            kind = p.get("type")
            yield prefix + name, (kind or None) if not isinstance(kind, list) else compact(kind), name in (schema.get("required") or []), compact(p.get("default")), compact(p.get("enum")), p.get("description")
            yield from plain_rows(p, f"{prefix}{name}.")
            if isinstance(p.get("items"), dict):
                yield from plain_rows(p["items"], f"{prefix}{name}[].")


def test_nested_schemas_without_python(spark):
    r = random.Random(3)
    made = [schema_of(r, 8) for _ in range(60)]
    texts = [json.dumps(x) for x in made] + [None, "", "[1]", "{bad", '{"properties": []}', '{"properties": {"a": {"type": "x", "properties": 3}}}']
    df = variants.flat_schema(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "tool string, schema string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((tuple(x) for x in df.collect()), key=repr)
    want = [(str(i), *x) for i, s in enumerate(made) for x in plain_rows(s)] + [("65", "a", "x", False, None, None, None)]
    assert max(x[1].count(".") for x in want) >= 5
    assert got == sorted(want, key=repr)
