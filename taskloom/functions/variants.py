"""JSON of any shape inside the JVM: strictness, payload flags, and nested schemas walked as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EMPTY_PATTERN

#: A JSON string; possessive, so a long one costs no stack. Control characters end no string: JSON has none in it.
STRING = r'"([^"\\\x00-\x1F]*+(?:\\.[^"\\\x00-\x1F]*+)*+)"'
#: Numbers that JSON does not have but Python reads.
ODD_NUMBER = r"(?<![\w.])-?(?:NaN|Infinity)(?![\w.])"
SPACES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def strict_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else, as Python reads it: NaN and infinities are numbers, keys may be
    repeated, control characters in strings and what follows the value are not allowed. Null is not JSON.

    The text is put into an object, with a key after it that no text can know; only a whole value leaves that key in place.
    """
    seal = F.hex(F.xxhash64(c, F.lit("seal")))
    wrapped = F.concat(F.lit('{"v":'), F.regexp_replace(c, ODD_NUMBER, "0"), F.lit(',"'), seal, F.lit('":0}'))
    keys = F.json_object_keys(wrapped)
    whole = keys == F.array(F.lit("v"), seal)
    return F.coalesce(whole & ~F.regexp_replace(c, STRING, "").contains('"'), F.lit(False))


def payload_flags(c: Column | str) -> Column:
    """struct(json_like, non_empty, empty_signal) of a response.

    An error or a blank text holds nothing, and text that is no JSON is full. Of JSON, a scalar is neither; a list holds
    something if it has items; an object does if it has a value that is not null, "" or empty anywhere inside, or an object
    inside it (or itself) has values and no containers. This is read off the text with its values replaced by letters: no
    recursion, and no Python.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, "")
    m = F.regexp_replace(t, STRING, "\x01$1\x02")  # no string has these two inside
    m = F.regexp_replace(F.replace(m, F.lit("\x01\x02"), F.lit('""')), "\x01[^\x02]*+\x02", "S")
    m = F.regexp_replace(m, r'(?:S|"")\s*:', "k:")
    m = F.regexp_replace(m, r"-?[0-9][0-9.eE+\-]*|true|false|-?Infinity|NaN", "S")
    m = F.regexp_replace(F.regexp_replace(m, r'null|""', "E"), r"\s+", "")
    like = m.startswith("{") | m.startswith("[")
    inside = m.contains("S") | m.rlike(r"\[[^\]]|\{k:E(?:,k:E)*+\}")
    full = F.when(m.startswith("["), m != "[]").otherwise(inside)
    says = t.rlike(f"(?i){EMPTY_PATTERN}")
    made = lambda a, b, e: F.struct(a.alias("json_like"), b.alias("non_empty"), e.alias("empty_signal"))
    no = F.lit(False)
    nothing = (t == "") | t.startswith("Error:")
    return F.when(nothing, made(no, no, says)).when(~strict_json(t), made(no, F.lit(True), says)).otherwise(made(like, like & full, like & ~full))


_PROPERTIES = "LATERAL variant_explode(CASE WHEN schema_of_variant(try_variant_get(w.node, '$.properties', 'variant')) LIKE 'OBJECT%' THEN try_variant_get(w.node, '$.properties', 'variant') END)"
_ITEMS = "try_variant_get(p, '$.items', 'variant')"


def flat_schema(tools: DataFrame) -> DataFrame:
    """Rows (tool, path, type, required, default, allowed, description) of nested input schemas (tool, schema: JSON text).

    Properties of objects have the path a.b, those of the items of an array a[].b. type is a name, or several as a JSON
    list; default and allowed are compact JSON. A schema that is no JSON object has no rows. Each level of nesting is one
    step of a recursive query.
    """
    spark = tools.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows grow with the tools; depth is bounded by its own limit
    text = lambda field: f"CASE WHEN try_variant_get(p, '$.{field}', 'variant') IS NOT NULL AND NOT is_variant_null(try_variant_get(p, '$.{field}', 'variant')) THEN to_json(try_variant_get(p, '$.{field}', 'variant')) END"
    return spark.sql(
        f"""WITH RECURSIVE walk(tool, prefix, node) AS (
          SELECT tool, '', try_parse_json(schema) FROM {{tools}}
          UNION ALL
          SELECT tool, prefix || name || suffix, CASE suffix WHEN '.' THEN p ELSE {_ITEMS} END
          FROM (SELECT w.tool, w.prefix, e.key AS name, e.value AS p, suffix FROM walk w, {_PROPERTIES} e, LATERAL (VALUES ('.'), ('[].')) s(suffix))
          WHERE schema_of_variant(p) LIKE 'OBJECT%' AND (suffix = '.' OR schema_of_variant({_ITEMS}) LIKE 'OBJECT%'))
        SELECT tool, prefix || name AS path,
          CASE WHEN schema_of_variant(try_variant_get(p, '$.type', 'variant')) = 'STRING' THEN nullif(try_variant_get(p, '$.type', 'string'), '') ELSE {text("type")} END AS type,
          coalesce(array_contains(try_variant_get(node, '$.required', 'array<string>'), name), false) AS required,
          {text("default")} AS default, {text("enum")} AS allowed, try_variant_get(p, '$.description', 'string') AS description
        FROM (SELECT w.tool, w.prefix, w.node, e.key AS name, e.value AS p FROM walk w, {_PROPERTIES} e)
        WHERE schema_of_variant(p) LIKE 'OBJECT%'""",
        tools=tools.select("tool", "schema"),
    )
