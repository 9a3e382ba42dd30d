"""Rules that the driver tables do not reach, on hand-made rows."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from taskloom.functions import calls, code, jsonkit, text, variants
from taskloom.operators import diversity, rows, runtime, scores, selection, state
from taskloom.sources import tables
from taskloom.streaming import live


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, text.normalized_name(F.col("a")), a="  My Scenario--1_") == "my_scenario_1"
    assert one(spark, text.file_safe(F.col("a")), a="///") == "item"
    assert one(spark, text.run_component(F.col("a")), a="x/y z/.run-1.") == "run-1"


def test_truncated_counts_code_points(spark):
    assert one(spark, text.truncated(F.col("a"), 2, "\n"), a="äöüß") == "äö\n...[truncated 2 chars]"
    assert one(spark, text.truncated(F.col("a"), 4), a="äöüß") == "äöüß"


def test_error_class_needs_its_prefix(spark):
    c = text.error_class(F.col("a"))
    assert one(spark, c, a="a 500 internal server error in a body") is None
    assert [one(spark, c, a=f"Error: {x}") for x in ("500", "timed out", "invalid id", "404", "so")] == ["http_500", "timeout", "validation", "route_or_schema", "tool_error"]
    assert one(spark, text.has_error_phrase(F.col("a")), a="a Traceback here") is True


def test_payload_flags(spark):
    texts = ["{}", '{"a": null}', '{"a": []}', '{"a": 0}', "3", "not found", "", "Error: x", '{"a": {"b": [1]}}', "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", variants.payload_flags("t").alias("f")).orderBy("i")
    got = [(r.f.json_like, r.f.non_empty) for r in df.collect()]
    assert got == [(True, False), (True, True), (True, False), (True, True), (False, False), (False, True), (False, False), (False, False), (True, True), (True, False), (False, False)]


def test_observation_cuts_and_logs(spark):
    value = {"items": list(range(11)), "s": "x" * 301, "deep": [{"a": "y" * 302}]}
    df = spark.createDataFrame([(json.dumps(value),), ("  two\n words ",), (None,), ('"scalar"',)], "t string").select(jsonkit.observation()("t").alias("o"))
    a, b, c, d = [r.o for r in df.collect()]
    assert {(t.path, t.type) for t in a.truncations} == {("$.items", "list"), ("$.s", "string"), ("$.deep[0].a", "string")}
    assert json.loads(a.content)["items"] == list(range(10)) and a.truncated
    assert (b.type, b.content, b.parse_ok) == ("text", "two words", False)
    assert c.type == "none" and (d.type, d.parse_ok) == ("text", True)


def test_strict_json_rejects_what_follows(spark):
    df = spark.createDataFrame([('{"a":1} x',), ('{"a":1,"a":2}',), ("[1]",)], "t string").select(jsonkit.json_facts("t").alias("f"))
    assert [(r.f.ok, r.f.kind, r.f.text) for r in df.collect()] == [(False, None, None), (True, "object", '{"a":2}'), (True, "array", "[1]")]


def test_response_after(spark):
    steps = [("assistant", "", ["c"], None), ("user", "u", [], None), ("tool", "late", [], None), ("assistant", "", ["c"], "own"), ("assistant", "", ["c"], None), ("assistant", "x", ["c"], None), ("tool", "next", [], None)]
    df = spark.createDataFrame([(steps,)], "s array<struct<role string, content string, calls array<string>, response string>>")
    got = df.select(*[calls.response_after(F.col("s"), F.lit(i)).alias(f"r{i}") for i in (0, 3, 4, 5)]).first()
    assert tuple(got) == ("late", "own", None, "next")


def test_rate_text_rounds_as_python(spark):
    df = spark.createDataFrame([(0.125,), (0.165,)], "r double").select(runtime.two_digits("r").alias("t"))
    assert [r.t for r in df.collect()] == [f"{0.125:.2f}", f"{0.165:.2f}"]


def test_label_stays_for_later_calls_of_a_step(spark):
    bad = '{"tool_name": "mcp_tool_set_x", "arguments": "{", "id": 1}'
    good = '{"tool_name": "mcp_tool_set_x", "arguments": "{}"}'
    data = [("r", "s", 0, 1, 0, "call_tool", good, "Error: invalid"), ("r", "s", 0, 1, 1, "call_tool", bad, "Error: invalid"), ("r", "s", 0, 1, 2, "call_tool", good, "Error: invalid"), ("r", "s", 0, 2, 0, "call_tool", good, "Error: invalid")]
    df = spark.createDataFrame(data, "run string, scenario string, task_id long, iteration long, call_pos int, name string, args string, response string")
    got = runtime.classified_calls(df, variants.payload_flags("response")).orderBy("iteration", "call_pos")
    assert [r.label for r in got.collect()] == ["validation", "agent_argument_parse_error", "agent_argument_parse_error", "validation"]


def test_code_is_parsed_and_not_run(spark):
    df = spark.createDataFrame([("def verify_a(x):\n    return 1",), ("raise SystemExit(1)",), ("def broken(:",), ("x",)], "c string").select(code.verifier_check("c").alias("v"))
    assert [r.v.reason for r in df.collect()] == [None, "no_verify_function", "syntax_error", "too_short"]


def test_skill_warnings(spark):
    good = "\n".join(text.SKILL_SECTIONS) + "\nConfidence: high"
    assert one(spark, text.skill_warnings(F.col("a"), 50), a=good) == []
    assert one(spark, text.skill_warnings(F.col("a"), 5), a=good + " ``` training get_* Confidence: low") == ["too_long:23>5", "wildcard_or_placeholder_tool_name", r"banned_terms:\btraining\b", "code_fence", "confidence_count:2"]


def test_diverse_equals_one_by_one(spark):
    rng = random.Random(4)
    base = np.random.default_rng(1).normal(size=(6, 8))
    data = [(i, (base[rng.randrange(6)] + 0.5 * np.random.default_rng(i).normal(size=8)).tolist(), [f"c{i % 3}"]) for i in range(60)]
    pool = data[:5]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    kept: list = []
    for c in data[5:]:
        limit = 0.6 if c[2][0] == "c1" else 0.8
        if all(cos(c[1], p[1]) <= limit for p in [*pool, *kept]):
            kept.append(c)
    frame = lambda x: spark.createDataFrame(x, "id long, embedding array<double>, categories array<string>")
    counts = spark.createDataFrame([("c0", 1), ("c1", 9)], "category string, n int")
    from taskloom.sources.tables import written

    got = diversity.diverse(frame(data[5:]), frame(pool).select("id", "embedding"), counts, 0.8, 0.6, 9, save=written)
    assert sorted(r.id for r in got.where("kept").collect()) == [c[0] for c in kept]


def test_nearest_of_zero_vector(spark):
    a = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    b = spark.createDataFrame([(7, [2.0, 0.0]), (8, [1.0, 0.0])], "id long, embedding array<double>")
    assert sorted(map(tuple, diversity.nearest(a, b).collect())) == [(1, 0.0, -1), (2, 1.0, 7)]
    assert sorted(map(tuple, diversity.nearest(a, b.where("false")).collect())) == [(1, 0.0, -1), (2, 0.0, -1)]


def test_covering_examples(spark):
    data = [("s", 1, "complete", 3, ["a"]), ("s", 2, "complete", 4, ["a"]), ("s", 3, "complete", 5, ["b"]), ("s", 4, "others", 1, ["b"]), ("s", 5, "others", 2, ["z"])]
    df = spark.createDataFrame(data, "scenario string, task_id long, reward_type string, num_tool_calls int, tools_used array<string>")
    got = {(r.part, r.rank): r.task_id for r in selection.covering_examples(df, 3, 1).collect()}
    assert got == {("positive", 1): 1, ("positive", 2): 2, ("positive", 3): 3, ("negative", 1): 4}


def test_ids():
    assert rows.parsed_ids("0-3,7, 2") == [0, 1, 2, 3, 7]


def test_tiers_add_up(spark):
    k = lambda *ids: spark.createDataFrame([("s", i) for i in ids], "scenario string, task_id long")
    got = scores.tiers(k(1, 2), k(2, 3), k(4), k(3))
    assert sorted((r.task_id, r.tier) for r in got.collect()) == [(1, 1), (2, 1), (4, 3)]


def test_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "k int, v int, w string")
    b = spark.createDataFrame([(1, 3, "x"), (2, 5, "y"), (3, None, None)], "k int, v int, w string")
    assert sorted((r.k, r.change, r["columns"]) for r in state.snapshot_diff(a, b, ["k"]).collect()) == [(1, "updated", ["v"]), (3, "inserted", [])]


def test_diff_sees_nulls_that_move(spark):
    a = spark.createDataFrame([(1, 5, None), (2, None, None)], "k int, v int, w int")
    b = spark.createDataFrame([(1, None, 5), (2, None, None)], "k int, v int, w int")
    assert [(r.k, r.change, r["columns"]) for r in state.snapshot_diff(a, b, ["k"]).collect()] == [(1, "updated", ["v", "w"])]
    assert state.snapshot_diff(a.where("false"), b.where("false"), ["k"]).count() == 0


def test_cleaning_reasons(spark):
    from taskloom.operators import cleaning

    call = lambda tool, args="{}": json.dumps({"name": "call_tool", "arguments": {"tool_name": tool, "arguments": args}})
    said = lambda text, calls=(), response=None: ("assistant", text, list(calls), response)
    listed = json.dumps({"name": "list_tools", "arguments": {}})
    runs = {
        "kept": [said("", [call("b", '{"x": 1}')], '{"ok": [1, 2]}'), said("", [call("a", "oops")], "plain  text"), said("", [call("b")], None), ("tool", "late", [], None), said(" done ")],
        "text": [said(f"go <tool_call>{call('t')}</tool_call>", [], "fine"), said("end")],
        "list_only": [said("", [listed], "tools"), said("end")],
        "unparseable": [said("", [json.dumps({"name": "call_tool", "arguments": "x"})], "r"), said("end")],
        "user_only": [("user", "u", [call("t")], "r"), said("end")],
        "error": [said("", [call("t")], "a Timeout here"), said("end")],
        "no_final": [said("", [call("t")], "r")],
        "no_list": None,
    }
    schema = "run string, scenario string, task_id long, task string, steps array<struct<role string, content string, calls array<string>, response string>>"
    t = spark.createDataFrame([("r", k, 1, "do", v) for k, v in runs.items()] + [("r", "undone", 1, "do", None)], schema)
    v = spark.createDataFrame([("r", k, 1, "complete") for k in runs] + [("r", "undone", 1, "others")], "run string, scenario string, task_id long, reward_type string")
    got = {r.scenario: r for r in cleaning.cleaned(t, v).collect()}
    want = {"kept": None, "text": None, "list_only": "no_call_tool", "unparseable": "all_tool_calls_unparseable", "user_only": "no_call_tool", "error": "tool_error", "no_final": "no_final_answer", "no_list": "parse_error", "undone": "not_complete"}
    assert {k: r.reason for k, r in got.items()} == want
    assert got["kept"].tools_used == ["b", "a", "b"]
    assert got["kept"].trace == 'Task: do\nSteps:\n1. Call b with {"x":1}; observe {"ok":[1,2]}.\n2. Call a with "oops"; observe "plain text".\n3. Call b with {}; observe "late".\nFinal: done'


def test_all_calls_of_a_text(spark):
    text = 'x <tool_call>{"name": "mcp_tool_get", "arguments": {"a": 1}}</tool_call> y <tool_call>[{"name": "z"}]</tool_call><tool_call>no</tool_call>'
    got = spark.createDataFrame([(text,)], "t string").select(calls.all_calls(F.col("t")).alias("c")).first().c
    assert json.loads(got[0]) == {"name": "call_tool", "arguments": {"tool_name": "mcp_tool_get", "arguments": '{"a":1}'}} and json.loads(got[1]) == {"name": "z"} and len(got) == 2


def test_endpoints_of_broken_sources():
    source = '@app.get("/a", summary="S")\nasync def a(x: int, request: Request, *, y: str = "d"):\n    return 1\n\n@other.get("/b")\ndef b(): pass\n'
    found = ("GET", "/a", "S", None, "a", ["x", "y"], ["int", "str"])
    assert code._endpoints(source) == (True, [found]) and code._endpoints(source + "def (") == (False, [found])


def write_verdict(root, run, task, reward, mode="code"):
    p = root / run / "scn" / f"task_{task}"
    p.mkdir(parents=True, exist_ok=True)
    (p / f"verify.{mode}.json").write_text(json.dumps({"reward_type": reward}))


def test_run_tree_and_quarantine(spark, tmp_path):
    write_verdict(tmp_path, "r1", 1, "complete")
    write_verdict(tmp_path, "r1", 2, "others")
    (tmp_path / "r1/scn/task_2/trajectory.json").write_text("[]")
    (tmp_path / "r1/scn/task_1/trajectory.json").write_text("{ broken")
    good, bad = tables.read_run_tree(spark, str(tmp_path))
    assert sorted((r.run, r.task_id, r.kind, r.mode) for r in good.collect()) == [("r1", 1, "verify", "code"), ("r1", 2, "verify", "code")]
    assert sorted((r.task_id, r.reason) for r in bad.collect()) == [(1, "not_json"), (2, "not_an_object")]


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "sink")
    assert tables.append_new(df, path, ["k"]) == 2
    assert tables.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3


def test_json_lines_apart(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    good, bad = tables.read_json_lines_apart(spark, str(tmp_path / "t.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert bad.count() == 1


def test_stream_counts_each_file_once(spark, tmp_path):
    root, at = tmp_path / "runs", str(tmp_path / "ck")
    write_verdict(root, "r1", 1, "complete")
    write_verdict(root, "r1", 2, "others")

    def turn():
        q = live.each_batch(live.verdict_stream(spark, str(root)), lambda df: df.select("run", "task_id", "mode", "reward_type"), str(tmp_path / "sink"), ["run", "task_id", "mode"], at)
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "sink"))

    assert turn().count() == 2
    write_verdict(root, "r1", 3, "complete")
    rows_ = turn()  # starts again from its checkpoint
    assert rows_.count() == 3 and rows_.where("reward_type = 'complete'").count() == 2


def run_frames(spark):
    calls = [("r1", "s", 1, 1, 0, "call_tool", '{"tool_name": "mcp_tool_set_x", "arguments": "{}"}', '{"ok": 1}', True), ("r1", "s", 2, 1, 0, "call_tool", '{"tool_name": "mcp_tool_set_x", "arguments": "{}"}', "Error: 500 Internal Server Error", False)]
    calls = spark.createDataFrame(calls, "run string, scenario string, task_id long, iteration long, call_pos int, name string, args string, response string, is_final boolean")
    verdicts = spark.createDataFrame([("r1", "s", 1, "complete", True), ("r1", "s", 2, "others", True), ("r1", "s", 3, "others", True)], "run string, scenario string, task_id long, reward_type string, readable boolean")
    return verdicts, calls, spark.createDataFrame([("s", i) for i in range(1, 5)], "scenario string, task_id long")


def test_allowlist_job(spark, tmp_path):
    verdicts, calls_, source = run_frames(spark)
    flags = variants.payload_flags("response")
    got = runtime.allowlist_job(verdicts, calls_, flags, source, str(tmp_path / "lenient"))
    assert {r.task_id: r.decision for r in got["decisions"].collect()} == {1: "keep", 2: "reject", 3: "reject"}
    assert {(r.task_id, r.decision) for r in got["allowlist"].collect()} == {(1, "keep"), (4, "missing_evidence")}
    assert got["stats"].collect()[0].asDict() == {"tasks_analyzed": 3, "n_keep": 1, "n_review": 0, "n_reject": 2, "run_task_records": 3}
    assert {r.task_id: (r.final_seen, r.tool_calls) for r in got["runs"].collect()} == {1: (True, 1), 2: (False, 1), 3: (False, 0)}
    assert sorted(p.name for p in (tmp_path / "lenient/decisions").iterdir() if p.is_dir()) == ["decision=keep", "decision=reject"]
    strict = runtime.allowlist_job(verdicts, calls_, flags, source, str(tmp_path / "strict"), expected_runs=1)
    assert {r.task_id: r.decision for r in strict["decisions"].collect()} == {1: "keep", 2: "reject", 3: "reject"}
    empty = runtime.allowlist_job(verdicts.where("false"), calls_.where("false"), flags, source, str(tmp_path / "empty"))
    assert empty["decisions"].count() == 0 and empty["stats"].first().tasks_analyzed == 0 and empty["allowlist"].count() == 4


def test_strict_needs_complete_runs(spark):
    verdicts, calls_, _ = run_frames(spark)
    known = runtime.classified_calls(calls_, variants.payload_flags("response"))
    args = runtime.run_rows(verdicts, runtime.run_counters(known)), runtime.error_signatures(known)
    assert {r.decision for r in runtime.strict_decisions(*args, expected_runs=3).where("task_id <> 1").collect()} == {"review"}


def test_global_check_of_few_and_of_a_sample(spark):
    m = np.random.default_rng(5).normal(size=(30, 4))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    few = diversity.global_check(v.where("id < 9"), 0.5).first()
    assert (few.status, few.n_rows, few.mean) == ("not_enough_data", 9, None)
    some = diversity.global_check(v, 0.5, sample=12).first()
    assert (some.status, some.n_rows, some.n_sample, some.n_pairs) == ("ok", 30, 12, 66)


def test_manifest_and_requests_without_rows(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "scenario string")
    good = "\n".join(text.SKILL_SECTIONS) + "\nConfidence: high"
    m = selection.skill_manifest(asked, spark.createDataFrame([("a", good), ("b", " "), ("c", "no")], "scenario string, skill string"), 50)
    assert {r.scenario: (r.status, r.quality_ok) for r in m.collect()} == {"a": ("done", True), "b": ("skipped", None), "c": ("done", False)}
    assert tuple(selection.manifest_totals(m).first()) == (3, 2, 1, 1, 1)
    none = spark.createDataFrame([], "scenario string, task_id long, part string, rank int, trace string")
    r = selection.distillation_requests(none, spark.createDataFrame([("s", "others")], "scenario string, reward_type string"), spark.createDataFrame([], "scenario string, tool_summary string, db_summary string"), "{scenario}:{tools}:{positives}").first()
    assert (r.prompt, r.positive_task_ids, r.num_positive_available, r.num_aux_available, r.has_tool_summary) == ("s:(tool summary unavailable):", [], 0, 1, False)
