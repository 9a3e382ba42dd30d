"""Stages of generation, profiles, builds, history rows and examples against plain versions."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.functions import text
from taskloom.operators import attempts, build, profile, rows, scores, selection, training
from taskloom.plans import registry
from taskloom.sources.committed import manifests, read_committed

TRIED = "stage string, scenario string, attempt int, response string, error_ratio double, errors array<string>"


def plain_ok(stage, response, ratio, n):
    """Whether a response passes its stage, and what it says."""
    try:
        cut = response[response.index("{") : response.rindex("}") + 1]
        v = json.loads(cut)
    except (AttributeError, ValueError):
        return False
    said = lambda k: bool(str(v.get(k) or "").strip())
    if stage == "scenario":
        return said("name") and said("description")
    if stage == "tasks":
        return len(v.get("tasks") or []) >= n
    if stage == "spec":
        return sum(len(g.get("endpoints") or []) for g in v.get("api_groups") or []) > 0
    if stage in ("env", "verifier"):
        return said({"env": "code", "verifier": "python_code"}[stage])
    return stage in attempts.MEASURED and ratio is not None and ratio <= 0.1


def test_attempts_against_a_plain_version(spark):
    r = random.Random(1)
    texts = ['{"name":"a","description":"b"}', '{"name":"a","description":" "}', 'so {"tasks":["x","y","z"]} ok', '{"tasks":["x"]}', '{"api_groups":[{"endpoints":[]},{"endpoints":[{"p":1}]}]}', '{"api_groups":[{"endpoints":[]},{}]}', '{"code":"x"}', '{"python_code":"y"}', '{"tables":[]}', "", None, "{broken"]
    data = [(stage, f"s{k}", a, r.choice(texts), r.choice([None, 0.05, 0.1, 0.2, 0.2, 0.9]), []) for stage in (*attempts.STAGES, "other") for k in range(25) for a in range(1, r.randrange(2, 6))]
    got = {(x.stage, x.scenario, x.attempt): x for x in attempts.judged_attempts(spark.createDataFrame(data, TRIED), most=3, n_tasks=2).collect()}
    groups = {}
    for row in data:
        groups.setdefault(row[:2], []).append(row)
    for (stage, scenario), tries in groups.items():
        ok = [t[2] for t in tries if plain_ok(stage, t[3], t[4], 2)]
        first, last, held = min(ok, default=None), max(t[2] for t in tries), None
        if first is None and last >= 3 and stage in attempts.MEASURED:
            held = min(((t[4], t[2]) for t in tries if t[4] is not None and t[3] and "{" in t[3] and "}" in t[3]), default=(None, None))[1]
        for t in tries:
            a = t[2]
            want = "accepted" if a == first else "extra" if first and a > first else "fallback" if a == held else "given_up" if not first and last >= 3 and a == last else "retry"
            assert got[stage, scenario, a].state == want, (t, ok)
    cut = [json.loads(x.parsed)["tasks"] for x in got.values() if x.stage == "tasks" and x.ok]
    assert cut and all(c == ["x", "y"] for c in cut)


def test_results_and_next_requests(spark):
    data = [
        ("scenario", "a", 1, '{"name":"n","description":"d"}', None, []), ("tasks", "a", 1, "no", None, ["boom", "bad"]), ("tasks", "a", 2, None, None, ["boom"]),
        ("scenario", "b", 1, "", None, ["x"]), ("scenario", "b", 2, "", None, None), ("scenario", "b", 3, "", None, ["y"]), ("scenario", "c", 1, '{"name":"n","description":"d"}', None, []), ("tasks", "c", 1, '{"tasks":["t","u","v"]}', None, []),
        ("schema", "c", 1, "{}", 0.5, ["e1"]), ("schema", "c", 2, "{}", 0.4, []), ("schema", "c", 3, "{}", 0.4, []),
    ]
    tried = spark.createDataFrame(data, TRIED)
    results = attempts.stage_results(attempts.judged_attempts(tried, n_tasks=2))
    assert {(x.stage, x.scenario): (x.status, x.attempts, x.attempt) for x in results.collect()} == {("scenario", "a"): ("accepted", 1, 1), ("tasks", "a"): ("retry", 2, None), ("scenario", "b"): ("given_up", 3, None), ("scenario", "c"): ("accepted", 1, 1), ("tasks", "c"): ("accepted", 1, 1), ("schema", "c"): ("fallback", 3, 2)}
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "scenario string")
    asked = attempts.next_requests(names, results, tried, {s: s + "|{scenario}|{payload}|{errors}" for s in attempts.STAGES})
    assert {(x.stage, x.scenario, x.attempt): x.prompt for x in asked.collect()} == {
        ("tasks", "a", 3): 'tasks|a|{"name":"n","description":"d"}|bad\nboom', ("sample", "c", 1): "sample|c|{}|", ("scenario", "d", 1): "scenario|d||",
    }


def test_a_digest_holds_no_more_than_it_shows(spark):
    errors = [f"error {i:05d} {'x' * 50}" for i in range(3000)]
    df = spark.createDataFrame([("a", 1, errors), ("a", 2, errors[:5] + [None]), ("b", 1, []), ("c", 1, None)], "k string, attempt int, errors array<string>")
    got = {x.k: x.digest for x in selection.error_digest(df, ["k"], 1000).collect()}
    assert got == {"a": "\n".join(sorted(errors))[-1000:]}
    assert "Window" in selection.error_digest(df, ["k"], 1000)._jdf.queryExecution().executedPlan().toString()


def test_indices_of_an_answer(spark):
    c = spark.createDataFrame([(b, i) for b in range(6) for i in range(3)], "batch int, idx int")
    said = {0: '{"decisions": [{"index": 1, "decision": "keep"}, {"index": 1, "decision": "keep"}, {"index": 7, "decision": "keep"}, {"decision": "keep"}, {"index": 2, "decision": "reject"}]}', 1: '{"decisions": []}', 2: "oops", 3: '{"decisions": "all"}', 4: None}
    got = attempts.kept_by_answer(c, spark.createDataFrame(list(said.items()), "batch int, response string")).groupBy("batch").agg(F.sort_array(F.collect_list("idx")).alias("i"))
    assert {x.batch: x.i for x in got.collect()} == {0: [1], 2: [0, 1, 2], 3: [0, 1, 2], 4: [0, 1, 2], 5: [0, 1, 2]}


def test_merged_profiles_equal_one_pass(spark):
    r = np.random.default_rng(2)
    data = [(int(k), None if k % 7 == 0 else float(x)) for k, x in zip(r.integers(0, 30_000, 40_000), r.normal(size=40_000))]
    df = spark.createDataFrame(data, "k long, x double")
    parts = [profile.profile_sketch(df.where(f"pmod(xxhash64(k), 3) = {i}"), ["k"], {"x": F.col("x")}) for i in range(3)]
    parts.append(profile.profile_sketch(df.where("false"), ["k"], {"x": F.col("x")}))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    m = profile.merged_profile(all_, ["x"]).first()
    x = np.array([v for _, v in data if v is not None])
    assert m.n_rows == len(data) and abs(m.x_avg - x.mean()) < 1e-12 and (m.x_min, m.x_max) == (x.min(), x.max())
    assert abs(m.n_keys / len({k for k, _ in data}) - 1) < 0.05
    for q in (0.5, 0.9, 0.99):
        assert abs((x <= m[f"x_p{round(q * 100)}"]).mean() - q) < 0.02
    empty = profile.merged_profile(parts[3], ["x"]).first()
    assert (empty.n_rows, empty.n_keys, empty.x_avg, empty.x_p50) == (0, 0, None, None)


def test_tokens_fall_back_to_length(spark):
    df = spark.createDataFrame([("äöü words",), ("",), (None,)], "t string")
    for name in (None, "no such encoding"):
        assert [x.n for x in df.select(profile.token_count(name)("t").alias("n")).collect()] == [9, 0, None]


def test_rules_relax_after_a_stall():
    rules = build.Rules(stall_after=2)
    at = lambda *added: build.Progress.of(list(added), rules)
    assert at(5, 0).rules == rules and at(5, 0).stalled == 1
    assert (at(5, 0, 0).rules.sim, at(5, 0, 0).rules.cap, at(5, 0, 0).stalled) == (0.9, 96, 0)
    assert at(5, 0, 0, 3, 0).rules.sim == 0.9 and at(*[0] * 20).rules.sim == 0.95 and at(5, 0, 3, 0, 3, 0).rules == rules


def plain_build(existing, batches, rules):
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    pool, added = list(existing), []
    for batch in batches:
        now = build.Progress.of(added, rules).rules
        full = [c for c in {c for p in pool for c in p[2]} if sum(c in p[2] for p in pool) >= now.cap]
        names, kept = {p[1].strip().lower() for p in pool}, []
        for c in sorted(batch):
            if c[1].strip().lower() in names:
                continue
            names.add(c[1].strip().lower())
            limit = min(now.warn, now.sim) if set(c[2]) & set(full) else now.sim
            if all(cos(c[3], p[3]) <= limit for p in [*pool, *kept]):
                kept.append(c)
        added.append(len(kept))
        pool += kept
    return sorted(p[0] for p in pool[len(existing) :]), added


def test_a_build_goes_on_where_it_was_stopped(spark, tmp_path):
    r = np.random.default_rng(3)
    base = r.normal(size=(5, 6))
    made = [(i, f"Name {i % 70} ", [f"c{i % 3}"], (base[i % 5] + 0.7 * r.normal(size=6)).tolist()) for i in range(120)]
    same = made[:10]  # batches of what is there add nothing
    batches = [made[20:60], same, same, made[60:100], made[100:]]
    rules = build.Rules(sim=0.5, warn=0.4, cap=9, stall_after=2, step=0.3)
    frame = lambda x: spark.createDataFrame(x, "id long, name string, categories array<string>, embedding array<double>")
    want, added = plain_build(made[:20], batches, rules)
    path, asked = str(tmp_path / "pool"), []

    def batch(until):
        def give(k):
            asked.append(k)
            return frame(batches[k]) if k < until else None

        return give

    build.build_diverse(frame(made[:20]), batch(2), path, 10**6, rules)
    done = build.build_diverse(frame(made[:20]), batch(5), path, 10**6, rules)
    assert asked == [0, 1, 2, 2, 3, 4, 5] and [m["summary"]["total"] for m in manifests(path)] == added and added[1:3] == [0, 0]
    assert sorted(x.id for x in read_committed(spark, path).collect()) == want
    assert (done.batches, done.added) == (5, len(want)) and done.rules.sim == 0.8
    assert build.build_diverse(frame(made[:20]), batch(9), path, 20 + len(want), rules) == done  # enough: nothing is asked
    check, kinds = build.build_report(spark, frame(made[:20]), path, 0.4, 9)
    assert check.first().n_rows == 20 + len(want) and kinds.agg(F.sum("n")).first()[0] == 20 + len(want)


def test_a_build_of_copies_adds_nothing(spark, tmp_path):
    """j13_c8_build over a table where every vector has copies in the existing pool: no batch adds a row, as in its SQL."""
    m = np.random.default_rng(8).normal(size=(10, 6)).round(3).tolist()
    data = [(i, m[i // 4 % 10], i % 3) for i in range(80)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["j13_c8_build"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(registry.oracle_sql()["j13_c8_build"])
    assert (got.columns, got.collect()) == ([c[0] for c in want.description], want.fetchall()) == (["id", "name"], [])


def test_history_rows_keep_turns_whole(spark):
    say = ["system:S", "user:U", "assistant:list", "tool:tools", "assistant:a2", "tool:r2", "user:more", "assistant:a3", "assistant:a4", "tool:r4", "assistant:a5", "assistant:a6"]
    data = [(1, i, *x.split(":")) for i, x in enumerate(say)] + [(2, 0, "assistant", "hello"), (2, 1, "user", "late"), (2, 2, "assistant", "bye"), (3, 0, "user", "alone")]
    got = {(x.conv_id, x.turn): x for x in training.history_rows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    said = lambda ms: [m.text for m in ms]
    assert set(got) == {(1, 2), (1, 4), (1, 7), (1, 8), (1, 10), (1, 11), (2, 0), (2, 2)}
    last = got[1, 11]
    assert (last.system, last.first_user, said(last.first_exchange), last.target) == ("S", "U", ["list", "tools"], "a6")
    assert [said(t) for t in last.history] == [["a3"], ["a4", "r4"], ["a5"]]
    assert [said(t) for t in got[1, 7].history] == [["a2", "r2", "more"]]  # the first exchange is not repeated
    assert got[1, 2].first_exchange is None and got[1, 2].history == []
    assert (got[2, 0].first_user, got[2, 2].first_user, got[2, 2].system) == (None, "late", None)


def plain_cover(rows_, positives, negatives):
    out, tools = [], set()
    good = sorted((x for x in rows_ if x[2] == "complete"), key=lambda x: (x[3], x[1]))
    for x in good:
        if len(out) < positives and (set(x[4]) - tools or len(out) < min(2, positives)):
            out.append(x[1])
            tools |= set(x[4])
    out += sorted(x[1] for x in good if x[1] not in out)[: positives - len(out)]
    rest = sorted((x[2] == "complete", -len(set(x[4]) & tools), x[3], x[1]) for x in rows_ if x[1] not in out)
    return [(rows_[0][0], t, "positive", i + 1) for i, t in enumerate(out)] + [(rows_[0][0], x[3], "negative", i + 1) for i, x in enumerate(rest[:negatives])]


@pytest.mark.parametrize("positives, negatives", [(1, 1), (3, 2), (6, 4)])
def test_covering_examples_are_those_of_a_plain_walk(spark, positives, negatives):
    r = random.Random(positives)
    data = [(f"s{k}", t, r.choice(["complete", "complete", "others", None]), r.randrange(1, 9), r.sample("abcdefg", r.randrange(0, 5))) for k in range(20) for t in range(r.randrange(1, 60))]
    df = spark.createDataFrame(data, "scenario string, task_id long, reward_type string, num_tool_calls long, tools_used array<string>")
    got = selection.covering_examples(df, positives, negatives)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [x for k in range(20) for x in plain_cover([d for d in data if d[0] == f"s{k}"], positives, negatives)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_only_success_passes_the_gate(spark):
    b = spark.createDataFrame([(f"s{i}", 0, True, True, True, True) for i in range(5)], "scenario string, task_id int, has_env boolean, has_db_schema boolean, has_sample boolean, has_verifier boolean")
    checks = b.select("scenario", "task_id", F.lit(True).alias("ok"))
    status = ["success", "error", "timeout", None, "ok"]
    outcomes = spark.createDataFrame([(f"s{i}", 0, None, x, "others") for i, x in enumerate(status)], "scenario string, task_id int, db_error string, execution_status string, result string")
    got = {x.scenario: x.reason for x in rows.static_gate(b, checks, outcomes, b.where("false")).collect()}
    assert got == {"s0": None} | {f"s{i}": "noop_verifier_error" for i in (1, 2, 3, 4)}


def test_runs_with_bad_files_only(spark):
    v = spark.createDataFrame([("a", "complete"), ("a", None)], "run string, reward_type string")
    bad = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "run string, file string")
    assert {x.run: (x.total, x.complete, x.score, x.bad_files) for x in scores.run_scores(v, bad).collect()} == {"a": (2, 1, 0.5, 1), "b": (0, 0, 0.0, 2)}


def test_an_allowlist_without_tasks_is_an_error(spark):
    tasks = spark.createDataFrame([("s", ["t"])], "scenario string, tasks array<string>")
    allow = spark.createDataFrame([("s", 3, 1), ("x", 0, 2), ("x", 1, 3)], "scenario string, task_id int, pos int")
    with pytest.raises(ValueError, match="task_id_out_of_range: 1, unknown_scenario: 2"):
        rows.required_allowlist(allow, tasks, "pos")
    with pytest.raises(ValueError, match="it has no rows"):
        rows.required_allowlist(allow.where("false"), tasks, "pos")
    assert rows.required_allowlist(allow.union(allow.selectExpr("'s'", "0", "4")), tasks, "pos").count() == 1


def test_strict_skills(spark):
    good = "\n".join(text.SKILL_SECTIONS) + "\nConfidence: high"
    df = spark.createDataFrame([(good,), (good + " Schemas, an example and ``` logs",)], "c string").select(text.skill_warnings(F.col("c"), 90, True).alias("w"))
    assert [x.w for x in df.collect()] == [[], [r"banned_terms:\bexamples?\b", r"banned_terms:\blogs?\b", r"banned_terms:\bschemas?\b", "code_fence"]]


STEPS = "run string, scenario string, task_id long, steps array<struct<role string, content string, calls array<string>, response string>>, tools array<string>"


def call(name, **args):
    return json.dumps({"name": name, "arguments": args})


def test_a_rollout_ends_with_its_first_violation(spark):
    thought, lists = "<think>so</think> ok", call("list_tools")
    use = lambda tool, inner="{}": call("call_tool", tool_name=tool, arguments=inner)
    say = lambda calls=(), text=thought, response=None: ("assistant", text, list(calls), response)
    head = [("system", "S", [], None), ("user", "U", [], None)]
    cases = {
        0: ([say([lists], response="tools"), say([use("a")], response="r"), say(text=thought + "done")], None, None),
        1: ([say([use("a")])], 2, "tools_not_listed"),
        2: ([say([lists]), say([lists])], 3, "list_tools_again"),
        3: ([say([lists, lists])], 2, "list_tools_again"),
        4: ([say([lists]), say([use("zz")]), say([use("zz")])], 3, "unknown_tool"),
        5: ([say([lists]), say([use("a", "{bad")])], 3, "bad_arguments"),
        6: ([say([lists]), say(text="<think> </think> no")], 3, "no_thought"),
        7: ([say([lists]), say([call("call_tool", tool_name=None)])], 3, "unknown_tool"),
        8: ([("assistant", None, None, None)], 2, "no_thought"),
    }
    t = spark.createDataFrame([("r", "s", k, head + steps, ["a", "b"]) for k, (steps, _, _) in cases.items()], STEPS)
    got = {x.task_id: (x.pos, x.violation) for x in training.format_violations(t).collect()}
    assert got == {k: (at, why) for k, (_, at, why) in cases.items() if why}
    v = spark.createDataFrame([("r", "s", k, "complete") for k in range(7)], "run string, scenario string, task_id long, reward_type string")
    rows_ = {(x.task_id, x.pos): x for x in training.rollout_rows(t, v).collect()}
    assert [rows_[0, p].reward for p in (2, 3, 4)] == [1.0, 1.0, 1.0] and rows_[0, 4].violation is None
    assert [m.text for m in rows_[0, 4].first_exchange] == [thought, "tools"] and [[m.text for m in turn] for turn in rows_[0, 4].history] == [[thought, "r"]]
    assert {p: r.reward for (k, p), r in rows_.items() if k == 4} == {2: 1.0, 3: -1.0}  # what comes after is left out
    assert rows_[7, 2].reward is None and rows_[7, 3].reward == -1.0
