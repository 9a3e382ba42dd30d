"""Streams over landing run files: timers, gates, joins, late and repeated files, restarts."""

import json
import os
import time

import pytest
from pyspark.errors import AnalysisException

from taskloom.streaming import live, stateful


def drop(root, run, task, name, body, at=None, folder=""):
    path = root / folder / run / "Scenario_1" / f"task_{task}" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(body) if not isinstance(body, str) else body)
    if at is not None:
        os.utime(path, (at, at))


def verdict(root, run, task, reward="complete", mode="code", at=None, folder=""):
    drop(root, run, task, f"verify.{mode}.json", {"reward_type": reward}, at, folder)


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "runs"
    root.mkdir()
    return root, str(tmp_path / "out"), str(tmp_path / "ck")


def started(df, place, mode="append"):
    return df.writeStream.format("parquet").option("path", place[1]).option("checkpointLocation", place[2]).outputMode(mode).trigger(processingTime="1 second").start()


def wait_for(spark, path, n, seconds=60):
    """The rows of a streaming sink, as soon as there are n."""
    until = time.time() + seconds
    while time.time() < until:
        try:
            rows = spark.read.parquet(path).collect()
        except AnalysisException:  # nothing has been written yet
            rows = []
        if len(rows) >= n:
            return rows
        time.sleep(0.5)
    raise AssertionError(f"no {n} rows")


def test_only_run_that_falls_silent_is_flagged_once(spark, place):
    now = time.time()
    for i in range(3):
        verdict(place[0], "r1", i, at=now - 2 + i / 10)
    stream = lambda: stateful.stall_flags(live.landed_verdicts(spark, str(place[0])), gap_seconds=6)
    q = started(stream(), place)
    rows = wait_for(spark, place[1], 1)
    assert [(r.run, r.n) for r in rows] == [("r1", 3)]
    assert abs((rows[0].stalled_at - rows[0].last).total_seconds() - 6) < 0.01
    time.sleep(4)  # more batches by the clock, no more flags
    q.stop()
    q = started(stream(), place)
    time.sleep(5)
    assert spark.read.parquet(place[1]).count() == 1  # none after the restart
    verdict(place[0], "r1", 7, at=time.time())
    rows = wait_for(spark, place[1], 2)  # a second silence is another one
    q.stop()
    assert sorted(r.n for r in rows) == [3, 4]


def test_run_that_is_done_is_not_flagged(spark, place):
    old = time.time() - 1000
    for run, n in (("done", 200), ("open", 3)):
        for i in range(n - 1 if run == "done" else n):
            verdict(place[0], run, i, at=old)
    plan = spark.createDataFrame([("done", 200), ("open", 200)], "run string, expected long")
    q = started(stateful.stall_flags(live.landed_verdicts(spark, str(place[0])), 10, plan), place)
    rows = wait_for(spark, place[1], 1)
    q.stop()
    assert [r.run for r in rows] == ["open"]  # 199 of 200 are int(0.995 * 200)


def test_gate_releases_once_and_waits_for_an_interruption_to_end(spark, place, tmp_path):
    plans = tmp_path / "plans"
    plans.mkdir()
    say = lambda name, **x: (plans / name).write_text(json.dumps(x) + "\n")
    say("1.json", run="r1", expected=4, interrupted=False)
    say("2.json", run="r2", expected=2, interrupted=True)
    for i in range(2):
        verdict(place[0], "r1", i)
        verdict(place[0], "r1", i, mode="sql")  # the same tasks again
        verdict(place[0], "r2", i)

    def stream():
        plan = spark.readStream.schema("run string, expected long, interrupted boolean").json(str(plans))
        return stateful.released_runs(live.landed_verdicts(spark, str(place[0])), plan)

    q = started(stream(), place)
    time.sleep(6)
    drop(place[0], "r1", 2, "verify.code.json", "{broken")  # an attempt without a verdict: 3 of int(0.995 * 4)
    rows = wait_for(spark, place[1], 1)
    assert [tuple(r) for r in rows] == [("r1", 3, 2, 4)]
    q.stop()
    verdict(place[0], "r1", 3)
    say("3.json", run="r2", expected=2, interrupted=False)
    q = started(stream(), place)
    rows = wait_for(spark, place[1], 2)
    time.sleep(3)
    q.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(place[1]).collect()) == [("r1", 3, 2, 4), ("r2", 2, 2, 2)]


def test_gate_with_a_static_plan(spark, place):
    for run in ("a", "b", "c"):
        verdict(place[0], run, 0)
    plan = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("c", 9, None)], "run string, expected long, interrupted boolean")
    q = started(stateful.released_runs(live.landed_verdicts(spark, str(place[0])), plan), place)
    rows = wait_for(spark, place[1], 1)
    time.sleep(2)
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(place[1]).collect()] == [("a", 1, 1, 1)] and len(rows) == 1


def trajectory(root, run, task, final="done", at=None, folder="", body=None):
    call = {"id": "1", "name": "call_tool", "arguments": json.dumps({"tool_name": "mcp_tool_set_x", "arguments": "{}"})}
    steps = [{"role": "assistant", "content": "", "tool_calls": [call], "tool_response": {"content": '{"ok": 1}'}}, "odd", {"role": "assistant", "content": final, "tool_calls": []}]
    drop(root, run, task, "trajectory.json", body or {"scenario": "Scenario 1", "task_id": task, "task": "do it", "model": "m", "trajectory": steps}, at, folder)


def batch_clean(spark, root):
    from taskloom.operators import cleaning
    from taskloom.sources.runtree import run_tree

    files = run_tree(spark, str(root), run=["r1", "r2"])
    return cleaning.cleaned_files(cleaning.read_trajectories(files.where("kind = 'trajectory'")), cleaning.read_verdicts(files.where("kind = 'verify'")))


def as_set(df):
    return {tuple(str(r[c]) for c in ("run", "scenario", "task_id", "bucket", "reason", "trace", "num_tool_calls")) for r in df.collect()}


def test_landing_trajectories_are_cleaned_with_late_verdicts(spark, place):
    from taskloom.sources.committed import manifests, read_committed
    from taskloom.streaming.landing import clean_as_they_land

    t0 = time.time() - 36_000

    def turn():
        q = clean_as_they_land(spark, str(place[0]), place[1], place[2], wait="10 minutes", late="5 minutes")
        q.awaitTermination(180)
        assert q.exception() is None

    trajectory(place[0], "r1", 0, at=t0)
    verdict(place[0], "r1", 0, at=t0 + 60)
    trajectory(place[0], "r1", 1, at=t0)
    trajectory(place[0], "r1", 2, at=t0)
    verdict(place[0], "r1", 2, "others", at=t0 + 5)
    trajectory(place[0], "r1", 3, at=t0)  # its verdict never comes
    trajectory(place[0], "r1", 4, final="", at=t0)
    verdict(place[0], "r1", 4, at=t0)
    trajectory(place[0], "r1", 5, at=t0, body="[broken")
    verdict(place[0], "r1", 5, at=t0)
    turn()
    verdict(place[0], "r1", 1, at=t0 + 500)  # late, but within the wait
    trajectory(place[0], "r1", 0, at=t0 + 30, folder="copy")  # the same key again
    verdict(place[0], "r1", 0, at=t0 + 40, folder="copy")
    turn()
    for at in (t0 + 4000, t0 + 8000):  # later files move the watermark past the run with no verdict
        trajectory(place[0], "r2", int(at - t0), at=at)
        verdict(place[0], "r2", int(at - t0), at=at)
        turn()
    turn()  # nothing new: nothing is added
    got = read_committed(spark, place[1])
    want = batch_clean(spark, place[0])
    assert as_set(got.where("run = 'r1'")) == as_set(want.where("run = 'r1'")) and got.where("run = 'r1'").count() == 6
    assert {(r.task_id, r.bucket, r.reason) for r in got.where("run = 'r1'").collect()} == {(0, "kept", None), (1, "kept", None), (2, "rejected", "not_complete"), (3, "rejected", "not_complete"), (4, "rejected", "no_final_answer"), (5, "rejected", "parse_error")}
    assert got.count() == got.select("run", "scenario", "task_id").distinct().count()
    n = len(manifests(place[1]))
    turn()
    assert read_committed(spark, place[1]).count() == got.count() and len(manifests(place[1])) >= n


def test_cleaning_job_writes_buckets_and_totals(spark, place, tmp_path):
    from taskloom.operators import cleaning
    from taskloom.sources.runtree import run_tree

    for i in range(4):
        trajectory(place[0], "r", i)
        verdict(place[0], "r", i, "complete" if i else "others")
    verdict(place[0], "r", 1, "others", mode="sql")  # code counts
    trajectory(place[0], "r", 9, body='{"trajectory": {}, "task_id": 9}')
    verdict(place[0], "r", 9)
    out = cleaning.cleaning_job(run_tree(spark, str(place[0])), str(tmp_path / "job"))
    assert {(r.task_id, r.bucket, r.reason) for r in out["rows"].collect()} == {(0, "rejected", "not_complete"), (1, "kept", None), (2, "kept", None), (3, "kept", None), (9, "rejected", "parse_error")}
    assert {r.reason: r.n for r in out["reasons"].collect()} == {"not_complete": 1, "parse_error": 1}
    assert [tuple(r) for r in out["tools"].collect()] == [("mcp_tool_set_x", 3)]
    s = out["stats"].first()
    assert (s.matched, s.kept, s.rejected, s.avg_calls) == (5, 3, 2, 1.0) and s.ratio == s.avg_clean_chars / s.avg_raw_chars
    assert sorted(p.name for p in (tmp_path / "job/rows").iterdir() if p.is_dir()) == ["bucket=kept", "bucket=rejected"]
    empty = cleaning.cleaning_job(run_tree(spark, str(tmp_path / "none")), str(tmp_path / "job2"))
    assert empty["rows"].count() == 0 and empty["stats"].first().matched == 0


def test_throughput_leaves_out_what_is_too_late(spark, place):
    t0 = 1_700_000_000

    def turn(stream, mode):
        q = stream.writeStream.format("parquet").option("path", place[1]).option("checkpointLocation", place[2]).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)

    rates = lambda: live.throughput(live.verdict_stream(spark, str(place[0]), "10 minutes"), "10 minutes")
    for i in range(2):
        verdict(place[0], "r", i, at=t0 + i)
    verdict(place[0], "r", 0, at=t0 + 5, folder="copy")  # the same task again
    turn(rates(), "append")
    verdict(place[0], "r", 7, at=t0 + 20_000)
    turn(rates(), "append")
    verdict(place[0], "r", 8, at=t0 + 9)  # far behind the watermark
    verdict(place[0], "r", 9, at=t0 + 40_000)
    turn(rates(), "append")
    rows = spark.read.parquet(place[1]).orderBy("start").collect()
    assert [(r.run, r.n) for r in rows] == [("r", 2), ("r", 1)]
