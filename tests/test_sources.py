"""The run tree and JSON lines as data sources, and the committing sink."""

import json
import threading
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from taskloom.sources import committed, runtree


def tree(root, runs=("a", "b"), scenarios=3, tasks=2):
    for run in runs:
        for s in range(scenarios):
            for t in range(tasks):
                folder = root / run / f"Scenario_{s}" / f"task_{t}"
                folder.mkdir(parents=True)
                (folder / "trajectory.json").write_text(json.dumps({"scenario": f"Scenario {s}", "task_id": t, "trajectory": []}))
                (folder / "verify.code.json").write_text(json.dumps({"reward_type": "complete" if t else "others"}))
    return root


class Watched:
    """A file system that notes which folders are listed and which files are opened."""

    def __init__(self):
        self.real, self.listed, self.opened = fs.LocalFileSystem(), [], []

    def get_file_info(self, x):
        self.listed.append(x.base_dir)
        return self.real.get_file_info(x)

    def open_input_stream(self, path):
        self.opened.append(path)
        return self.real.open_input_stream(path)


def test_filters_choose_what_is_listed(spark, tmp_path, monkeypatch):
    root, store = tree(tmp_path), Watched()
    monkeypatch.setattr(runtree, "at", lambda path: (store, path))
    assert list(runtree.TreeReader({"path": str(root)}).pushFilters([EqualTo(("run",), "b")])) == [EqualTo(("run",), "b")]
    reader = runtree.TreeReader({"path": str(root), "push": "true"})
    left = list(reader.pushFilters([EqualTo(("run",), "b"), In(("task_id",), (1, 7)), EqualTo(("mode",), "code"), GreaterThan(("task_id",), 0)]))
    assert left == [GreaterThan(("task_id",), 0)]
    parts = reader.partitions()
    assert store.listed == [f"{root}/b"]  # not the root, and no other run
    rows = [r for p in parts for r in reader.read(p)]
    assert {(r[0], r[2], r[4]) for r in rows} == {("b", 1, "code")} and len(rows) == len(store.opened) == 3
    assert all(f"{root}/b" in x for x in store.listed)


def test_run_tree_through_spark(spark, tmp_path):
    root = tree(tmp_path)
    (root / "a/Scenario_0/task_0/trajectory.json").write_text("[1]")
    (root / "a/Scenario_1/task_0/trajectory.json").write_text('{"a": 1} x')
    (root / "a/Scenario_2/task_0/trajectory.json").write_bytes(b"\xff{}")
    (root / "a/Scenario_2/task_0/notes.txt").write_text("no run file")
    df = runtree.run_tree(spark, str(root))
    assert df.count() == 24
    assert sorted(r.problem for r in df.where("problem is not null").collect()) == ["not_an_object", "not_json", "unreadable: UnicodeDecodeError"]
    asked = [runtree.run_tree(spark, str(root), run=["b"], kind=["verify"]), runtree.run_tree(spark, str(root), push=True).where("run = 'b' and kind = 'verify' and mode in ('code', 'sql')")]
    for one in asked:
        assert one.rdd.getNumPartitions() == 1 and one.count() == 6
    both = df.where("run = 'a' and kind = 'verify'").select("task_id", "run").union(df.where("run = 'b' and kind = 'trajectory'").select("task_id", "run"))
    assert sorted(r.run for r in both.collect()) == ["a"] * 6 + ["b"] * 6  # one frame, two filters
    assert df.where("run = 'none'").count() == 0
    assert runtree.run_tree(spark, str(root) + "/nowhere").count() == 0


def test_run_tree_is_written_and_read(spark, tmp_path):
    rows = [("r", "S_1", 1, "trajectory", None, '{"a": 1}'), ("r", "S_1", 1, "verify", "sql", '{"b": 1}'), ("r 2", "S_1", 2, "verify", "code", None)]
    df = spark.createDataFrame(rows, "run string, scenario_dir string, task_id int, kind string, mode string, body string")
    for _ in range(2):  # a second time it replaces what is there
        runtree.write_run_tree(df, str(tmp_path / "t"))
    got = runtree.run_tree(spark, str(tmp_path / "t")).collect()
    assert sorted((r.run, r.kind, r.mode or "", r.body, r.problem or "") for r in got) == [("r", "trajectory", "", '{"a": 1}', ""), ("r", "verify", "sql", '{"b": 1}', ""), ("r 2", "verify", "code", "", "not_json")]


@pytest.mark.parametrize("size", [3, 7, 64, 1 << 20])
def test_bad_lines_have_their_number_in_any_range(spark, tmp_path, size):
    lines = ['{"a": 1}', "", '{"a": 2', '{"ä": 3}', "  ", "[4]", '{"a": 5}', '{"a": 6} x', '{"a": 7}']
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(lines))
    runtree.registered(spark)
    got = spark.read.format("json_lines").option("range", str(size)).load(str(path)).collect()
    assert sorted((r.at, r.body) for r in got) == sorted((len("\n".join(lines[:i]).encode()) + (i > 0), x) for i, x in enumerate(lines) if x.strip())
    assert {r.line: r.problem for r in got if r.problem} == {3: "not_json", 6: "not_an_object", 8: "not_json"}
    assert all(r.line is None for r in got if not r.problem)


def test_json_lines_fail_with_their_place(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good/1.jsonl").write_text('{"a": 1, "b": [1]}\n\n{"a": 2}\n')
    (tmp_path / "good/2.jsonl").write_text("")
    assert sorted((r.a, r.b) for r in runtree.read_json_lines(spark, str(tmp_path / "good"), "a int, b array<int>").collect()) == [(1, [1]), (2, None)]
    (tmp_path / "good/3.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match=r"3\.jsonl:2: not_json"):
        runtree.read_json_lines(spark, str(tmp_path / "good"), "a int").collect()


RESULT = "run string, task_id long, reward_type string, problem string"


def results(spark, *rows):
    return spark.createDataFrame(list(rows), RESULT)


def there(spark, path):
    return sorted(map(tuple, committed.read_committed(spark, path).collect()), key=repr)


def test_a_batch_that_is_repeated_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "sink")
    first = results(spark, ("a", 1, "complete", None), ("a", 2, None, None), ("a", None, "others", None), ("a", None, "others", None), ("a", 9, None, "not_json"))
    m = committed.append_committed(first, path, ["run", "task_id"], "b1", "problem", "reward_type")
    assert m["summary"] == {"total": 3, "bad": 1, "counts": {"complete": 1, "others": 1, "unknown": 1}}
    assert committed.append_committed(first, path, ["run", "task_id"], "b1", "problem", "reward_type") is None
    again = committed.append_committed(first.union(results(spark, ("a", 3, "complete", None))), path, ["run", "task_id"], "b2", "problem", "reward_type")
    assert again["summary"] == {"total": 1, "bad": 1, "counts": {"complete": 1}}  # null keys are known too
    assert there(spark, path) == sorted([("a", 1, "complete"), ("a", 2, None), ("a", None, "others"), ("a", 3, "complete")], key=repr)
    assert [(r.version, r.batch, r.total, r.bad) for r in committed.summaries(spark, path).collect()] == [(1, "b1", 3, 1), (2, "b2", 1, 1)]
    assert committed.read_committed(spark, path, bad=True).count() == 2
    assert committed.read_committed(spark, str(tmp_path / "none")) is None


def test_a_killed_batch_leaves_no_rows(spark, tmp_path):
    """A writer that dies before its commit leaves files that nobody reads; one whose tasks fail leaves none of its rows."""
    path = str(tmp_path / "sink")
    committed.append_committed(results(spark, ("a", 1, "complete", None)), path, ["run", "task_id"], "b1", "problem")
    writer = committed.CommittedWriter({"path": path, "batch": "b2", "base": "1", "problem": "problem"})
    writer.write(iter(results(spark, ("a", 2, "complete", None)).toArrow().to_batches()))  # and then killed
    bad = results(spark, ("a", 3, "complete", None), ("a", 4, "x", None)).withColumn("reward_type", F.when(F.col("task_id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("reward_type")))
    with pytest.raises(Exception, match="lost"):
        committed.append_committed(bad, path, ["run", "task_id"], "b3", "problem")
    assert there(spark, path) == [("a", 1, "complete")]
    committed.append_committed(results(spark, ("a", 2, "complete", None)), path, ["run", "task_id"], "b2", "problem")
    assert there(spark, path) == [("a", 1, "complete"), ("a", 2, "complete")]


def test_two_writers_add_no_key_twice(spark, tmp_path):
    path, made = str(tmp_path / "sink"), []
    rows = lambda a, b: results(spark, *[("a", i, "complete", None) for i in range(a, b)])
    write = lambda k: made.append(committed.append_committed(rows(10 * k, 10 * k + 15), path, ["run", "task_id"], f"w{k}", "problem"))
    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r[1] for r in there(spark, path)) == list(range(45))
    assert sorted(m["version"] for m in made) == [1, 2, 3, 4]
    assert len(list(Path(path, "_commits").iterdir())) == 4  # no draft is left


def test_an_overtaken_writer_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "sink")
    committed.append_committed(results(spark, ("a", 1, "complete", None)), path, ["run", "task_id"], "b1", "problem")
    late = committed.CommittedWriter({"path": path, "batch": "b2", "base": "0", "problem": "problem"})
    message = late.write(iter(results(spark, ("a", 2, "complete", None)).toArrow().to_batches()))
    before = set(Path(path).iterdir())
    with pytest.raises(RuntimeError, match=committed.OVERTAKEN):
        late.commit([message, None])
    assert len(before - set(Path(path).iterdir())) == 1 and len(committed.manifests(path)) == 1
