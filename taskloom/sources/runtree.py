"""Run trees and JSON lines as data sources: who asks for a run has its folder listed alone; bad lines have their number."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .ship import ship

TREE = "run string, scenario_dir string, task_id int, kind string, mode string, file string, body string, problem string"
LINES = "file string, at long, line long, body string, problem string"
_FILE = re.compile(r"(trajectory|verify)(?:\.(\w+))?\.json$")
_TASK = re.compile(r"task_(\d+)$")
#: Scenario folders of a run that one task reads; bytes of a file that one task reads; bytes read at a time.
FOLDERS, RANGE, CHUNK = 200, 64 << 20, 1 << 20
#: Columns that choose what is listed, by options or by equality in filters.
PUSHED = ("run", "scenario_dir", "task_id", "kind", "mode")


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that Python can open (local, mounted, or one of Arrow's), and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def object_problem(body: str) -> str | None:
    """Why a text is not one JSON object."""
    try:
        return None if isinstance(json.loads(body), dict) else "not_an_object"
    except ValueError:
        return "not_json"


@dataclass
class Folders(InputPartition):
    run: str
    scenarios: tuple[str, ...]


class TreeReader(DataSourceReader):
    """One partition for FOLDERS scenario folders of a run. Options with the names of keys (JSON lists of values) choose
    what is listed and read, and so do filters, where the option `push` is true."""

    def __init__(self, options: dict) -> None:
        self.root, self.push = options["path"].rstrip("/"), options.get("push") == "true"
        self.wanted = {c: set(json.loads(options[c])) for c in PUSHED if c in options}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters if self.push else ():
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PUSHED and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f
        if not self.push:
            yield from filters

    def _asked(self, name: str, value: object) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def _folders(self, store: fs.FileSystem, path: str) -> list[str]:
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory)

    def partitions(self) -> list[InputPartition]:
        store, root = at(self.root)
        if "run" in self.wanted:  # asked by name: nothing else is listed
            runs = sorted(str(x) for x in self.wanted["run"] if x is not None)
        else:
            runs = self._folders(store, root)
        out: list[InputPartition] = []
        for run in runs:
            names = [x for x in self._folders(store, f"{root}/{run}") if self._asked("scenario_dir", x)]
            out += [Folders(run, tuple(names[i : i + FOLDERS])) for i in range(0, len(names), FOLDERS)]
        return out or [Folders("", ())]

    def read(self, partition: Folders) -> Iterator[tuple]:
        store, root = at(self.root)
        for scenario in partition.scenarios:
            folder = f"{root}/{partition.run}/{scenario}"
            for task in self._folders(store, folder):
                found = _TASK.match(task)
                if not found or not self._asked("task_id", int(found[1])):
                    continue
                for info in sorted(store.get_file_info(fs.FileSelector(f"{folder}/{task}")), key=lambda x: x.base_name):
                    name = _FILE.match(info.base_name)
                    if not name or not self._asked("kind", name[1]) or not self._asked("mode", name[2]):
                        continue
                    try:
                        with store.open_input_stream(info.path) as f:
                            body = f.read().decode()
                        problem = object_problem(body)
                    except (OSError, UnicodeDecodeError) as e:
                        body, problem = None, f"unreadable: {type(e).__name__}"
                    yield partition.run, scenario, int(found[1]), name[1], name[2], info.path, body, problem


class TreeWriter(DataSourceWriter):
    """Writes each row to the file of its keys: a file that is written again is replaced, so a repeated task changes nothing."""

    def __init__(self, options: dict, names: list[str]) -> None:
        self.root, self.names = options["path"].rstrip("/"), names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = at(self.root)
        for r in rows:
            r = dict(zip(self.names, r))
            folder = f"{root}/{r['run']}/{r['scenario_dir']}/task_{r['task_id']}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{r['kind']}{'.' + r['mode'] if r['mode'] else ''}.json") as f:
                f.write((r["body"] or "").encode())
        return WriterCommitMessage()


class RunTree(DataSource):
    """<root>/<run>/<scenario_dir>/task_<id>/{trajectory,verify.<mode>}.json"""

    @classmethod
    def name(cls) -> str:
        return "run_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options, schema.names)


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


class LinesReader(DataSourceReader):
    """One partition for RANGE bytes of a file; a line belongs to the range in which it begins. The number of a line that
    can't be read is found by counting the line breaks before its range, which is done only where there is such a line."""

    def __init__(self, options: dict) -> None:
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        store, path = at(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            files = sorted((x for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
        elif info.type == fs.FileType.File:
            files = [info]
        else:
            raise FileNotFoundError(self.path)
        return [Range(x.path, b, min(b + self.range, x.size)) for x in files for b in range(0, x.size, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = at(self.path)
        before = None
        with store.open_input_file(partition.file) as f:
            place, kept, n = max(partition.begin - 1, 0), b"", 0
            f.seek(place)
            if partition.begin:  # the byte before tells whether a line begins here; else it is the range's before
                while (chunk := f.read(CHUNK)) and (cut := chunk.find(b"\n")) < 0:
                    place += len(chunk)
                if not chunk:
                    return
                place += cut + 1
                f.seek(place)
            begin = place
            while place < partition.end:
                cut = kept.find(b"\n")
                if cut < 0:
                    if chunk := f.read(CHUNK):
                        kept += chunk
                        continue
                    if not kept:
                        return
                    cut = len(kept)
                raw, kept, here = kept[:cut], kept[cut + 1 :], place
                place += cut + 1
                n += 1
                if not raw.strip():
                    continue
                try:
                    body = raw.decode()
                    problem = object_problem(body)
                except UnicodeDecodeError:
                    body, problem = raw.decode(errors="replace"), "not_utf8"
                if problem and before is None:
                    before = self._breaks(store, partition.file, begin)
                yield partition.file, here, before + n if problem else None, body, problem

    def _breaks(self, store: fs.FileSystem, file: str, end: int) -> int:
        n = 0
        with store.open_input_file(file) as f:
            while end > 0 and (chunk := f.read(min(CHUNK, end))):
                n += chunk.count(b"\n")
                end -= len(chunk)
        return n


class JsonLines(DataSource):
    """A file of JSON objects, one a line, or a folder of such files."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LinesReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the sources of this module, filters pushed to them, and the package on every executor."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunTree)
    spark.dataSource.register(JsonLines)
    return spark


def run_tree(spark: SparkSession, root: str, push: bool = False, **keys: list) -> DataFrame:
    """Files of a run tree: run, scenario_dir, task_id, kind, mode, file, body, and problem (null: one JSON object).

    keys: values of run, scenario_dir, task_id, kind or mode; only the folders of the runs asked for are listed, and only
    files asked for are opened. push: filters on these columns by = or IN do the same. Spark keeps one set of pushed
    filters for a loaded frame: where it occurs twice in one query, as in a join of two of its runs, the second filter
    takes the place of the first. So ask for it only where the frame occurs once, and else load once for each set of keys.
    The tree has to be where Python can open it; read_run_tree() reads one that only Spark can.
    """
    wanted = {name: json.dumps(list(values)) for name, values in keys.items()}
    return registered(spark).read.format("run_tree").options(**wanted, push=str(push).lower()).load(root)


def write_run_tree(files: DataFrame, root: str) -> None:
    """Writes (run, scenario_dir, task_id, kind, mode, body) as a run tree."""
    registered(files.sparkSession)
    files.select("run", "scenario_dir", "task_id", "kind", "mode", "body").write.format("run_tree").mode("append").save(root)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON-lines files: file, at (first byte), line (number from 1, of lines with a problem), body, problem.
    Blank lines are skipped but counted. Large files are read in ranges."""
    return registered(spark).read.format("json_lines").load(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files; a line that is not one JSON object fails the job, with its place: file:line: problem."""
    lines = json_lines(spark, path)
    bad = F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "problem"))
    return lines.select(F.from_json(F.when(F.col("problem").isNull(), F.col("body")).otherwise(bad.cast("string")), schema).alias("r")).select("r.*")
