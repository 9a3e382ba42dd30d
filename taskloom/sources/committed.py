"""A sink whose batches become visible as a whole and once: data files first, then one manifest that lists them."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ship import ship

COMMITS = "_commits"
#: A writer that was overtaken starts again from the new state so many times.
TRIES = 20
OVERTAKEN = "another writer was first"


def local(path: str) -> Path:
    """The folder, which the driver and all executors have to see under one path (a mounted one, on a cluster)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the committed sink needs a folder that all machines mount, not {path}")
    return Path(path)


def manifests(path: str) -> list[dict]:
    """All commits of a sink, the first one first."""
    folder = local(path) / COMMITS
    return [json.loads(p.read_text()) for p in sorted(folder.glob("*.json"))] if folder.is_dir() else []


@dataclass
class Written(WriterCommitMessage):
    file: str | None = None
    bad_file: str | None = None
    rows: int = 0
    bad: int = 0
    counts: dict = field(default_factory=dict)


class CommittedWriter(DataSourceArrowWriter):
    """Tasks write Parquet files; the driver commits their messages by a manifest of the next number, made only if there
    is none of that number. A batch that has been committed before, and a writer that was overtaken, leave nothing."""

    def __init__(self, options: dict) -> None:
        self.path, self.batch, self.base = str(local(options["path"])), options["batch"], int(options["base"])
        self.problem, self.by = options.get("problem"), options.get("count")

    def _put(self, t: pa.Table, kind: str, writers: dict) -> None:
        if len(t):
            if kind not in writers:
                name = f"{kind}-{uuid.uuid4().hex}.parquet"
                writers[kind] = (name, pq.ParquetWriter(f"{self.path}/{name}", t.schema))
            writers[kind][1].write_table(t)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        writers: dict = {}
        rows, bad, counts = 0, 0, Counter()
        Path(self.path).mkdir(parents=True, exist_ok=True)
        for batch in iterator:
            t = pa.Table.from_batches([batch])
            if self.problem:
                wrong = t.column(self.problem).is_valid()
                self._put(t.filter(wrong), "bad", writers)
                bad += sum(wrong.to_pylist())
                t = t.filter(pa.compute.invert(wrong)).drop_columns([self.problem])
            if self.by:
                counts.update("unknown" if x is None else str(x) for x in t.column(self.by).to_pylist())
            rows += len(t)
            self._put(t, "part", writers)
        for _, w in writers.values():
            w.close()
        return Written(writers.get("part", (None,))[0], writers.get("bad", (None,))[0], rows, bad, dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        found = [m for m in messages if m is not None]
        if any(m["batch"] == self.batch for m in manifests(self.path)):
            return self.abort(messages)
        counts = sum((Counter(m.counts) for m in found), Counter())
        body = {"version": self.base + 1, "batch": self.batch, "files": [m.file for m in found if m.file], "bad_files": [m.bad_file for m in found if m.bad_file],
                "summary": {"total": sum(m.rows for m in found), "bad": sum(m.bad for m in found), "counts": dict(sorted(counts.items()))}}
        folder = Path(self.path, COMMITS)
        folder.mkdir(parents=True, exist_ok=True)
        draft = folder / f".{uuid.uuid4().hex}"
        draft.write_text(json.dumps(body))
        try:
            os.link(draft, folder / f"{self.base + 1:012d}.json")  # whole at once, and only if nobody else was first
        except FileExistsError:
            self.abort(messages)
            raise RuntimeError(OVERTAKEN) from None
        finally:
            draft.unlink()

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in (m.file, m.bad_file) if m is not None else ():
                if name:
                    Path(self.path, name).unlink(missing_ok=True)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return CommittedWriter(self.options)


def _files(spark: SparkSession, path: str, known: list[dict], which: str) -> DataFrame | None:
    files = [f"file://{local(path)}/{f}" for m in known for f in m[which]]
    return spark.read.option("mergeSchema", "true").parquet(*files) if files else None


def read_committed(spark: SparkSession, path: str, bad: bool = False) -> DataFrame | None:
    """The rows of all commits, read by Spark itself (bad: those with a problem); None if there is none. Files that no
    manifest lists, as a killed writer leaves them, are not read."""
    return _files(spark, path, manifests(path), "bad_files" if bad else "files")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each commit: version, batch, total, bad, and counts by value of the counted column."""
    rows = [(m["version"], m["batch"], m["summary"]["total"], m["summary"]["bad"], m["summary"]["counts"]) for m in manifests(path)]
    return spark.createDataFrame(rows, "version long, batch string, total long, bad long, counts map<string, long>")


def append_committed(df: DataFrame, path: str, keys: list[str], batch: str, problem: str | None = None, count: str | None = None) -> dict | None:
    """Appends the rows of df whose keys the sink does not have, as one batch; gives its manifest, or None if the batch
    had been committed before.

    Null keys are equal to each other. Of rows with one key the batch takes one. problem: rows where this column is not
    null go to the bad ones, without a check of their keys; their number is in the manifest with the totals, so results
    and summary are published together. count: the column whose values the summary counts. If another writer commits
    first, the batch starts again from what is there then, so two writers never add one key twice.
    """
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(Committed)
    for _ in range(TRIES):
        known = manifests(path)
        if any(m["batch"] == batch for m in known):
            return None
        good = (df.where(F.col(problem).isNull()) if problem else df).dropDuplicates(keys)
        if (there := _files(spark, path, known, "files")) is not None:
            old = there.select(*[F.col(k).alias(f"_{k}") for k in keys])
            met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            good = good.join(old, met, "left_anti")
        rows = good.unionByName(df.where(F.col(problem).isNotNull())) if problem else good
        options = {"path": path, "batch": batch, "base": str(len(known))} | ({"problem": problem} if problem else {}) | ({"count": count} if count else {})
        try:
            rows.write.format("committed").mode("append").options(**options).save()
        except Exception as e:
            if OVERTAKEN not in str(e):
                raise
            continue
        return next(m for m in manifests(path) if m["batch"] == batch)
    raise RuntimeError(f"{path}: overtaken {TRIES} times")
