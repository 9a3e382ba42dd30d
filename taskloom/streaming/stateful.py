"""Runs watched with state of their own: silence found by timers, and a gate that releases each run once."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.ship import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARE = 0.995


def keeps_state(spark: SparkSession) -> None:
    """The package on every executor, and the state store that timers need (a session that has set another keeps it)."""
    ship(spark)
    spark.streams.active  # starts what coordinates state, for a batch query too
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name):
        spark.conf.set(name, STORE)


def enough(expected: int, share: float = SHARE) -> int:
    """So many tasks of a run have to be attempted."""
    return int(expected * share)


class _Silence(StatefulProcessor):
    def __init__(self, gap_ms: int, share: float) -> None:
        self.gap_ms, self.share = gap_ms, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms long, n long, expected long")
        self.tasks = handle.getMapState("tasks", "scenario_dir string, task_id int", "landed_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, expected = self.seen.get() or (0, 0, -1)
        for part in rows:
            for scenario, task, landed, wanted in zip(part["scenario_dir"], part["task_id"], part["landed_ms"], part["expected"]):
                task = (scenario, int(task))
                if not self.tasks.containsKey(task):
                    n += 1
                    self.tasks.updateValue(task, (int(landed),))
                last = max(last, int(landed))
                expected = max(expected, int(wanted))
        self.seen.update((last, n, expected))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if expected < 0 or n < enough(expected, self.share):
            self.handle.registerTimer(last + self.gap_ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n, _ = self.seen.get()
        at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        yield pd.DataFrame({"run": [key[0]], "last": [at(last)], "stalled_at": [at(last) + timedelta(milliseconds=self.gap_ms)], "n": [n]})


def stall_flags(verdicts: DataFrame, gap_seconds: float = 3600, expected: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """A stream of (run, last, stalled_at, n): each run that has had no new verdict for the gap, once for each silence.

    verdicts: a stream of (run, scenario_dir, task_id, landed). A timer stands for each run at its last verdict plus the
    gap, by the clock and not by a watermark: a run is flagged though no file of any run lands. A later verdict sets the
    timer anew; n counts the run's tasks, each once. Timers and what was flagged are in the checkpoint, so a restart
    flags nothing again. expected: a static (run, expected); a run with nearly all its tasks is silent because it is
    done, and is not flagged. State grows with the tasks of a run. For append output.
    """
    keeps_state(verdicts.sparkSession)
    rows = verdicts.select("run", "scenario_dir", "task_id", F.unix_millis("landed").alias("landed_ms"))
    if expected is not None:
        rows = rows.join(expected.select("run", F.col("expected").cast("long").alias("expected")), "run", "left")
    else:
        rows = rows.withColumn("expected", F.lit(None).cast("long"))
    rows = rows.withColumn("expected", F.coalesce("expected", F.lit(-1).cast("long")))
    return rows.groupBy("run").transformWithStateInPandas(_Silence(int(gap_seconds * 1000), share), "run string, last timestamp, stalled_at timestamp, n long", "append", "processingTime")


class _Gate(StatefulProcessor):
    def __init__(self, share: float) -> None:
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "attempted long, verified long, expected long, interrupted boolean, released boolean")
        self.tasks = handle.getMapState("tasks", "scenario_dir string, task_id int", "verified boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempted, verified, expected, interrupted, released = self.state.get() or (0, 0, -1, False, False)
        for part in rows:
            for r in part.itertuples():
                if r.is_plan:  # the last one of a batch by its order counts
                    expected, interrupted = int(r.expected), bool(r.interrupted)
                    continue
                task, good = (r.scenario_dir, int(r.task_id)), bool(r.verified)
                known = self.tasks.getValue(task) if self.tasks.containsKey(task) else None
                if known is None:
                    attempted += 1
                if good and not (known and known[0]):
                    verified += 1
                if known is None or (good and not known[0]):
                    self.tasks.updateValue(task, (good,))
        due = expected >= 0 and not interrupted and verified > 0 and attempted >= enough(expected, self.share)
        self.state.update((attempted, verified, expected, interrupted, released or due))
        if due and not released:
            yield pd.DataFrame({"run": [key[0]], "attempted": [attempted], "verified": [verified], "expected": [expected]})


def released_runs(verdicts: DataFrame, expected: DataFrame, share: float = SHARE) -> DataFrame:
    """A stream of (run, attempted, verified, expected): each run once, when it is complete enough: as many tasks attempted
    as int(share * expected), some of them with a verdict, and not interrupted.

    verdicts: a stream of (run, scenario_dir, task_id, reward_type); a null reward is an attempt without a verdict. A task
    counts once, though its file lands in both modes or again. expected: (run, expected, interrupted), static, or a stream
    of its own, whose rows change what is known of a run: an interruption that is lifted releases the run without another
    verdict. What was released is in the checkpoint. For append output.
    """
    keeps_state(verdicts.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    plan = expected.select("run", none("string").alias("scenario_dir"), none("int").alias("task_id"), none("boolean").alias("verified"), F.lit(True).alias("is_plan"), F.col("expected").cast("long").alias("expected"), F.coalesce("interrupted", F.lit(False)).alias("interrupted"))
    rows = verdicts.select("run", "scenario_dir", F.col("task_id").cast("int").alias("task_id"), F.col("reward_type").isNotNull().alias("verified"), F.lit(False).alias("is_plan"))
    if expected.isStreaming:
        rows = rows.withColumn("expected", none("long")).withColumn("interrupted", none("boolean")).unionByName(plan)
    else:  # each verdict brings its run's row along, as a row of its own
        met = rows.join(plan.select("run", "expected", "interrupted"), "run", "left")
        own = F.struct(F.col("scenario_dir"), F.col("task_id"), F.col("verified"), F.lit(False).alias("is_plan"), none("long").alias("expected"), none("boolean").alias("interrupted"))
        known = F.struct(none("string").alias("scenario_dir"), none("int").alias("task_id"), none("boolean").alias("verified"), F.lit(True).alias("is_plan"), F.col("expected"), F.col("interrupted"))
        both = F.when(F.col("expected").isNotNull(), F.array(own, known)).otherwise(F.array(own))
        rows = met.select("run", F.explode(both).alias("x")).select("run", "x.*")
    # Nulls would turn whole numbers and flags of the pandas frame into other kinds.
    rows = rows.fillna({"scenario_dir": "", "task_id": -1, "verified": False, "expected": -1, "interrupted": False})
    return rows.groupBy("run").transformWithStateInPandas(_Gate(share), "run string, attempted long, verified long, expected long", "append", "processingTime")
