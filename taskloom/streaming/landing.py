"""Trajectories and verdicts that land apart, joined as streams and cleaned as they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import KEY, cleaned_files, read_trajectories
from ..sources.committed import append_committed
from ..sources.ship import ship
from .live import landed_files, landed_verdicts

PATH_KEY = ["run", "scenario_dir", "task_id"]


def trajectory_stream(spark: SparkSession, root: str) -> DataFrame:
    """Trajectory files as they appear: run, scenario_dir, task_id, file, body, landed."""
    return landed_files(spark, root, "trajectory.json").select(*PATH_KEY, "file", "body", "landed")


def met(trajectories: DataFrame, verdicts: DataFrame, mode: str = "code", wait: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each trajectory once, with the verdict of the mode that lands within `wait` of it, before or after; reward_type is
    null where none does. A stream-stream outer join: state is dropped once the watermark has passed it, and a trajectory
    without a verdict comes out then. A file of a key that has landed before, within the watermark, is left out."""
    t = trajectories.withWatermark("landed", late).dropDuplicatesWithinWatermark(PATH_KEY)
    v = verdicts.where(F.col("mode") == mode).select(*[F.col(c).alias(f"v_{c}") for c in PATH_KEY], "reward_type", F.col("landed").alias("v_landed"))
    v = v.withWatermark("v_landed", late).dropDuplicatesWithinWatermark([f"v_{c}" for c in PATH_KEY])
    same = [t[c] == v[f"v_{c}"] for c in PATH_KEY]
    near = F.expr(f"v_landed >= landed - interval {wait} and v_landed <= landed + interval {wait}")
    on = same[0]
    for c in same[1:]:
        on = on & c
    return t.join(v, on & near, "left").select(*PATH_KEY, "file", "body", "landed", "reward_type")


def clean_as_they_land(spark: SparkSession, root: str, path: str, checkpoint: str, mode: str = "code", wait: str = "1 hour", late: str = "1 hour", **trigger) -> StreamingQuery:
    """Cleans what met() gives into a committed sink at path (bucket: kept or rejected), one commit for each batch.

    A batch that runs again after a stop is the same batch and is not committed twice; a trajectory that the sink has is not
    added again. trigger: as for writeStream.trigger(); all that is there, if none is given.
    """
    ship(spark)
    stream = met(trajectory_stream(spark, root), landed_verdicts(spark, root), mode, wait, late)

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        verdicts = rows.select("run", F.col("scenario_dir").alias("scenario"), F.col("task_id").cast("long").alias("task_id"), "reward_type")
        append_committed(cleaned_files(read_trajectories(rows), verdicts), path, KEY, f"{checkpoint}#{number}", count="bucket")
        rows.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()
