"""Runs watched as their verdict files land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import run_files

VERDICT = "reward_type string, llm_judge struct<classification: string>"


def landed_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Run files as they appear: keys from their paths, when they landed, and their bodies."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").format("text").schema("value string").load(root)
    return run_files(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"), F.col("value").alias("body")))


def landed_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Every verdict file as it appears: run, scenario_dir, task_id, mode, reward_type (null where there is none), landed."""
    rows = landed_files(spark, root, "verify.*.json").withColumn("v", F.from_json("body", VERDICT))
    judged = F.when(F.col("v.reward_type").isNotNull(), F.coalesce("v.llm_judge.classification", "v.reward_type"))
    return rows.select("run", "scenario_dir", "task_id", "mode", judged.alias("reward_type"), "landed")


def verdict_stream(spark: SparkSession, root: str, late: str = "1 hour") -> DataFrame:
    """Verdicts as their files appear, each task and mode once: run, scenario_dir, task_id, mode, reward_type, landed."""
    rows = landed_verdicts(spark, root).where("reward_type is not null")
    return rows.withWatermark("landed", late).dropDuplicatesWithinWatermark(["run", "scenario_dir", "task_id", "mode"])


def live_scores(verdicts: DataFrame) -> DataFrame:
    """Verified, complete and score by run and mode; for update or complete output."""
    n, done = F.count("*"), F.count_if(F.col("reward_type") == "complete")
    return verdicts.groupBy("run", "mode").agg(n.alias("verified"), done.alias("complete"), (done / n).alias("score"))


def throughput(verdicts: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Verdicts by run and time bucket; what comes later than the watermark is dropped. late: the watermark of a stream that
    has none (verdict_stream() has one, and Spark allows no second)."""
    bucket = F.window("landed", size, slide) if slide else F.window("landed", size)
    rows = verdicts.withWatermark("landed", late) if late else verdicts
    return rows.groupBy("run", bucket.alias("bucket")).agg(F.count("*").alias("n")).select("run", F.col("bucket.start").alias("start"), "n")


def stalls(verdicts: DataFrame, gap: str = "3600 seconds", late: str | None = None) -> DataFrame:
    """Sessions of each run that ended because no verdict came for `gap`: its last verdict and when it counts as
    stalled. For what has landed already; a stream gives a session out only when other files have moved the watermark
    past it, so stall_flags() watches a live one."""
    rows = verdicts.withWatermark("landed", late) if late else verdicts
    w = rows.groupBy("run", F.session_window("landed", gap).alias("s")).agg(F.count("*").alias("n"), F.max("landed").alias("last"))
    return w.select("run", "last", F.col("s.end").alias("stalled_at"), "n")


def completion_gate(scores: DataFrame, expected: DataFrame, share: float = 0.995) -> DataFrame:
    """Runs (run, expected, interrupted) that are complete enough: attempted >= int(share * expected), some verified."""
    rows = expected.join(scores.groupBy("run").agg(F.sum("verified").alias("attempted")), "run", "left").fillna(0, ["attempted"])
    done = (F.col("attempted") >= F.floor(F.col("expected") * share)) & (F.col("attempted") > 0) & ~F.col("interrupted")
    return rows.withColumn("done", done)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, keys: list[str], checkpoint: str):
    """Applies a batch transform to what lands and appends new keys to a sink: a batch that runs again adds nothing."""
    from ..sources.tables import append_new

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(transform(df), path, keys)).start()
