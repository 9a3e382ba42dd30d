"""JSON-lines tables, run trees, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.jsonkit import json_facts

RUN_FILE = r"([^/]+)/([^/]+)/task_(\d+)/(trajectory|verify\.(\w+))\.json$"


def read_json_lines_apart(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their file)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    parsed = lines.withColumn("_row", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_row._bad is null").select("_row.*").drop("_bad"), parsed.where("_row._bad is not null").select("file", "line")


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read again; without one, in the session's warehouse."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/taskloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_files(raw: DataFrame, path: str = "file") -> DataFrame:
    """Keys of run files from their paths: run, scenario_dir, task_id, kind (trajectory or verify) and mode."""
    part = lambda i: F.regexp_extract(path, RUN_FILE, i)
    keyed = raw.withColumn("run", part(1)).withColumn("scenario_dir", part(2)).withColumn("task_id", part(3).cast("int"))
    return keyed.withColumn("kind", F.substring_index(part(4), ".", 1)).withColumn("mode", F.nullif(part(5), F.lit(""))).where("run <> ''")


def read_run_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, quarantine) of <root>/<run>/<scenario_dir>/task_<id>/*.json: bodies stay text; those that are not one
    JSON object go to quarantine with a reason."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    files = run_files(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")))
    facts = files.withColumn("_f", json_facts("body"))
    bad = F.when(~F.col("_f.ok"), "not_json").when(F.col("_f.kind") != "object", "not_an_object")
    facts = facts.withColumn("reason", bad).drop("_f")
    return facts.where("reason is null").drop("reason"), facts.where("reason is not null").select("file", "run", "scenario_dir", "task_id", "reason")


def write_buckets(df: DataFrame, by: str, path: str) -> None:
    """One folder for each value of `by`, from one pass."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key the sink does not have; gives their number. A sink that is not there yet is empty, and null
    keys are equal to each other. One writer at a time: append_committed() holds for several."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = df
    if there:
        old = spark.read.parquet(path).select(*[F.col(k).alias(f"_{k}") for k in keys])
        fresh = df.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    fresh = fresh.dropDuplicates(keys).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
