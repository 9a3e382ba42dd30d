"""Helpers that the corpus operators share: saved tables, ranks, prefix sums, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.ship import ship

#: Bytes of an Arrow batch, where the session has Spark's own default: texts are long, and a batch is held several times.
BATCH = 4 << 20
#: ASCII white space ends a word; nothing else does.
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """The package on every executor, and Arrow batches of bounded size (a session that has set its own keeps it)."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only on one machine (local mode, as in tests) may it be unset; then a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_taskloom_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="taskloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._taskloom_dir = own
    return f"file://{own}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder: lineage ends here and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/taskloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """df with `rank`, the 0-based place of each row in `order`: gapless, and fixed once it is returned.

    One range exchange of the given (narrow) rows; a row's place is its place in its partition plus the rows of the
    partitions before it. Only one count for each partition meets in one task. End `order` with a column that tells
    rows apart, so that equal sort keys do not gather in one partition. An empty df gives no rows.
    """
    spark = df.sparkSession
    laid = saved(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    # One row for each partition of the exchange, so the broadcast is bounded by the number of partitions.
    return laid.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(rank, F.col("_first") + place).drop("_part", "_at", "_first")


def running_sum(df: DataFrame, rank: str, value: str, out: str, n: int, bits: int = 10) -> DataFrame:
    """df with `out`, the sum of `value` over all rows of a smaller `rank` (0 to n - 1, gapless).

    Blocks of 2**bits ranks are summed, blocks of blocks too, until one block is left; so no window holds more than
    2**bits rows, and each level moves 2**bits times fewer rows than the one below.
    """
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block, inside, base = f"_block{n}", f"_inside{n}", f"_base{n}"
    if n <= 1 << bits:
        return df.withColumn(block, F.lit(0)).withColumn(out, before(Window.partitionBy(block).orderBy(rank))).drop(block)
    parts = df.withColumn(block, F.shiftright(rank, bits))
    inner = parts.withColumn(inside, before(Window.partitionBy(block).orderBy(rank)))
    blocks = parts.groupBy(block).agg(F.sum(value).alias(value))
    blocks = running_sum(blocks, block, value, base, ((n - 1) >> bits) + 1, bits).select(block, base)
    return inner.join(blocks, block).withColumn(out, F.col(inside) + F.col(base)).drop(block, inside, base)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in `links` (undirected, any repeats): the smallest node reachable.

    Rounds of contraction: each node takes its least neighbour by hash, chains are shortened twice by doubling, then
    links are rewritten to the nodes taken, until none is left. Stars fold in two rounds and chains by a constant
    factor. Each round shuffles only pairs of ids, written to the shared folder.
    """
    spark = links.sparkSession
    order = F.xxhash64("y")
    pairs = saved(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct())
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("y", "x"))
        least = both.groupBy("x").agg(F.min_by("y", F.struct(order, "y")).alias("p"))
        up = least.select("x", F.when(F.struct(F.xxhash64("p"), F.col("p")) < F.struct(F.xxhash64("x"), F.col("x")), F.col("p")).otherwise(F.col("x")).alias("p"))
        for _ in range(2):
            up = saved(up)
            up = up.join(up.select(F.col("x").alias("p"), F.col("p").alias("q")), "p").select("x", F.col("q").alias("p"))
        up = saved(up)
        maps.append(up)
        to = lambda c: up.select(F.col("x").alias(c), F.col("p").alias(f"{c}_p"))  # noqa: E731, B023
        moved = pairs.join(to("x"), "x").join(to("y"), "y").select(F.least("x_p", "y_p").alias("x"), F.greatest("x_p", "y_p").alias("y"))
        pairs = saved(moved.where("x <> y").distinct())
    if not maps:
        return pairs.select(F.col("x").alias("node"), F.col("y").alias("component"))
    found = maps[0].select(F.col("x").alias("node"), F.col("p").alias("root"))
    for up in maps[1:]:
        found = found.join(up.select(F.col("x").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    found = saved(found)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def word_count(text: str | Column = "text") -> Column:
    """Words of a text (null: 0): the places where a word begins."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
