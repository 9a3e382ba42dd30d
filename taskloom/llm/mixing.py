"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, ranked, running_sum, saved, word_count

#: No document is taken more often than this.
MOST = 3
#: Steps of importance in an octave, and octaves to either side of 1 that are told apart.
STEPS, OCTAVES = 8, 40
#: Documents that may be added to a source's sample at the end, to come nearer to its open words.
SETTLED = 2


def source_targets(rows: DataFrame, weights: tuple[float, ...], most: int = MOST) -> DataFrame:
    """(source, source_size, idx, start, target) for each source, null last: shares of the total size by weight.

    Weights repeat over the sources in code-point order. A target stops at `most` times its source's size; the excess
    is shared again by weight until none is above. The level is found from two sums over the sources at a time, so
    only scalars reach the driver. Sources of size 0 get 0.
    """
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    laid = saved(ranked(sizes, F.col("source").asc_nulls_last(), rank="idx"))
    n = laid.count()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("idx", F.lit(len(weights))) + 1).cast("int"))
    laid = saved(running_sum(laid, "idx", "source_size", "start", n).withColumn("weight", weight)) if n else laid.withColumn("start", F.lit(0).cast("long")).withColumn("weight", weight)
    top = F.lit(most) * F.col("source_size")
    total, all_weights = laid.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level, last = total / all_weights, None
    while level != last:
        above = F.col("weight") * F.lit(level) > top
        full, free = laid.agg(F.coalesce(F.sum(F.when(above, top)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        last, level = level, max(level, (total - full) / free) if free else level
    return laid.select("source", "source_size", "idx", "start", F.least(F.col("weight") * F.lit(level), top.cast("double")).alias("target"))


def unit_random(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that the keys decide."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12).cast("double") + 0.5) / float(1 << 52)


def inclusion(met: DataFrame) -> DataFrame:
    """met (idx, _bin, size, _open and more) with `_p`: each row's chance of inclusion, so that the expected words of
    each source are its open words.

    A chance is a factor of the source times the row's importance, 2 ** (_bin / STEPS); where that reaches 1, the row
    is certain and the factor is of the others. Sizes are summed by source and step first, so the steps of a source
    (2 * STEPS * OCTAVES + 1 at most) meet in one window and rows do not.
    """
    x = F.pow(F.lit(2.0), F.col("_bin") / STEPS)
    bins = met.where("_open > 0").groupBy("idx", "_bin").agg(F.sum("size").alias("w"), F.max("_open").alias("_open"))
    above = Window.partitionBy("idx").orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("idx").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.try_divide(F.col("_open") - F.coalesce(F.sum("w").over(above), F.lit(0)), F.sum(x * F.col("w")).over(below))
    bins = bins.select("idx", "_bin", factor.alias("c")).where(F.col("c") * x <= 1 + 1e-12)
    levels = bins.groupBy("idx").agg(F.max("_bin").alias("_top"), F.max_by("c", "_bin").alias("_c"))
    return met.join(levels, "idx", "left").withColumn("_p", F.when(F.col("_bin") > F.col("_top"), 1.0).otherwise(F.least(F.col("_c") * x, F.lit(1.0)))).drop("_top", "_c")


def pareto_mix(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 7, most: int = MOST, importance: Column | None = None) -> DataFrame:
    """rows (doc_id, source, size and more) with source_size, target, copies and taken (size times copies).

    A source whose target is f times its size gives floor(f) whole copies of each document for certain. The words that
    are open then come from a Pareto order sample of unequal chances p in proportion to importance (a positive column;
    null, NaN or not above 0: 1; by default the logarithm of the size, so longer documents are likelier): documents are
    ranked by the random odds u / (1 - u) over the inclusion odds p / (1 - p), certain ones (p = 1) first, and taken
    from the least on while they fit. At most SETTLED documents of those behind are added, each the one whose size is
    nearest to what is open still. u is a hash of doc_id and seed, so reruns agree; identical rows tie and either may be
    taken. Null sizes count as 0 and take nothing. rows must be narrow. Columns named like a result are replaced. No
    rows give no rows.
    """
    own = ["source_size", "target", "copies", "taken", "idx", "start", "_odds", "_before", "_rank", "_whole", "_open", "_bin", "_p"]
    rows = rows.drop(*own).withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    weight = F.log2(F.col("size").cast("double") + 1) if importance is None else importance.cast("double")
    step = F.when((weight > 0) & ~F.isnan(weight), F.rint(F.least(F.greatest(F.log2(weight), F.lit(-float(OCTAVES))), F.lit(float(OCTAVES))) * STEPS)).otherwise(0.0)
    rows = saved(rows.withColumn("_bin", step.cast("int")))
    sources = saved(source_targets(rows, weights, most))
    # Spark splits a hot source in this join by itself; the source side has one row for each source.
    sides = [sources["source_size"], sources["idx"], sources["start"], sources["target"]]
    met = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(*[rows[c] for c in rows.columns], *sides)
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    met = met.withColumn("_whole", F.floor(f)).withColumn("_open", F.when(f > F.floor(f), F.col("target") - F.floor(f) * F.col("source_size")).otherwise(0.0))
    u = unit_random(seed, "doc_id")
    odds = F.when(F.col("size") > 0, u / (1 - u) * (1 - F.col("_p")) / F.col("_p"))
    order = [F.col("idx"), F.col("_odds").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    laid = ranked(inclusion(met).withColumn("_odds", odds), *order, rank="_rank")
    n = laid.count()
    summed = saved(running_sum(laid, "_rank", "size", "_before", n) if n else laid.withColumn("_before", F.lit(0).cast("long")))
    until = F.col("_before") - F.col("start") + F.col("size")
    fits = (F.col("size") > 0) & (until <= F.col("_open"))
    gaps = saved(summed.where("_open > 0").groupBy("idx").agg((F.max("_open") - F.coalesce(F.max(F.when(fits, until)), F.lit(0))).alias("gap")))
    behind = summed.where((F.col("_open") > 0) & (F.col("size") > 0) & ~fits).select("idx", "size", "_rank")
    added: DataFrame | None = None
    for _ in range(SETTLED):
        free = behind if added is None else behind.join(added, "_rank", "left_anti")
        near = F.struct(F.abs(F.col("gap") - F.col("size")), F.col("_rank"))
        best = saved(free.join(gaps, "idx").where("size < 2 * gap").groupBy("idx").agg(F.min_by(F.struct("_rank", "size"), near).alias("b")))
        gaps = gaps.join(best, "idx").select("idx", (F.col("gap") - F.col("b.size")).alias("gap"))
        chosen = best.select(F.col("b._rank").alias("_rank"))
        added = chosen if added is None else added.union(chosen)
    taken = summed.join(added.withColumn("_more", F.lit(True)), "_rank", "left")
    copies = F.least(F.col("_whole") + F.when(fits | F.col("_more"), 1).otherwise(0), F.lit(most)).cast("long")
    return taken.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(*[c for c in own if c.startswith("_")], "_more", "idx", "start")


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
