"""Table states: differences, constraints, and expectations on a difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, columns): rows inserted, deleted or updated, with the columns that differ (null-safe).

    Values are compared themselves, null-safely: a null that moves to another column is a change.
    """
    rest = [c for c in before.columns if c not in keys]
    side = lambda df, s: df.select(*keys, F.struct(*rest).alias(s))
    both = side(before, "old").join(side(after, "new"), keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("updated")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in rest]))
    return both.select(*keys, change.alias("change"), F.when(change == "updated", differs).otherwise(F.array().cast("array<string>")).alias("columns"), *[F.col(f"new.{c}").cast("string").alias(f"new_{c}") for c in rest])


def constraint_failures(child: DataFrame, key: list[str], required: list[str], foreign: dict[str, tuple[DataFrame, str]], threshold: float = 0.1) -> DataFrame:
    """(check, n_failed, ratio, ok) for a table: duplicate keys (rows past the first), nulls, and keys without a parent.

    ok is whether the share of rows that fail is at most the threshold. Nulls of all columns are counted in one pass.
    """
    n = F.count("*").alias("n")
    dup = child.groupBy(*key).agg(n).agg(F.lit("duplicate:" + ",".join(key)).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parts = [dup]
    if required:
        counts = child.agg(n, *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(required)])
        each = F.array(*[F.struct(F.lit(f"not_null:{c}").alias("check"), F.col(f"_{i}").alias("n_failed")) for i, c in enumerate(required)])
        parts.append(counts.select(F.explode(each).alias("x"), "n").select("x.check", "x.n_failed", "n"))
    for c, (parent, p) in foreign.items():
        known = parent.select(F.col(p).alias(c)).distinct().withColumn("_known", F.lit(True))
        met = child.select(c).join(known, c, "left")
        parts.append(met.agg(F.lit(f"foreign_key:{c}").alias("check"), F.count_if(F.col(c).isNotNull() & F.col("_known").isNull()).alias("n_failed"), n))
    ratio = F.col("n_failed") / F.greatest("n", F.lit(1))
    return reduce(lambda a, b: a.unionByName(b), parts).select("check", "n_failed", ratio.alias("ratio"), (ratio <= threshold).alias("ok"))


def unmet_expectations(diff: DataFrame, expectations: DataFrame, keys: list[str]) -> DataFrame:
    """Expectations (keys, change, column, expected) that no row of the difference meets."""
    long = diff.select(*keys, "change", F.explode(F.map_from_arrays(F.array(*[F.lit(c[4:]) for c in diff.columns if c.startswith("new_")]), F.array(*[F.col(c) for c in diff.columns if c.startswith("new_")]))).alias("column", "expected"))
    match = [expectations[c] == long[c] for c in [*keys, "change"]] + [expectations["column"].isNull() | ((expectations["column"] == long["column"]) & expectations["expected"].eqNullSafe(long["expected"]))]
    return expectations.join(long, reduce(lambda a, b: a & b, match), "left_anti")
