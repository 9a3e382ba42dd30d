"""A dataset's profile from sketches of its ingests, merged without reading anything again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised

#: Logarithm of the buckets of a sketch of distinct keys: a relative error of about 1.04 / sqrt(2 ** 12) = 1.6 %.
LG_K = 12
#: Size of a sketch of quantiles: a rank error of about 1.3 % with 99 % confidence.
QUANTILE_K = 200
PARTS = (0.5, 0.9, 0.99)


def token_count(encoding: str | None = None):
    """A function of a text column: its tokens by an encoding of the installed tokenizer, or, where that can't be loaded,
    its length in characters (null: null). The encoding is loaded once in each task."""

    @vectorised("long")
    def counted(s: pd.Series) -> pd.Series:
        try:
            import tiktoken

            known = tiktoken.get_encoding(encoding) if encoding else None
        except Exception:  # no tokenizer, or no file of this encoding on this machine
            known = None
        size = (lambda t: len(known.encode(t, disallowed_special=()))) if known is not None else len
        return s.map(lambda t: None if t is None else size(t)).astype("Int64")

    return counted


def profile_sketch(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row: rows, a sketch of distinct keys, and for each measure its number, sum, extremes and a sketch of quantiles.

    Rows of several ingests, kept as a table, merge by merged_profile(). Keys are told apart by their JSON text, so a null
    is not an empty string; nulls of a measure do not count.
    """
    parts = [F.count("*").alias("n_rows"), F.hll_sketch_agg(F.to_json(F.struct(*keys)), F.lit(LG_K)).alias("keys")]
    for name, c in measures.items():
        x = c.cast("double")
        parts += [F.count(x).alias(f"{name}_n"), F.sum(x).alias(f"{name}_sum"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, F.lit(QUANTILE_K))).alias(f"{name}_kll")]
    return df.agg(*parts)


def merged_profile(sketches: DataFrame, measures: list[str], quantiles: tuple[float, ...] = PARTS) -> DataFrame:
    """One row over the rows of profile_sketch(): n_rows and, for each measure, avg, min and max are exact; n_keys and the
    quantiles (_p50 and so on) are estimates within the stated errors. Ingests are few, so their sketches meet in one row."""
    merge = lambda c: F.reduce(F.filter(F.collect_list(c), lambda x: x.isNotNull()), F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x).otherwise(F.kll_sketch_merge_double(a, x)))
    parts = [F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n_keys")]
    for m in measures:
        parts += [(F.sum(f"{m}_sum") / F.sum(f"{m}_n")).alias(f"{m}_avg"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"), merge(f"{m}_kll").alias(f"{m}_kll")]
    rows = sketches.agg(*parts)
    for m in measures:
        for q in quantiles:
            rows = rows.withColumn(f"{m}_p{round(q * 100)}", F.kll_sketch_get_quantile_double(f"{m}_kll", F.lit(q)))
    return rows.drop(*[f"{m}_kll" for m in measures])
