"""Hilbert-curve sharding: rows that are alike in several metadata dimensions lie in the same shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ranked, saved

#: Bits of each quantised dimension.
BITS = 6


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a cell whose coordinates (0 to 2**bits - 1) are `axes`, as a long.

    Skilling's transform: coordinates are turned from the high bit down, Gray-coded, and their bits interleaved.
    It is a chain of built-in higher-order functions, so it runs in the JVM.
    """
    if len(axes) * bits > 62:
        raise ValueError("dimensions times bits must be at most 62")
    n = len(axes)
    state = F.struct(*[a.cast("long").alias(f"x{i}") for i, a in enumerate(axes)])
    low = lambda v, m: v.bitwiseAND(F.lit(m).cast("long"))

    def turn(state: Column, q: int, i: int) -> Column:
        x0, xi = state.getField("x0"), state.getField(f"x{i}")
        swap = low(x0.bitwiseXOR(xi), q - 1)
        is_set = low(xi, q) != 0
        new = {j: state.getField(f"x{j}") for j in range(n)}
        new[0] = F.when(is_set, x0.bitwiseXOR(F.lit(q - 1).cast("long"))).otherwise(x0.bitwiseXOR(swap))
        if i:
            new[i] = F.when(is_set, xi).otherwise(xi.bitwiseXOR(swap))
        return F.struct(*[new[j].alias(f"x{j}") for j in range(n)])

    steps = [(1 << k, i) for k in range(bits - 1, 0, -1) for i in range(n)]
    # Each step is one lambda over a literal array, so the expression grows with the steps and not with their product.
    state = reduce(lambda s, step: F.transform(F.array(s), lambda z: turn(z, *step))[0], steps, state)

    def gray(z: Column) -> Column:
        g = [z.getField("x0")]
        for i in range(1, n):
            g.append(z.getField(f"x{i}").bitwiseXOR(g[-1]))
        return F.struct(*[c.alias(f"x{i}") for i, c in enumerate(g)])

    def finish(z: Column) -> Column:
        last = z.getField(f"x{n - 1}")
        t = reduce(lambda s, k: s.bitwiseXOR(F.when(low(last, 1 << k) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)).cast("long")), range(bits - 1, 0, -1), F.lit(0).cast("long"))
        bit = lambda i, k: low(F.shiftright(z.getField(f"x{i}").bitwiseXOR(t), k), 1)
        out = F.lit(0).cast("long")
        for k in range(bits - 1, -1, -1):
            for i in range(n):
                out = F.shiftleft(out, 1).bitwiseOR(bit(i, k))
        return out

    coded = F.transform(F.array(state), gray)
    return F.transform(coded, finish)[0]


def quantised(df: DataFrame, size: str, dims: list[str], bits: int = BITS) -> tuple[DataFrame, list[Column]]:
    """(df with a cell for each of dims, coordinates): the size on a log scale (2 cells an octave), other columns by the
    rank of their value among the distinct ones, so that near values lie in near cells. Nulls take the last cell."""
    top = (1 << bits) - 1
    log = F.least(F.floor(2 * F.log2(F.col(size).cast("double") + 1)), F.lit(top)).cast("long")
    for k, d in enumerate(dims):
        values = saved(ranked(df.select(F.col(d).alias(f"_v{k}")).where(F.col(f"_v{k}").isNotNull()).distinct(), F.col(f"_v{k}"), rank=f"_c{k}"))
        cells = values.withColumn(f"_c{k}", F.floor(F.col(f"_c{k}") * top / max(values.count(), 1)).cast("long"))
        df = df.join(cells, df[d] == cells[f"_v{k}"], "left").drop(f"_v{k}")
    return df, [F.coalesce(c, F.lit(top).cast("long")) for c in (log, *[F.col(f"_c{k}") for k in range(len(dims))])]


def hilbert_shards(df: DataFrame, shards: int, size: str, dims: list[str], key: str, group: str | None = None, bits: int = BITS) -> DataFrame:
    """df with `curve`, `shard` (0 to shards - 1) and `slot` (gapless from 0): the curve is cut into runs of equal counts.

    Row counts of any two shards differ by at most one. Order: curve index, then the group, then a hash of the key, then
    the key, so a hot cell or group is spread over many range partitions. Rows with the same `group` (a hash of the
    text, say) stand together, at the least index of any of them: they share a shard unless a cut falls among them.
    df must be narrow (keys and metadata, no texts): it is laid out once by range and written to the shared folder.
    Null keys, sizes and groups have places like any others; repeated rows each have one; columns of df pass unchanged
    (`curve`, `rank`, `shard` and `slot` are replaced); no rows, no shards.
    """
    df = df.drop("curve", "rank", "shard", "slot")
    own = df.columns
    df, axes = quantised(df, size, dims, bits)
    cells = df.withColumn("curve", hilbert_index(axes, bits)).select(*own, "curve")
    if group is not None:
        cells = saved(cells)
        # Spark splits a hot group in this join by itself; the other side has one row for each group.
        least = cells.groupBy(F.col(group).alias("_g")).agg(F.min("curve").alias("_least"))
        cells = cells.join(least, F.col(group).eqNullSafe(F.col("_g"))).withColumn("curve", F.col("_least")).drop("_g", "_least")
    laid = ranked(cells, F.col("curve"), *([F.col(group)] if group is not None else []), F.xxhash64(key), F.col(key))
    n = max(laid.count(), 1)
    shard = F.expr(f"(rank * {shards}) div {n}")
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards} - 1) div {shards}")
    return laid.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first).drop("rank")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_text"), "source", "lang")
    out = hilbert_shards(rows, 16, "size", ["source", "lang"], "doc_id", group="_text")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
