"""Hard negatives: scores bounded by the means and deviations of vector segments, refined step by step before exact ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, partitions, ready, saved

#: Segments of a vector at each step of refinement; each step's are unions of the next one's.
STEPS = (1, 4, 16)
#: Rows of a block of anchors or vectors; blocks of vectors that one task scans, blocks of anchors it scans them for.
BLOCK, SLICE, GROUP = 512, 64, 2
#: Components of this size or more (as whole numbers) are too large for 64-bit scores of up to 6,000 dimensions.
LARGEST = 1 << 23
#: A step looks at single pairs once fewer than this share of a block's pairs is left, and at all of them before.
SPARSE = 0.2
NONE = np.iinfo(np.int64).min

_ROWS = "id long, label long, dim int, v binary"
_BLOCKS = "dim int, n int, rows binary, ids binary, labels binary, ints binary, means binary, spreads binary, positives binary"
_FOUND = "anchor long, part int, row long, id long, score long"


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(id, label, e) -> (id, label, dim, v) of the vectors that take part: v has floor(scale * x) in 32 bits."""
    for batch in batches:
        e = batch.column(2)
        ok = np.asarray(batch.column(1).is_valid()) & np.asarray(batch.column(0).is_valid()) & np.asarray(e.is_valid())
        ids, labels, dims, out = [], [], [], []
        for i in np.flatnonzero(ok):
            x = e[int(i)].values
            if x.null_count:
                continue
            x = np.floor(np.asarray(x, np.float64) * scale)
            if len(x) and not (np.abs(x) < LARGEST).all():  # NaN and infinite ones too
                continue
            ids.append(batch.column(0)[int(i)].as_py())
            labels.append(batch.column(1)[int(i)].as_py())
            dims.append(len(x))
            out.append(x.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "dim", "v"])


def summaries(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, spreads) of the segments of each row, for all steps side by side, each times the root of the segment's
    length: so the product of two rows' segments is that of the means, give or take that of the spreads."""
    x, dim = ints.astype(np.float64), ints.shape[1]
    means, spreads = [], []
    for n in STEPS:
        ends = np.linspace(0, dim, n + 1).astype(int)
        for a, b in zip(ends[:-1], ends[1:]):
            seg = x[:, a:b]
            mean = seg.mean(1) if b > a else np.zeros(len(x))
            means.append(mean * (b - a) ** 0.5)
            spreads.append(np.sqrt(((seg - mean[:, None]) ** 2).sum(1)))
    return np.stack(means, 1), np.stack(spreads, 1)


@dataclass
class Block:
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    means: np.ndarray
    spreads: np.ndarray
    positives: np.ndarray | None

    @classmethod
    def read(cls, r: dict) -> Block:
        n, wide = r["n"], max(r["dim"], 1)
        get = lambda c, kind=np.int64: np.frombuffer(r[c], kind)
        positives = get("positives").reshape(n, -1) if r["positives"] is not None else None
        return cls(get("rows"), get("ids"), get("labels"), get("ints", np.int32).reshape(n, wide), get("means", np.float64).reshape(n, -1), get("spreads", np.float64).reshape(n, -1), positives)


def _blocked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(row, id, label, dim, v, positives), sorted by dim -> blocks of up to `most` rows of one dim."""

    def block(rows: list[tuple]) -> list:
        row, ids, labels, dims, v, positives = zip(*rows)
        dim = dims[0]
        ints = np.frombuffer(b"".join(v), np.int32).reshape(len(v), dim) if dim else np.zeros((len(v), 1), np.int32)
        means, spreads = summaries(ints)
        number = lambda x: np.array(x, np.int64).tobytes()
        return [dim, len(v), number(row), number(ids), number(labels), ints.tobytes(), means.tobytes(), spreads.tobytes(), b"".join(positives) if positives[0] is not None else None]

    def made(blocks: list[list]) -> pa.RecordBatch:
        kinds = [pa.int32()] * 2 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) == most or (held and held[0][3] != r[3]):
                yield made([block(held)])
                held = []
            held.append(r)
    if held:
        yield made([block(held)])


def survivors(a: Block, b: Block, alive: np.ndarray, low: np.ndarray, high: np.ndarray, top: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the pairs in `alive` whose score may be from low to high (by row of a), and maybe
    others: bounds by segments are refined step by step, and what they can't rule out is scored exactly.

    top: only the best `top` scores of a row of a are wanted: the greatest lower bounds raise `low`.
    """
    at = 0
    for n in STEPS:
        ma, sa, mb, sb = a.means[:, at : at + n], a.spreads[:, at : at + n], b.means[:, at : at + n], b.spreads[:, at : at + n]
        at += n
        if alive.mean() > SPARSE:
            mid, out = ma @ mb.T, sa @ sb.T
            out += 1e-9 * (np.abs(mid) + out) + 1e-6  # so that rounding rules out no pair
            if 0 < top <= alive.shape[1]:
                least = np.where(alive, mid - out, -np.inf)
                low = np.maximum(low, np.partition(least, -top, 1)[:, -top])
            alive = alive & (mid + out >= low[:, None]) & (mid - out <= high[:, None])
        else:
            i, j = np.nonzero(alive)
            mid, out = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", sa[i], sb[j])
            out += 1e-9 * (np.abs(mid) + out) + 1e-6
            alive = np.zeros_like(alive)
            ok = (mid + out >= low[i]) & (mid - out <= high[i])
            alive[i[ok], j[ok]] = True
    i, j = np.nonzero(alive)
    exact = float(np.abs(a.ints).max(initial=0)) * float(np.abs(b.ints).max(initial=0)) * a.ints.shape[1] < 2**53
    if exact and alive.mean() > SPARSE:
        score = (a.ints.astype(np.float64) @ b.ints.astype(np.float64).T)[i, j].astype(np.int64)
    else:
        score = np.zeros(len(i), np.int64)
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            score[k : k + len(p)] = (a.ints[p].astype(np.int64) * b.ints[q].astype(np.int64)).sum(1)
    return i, j, score


class Best:
    """The best `most` (score, id, row) for each of n keys so far: higher scores first, ties by id, then by row."""

    def __init__(self, n: int, most: int) -> None:
        self.n, self.most = n, most
        self.key, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        key, score, ids, rows = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, key))
        k = key[order]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        place = np.arange(len(k)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = order[place < self.most]
        self.key, self.score, self.id, self.row = key[keep], score[keep], ids[keep], rows[keep]

    def least(self) -> np.ndarray:
        """What a new score has to reach, by key."""
        counts = np.bincount(self.key, minlength=self.n)
        low = np.full(self.n, np.inf)
        np.minimum.at(low, self.key, self.score.astype(np.float64))
        return np.where(counts >= self.most, low, -np.inf)


def _scan(anchors: pa.Table, vectors: pa.Table, most: int, share: tuple[int, int, int] | None) -> pa.Table:
    """One task's anchors against its blocks of vectors: the best rows of the same label (share: None), or, for each
    positive, the best of other labels within the share of its score."""
    found: list[list[np.ndarray]] = []
    blocks = [Block.read(r) for r in vectors.select([c.split()[0] for c in _BLOCKS.split(", ")]).to_pylist()]
    for a in map(Block.read, anchors.to_pylist()):
        n, wide = len(a.rows), 1 if share is None else a.positives.shape[1]
        best = Best(n * wide, most)
        if share is not None:
            below, above, whole = share
            positive = a.positives
            there = positive != NONE
            first, last = np.where(there, positive * (below / whole), np.inf), np.where(there, positive * (above / whole), -np.inf)
            high = last.max(1) + 1
        for b in blocks:
            same = a.labels[:, None] == b.labels[None]
            if share is None:
                alive = same & (a.rows[:, None] != b.rows[None])
                if not alive.any():
                    continue
                i, j, score = survivors(a, b, alive, best.least(), np.full(n, np.inf), most)
                best.add(i, score, b.ids[j], b.rows[j])
            else:
                low = np.maximum(first, best.least().reshape(n, wide)).min(1) - 1
                i, j, score = survivors(a, b, ~same, low, high)
                w = np.arange(wide)
                p, s = positive[i], score[:, None]
                ok = there[i] & (below * p <= whole * s) & (whole * s <= above * p)
                x, y = np.nonzero(ok)
                best.add(i[x] * wide + w[y], score[x], b.ids[j[x]], b.rows[j[x]])
        found.append([a.rows[best.key // wide], (best.key % wide).astype(np.int32), best.row, best.id, best.score])
    kinds = (np.int64, np.int32, np.int64, np.int64, np.int64)
    cols = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, k) for c, k in enumerate(kinds)]
    return pa.table(dict(zip(("anchor", "part", "row", "id", "score"), cols)))


def _met(anchors: DataFrame, vectors: DataFrame, most: int, share: tuple[int, int, int] | None, slice_blocks: int) -> DataFrame:
    """All anchors against all vectors: each task takes about GROUP blocks of anchors and `slice_blocks` of vectors, a block being
    one row; then the best of all tasks, for each anchor and part."""
    groups, slices = -(-anchors.count() // GROUP), -(-vectors.count() // slice_blocks)
    at = lambda n: F.pmod(F.xxhash64("ids", "rows"), F.lit(max(n, 1))).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    a = anchors.withColumn("g", at(groups)).withColumn("s", over(slices))
    b = vectors.withColumn("s", at(slices)).withColumn("g", over(groups))
    keys = ["dim", "g", "s"]
    scan = lambda x, y: _scan(x, y, most, share)
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(scan, _FOUND)
    place = F.row_number().over(Window.partitionBy("anchor", "part").orderBy(F.col("score").desc(), "id", "row"))
    return saved(found.withColumn("rank", place).where(F.col("rank") <= most))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    n = rows.count()
    spread = max(1, min(partitions(rows.sparkSession), -(-n // block)))
    laid = rows.repartitionByRange(spread, "dim", "label", "row").sortWithinPartitions("dim", "label", "row")
    return saved(laid.select("row", "id", "label", "dim", "v", "positives").mapInArrow(lambda it: _blocked(it, block), _BLOCKS))


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int, int] = (50, 95, 100), scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, slice_blocks: int = SLICE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` is true.

    Components become floor(scale * x); a row's score with an anchor is the inner product of these whole numbers. The
    positives of an anchor are the best `positives` other rows of its label; for each, the best `negatives` rows of other
    labels with share[0] * positive score <= share[2] * score <= share[1] * positive score; ties go to the smaller key.
    Rows take no part whose key, label or vector is null, or whose vector holds a null, a number that is not finite, or
    one of 32,768 or more in size (LARGEST / 256). Vectors of different length are never compared; empty ones score 0.
    Rows with one key are rows of their own; equal ones too. Other columns are not read. No rows give no rows.

    Scores are exact for every pair that the bounds leave; no candidate is left out otherwise. Of rows with the same label
    and vector, only those of the smallest keys can be among the best, so only these are candidates.
    """
    spark = vectors.sparkSession
    ready(spark)
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("e"))
    rows = saved(plain.mapInArrow(lambda it: _whole(it, scale), _ROWS).withColumn("row", F.monotonically_increasing_id()))
    copy = F.row_number().over(Window.partitionBy("label", "v").orderBy("id", "row"))
    most = max(positives + 1, negatives)
    none = F.lit(None).cast("binary").alias("positives")
    pool = _dealt(rows.withColumn("_copy", copy).where(F.col("_copy") <= most).select("row", "id", "label", "dim", "v", none), block)
    asked = saved(rows.where(F.coalesce(anchors, F.lit(False))))
    best = _met(_dealt(asked.select("*", none), block), pool, positives, None, slice_blocks).select(F.col("anchor").alias("row"), F.col("rank").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "positive_score"))).alias("p"))
    scores = F.transform("p", lambda x: x["positive_score"])
    padded = saved(asked.join(known, "row").select("row", "id", "label", "dim", "v", scores.alias("p")))
    with_scores = padded.mapInArrow(lambda it: _padded(it, positives), "row long, id long, label long, dim int, v binary, positives binary")
    found = _met(_dealt(with_scores, block), pool, negatives, share, slice_blocks)
    out = found.select(F.col("anchor").alias("row"), (F.col("part") + 1).alias("part"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["row", "part"])
    return out.join(asked.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _padded(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Lists of scores -> numbers of one width, NONE where there are fewer."""
    for batch in batches:
        lists = [np.array((x + [NONE] * wide)[:wide], np.int64).tobytes() for x in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(lists, pa.binary())], names=["row", "id", "label", "dim", "v", "positives"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0)


#: The same result in DuckDB SQL (the products are of whole numbers far below 2^53, so doubles hold them exactly).
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""
