"""Near-duplicate vectors: random projections decoded to E8 lattice points, in several tables with probes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, partitions, ready, saved
from .words import mix, ragged

#: Tables; lattice points in a key; size of a lattice step in the projected space; neighbouring cells probed.
#: Measured on pairs of cosine 0.93 in 64 dimensions: one table meets 0.6 of them (0.7 at 0.95), so 8 tables miss 7e-4.
TABLES, BLOCKS, STEP, PROBES = 8, 2, 0.32, 3
#: Rows of a cell that are compared in one group; larger cells are split into blocks, and pairs of blocks compared.
BLOCK = 2048
#: Pairs compared at a time.
PAIRS = 1 << 17


@cache
def _rotations(dim: int) -> np.ndarray:
    """TABLES * BLOCKS projections to 8 dimensions: rows of random rotations, padded to a multiple of 8."""
    rng, wide, out = np.random.default_rng(dim), -(-dim // 8) * 8, []
    while len(out) < TABLES * BLOCKS:
        q, _ = np.linalg.qr(rng.normal(size=(wide, wide)))
        out += [q[k : k + 8, :dim] for k in range(0, wide, 8)]
    # A unit vector's part in 8 of `dim` dimensions shrinks with their share; the step is stated for 64.
    return np.stack(out[: TABLES * BLOCKS]) * (wide / 64) ** 0.5


def e8_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of 8 numbers, 8 points of E8 near it (doubled, so whole numbers) and their squared distances,
    nearest first. E8 is D8 and D8 shifted by a half in every coordinate; D8 is the whole numbers of even sum. The
    first is the nearest point; the others come from turning up to three of the coordinates cheapest to turn."""
    points, dist, rows = [], [], np.arange(len(x))
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        err = y - r
        step, cost = np.where(err >= 0, 1.0, -1.0), 1 - 2 * np.abs(err)
        cheap = np.argsort(cost, 1)[:, :3]
        odd = r.sum(1) % 2 != 0
        for even_turns, odd_turns in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,)), ((1, 2), (0, 1, 2))):
            p, d = r.copy(), (err**2).sum(1)
            for chosen, turns in ((~odd, even_turns), (odd, odd_turns)):
                i = rows[chosen]
                for k in turns:
                    c = cheap[chosen, k]
                    p[i, c] += step[i, c]
                    d[i] += cost[i, c]
            points.append(2 * (p + shift))
            dist.append(d)
    points, dist = np.stack(points, 1).astype(np.int64), np.stack(dist, 1)
    order = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(points, order[:, :, None], 1), np.take_along_axis(dist, order, 1)


def cells(u: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Keys of unit vectors, [row, table, 1 + PROBES]: the own cell of each table and the neighbouring ones nearest."""
    out = np.empty((len(u), TABLES, 1 + PROBES), np.uint64)
    rotations = _rotations(u.shape[1])
    weights = mix(np.arange(1, 9 * BLOCKS + 1, dtype=np.uint64)).reshape(BLOCKS, 9)
    salt = mix(label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(u.shape[1]))
    for t in range(TABLES):
        ids, dist = [], []
        for b in range(BLOCKS):
            p, d = e8_points(u @ rotations[t * BLOCKS + b].T / STEP)
            ids.append(mix((p.view(np.uint64) * weights[b, :8]).sum(2, dtype=np.uint64)))
            dist.append(d - d[:, :1])
        own = [i[:, 0] for i in ids]
        keys, extra = [], []
        for b in range(BLOCKS):
            for k in range(1, 4):
                keys.append(sum((ids[b][:, k] if c == b else own[c]) * weights[c, 8] for c in range(BLOCKS)))
                extra.append(dist[b][:, k])
        if BLOCKS > 1:
            keys.append(sum((ids[c][:, 1] if c < 2 else own[c]) * weights[c, 8] for c in range(BLOCKS)))
            extra.append(dist[0][:, 1] + dist[1][:, 1])
        near = np.argsort(np.stack(extra, 1), 1, kind="stable")[:, :PROBES]
        mine = sum(own[c] * weights[c, 8] for c in range(BLOCKS))
        key = np.concatenate([mine[:, None], np.take_along_axis(np.stack(keys, 1), near, 1)], 1)
        out[:, t] = mix(key + salt[:, None] + np.uint64(t + 1))
    return out


def _unit(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors in double precision) of the vectors of one length."""
    v = np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec, label, embedding) -> (vec, label, v): the vector's bytes, null where it can't be compared."""
    for batch in batches:
        out = []
        for label, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ok = label is not None and e and None not in e
            v = np.asarray(e, np.float64) + 0.0 if ok else None
            if v is not None and np.isfinite(v).all() and v.any():
                v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
                out.append(v.tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec", "label", "v"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec, label, v) -> (vec, keys): all cells of each vector, table by table, the own cell first."""
    for batch in batches:
        size = np.array([len(x) for x in batch.column(2).to_pylist()], int)
        for s in np.unique(size):
            part = batch.filter(pa.array(size == s))
            for i in range(0, len(part), 4096):
                p = part.slice(i, 4096)
                k = cells(_unit(p.column(2)), p.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([x.tobytes() for x in k.reshape(len(p), -1)], pa.binary())], names=["vec", "keys"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(batch), -1)
            own = np.tile(np.arange(k.shape[1]) % (1 + PROBES) == 0, len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), k.shape[1])), pa.array(own)], names=["cell", "vec", "own"])


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows of a cell's groups, sorted by (cell, x, y) -> (vec, links, to): links found first in this cell, summed for
    each vector, and the least vector of the group that they lead to."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, x, y, side = (t.column(c).to_numpy() for c in ("cell", "x", "y", "side"))
        vec, copies, raw = t.column("vec").to_numpy(), t.column("copies").to_numpy(), t.column("v").to_pylist()
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(len(t), TABLES, 1 + PROBES)
        wide = max(map(len, raw)) // 8
        u = np.zeros((len(t), wide))
        for i, b in enumerate(raw):
            u[i, : len(b) // 8] = np.frombuffer(b, np.float64)
        u /= np.sqrt((u * u).sum(1))[:, None]
        new = np.append(True, (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        ends = np.append(np.flatnonzero(new)[1:], len(t))
        # Each row meets the rows after it in its group; in a pair of blocks, those of the other block.
        ahead = np.repeat(ends, np.diff(np.append(np.flatnonzero(new), len(t)))) - np.arange(len(t)) - 1
        i = 0
        while i < len(t):
            j = max(i + 1, int(np.searchsorted(np.cumsum(ahead[i:]), PAIRS, "right")) + i)
            a = np.repeat(np.arange(i, j), ahead[i:j])
            b = a + 1 + ragged(ahead[i:j])
            i = j
            cross = (x[a] == y[a]) | (side[a] != side[b])
            a, b = a[cross], b[cross]
            close = np.einsum("ij,ij->i", u[a], u[b]) >= least
            a, b = a[close], b[close]
            # Where two vectors meet: the own cell of one is among the cells of the other. The pair counts in the
            # first table in which they meet, and there in the lesser of the cells in which they do.
            ka, kb = keys[a], keys[b]
            a_in_b, b_in_a = (kb == ka[:, :, :1]).any(2), (ka == kb[:, :, :1]).any(2)
            meet = a_in_b | b_in_a
            first = meet.argmax(1)
            r = np.arange(len(a))
            big = np.iinfo(np.int64).max
            where = np.minimum(np.where(a_in_b[r, first], ka[r, first, 0], big), np.where(b_in_a[r, first], kb[r, first, 0], big))
            ok = meet.any(1) & (where == cell[a])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            p, q = at[: len(a)], at[len(a) :]
            links = np.bincount(p, copies[b], len(rows)) + np.bincount(q, copies[a], len(rows))
            to = vec[rows].copy()
            while True:
                was = to.copy()
                np.minimum.at(to, p, to[q])
                np.minimum.at(to, q, to[p])
                if (to == was).all():
                    break
            yield pa.RecordBatch.from_arrays([pa.array(vec[rows]), pa.array(links.astype(np.int64)), pa.array(to)], names=["vec", "links", "to"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= 20_000:
            t = pa.Table.from_batches(held)
            cell, x, y = (t.column(c).to_numpy() for c in ("cell", "x", "y"))
            # The last pair of blocks may go on; a cell of many goes pair by pair.
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from pairs(t.slice(0, cut))
                held, rows = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
    if rows:
        yield from pairs(pa.Table.from_batches(held))


def vector_classes(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of each row: links to other rows, and the least key reachable by them.

    Rows are compared only if their labels are equal and not null and their vectors equally long; those with a cosine
    of `least` or more in double precision are linked. A vector that is null, empty or zero, or holds a null or a
    number that is not finite, is linked with nothing. Links are found among vectors that share a lattice cell (their
    own, or one they probe) in any table, so a few just above `least` can be missed (see TABLES). Copies (equal labels
    and vectors) are one class, compared once and counted fully. Links are counted for each row, whatever its key: rows
    of one key are linked with each other only if they are alike. For components, rows of one key are one node. A null
    key is a key, the least, and comes back null. Other columns are not read. No rows give no rows.

    A large cell is split into blocks; no pair leaves a task: each vector's links are summed there, each pair in the
    first cell where it meets.
    """
    spark = vectors.sparkSession
    ready(spark)
    none = F.lit(-(1 << 63))
    plain = vectors.select(F.coalesce(F.col(key).cast("long"), none).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("e"))
    read = plain.withColumnRenamed("id", "vec").mapInArrow(_read, "vec long, label long, v binary").withColumnRenamed("vec", "id")
    rows = saved(read.withColumn("s1", F.xxhash64("v", "label")).withColumn("s2", F.xxhash64(F.lit(1), "v", "label")))
    # A class is what has one label and vector; it has a number of its own, so keys may be null or repeated.
    classes = saved(rows.where("v is not null").groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("vec", F.monotonically_increasing_id()))
    placed = saved(classes.select("vec", "label", "v").mapInArrow(_placed, "vec long, keys binary"))
    spread = placed.mapInArrow(_spread, "cell long, vec long, own boolean")
    full = spread.groupBy("cell").agg(F.count("*").alias("n"), F.bool_or("own").alias("any")).where("n > 1 and any").select("cell", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks"))
    met = spread.join(full, "cell").select("cell", "vec", "blocks", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int").alias("side"))
    grid = met.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select("cell", "vec", "side", F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"))
    payload = classes.select("vec", "copies", "v").join(placed, "vec")
    groups = grid.join(payload, "vec").repartition(partitions(spark), "cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    found = saved(groups.mapInArrow(lambda it: _compared(it, least), "vec long, links long, to long"))
    linked = found.groupBy("vec").agg(F.sum("links").alias("links"))
    # Links of a vector are those of its class; components also pass through rows of one key, which are one node.
    numbers = saved(classes.select("s1", "s2", "vec", "copies", "least").join(linked, "vec", "left"))
    comp = components(found.select(F.col("vec").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("vec"), "component")
    named = saved(rows.where("v is not null").select("id", "s1", "s2").join(numbers, ["s1", "s2"]).join(comp, "vec", "left").select("id", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec").alias("part")))
    roots = _least_keys(named)
    out = named.join(roots, "part").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "found")
    # A row that can't be compared has no links, but shares the node of its key.
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"))
    keyed = named.join(roots, "part").groupBy(F.col("id").alias("_id")).agg(F.min("found").alias("found"))
    out = out.unionByName(alone.join(keyed, F.col("id") == F.col("_id"), "left").select("id", "n_links", F.coalesce("found", "id").alias("found")))
    back = lambda c: F.when(F.col(c) != none, F.col(c))
    return out.select(back("id").alias(key), "n_links", back("found").alias("component_id"), (F.col("id") == F.col("found")).alias("kept"))


def _least_keys(named: DataFrame) -> DataFrame:
    """(part, found): the least key that each part of the classes reaches, also through keys that several parts have."""
    least = saved(named.groupBy("part").agg(F.min("id").alias("found"), F.count("*").alias("n")))
    several = saved(named.select("id", "part").distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("part").alias("first")).where("n > 1"))
    if several.isEmpty():
        return least.select("part", "found")
    through = named.select("id", "part").distinct().join(several.select("id", "first"), "id")
    joined = components(through.select(F.col("part").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("part"), "component")
    wide = least.join(joined, "part", "left").withColumn("component", F.coalesce("component", "part"))
    roots = wide.groupBy("component").agg(F.min("found").alias("root"))
    return wide.select("part", "component").join(roots, "component").select("part", F.col("root").alias("found"))


def op6_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_classes(load(spark, sf_dir, "embeddings"))
