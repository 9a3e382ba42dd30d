"""Near-duplicate documents: HyperMinHash registers, bands of them, an estimate, and verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, load, partitions, ready, saved
from .words import give_back, hashed_words, mix, text_slices

#: BANDS bands of ROWS registers: a pair of Jaccard 0.8 shares no band with probability (1 - 0.8**5)**40 = 1e-7.
BANDS, ROWS = 40, 5
#: Bits kept after the leading one of a register's minimum.
MANTISSA = 10
#: Bytes of text, and texts, that are looked at together.
SLICE, TEXTS = 1 << 20, 16_000
#: Turns in which classes try single members of the largest component they meet, before all open pairs are tried.
TURNS = 1
#: Classes of either side that are compared in one group at the end, and shingles that are looked at together there.
BLOCK, COLUMNS = 256, 8192
#: Shingles of either side in such a group, about: fewer classes are compared at once if their texts are long.
WIDE = 2_000_000
_RANDOM = np.random.default_rng(77)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each of at most 65,536 texts, as sorted 64-bit hashes; offsets of the texts among them). A
    text of fewer than `size` words, but some, has its whole word sequence as one shingle."""
    h, rows = hashed_words(data, offsets, lower=True)
    count = np.diff(rows)
    doc = np.repeat(np.arange(len(count), dtype=np.uint16), count)
    x = h.copy()
    for k in range(1, size):
        ahead = np.zeros_like(h)
        ahead[: len(h) - k] = h[k:]
        x = x * np.uint64(0xD6E8FEB86659FD93) + ahead
    x = mix(x + np.uint64(size))
    real = np.ones(len(h), bool)
    for k in range(1, size):
        ends = rows[1:][count >= k] - k
        real[ends] = False
    short = np.flatnonzero((count > 0) & (count < size))
    for i in short:
        real[rows[i]] = True
        v = np.uint64(0)
        for w in h[rows[i] : rows[i + 1]]:
            v = mix(np.array([v ^ w]))[0]
        x[rows[i]] = mix(np.array([v + np.uint64(count[i])]))[0]
    doc, x = doc[real], x[real]
    order = np.argsort(x)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, x = doc[order], x[order]
    new = np.append(True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])) if len(x) else np.zeros(0, bool)
    return x[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(count))))


def registers(e: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of non-empty sets e[rows[i]:rows[i+1]]: for each hash function, the leading
    zeros of the least value and the bits after its leading one."""
    n, k = len(rows) - 1, len(_A)
    low = np.empty((k, n), np.uint64)
    e = mix(e)
    i = 0
    while i < n:  # some thousand elements at a time, so that they stay in the cache
        j = max(i + 1, int(np.searchsorted(rows, rows[i] + 16384, "right")) - 1)
        part, at = e[rows[i] : rows[j]], rows[i:j] - rows[i]
        for q in range(k):
            low[q, i:j] = np.minimum.reduceat(part * _A[q] + _B[q], at)
        i = j
    m, power = np.frexp(low.T.astype(np.float64))
    zeros = (64 - power).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | ((2 * m - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    r = reg.reshape(len(reg), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(reg), BANDS))
    for q in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, q])
    return key


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard from registers: the share of equal ones, less those expected to be equal by chance."""
    chance = 0.7213 / (1 << MANTISSA) * na * nb / (na + nb) ** 2
    return ((a == b).mean(1) - chance) / (1 - chance)


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column(2), SLICE):
            for a in range(i, j, TEXTS):
                b = min(j, a + TEXTS)
                part = data[offsets[a - i] : offsets[b - i]]
                e, rows = shingle_sets(part, offsets[a - i : b - i + 1] - offsets[a - i], size)
                n = np.diff(rows)
                full = np.flatnonzero(n)
                reg = registers(e, np.append(rows[:-1][full], len(e))) if len(full) else np.zeros((0, BANDS * ROWS), np.uint16)
                sums = np.zeros((2, b - a), np.uint64)
                if len(full):
                    for q, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        sums[q, full] = np.add.reduceat(mix(e ^ np.uint64(salt)), rows[:-1][full])
                sketch = [None] * (b - a)
                for x, r in zip(full.tolist(), reg):
                    sketch[x] = r.tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sketch, pa.binary())], names=["doc", "mark", "n", "s1", "s2", "sketch"])
            give_back()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), -1)
        key = band_keys(reg)
        doc = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(doc)], names=["key", "doc"])


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate is not below `least` by more than six standard deviations, and whose sizes allow it."""
    margin = 6 * (least * (1 - least) / (BANDS * ROWS)) ** 0.5
    for batch in batches:
        if not len(batch):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("sa", "sb"))
        na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        ok = (estimated(a, b, na, nb) >= least - margin) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= percent * union, on the sets of both whole texts."""
    expand = zstandard.ZstdDecompressor().decompress

    def judge(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        at = [[seen.setdefault(z, len(seen)) for z in r[2:]] for r in rows]
        texts = [expand(z) for z in seen]
        e, ends = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), size)
        out = []
        for (a, b, *_), (x, y) in zip(rows, at):
            p, q = e[ends[x] : ends[x + 1]], e[ends[y] : ends[y + 1]]
            both = np.sort(np.concatenate([p, q]))
            inter = int((both[1:] == both[:-1]).sum())
            if inter and 100 * inter >= percent * (len(p) + len(q) - inter):
                out.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held, weight = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "za", "zb"))):
            held.append(row)
            weight += len(row[2]) + len(row[3])
            if weight > 2 << 20 or len(held) >= 8000:
                yield judge(held)
                held, weight = [], 0
        give_back()
    if held:
        yield judge(held)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        z = pa.array([squeeze(v.as_buffer()) for v in batch.column(1).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), z], names=["id", "z"])
        give_back()


def _compared(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of (main, kind, i, j, side, id, comp, z), sorted by the first four -> links between different components:
    of each row of side 0, one to each component of the other rows of its group."""
    expand = zstandard.ZstdDecompressor().decompress

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        sets = [shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), size)[0] for t in (expand(r[7]) for r in rows)]
        e, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        doc, comp, side = (np.array([r[c] for r in rows], np.int64) for c in (5, 6, 4))
        x = np.flatnonzero(side == 0)
        y = x if rows[0][1] else np.flatnonzero(side == 1)
        # Shingles that one row alone has can't be common; the others are columns, some thousand at a time.
        order = np.argsort(e, kind="stable")
        new = np.append(True, e[order][1:] != e[order][:-1]) if len(e) else np.zeros(0, bool)
        col = np.empty(len(e), np.int64)
        col[order] = np.cumsum(new) - 1
        n = np.diff(ends)
        row = np.repeat(np.arange(len(rows)), n)
        often = np.bincount(col)[col] > 1 if len(e) else np.zeros(0, bool)
        names, col = np.unique(col[often], return_inverse=True)
        row, inter = row[often], np.zeros((len(x), len(y)), np.float32)
        for c in range(0, len(names), COLUMNS):
            here = (col >= c) & (col < c + COLUMNS)
            m = np.zeros((len(rows), min(COLUMNS, len(names) - c)), np.float32)
            m[row[here], col[here] - c] = 1
            inter += m[x] @ m[y].T
        union = n[x][:, None] + n[y] - inter
        p, q = np.nonzero((100 * inter >= percent * union) & (comp[x][:, None] != comp[y]))
        _, one = np.unique(np.stack([x[p], comp[y[q]]], 1), axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(doc[x[p[one]]]), pa.array(doc[y[q[one]]])], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if held and r[:4] != held[0][:4]:
                yield judge(held)
                held = []
            held.append(r)
        give_back()
    if held:
        yield judge(held)


def _settled(there: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between the classes that share a bucket and are in different components still. there: (main, id, n, comp),
    where main is the largest component of a bucket of the class.

    For each main, the classes outside of it are compared with those in it and with each other, on full sets, in blocks
    of about BLOCK by BLOCK at most, fewer if texts are long: no pair is a row, only what is found leaves a task.
    """
    out = F.col("comp") != F.col("main")
    blocks = lambda cond: F.greatest(F.ceil(F.count_if(cond) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) / WIDE), F.lit(1)).cast("int")
    sizes = there.groupBy("main").agg(F.count_if(out).alias("nx"), blocks(out).alias("bx"), blocks(~out).alias("by")).where("nx > 0").drop("nx")
    rows = there.join(sizes, "main").withColumn("side", F.when(out, 0).otherwise(1))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("bx")).otherwise(F.col("by"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = lambda kind, i, j: [F.col("main"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.col("side"), F.col("id"), F.col("comp")]
    x = rows.where("side = 0")
    cells = x.withColumn("o", upto("by")).select(*key(0, F.col("own"), F.col("o")))
    cells = cells.unionByName(rows.where("side = 1").withColumn("o", upto("bx")).select(*key(0, F.col("o"), F.col("own"))))
    cells = cells.unionByName(x.withColumn("o", upto("bx")).select(*key(1, F.least("own", "o"), F.greatest("own", "o"))))
    names = ["main", "kind", "i", "j"]
    met = cells.join(texts, "id").select(*names, "side", "id", "comp", "z").repartition(partitions(texts.sparkSession), *names).sortWithinPartitions(*names)
    return saved(met.mapInArrow(lambda it: _compared(it, shingle, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: component_id is the least key reachable by links.

    Words are runs of bytes that are not ASCII white space, with A-Z as a-z; a row's set is its distinct shingles of
    `shingle` words (the whole sequence, if it has fewer words), as 64-bit hashes. Rows are linked if 100 *
    intersection >= percent * union. Null, empty and blank texts have empty sets and are linked with nothing. Rows with
    equal sets are one class and are linked. Rows with the same key are one node, whatever their texts; null keys are
    one node, of the least key, and come back null. kept is whether the row has its component's key. Other columns are
    not read. No rows give no rows.

    Copies meet by the size of their set and two 64-bit sums over it, so only one row of a class is banded. In each
    bucket every class is paired with the bucket's least, and of those each class tries the one it meets most often.
    Then, TURNS times, each class outside of the largest component of a bucket tries members of that one, others in each
    turn. Each try is an estimate, then full sets. What is still open between components that share a bucket is settled
    on full sets in blocks, where no pair is a row; a bucket's largest component is not compared with itself.
    """
    spark = docs.sparkSession
    ready(spark)
    none = F.lit(-(1 << 63))
    text_of = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.coalesce(F.col(key).cast("long"), none).alias("doc"), F.xxhash64(text_of).alias("mark"), text_of.alias("text"))
    sketches = saved(plain.mapInArrow(lambda it: _sketched(it, shingle), "doc long, mark long, n long, s1 long, s2 long, sketch binary"))
    same = ["s1", "s2", "n"]
    # Classes are numbered as they are written; the numbers stay as they are read again.
    classes = saved(sketches.where("n > 0").groupBy(*same).agg(F.min(F.struct("doc", "mark")).alias("r")).select(*same, "r.doc", "r.mark", F.monotonically_increasing_id().alias("id")))
    single = saved(sketches.join(classes, [*same, "doc", "mark"]).select("id", "doc", "mark", "n", "sketch").dropDuplicates(["id"]))

    banded = single.select("id", "sketch").mapInArrow(_banded, "key long, id long")
    shared = banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("least")).where("c > 1")
    buckets = saved(banded.join(shared.select("key", "least"), "key"))
    members = single.select("id", "doc", "mark").join(buckets.select("id").distinct(), "id", "left_semi")
    texts = saved(plain.join(members, ["doc", "mark"]).select("id", "text").mapInArrow(_packed, "id long, z binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        known = lambda c: single.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        kinds = "a long, b long"
        likely = saved(pairs.join(known("a"), "a").join(known("b"), "b").mapInArrow(lambda it: _likely(it, percent / 100), kinds))
        full = lambda c: texts.select(F.col("id").alias(c), F.col("z").alias(f"z{c}"))
        both = likely.join(full("a"), "a").join(full("b"), "b")
        return saved(both.mapInArrow(lambda it: _verified(it, shingle, percent), kinds))

    # Rows of one key are one node: their classes are linked.
    of = saved(sketches.where("n > 0").select("doc", *same).join(classes.select(*same, "id"), same).select("doc", "id").distinct())
    several = of.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc", "a")
    met = buckets.where("id <> least").groupBy("id", "least").agg(F.count("*").alias("c"))
    tried = saved(met.groupBy("id").agg(F.max_by("least", F.struct(F.col("c"), -F.col("least"))).alias("b")).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")))
    links = saved(linked(tried).union(of.join(several, "doc").where("a <> id").select("a", "id")))
    for turn in range(TURNS + 1):
        comp = saved(components(links))
        there = buckets.select("key", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        mixed = there.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        there = saved(there.join(mixed, "key"))
        by_turn = F.struct(F.xxhash64(F.lit(turn), "id"), F.col("id"))
        parts = there.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by("id", by_turn).alias("face"))
        largest = parts.groupBy("key").agg(F.max_by(F.struct("comp", "face"), F.struct(F.col("c"), F.col("comp"))).alias("main"))
        there = there.join(largest.select("key", F.col("main.comp").alias("main"), F.col("main.face").alias("face")), "key")
        if turn == TURNS:
            there = saved(there.select("main", "id", "comp").distinct().join(single.select("id", "n"), "id"))
            links = saved(links.union(_settled(there, texts, shingle, percent)))
            break
        faces = there.where("comp <> main").groupBy(F.col("id").alias("x"), "face").agg(F.count("*").alias("c"))
        rank = F.row_number().over(Window.partitionBy("x").orderBy(F.col("c").desc(), "face"))
        pairs = faces.withColumn("r", rank).where("r <= 2").select(F.least("x", "face").alias("a"), F.greatest("x", "face").alias("b")).distinct()
        pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"))
        tried, links = saved(tried.union(pairs)), saved(links.union(linked(pairs)))

    comp = saved(components(links))
    known = saved(classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select(*same, "doc", F.coalesce("component", "id").alias("root")))
    least = known.groupBy("root").agg(F.min("doc").alias("found"))
    known = saved(known.join(least, "root").select(*same, "found"))
    rows = sketches.select("doc", *same)
    found = rows.where("n > 0").join(known, same).select("doc", "n", "found")
    # A text without words has its key's component too.
    empty = rows.where("n = 0").select("doc", "n").join(found.select("doc", "found").distinct(), "doc", "left").select("doc", "n", F.coalesce("found", "doc").alias("found"))
    found = found.unionByName(empty)
    back = lambda c: F.when(F.col(c) != none, F.col(c))
    return found.select(back("doc").alias(key), F.col("n").alias("n_shingles"), back("found").alias("component_id"), (F.col("doc") == F.col("found")).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=2)
