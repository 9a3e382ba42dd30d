"""Line dedup, the Merkle manifest and hard negatives against plain versions, and their edge cases."""

import hashlib
import random
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import lines, merkle, negatives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# 12 ---------------------------------------------------------------------------------------------------------------


def plain_lines(docs, least_docs=3, least_chars=20):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text), one line after another."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    first = -(1 << 63)
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(first if i is None else i)
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == (first if i is None else i)]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def text_rows(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def some_lines(seed, n=80):
    r = random.Random(seed)
    pool = ["a line of many words, number %d" % i for i in range(12)] + ["Ünïcödé líne of letters", "short", "", "nineteen characters", "x" * 20, "\tA LINE of many words, number 3 \v"]
    return [(i, r.choice([None, ""]) if r.random() < 0.08 else "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(n)]


@pytest.mark.parametrize("held", [1 << 16, 7])
def test_line_dedup(spark, held):
    """held: keys of more rows than a task holds are counted over all tasks."""
    docs = some_lines(1) + [(500 + i, "one line that a third of all documents hold\nown %d" % i) for i in range(120)]
    got = sorted(map(tuple, lines.dedup_lines(text_rows(spark, docs), held_rows=held).collect()), key=repr)
    assert got == plain_lines(docs)


def test_line_dedup_with_odd_keys(spark):
    """Null and repeated keys, equal rows, ties, very long texts, clashing columns."""
    line = "the very same line, again and again"
    long = "\n".join(f"line number {i} of the long text" for i in range(60_000))
    docs = [(None, line), (None, line + "\nother"), (1, line), (1, line), (1, line + "\n" + line), (2, f"{line}\nz\n{line}"), (-5, line), (9, long), (8, long), (7, long + "\nx"), (3, None), (4, "")]
    got = sorted(map(tuple, lines.dedup_lines(text_rows(spark, docs).withColumn("mark", F.lit(1)).withColumn("keep", F.lit("k")).withColumn("doc", F.lit(0))).collect()), key=repr)
    assert got == plain_lines(docs)
    assert lines.dedup_lines(text_rows(spark, [])).collect() == []


def test_bitmaps_are_short_and_whole():
    r = random.Random(3)
    for n in (1, 5, 400, 70_000):
        gone = np.array(sorted(r.sample(range(n), r.randrange(n))), np.int64)
        want = np.ones(n, bool)
        want[gone] = False
        assert (lines.kept_lines(lines.packed(gone), n) == want).all()
    assert len(lines.packed(np.arange(1, 60_000))) == 4 and lines.kept_lines(None, 3).all()


def test_line_bitmaps_hold_no_text(spark):
    docs = [(i, "own text %d\na line that all of them have" % i) for i in range(5)]
    got = lines.line_bitmaps(text_rows(spark, docs)).collect()
    assert {(r.doc, r.n_dropped, bytes(r.keep)) for r in got} == {(i, 1, b"\x01\x01") for i in range(4)}


# 13 ---------------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def plain_tree(level, run=8):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + run]) for i in range(0, len(levels[-1]), run)])
    return levels


def plain_manifest(docs, tampered):
    """Rows as op13 gives them, by a whole tree for each language."""
    by = defaultdict(list)
    for d in docs:
        by[d[2]].append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
        trees[g] = plain_tree([leaf_of(d) for d in by[g]])
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for o, g in enumerate(langs):
        for i, d in enumerate(by[g]):
            siblings, x = [], leaf_of(tampered(d))
            for levels, k in ((trees[g], i), (top, o)):
                for level in levels[:-1]:
                    run = level[k - k % 8 : k - k % 8 + 8]
                    siblings += run[: k % 8] + run[k % 8 + 1 :]
                    x = digest(*run[: k % 8], x, *run[k % 8 + 1 :])
                    k //= 8
            out.append((d[0], leaf_of(d), trees[g][-1][0], top[-1][0], digest(*siblings), x, x == top[-1][0]))
    return sorted(out, key=repr), trees, top


def lowered(d):
    if d[0] is None or zlib.crc32(str(d[0]).encode()) % 3:
        return d
    return (d[0], d[1] and d[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), *d[2:])


def manifest_rows(spark, docs, deep=4):
    """op13's rows for these documents, which have columns of the operator's own names."""
    rows = spark.createDataFrame(docs, SCHEMA + ", key long, idx long")
    return sorted(map(tuple, merkle.tampered_manifest(rows, deep).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 65, None: 9, "ß": 1}, {"en": 1}, {"en": 8, "de": 1}, {}])
def test_merkle_manifest(spark, sizes):
    """Blocks of 8 or 64 nodes, so that trees of these sizes have several layers of blocks."""
    r = random.Random(5)
    docs = [(r.randrange(10**6), r.choice(["Some Text", "no capitals", None, "", "Ünï Ö"]) , g, r.choice(["a", None]), r.choice([3, None]), 1, 2) for g, n in sizes.items() for _ in range(n)]
    want, trees, top = plain_manifest(docs, lowered)
    for deep in (1, 2, 4):
        assert manifest_rows(spark, docs, deep) == want


def test_merkle_with_odd_keys(spark):
    """Null and repeated keys, equal rows, very long texts."""
    docs = [(None, "A", "en", "s", 1, 0, 0), (None, "B", "en", "s", 1, 0, 0), (7, "C", "en", "s", 1, 0, 0), (7, "C", "en", "s", 1, 0, 0), (7, "D", "en", None, None, 0, 0), (6, "L" * 3_000_000, "en", "s", 1, 0, 0), (5, "x", None, "s", 1, 0, 0)]
    assert manifest_rows(spark, docs) == plain_manifest(docs, lowered)[0]


def test_merkle_nodes_and_versions(spark):
    docs = [(i, f"Text {i}", "en" if i % 3 else None, "s", 5) for i in range(100)]
    _, trees, top = plain_manifest(docs, lowered)
    m = merkle.Manifest(spark.createDataFrame(docs, SCHEMA), changed={"text": F.lit("changed")}, when=F.col("doc_id") == 50, deep=1)
    got = {(r.upper, r.group, r.level, r.idx): r.digest for r in m.nodes().collect()}
    want = {(False, g, lv, i): d for g, t in trees.items() for lv, level in enumerate(t) for i, d in enumerate(level)}
    assert got == want | {(True, None, lv, i): d for lv, level in enumerate(top) for i, d in enumerate(level)}
    changed = [(*d[:1], "changed", *d[2:]) if d[0] == 50 else d for d in docs]
    made = {r.doc_id: r for r in m.proofs().collect()}
    assert made[50].version[-1] == plain_manifest(changed, lambda d: d)[2][-1][0]  # the root of a tree built with it
    assert all(r.version[-1] == r.root for i, r in made.items() if i != 50)
    assert len(made[50].version) == len(made[50].siblings) // 2 + 1


# 11 ---------------------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50):
    """(anchor, positive, rank, negative, scores) of (id, label, vector), one anchor after another."""
    ok = [(i, g, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, g, v in rows if i is not None and g is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, (i, g, v) in enumerate(ok):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, h) for m, (j, h, w) in enumerate(ok) if m != n and len(w) == len(v)]
        for s, j, *_ in sorted(x for x in scored if x[3] == g)[:5]:
            near = sorted(x for x in scored if x[3] != g and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(near)]
    return sorted(out)


def mined(spark, rows, every=50, **more):
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    return sorted(map(tuple, negatives.hard_negatives(df.withColumn("row", F.lit("x")).withColumn("v", F.lit(1)), F.col("id") % every == 0, **more).collect()))


def vectors(seed, n, dim=16, spread=0.6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    return [(i, int(r.integers(0, 4)), (centres[r.integers(0, 8)] + spread * r.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [512, 16])
def test_hard_negatives(spark, block):
    """Small blocks: many tasks, in which thresholds come from earlier blocks."""
    rows = vectors(2, 900)
    want = plain_negatives(rows, 10)
    assert len(want) > 800 and mined(spark, rows, 10, block=block, slice_blocks=64 if block == 512 else 3) == want


def test_hard_negatives_with_odd_rows(spark):
    """Nulls, numbers that are not finite, zero and empty vectors, several lengths, ties, repeated rows and keys."""
    rows = vectors(3, 60, 4) + [(100 + i, i % 3, [1.0, 2.0, -0.001, 0.5]) for i in range(40)] + [(0, 1, [1.0, 2.0, 0.0, 0.5])] * 3
    rows += [(None, 1, [1.0] * 4), (50, None, [1.0] * 4), (150, 1, None), (200, 1, [1.0, None, 0.0, 1.0]), (250, 2, [float("nan")] * 4), (300, 2, [float("inf"), 0.0, 0.0, 0.0]), (350, 0, [0.0] * 4)]
    rows += [(400, 1, []), (401, 1, []), (402, 2, []), (450, 1, [1.0, 1.0]), (451, 1, [2.0, 1.0]), (452, 2, [1.0, 1.0]), (-50, 2, [3.0, 1.0])]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_bounds_hold():
    """No pair within the wanted scores is ruled out, and most others are."""
    r = np.random.default_rng(4)
    block = lambda x: negatives.Block(np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64), x, *negatives.summaries(x), None)
    base = r.integers(-300, 300, (6, 64))
    make = lambda n: (base[r.integers(0, 6, n)] + r.integers(-40, 40, (n, 64))).astype(np.int32)
    a, b = make(40), make(300)
    score = a.astype(np.int64) @ b.astype(np.int64).T
    low, high = np.quantile(score, 0.9, axis=1), np.quantile(score, 0.97, axis=1)
    i, j, s = negatives.survivors(block(a), block(b), np.ones(score.shape, bool), low, high)
    assert (score[i, j] == s).all()
    left = np.zeros(score.shape, bool)
    left[i, j] = True
    assert left[(score >= low[:, None]) & (score <= high[:, None])].all() and left.mean() < 0.5
    known = np.sort(score[:, :150], 1)[:, -5].astype(float)  # the fifth best of the blocks before
    i, j, _ = negatives.survivors(block(a), block(b[150:]), np.ones((40, 150), bool), known, np.full(40, np.inf), 5)
    left = np.zeros((40, 150), bool)
    left[i, j] = True
    assert left[score[:, 150:] >= known[:, None]].all() and left.mean() < 0.3
