"""Each numbered operator against a plain version, and its edge cases: nulls, empties, long texts, ties, repeats, no
rows, clashing columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import common, fingerprints, lattice, licenses, minhash, mixing, packing, quality, sharding, stages, substrings, toxicity

WS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n=60):
    """Documents of few words with copies, near copies, shared passages, odd white space, nulls and empties."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "the", "of", "ﬁn", "a a"]
    passage = " ".join(r.choice(words) for _ in range(45))
    docs = []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0 and docs:
            t = r.choice(docs)[1]
        elif kind == 1 and docs and (t := r.choice(docs)[1]):
            w = t.split(" ")
            w[r.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind == 2:
            t = " ".join(r.choice(words) for _ in range(r.randrange(1, 30))) + "\n" + passage + "\t" + r.choice(words)
        elif kind == 3:
            t = r.choice([None, "", " \n", "one", "x " * 50])
        else:
            t = r.choice([" ", "\n"]).join(r.choice(words) for _ in range(r.randrange(1, 90)))
        docs.append((i * 3, t, "en", r.choice(["a", "b", "c", None]), len(t or "")))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA)


def words(t, lower=False):
    b = (t or "").encode()
    return WS.findall(bytes(c + 32 if lower and 65 <= c <= 90 else c for c in b))


def canon(t):
    t = unicodedata.normalize("NFKC", t or "").upper().lower()
    return re.sub(r"[\x09-\x0d\x1c-\x20\x85  ]+", " ", t).strip(" ")


# 1 ----------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    docs = corpus(1) + [(500, "École  ÅB", "fr", "a", 9), (501, "École Åb", "fr", "a", 9)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    groups, prints = defaultdict(list), {}
    for k, (i, t, *_) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
        groups[canon(t)].append(i)
        assert prints.setdefault(canon(t), r.fingerprint) == r.fingerprint and len(r.fingerprint) == 32
    assert len(set(prints.values())) == len(prints)
    assert all(got[i].group_id == min(g) for g in groups.values() for i in g)


def test_canonical_is_nfkc(spark):
    """Every character by itself and decomposed, Hangul letters, marks in any order, all planes."""
    r = random.Random(2)
    ok = lambda n: not 0xD800 <= n < 0xE000 and unicodedata.category(chr(n)) != "Cn"
    texts = [chr(n) for n in range(0x80, 0x30000, 7) if ok(n)]
    texts += [unicodedata.normalize("NFD", chr(n)) for n in [*range(0xC0, 0x3000), *range(0xAC00, 0xD7A4, 97)] if ok(n)]
    texts += ["\u1100\u1161", "\u1112\u1175\u11c2", "\uac00\u11a8", "\u1161", "\u00ea\u0323", "e\u0302\u0323", "a\u0327\u0301\u0328", "q\u0307\u0323", "\U0001d400\U0001d41a", "\u0bc6\u0bbe", "\ufb01x\u0301", "\u0301 a", "a\u0301\u0301", "\u0344"]
    marks = [chr(n) for n in range(0x300, 0x370)]
    texts += ["".join(r.choice("aeiouqcsZ \u00ea\u1ea1\uac00") + "".join(r.choice(marks) for _ in range(r.randrange(4))) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.c for x in df.select("i", fingerprints.canonical(F.col("t")).alias("c")).collect()}
    fold = {x.i: x.c for x in spark.createDataFrame([(i, unicodedata.normalize("NFKC", t)) for i, t in enumerate(texts)], "i int, t string").select("i", F.trim(F.regexp_replace(F.lower(F.upper("t")), r"[\x09-\x0D\x1C-\x20\x{85}\x{2028}\x{2029}]+", " ")).alias("c")).collect()}
    wrong = [(texts[i], got[i], fold[i]) for i in got if got[i] != fold[i]]
    assert not wrong, (len(wrong), wrong[:5])


def test_fingerprints_of_hot_keys(spark):
    docs = [(None, f"text {i % 90}", None, None, 0) for i in range(200)] + [(4, f"other {i}", None, None, 0) for i in range(100)] + [(5, "x y" * 9000, None, None, 0)]
    df = frame(spark, docs).withColumn("fingerprint", F.lit("clash"))
    got = fingerprints.fingerprints(df).collect()
    assert len(got) == 301 and Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)
    unique = frame(spark, [(d[0], f"{d[1]} {i}", None, None, 0) for i, d in enumerate(docs)])
    key_of = {f"{d[1]} {i}": d[0] for i, d in enumerate(docs)}
    rows = fingerprints.over_next(unique, ["text"], {"text": F.col("text"), "after": F.col("next_text")}).collect()
    after = {r.text: r.after for r in rows}
    assert sorted(after) == sorted(after.values()) and len(rows) == 301
    steps, at = [], rows[0].text
    for _ in rows:  # one ring through all rows, in which each key's rows stand together
        steps.append(key_of[at])
        at = after[at]
    assert at == rows[0].text and sum(a != b for a, b in zip(steps, steps[1:] + steps[:1])) == 3


def test_fingerprints_edges(spark):
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.fingerprints(frame(spark, [(4, "abcdefgh", "en", "a", 8)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    rows = fingerprints.fingerprints(frame(spark, [(None, "x", None, None, None), (1, "x", "e", "s", 1), (1, "x", "e", "s", 1)])).collect()
    assert len(rows) == 3 and {r.fingerprint for r in rows} == {rows[0].fingerprint}


# 2 ----------------------------------------------------------------------------------------------------------------


def brute_repeats(docs, size):
    seen, out = set(), {}
    for i, t in sorted((d[0], d[1]) for d in docs):
        w = words(t)
        cover = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                cover[k : k + size] = [True] * size
            seen.add(key)
        kept = [x for x, c in zip(w, cover) if not c]
        out[i] = (len(w), sum(cover), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode())
    return out


@pytest.mark.parametrize("size", [20, 5])
def test_remove_repeats(spark, size):
    docs = corpus(2, 90)
    want = brute_repeats(docs, size)
    got = substrings.remove_repeats(frame(spark, docs), window=size).collect()
    assert len(got) == len(docs)
    for r in got:
        n, gone, sha, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha)
        assert r.text == (kept if gone else next(d[1] for d in docs if d[0] == r.doc_id))


@pytest.mark.parametrize("often,held,piece", [(1, 50_000, 200_000), (3, 50, 30), (32, 20, 200_000), (10**9, 10**9, 25)])
def test_remove_repeats_of_frequent_symbols(spark, often, held, piece):
    """Frequent symbols, long texts in pieces: the same results whatever the bounds."""
    r = random.Random(often)
    phrase = " ".join(f"p{i}" for i in range(12))
    docs = corpus(12, 40)
    for i in range(60):  # a phrase shorter than a window, in other surroundings each time; some of them repeat
        around = [f"a{r.randrange(3)}" for _ in range(14)]
        docs.append((1000 + i, " ".join([*around[:7], phrase, *around[7:], phrase, "end"]), "en", "a", 0))
    docs.append((2000, " ".join(d[1] or "" for d in docs[::3]), "en", "a", 0))
    want = brute_repeats(docs, 20)
    was = substrings.OFTEN, substrings.HELD, substrings.PIECE
    try:
        substrings.OFTEN, substrings.HELD, substrings.PIECE = often, held, piece
        plain = [(d[0], 0, d[1]) for d in sorted(docs)]
        import pyarrow as pa

        def batch(rows, n):
            t = pa.table({"doc": pa.array([x[0] for x in rows], pa.int64()), "mark": pa.array([x[1] for x in rows], pa.int64()), "text": pa.array([x[2] for x in rows], pa.string())})
            return t.to_batches(max_chunksize=n)

        sent = pa.Table.from_batches(substrings._sent(iter(batch(plain, 25)), 20)).sort_by([("key", "ascending"), ("kind", "ascending")])
        judged = pa.Table.from_batches(substrings._judged(iter(sent.to_batches(max_chunksize=17))), sent.schema)
        apart = judged.filter(pa.compute.equal(judged["kind"], substrings.APART)).sort_by([(c, "ascending") for c in ("key", "payload", "doc", "at")])
        known = [judged.filter(pa.compute.equal(judged["kind"], substrings.KNOWN)), *([pa.Table.from_batches(substrings._later(iter(apart.to_batches(max_chunksize=5))), sent.schema)] if len(apart) else [])]
        gone = defaultdict(set)
        for t in known:
            for d, p in zip(t["doc"].to_pylist(), t["payload"].to_pylist()):
                for s in np.frombuffer(p, np.uint32):
                    gone[d] |= set(range(s, s + 20))
        assert {d: len(gone[d]) for d in want} == {d: x[1] for d, x in want.items()}
    finally:
        substrings.OFTEN, substrings.HELD, substrings.PIECE = was


def test_parse_is_local(spark):
    """A window's symbols are the same wherever it stands."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        window = rng.integers(0, 3, 20).astype(np.uint64)
        seen = set()
        for _ in range(3):
            a, b = rng.integers(0, 3, rng.integers(0, 9)), rng.integers(0, 3, rng.integers(0, 9))
            h = np.concatenate([a, window, b]).astype(np.uint64)
            at, w, key, sym = substrings.anchors(h, np.array([0, len(h)]), 20)
            k = np.flatnonzero(at == len(a))[0]
            seen.add((int(w[k]), int(key[k]), int(sym[k] - at[k])))
        assert len(seen) == 1


@pytest.mark.parametrize("n", [19, 20, 21, 27, 35, 36])
def test_remove_repeats_of_few_words(spark, n):
    t = " ".join(map(str, range(n)))
    got = substrings.remove_repeats(frame(spark, [(1, t, None, None, 0), (2, t, None, None, 0)])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, n if n >= 20 else 0]


def test_remove_repeats_edges(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    long = " ".join(map(str, range(30_000)))
    docs = [(None, long, None, None, 1), (7, long, None, None, 1), (7, long, None, None, 1), (9, None, None, None, 1)]
    df = frame(spark, docs).withColumn("n_words", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.text is None) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 30_000, 0, False), (7, 30_000, 30_000, False), (7, 30_000, 30_000, False), (9, 0, 0, True)]


# 3 ----------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = corpus(3, 40) + [(900, "<|endoftext|> it's 'll  x\n\n y", "en", "a", 1), (901, "häß " * 1500, "de", "b", 1)]
    rows = packing.pack(frame(spark, docs), with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for i, text, *_ in docs:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        for r in own:
            assert r.doc_tokens == len(ids) and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_packing_edges(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.binary_pieces(2 * 1024 + 5) == [(0, 1024), (1024, 1024), (2048, 4), (2052, 1)]
    got = packing.pack(frame(spark, [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)])).collect()
    assert [(r.length, r.doc_tokens) for r in got] == [(1, 1)] * 3


# 4 ----------------------------------------------------------------------------------------------------------------


def brute_near(docs, size, percent=80):
    sets, parent = {}, {}
    for i, t, *_ in docs:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    docs = corpus(4, 120)
    want = brute_near(docs, size)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, docs), shingle=size).collect()}
    assert got == want


def test_near_duplicates_of_a_drifting_group(spark):
    """Each text differs a little from the one before, so that links form chains in one large group."""
    r = random.Random(9)
    w, docs = [f"t{r.randrange(300)}" for _ in range(60)], []
    for i in range(150):
        docs.append((i, " ".join(w), "en", "a", 0))
        if r.random() < 0.8:
            w[r.randrange(60)] = f"n{i}"
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(frame(spark, docs), shingle=2).collect()}
    assert got == brute_near(docs, 2)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    docs = [(None, "a b c", None, None, 1), (5, "A b  c", None, None, 1), (5, "A b  c", None, None, 1), (6, None, None, None, 1), (7, " ", None, None, 1), (8, "z", None, None, 1)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in minhash.near_duplicates(frame(spark, docs).withColumn("kept", F.lit(1)), shingle=2).collect())
    assert got == [(-1, 2, -1, True), (5, 2, -1, False), (5, 2, -1, False), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True)]


def test_near_duplicates_of_repeated_keys(spark):
    """Rows of one key are one node, so their links count together."""
    w, z, more = "one two three four five six seven eight nine ten", "red green blue black white grey pink brown teal gold", " x"
    docs = [(5, w), (5, z), (1, w + more), (2, z + more), (5, ""), (9, None)]
    got = minhash.near_duplicates(frame(spark, [(i, t, None, None, 0) for i, t in docs]), shingle=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (5, 1, False), (9, 9, True)]


def test_near_duplicates_of_long_texts(spark):
    r = random.Random(8)
    long = [f"t{r.randrange(5000)}" for _ in range(30_000)]
    docs = [(3, " ".join(long)), (4, " ".join(long[:28_000])), (5, " ".join(long[:15_000]))]
    df = frame(spark, [(i, t, None, None, 0) for i, t in docs])
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == {3: 3, 4: 3, 5: 5}


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 50, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 1 << 50, 400, dtype=np.uint64)])
    reg = minhash.registers(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    n = np.array([2000.0])
    assert abs(minhash.estimated(reg[:1], reg[1:], n, n)[0] - 1600 / 2400) < 0.12
    c = minhash.registers(rng.integers(0, 1 << 50, 2000, dtype=np.uint64), np.array([0, 2000]))
    assert abs(minhash.estimated(reg[:1], c, n, n)[0]) < 0.03


# 5 ----------------------------------------------------------------------------------------------------------------


def test_license_scan_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    mit = licenses.TEXTS[0][1]
    wrapped = "\n * ".join(mit[i : i + 60] for i in range(0, len(mit), 60)).replace("EXPRESS OR", "EITHER EXPRESS OR")
    long = ["word"] * 20_000
    texts = ["x\nLicensed  under the APACHE license, version 2.0!\nReleased under the MIT License.", "Copyright 2020 Foo. Released under the\nMIT License. See LICENSE.", "nothing here", "", None, "All rights reserved.",
             mit, f"/* {wrapped} */ code", " ".join([*long, licenses.TEXTS[4][1], *long]), licenses.TEXTS[3][1], licenses._gnu("", "3"), "of the " * 300, "rights", mit[: len(mit) // 3]]
    docs = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    df = frame(spark, docs).withColumn("license", F.lit("clash"))
    got = sorted(map(tuple, licenses.license_scan(df).collect()))
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    assert got == sorted(c.execute(licenses.oracle()).fetchall())
    named = {g[0]: g[3] for g in got}
    assert named == {0: "Apache-2.0", 1: "MIT", 2: None, 3: None, 4: None, 5: "Proprietary", 6: "MIT", 7: "MIT", 8: "Apache-2.0", 9: "BSD-3-Clause", 10: "GPL-3.0-or-later", 11: None, 12: None, 13: None}
    assert got[0][2] == "Apache-2.0,MIT" and got[8][5] == 20_000
    assert licenses.license_scan(frame(spark, [])).count() == 0


# 6 ----------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base, data = rng.normal(size=(8, 64)), []
    for i in range(400):
        v = base[i % 8] + rng.normal(size=64) * rng.choice([0.05, 0.25, 0.4, 3.0])
        data.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    data += [(1000 + i, data[5][1], data[5][2]) for i in range(30)]  # copies
    data += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] + [1.0] * 63, 1), (2003, [None] + [1.0] * 63, 1), (2004, data[5][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in lattice.vector_classes(df).collect()}
    ok = {i: (np.array(v, float), lab) for i, v, lab in data if v and None not in v and lab is not None and np.isfinite(v).all() and any(v)}
    links = {i: [j for j, (w, m) in ok.items() if j != i and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, (v, lab) in ok.items()}
    total, found = sum(map(len, links.values())), sum(got[i].n_links for i in ok)
    assert 0.99 * total <= found <= total and all(got[i].n_links <= len(x) for i, x in links.items())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(2000, 2006))
    assert (got[2006].n_links, got[2007].component_id) == (1, 2006)
    assert got[1029].component_id == got[5].component_id and len(got) == len(data)
    assert lattice.vector_classes(df.where("false")).count() == 0


def test_blocks_of_a_hot_cell_are_compared_pair_by_pair():
    import pyarrow as pa

    keys = np.full((lattice.TABLES, 1 + lattice.PROBES), 7, np.int64).tobytes()
    taken = []

    def batches():
        for y in range(300):  # one cell, 300 pairs of blocks of 200 rows
            n = 200
            taken.append(y)
            side = np.where(np.arange(n) < n // 2, 0, y).astype(np.int32)
            cols = [np.full(n, 7), np.zeros(n, np.int32), np.full(n, y, np.int32), side, np.arange(n) + n * y, np.ones(n, np.int64)]
            more = [pa.array([np.array([1.0, i]).tobytes() for i in range(n)], pa.binary()), pa.array([keys] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *more], names=["cell", "x", "y", "side", "vec", "copies", "v", "keys"])

    found = lattice._compared(batches(), 0.9)
    first = next(found)
    assert len(taken) <= 101  # as many as fill the buffer, not the whole cell
    assert {int(v) // 200 for b in [first, *found] for v in b.column(0).to_pylist()} == set(range(300))


def test_e8_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    p, d = lattice.e8_points(x)
    p = p / 2
    assert np.allclose(((p - x[:, None]) ** 2).sum(2), d) and (np.diff(d, axis=1) >= 0).all()
    s = p.sum(2)
    assert (s % 2 == 0).all() and ((p % 1 == 0).all(2) | (p % 1 == 0.5).all(2)).all()
    roots = [r for r in np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T if (r**2).sum() == 2]
    halves = [h for h in np.array(np.meshgrid(*[[-0.5, 0.5]] * 8)).reshape(8, -1).T if h.sum() % 2 == 0]
    for r in [*roots, *halves]:  # no neighbour of the first point is nearer
        assert (((p[:, 0] + r - x) ** 2).sum(1) >= d[:, 0] - 1e-9).all()


# 7 ----------------------------------------------------------------------------------------------------------------


def test_hilbert_shards(spark):
    docs = corpus(7, 203)
    rows = frame(spark, docs).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), "source", "lang")
    got = sharding.hilbert_shards(rows, 16, "size", ["source", "lang"], "doc_id").collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 203 and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert sharding.hilbert_shards(rows.where("false"), 16, "size", ["source"], "doc_id").count() == 0


def test_hilbert_shards_keep_copies_together(spark, tmp_path):
    docs = [(i, t, lang, s, 0) for i, t, lang, s, _ in corpus(17, 150)] + [(1000 + i, "one text of all", None, random.Random(i).choice(["a", None, "z"]), 0) for i in range(70)]
    docs += [(None, "no key", "en", "a", 0)] * 3 + [(5000, "x" * 100_000, "en", "a", 0), (5001, "y" * 60_000, "en", "a", 0)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op7_hilbert_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    text = {d[0]: (d[1] or "").encode() for d in docs}
    assert all((r["size"], r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in got)
    order = [text[r.doc_id] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    runs_ = 1 + sum(a != b for a, b in zip(order, order[1:]))
    assert runs_ == len(set(text.values()))  # copies follow each other; a group is cut only where a shard ends
    assert next(r.curve for r in got if r.doc_id == 5000) != next(r.curve for r in got if r.doc_id == 5001)


def test_hilbert_curve_moves_one_step(spark):
    n = 8
    df = spark.range(n**3).select(*[(F.floor(F.col("id") / n**k) % n).alias(f"c{k}") for k in range(3)])
    cells = sorted((r.h, (r.c0, r.c1, r.c2)) for r in df.select("*", sharding.hilbert_index([F.col("c0"), F.col("c1"), F.col("c2")], 3).alias("h")).collect())
    assert [h for h, _ in cells] == list(range(n**3))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(cells, cells[1:]))


# 8, 10 --------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    r, calm, bad = random.Random(1), [f"{a}{b}" for a in "ka lo mi ren tu sol".split() for b in "da ve rin to pel".split()], ["grubbish", "zornful", "zornly", "mukker"]
    docs = []
    for i in range(700):
        w = [r.choice(calm) for _ in range(r.randrange(5, 120))]
        if i % 4 == 0:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(bad)
        docs.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.train(docs[:500], steps=(120,))
    rows = [(i, t, "en", "a", y) for i, (t, y) in enumerate(docs[500:])] + [(900, None, None, None, 0), (901, "", None, None, 0), (902, "!! ?", None, None, 0), (903, docs[0][0], None, None, 1), (904, "kada " * 20_000, None, None, 0)]
    got = {x.doc_id: x for x in toxicity.toxicity(frame(spark, rows).withColumn("score", F.lit("clash")), model).collect()}
    right = sum((got[i].score >= 0.7) == (y == 1) for i, _, _, _, y in rows)
    assert right >= 0.97 * len(rows) and all(0 <= x.score <= 1 for x in got.values())
    assert got[900].score == got[901].score == got[902].score < 0.5
    assert toxicity.toxicity(frame(spark, rows), None).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.train(docs[:0]) is None and toxicity.toxicity(frame(spark, []), model).count() == 0


def test_toxicity_equals_one_window_after_another(spark):
    """Scores against a plain version: each window by itself, word by word, gates one after another."""
    import re as _re

    from taskloom.llm import recurrent as net
    from taskloom.llm.words import mix

    r = random.Random(6)
    pool = ["calm", "tree", "Grubbish", "zornful", "mukker", "öde", "x", "walking", "seventeen"]
    data = [(" ".join(r.choice(pool) for _ in range(r.randrange(1, 150))), int(i % 3 == 0)) for i in range(60)]
    p = toxicity.train(data, steps=(5,))

    def rows_of(word, sizes, head):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in word.encode())
        out = []
        for k in sizes:
            for i in range(len(b) - k + 1 if not head else int(len(b) >= k)):
                g = 2 * k + head
                for c in b[i : i + k]:
                    g = (g * 0x100000001B3 + c) % (1 << 64)
                out.append(int(mix(np.array([g], np.uint64))[0] % np.uint64(net.TABLE)))
        return out

    def vector(word):
        raw = word.encode()
        v = net.vocabulary(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        x = p["words"][v["word"][0]].astype(float)
        for name, sizes, head in (("grams", net.GRAMS, False), ("heads", net.BEGINNINGS, True)):
            own = rows_of(word, sizes, head)
            x = x + (np.mean([p[name][i] for i in own], 0) if own else 0)
        return x

    sig = lambda z: 1 / (1 + np.exp(-z))

    def states(xs, d):
        h, out, k = np.zeros(net.STATE), [], net.STATE
        for x in xs:
            g, u = x @ p[f"wx{d}"] + p[f"b{d}"], h @ p[f"wh{d}"]
            reset, keep = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
            n = np.tanh(g[2 * k :] + reset * u[2 * k :])
            h = (1 - keep) * n + keep * h
            out.append(h)
        return out

    def score(text):
        words_ = [vector(w) for w in _re.findall(r"[^\W_]+", text or "")]
        logits = []
        for a in range(0, max(1, len(words_) - net.WINDOW + net.STRIDE), net.STRIDE) if words_ else []:
            xs = words_[a : a + net.WINDOW]
            s = np.concatenate([np.array(states(xs, "f")), np.array(states(xs[::-1], "b")[::-1])], 1)
            e = np.exp(np.tanh(s @ p["wa"] + p["ba"]) @ p["va"])
            logits.append(float((e / e.sum()) @ s @ p["wo"] + p["bo"][0]))
        mean = np.mean([sig(z) for z in logits]) if logits else 2e-9
        top = max(logits) if logits else -20.0
        return sig(p["scale"] @ [top, np.log(mean / (1 - mean)) if logits else -20.03, 1.0])

    texts = [t for t, _ in data[:12]] + ["", None, " ".join(pool * 9), " ".join(pool * 7)]
    got = {x.doc_id: x.score for x in toxicity.toxicity(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), p).collect()}
    assert all(abs(got[i] - score(t)) < 2e-3 for i, t in enumerate(texts))


def test_toxicity_sample_leaves_held_out_rows(spark):
    docs = frame(spark, [(i, f"text {i}", "en", "a", 6) for i in range(60)] + [(60, None, None, None, 0), (61, "x" * 20_000, None, None, 0), (None, "n", None, None, 0)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(4, 1)], "doc_id long, toxic int")
    got = [(r.text, r.y) for r in toxicity.sample(docs, labels, "toxic", ~toxicity.held_out(), most=(9, 11)).collect()]
    ids = [int(t.split()[1]) for t, _ in got]
    assert len(got) == 20 and sum(y for _, y in got) == 9 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect() if r.doc_id is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


def test_toxicity_is_fitted_in_a_task_as_anywhere(spark):
    rows = [(i // 2, f"kalo {'grubbish zorn' if i // 2 % 3 == 0 else 'mira sol'} w{i}", "en", "a", 0) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    some = [toxicity.sample(x, labels, "toxic", F.lit(True)) for x in (frame(spark, rows).repartition(5), frame(spark, rows[::-1]).coalesce(1))]
    a, b = (sorted((r.doc_id, r.text, r.y) for r in x.collect()) for x in some)
    assert a == b and len(a) == 120  # rows of one doc_id, in any order
    got, want = toxicity.fitted(some[0]), toxicity.train([(t, y) for _, t, y in a])
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    assert toxicity.fitted(some[0].where("y = 1")) is None and toxicity.fitted(some[0].where("false")) is None


def test_drop_toxic_and_chain(spark, tmp_path):
    r, calm = random.Random(3), [f"{a}{b}" for a in "ka lo mi ren tu sol".split() for b in "da ve rin to pel".split()]
    rows, marks = [], []
    for i in range(240):
        w = [r.choice(calm) for _ in range(60)]
        if i % 3 == 0:
            w[::12] = ["grubbish"] * 5
        rows.append((i, " ".join(w), "en", "a", 9))
        marks.append((i, 1, int(i % 3 == 0)))
    rows += [(900, None, None, None, None), (901, "", None, None, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stages.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in rows if x[0] % 3 or x[0] >= 900}
    seen = []
    out = stages.chain(spark, [("a", lambda s, d, f: seen.append(d.count()) or d.limit(5)), ("b", lambda s, d, f: seen.append(d.count()) or d)], docs, str(tmp_path))
    assert seen == [242, 5] and out.count() == 5
    assert stages.drop_toxic(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_words_of_texts_without_ascii_gaps():
    from taskloom.llm import recurrent as net

    def seen(text):
        raw = [text.encode(), b"end"]
        v = net.vocabulary(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        ends = np.cumsum(v["n"])
        at = v["at"][: v["rows"][1]]
        return v["word"][at].tolist(), {int(g) for i in at for g in v["grams"][ends[i] - v["n"][i] : ends[i]]}

    for gap in "\u00a0 \u3000 \u2014 \u201d \u3002 \uff0c".split(" "):
        assert seen(f"calm{gap}grubbish{gap}tree")[0] == seen("calm grubbish tree")[0]
    r = random.Random(4)
    for letters in ("abcdefgh", "\u4e00\u4e8c\u4e09\u56db\u4e94", "a\u00e9\u4e00\U00020000"):
        text = "".join(r.choice(letters) for _ in range(300))
        start, size, rows = net._positions(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert size.max() <= net.LONG and size.min() > 0 and rows.tolist() == [0, len(start)]
        spans = list(zip(start.tolist(), (start + size).tolist()))
        assert all(text.encode()[a:b].decode() for a, b in spans)
        assert all(any(a <= i and i + 5 <= b for a, b in spans) for i in range(len(text.encode()) - 4))
    tail = "x" * 100
    assert seen(tail + "grubbish")[1] - seen(tail + "calmness")[1]


def test_gradients():
    from taskloom.llm import recurrent as net

    raw = [b"one two three four five", b"six two nine"]
    v = net.vocabulary(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    first, size, _ = net.windows(v["rows"])
    p = {k: a.astype(np.float64) for k, a in net.fresh(0).items()}
    idx, mask = net.gather(v, first, size)
    x = net.word_inputs(p, v).astype(np.float64)
    loss = lambda: float((net.forward(p, x, idx, mask) * [1.0, -2.0]).sum())
    keep: dict = {}
    net.forward(p, x, idx, mask, keep)
    g, dx = net._back(p, x, idx, mask, keep, np.array([1.0, -2.0]))
    for name in ("wxf", "whb", "bf", "wa", "va", "wo"):
        at = (0,) * p[name].ndim
        was, e = p[name][at], 1e-3
        p[name][at] = was + e
        up = loss()
        p[name][at] = was - e
        assert abs((up - loss()) / (2 * e) - g[name].reshape(p[name].shape)[at]) < 2e-3, name
        p[name][at] = was


def plain_text_view(text):
    """The text view of one text, word by word."""
    w = text.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ")
    w = [x for x in w if x]
    n, one, two = max(len(w), 1), Counter(w), Counter(zip(w, w[1:]))
    long = [min(len(x), 40) for x in w]
    mean = sum(long) / n
    deviation = max(sum(x * x for x in long) / n - mean**2, 0) ** 0.5
    out = [len(one) / n, max(one.values(), default=0) / n, len(two) / n, max(two.values(), default=0) / n, sum(x == y for x, y in zip(w, w[1:])) / n, mean, deviation, sum(len(x) == 1 for x in w) / n, np.log1p(len(w))]
    cells = [0] * quality.WORDS
    for x in w:
        h = quality.hash_spans(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
        cells[int(quality.mix(h)[0] % np.uint64(quality.WORDS))] += 1
    return [*out, *((c / n) ** 0.5 for c in cells)]


def test_quality_of_whole_texts_equals_plain_scores(spark):
    r = random.Random(8)
    good, bad = [f"w{i}" for i in range(60)], ["x", "***", "zz", "###"]
    texts = [" ".join(r.choices(bad if i % 4 == 0 else good, k=r.randrange(1, 90))) + ("\n|" * 9 if i % 4 == 0 else "") for i in range(240)]
    texts += ["", None, "a\u00a0b  c\td", " ".join(r.choices(good, k=300_000)), "y" * 3_000_000]
    docs = frame(spark, [(i, t, "en", f"s{i % 5}", 0) for i, t in enumerate(texts)]).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240) if i % 3], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, "quality", F.col("doc_id") >= 0)
    assert model is not None
    known = {x.doc_id: x for x in quality.quality(docs, model).collect()}
    assert len(known) == len(texts)
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        at = np.array([0, len(data)])
        plain = np.array([plain_text_view(t or "")])
        assert np.allclose(quality.text_view(data, at), plain)
        p, q = model[0].chance(plain)[0], model[1].chance(quality.page_view(data, at, [f"s{i % 5}"], ["en"]))[0]
        logit = lambda x: np.log(max(x, 1e-9) / max(1 - x, 1e-9))
        want = 1 / (1 + np.exp(-(logit(p) + logit(q)) / 2))
        assert abs(known[i].text_score - p) < 1e-6 and abs(known[i].page_score - q) < 1e-6 and abs(known[i].score - want) < 1e-6
    right = [(known[i].score >= 0.5) == (i % 4 != 0) for i in range(240) if i % 3 == 0]
    assert sum(right) >= 0.95 * len(right)


def test_quality_edges(spark):
    docs = [(1, None, None, None, 0), (1, None, None, None, 0), (2, "", "en", "a", 0), (None, "x y " * 30_000, "en", "a", 0)]
    got = quality.quality(frame(spark, docs).withColumn("score", F.lit("clash")), None).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert quality.quality(frame(spark, []), None).count() == 0


# 9 ----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        new = {s for s in free if w[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else w[s] * level for s in names}
        full |= new


def test_mixing(spark):
    r = random.Random(5)
    docs = [(i, " w" * r.randrange(0, 60), "en", r.choices(["a", "B", "é", None, "z"], [50, 9, 2, 3, 1])[0], 0) for i in range(900)]
    rows = frame(spark, docs).select("doc_id", "source", common.word_count("text").alias("size"))
    got = mixing.pareto_mix(rows).collect()
    sizes = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    assert len(got) == 900
    for s, n in sizes.items():
        own = [x for x in got if x.source == s]
        assert all(x.source_size == n and abs(x.target - want[s]) < 1e-6 * max(1, want[s]) for x in own)
        assert abs(sum(x.taken for x in own) - want[s]) <= 12
        assert all(x.taken in (0, x.size, 2 * x.size, 3 * x.size) for x in own)
        assert max(x.copies for x in own) - min(x.copies for x in own) <= 1
    assert {x.doc_id: x.taken for x in mixing.pareto_mix(rows.repartition(7)).collect()} == {x.doc_id: x.taken for x in got}


def test_mixing_takes_important_documents_more_often(spark):
    """Inclusion frequencies over 100 equal sources against the chances, for a fraction of words that is open."""
    sizes = [3, 7, 15, 31] * 12
    docs = [(1000 * k + i, f"s{k:04}", n) for k in range(300) for i, n in enumerate(sizes)]
    got = mixing.pareto_mix(spark.createDataFrame(docs, "doc_id long, source string, size long")).collect()
    total, weight = sum(sizes), [np.log2(n + 1) for n in sizes]
    for turn, f in ((0, 15 / 8), (1, 6 / 8), (2, 3 / 8)):
        open_ = (f - int(f)) * total
        sure: set = set()
        while True:  # the chances, one document after another
            c = (open_ - sum(sizes[i] for i in sure)) / sum(weight[i] * sizes[i] for i in range(48) if i not in sure)
            new = {i for i in range(48) if i not in sure and c * weight[i] > 1}
            if not new:
                break
            sure |= new
        p = [1.0 if i in sure else c * weight[i] for i in range(48)]
        own = [r for r in got if int(r.source[1:]) % 3 == turn]
        often = [np.mean([r.copies - int(f) for r in own if r.doc_id % 1000 % 4 == i]) for i in range(4)]
        assert max(abs(a - b) for a, b in zip(often, p)) < 0.08, (often, p[:4])
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 9 for r in got)


def test_mixing_edges(spark):
    rows = frame(spark, []).select("doc_id", "source", F.lit(1).alias("size"))
    assert mixing.pareto_mix(rows).count() == 0
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "a", 0), (None, "b", 10)], "doc_id long, source string, size long").withColumn("taken", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.size, r.taken, r.target) for r in mixing.pareto_mix(df).collect())
    assert got == [(-1, 10, 10, 10.0), (1, 0, 0, 0.0), (1, 0, 0, 0.0), (2, 0, 0, 0.0)]


# shared helpers and the stages ------------------------------------------------------------------------------------


def test_running_sum_and_rank(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000).alias("v"), "id")
    laid = common.saved(common.ranked(df, F.col("v"), F.col("id")))
    got = common.running_sum(laid, "rank", "v", "before", 5000, bits=4).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(5000)) and [r.v for r in got] == sorted(r.v for r in got)
    assert [r.before for r in got] == list(np.cumsum([0] + [r.v for r in got])[:-1])


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 300)] + [(7, i) for i in range(1000, 1200)] + [(5, 1199)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 301)) and all(got[i] == 5 for i in range(1000, 1200)) and got[7] == 5
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark):
    docs = corpus(11, 80)
    df = frame(spark, docs)
    kept = stages.drop_near_duplicates(spark, df, "")
    want = {i for i, x in brute_near(docs, 5).items() if x[2]}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
    twice = stages.drop_near_duplicates(spark, df.union(df.limit(5)), "")
    assert twice.count() == len(want)
    cut = stages.drop_repeats(spark, df, "")
    repeats = brute_repeats(docs, 20)
    assert cut.columns == df.columns and cut.count() == len(docs)
    assert all(words(r.text) == words(repeats[r.doc_id][3]) for r in cut.collect())
    mixed = stages.mix_sources(spark, df, "")
    counts = Counter(r.doc_id for r in mixed.collect())
    copies = {r.doc_id: r.copies for r in mixing.pareto_mix(df.select("doc_id", "source", common.word_count("text").alias("size"))).where("size > 0").collect()}
    assert mixed.columns == df.columns and counts == Counter({k: v for k, v in copies.items() if v})
    for stage in (stages.drop_near_duplicates, stages.drop_repeats, stages.mix_sources, stages.pack_sequences):
        assert stage(spark, df.where("false"), "").count() == 0


def test_near_duplicate_stage_keeps_rows_of_one_doc_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    docs = [(None, text(i), "en", "a", 0) for i in range(20)] + [(7, text(100 + i), "en", "a", 0) for i in range(3)]
    docs += [(50, text(3) + " more", "en", "a", 0), (51, text(102) + " more", "en", "a", 0), (52, text(200), "en", "a", 0), (None, "", "en", "a", 0), (None, "", "en", "b", 0)]
    got = stages.drop_near_duplicates(spark, frame(spark, docs), "")
    rest = [x for x in docs if x[0] not in (50, 51)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rest))
