"""Repeated passages, found by recompression.

Every document is parsed by the same rounds everywhere: runs of a word become one symbol, then adjacent symbols are
paired, left ones with right ones, by a bit of their own hash. A symbol's name is a hash of what it stands for, so
names agree over the whole corpus without a directory, and equal passages get equal symbols but near their ends. How
far the ends reach is known: each symbol carries the words on which it depends. A window of words is sent under the
highest symbol that the window alone decides; equal windows therefore meet, and there they are verified. What meets
under a symbol that is too frequent goes into a second round, in which each window is a symbol of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, partitions, ready, saved
from .words import binaries, give_back, hashed_words, mix, powers, ragged, text_slices

WINDOW = 20
#: Rounds of pairing, and words from which a symbol is no longer paired.
ROUNDS, FULL = 3, 4
#: Bytes of text parsed at a time, and words of a longer text.
SLICE, PIECE = 1 << 20, 200_000
#: A symbol is frequent if it has so many places in a slice, or so many rows in a task; its windows part then.
OFTEN, HELD = 32, 50_000
#: Kinds of rows: a symbol is frequent; windows under a symbol; a window of a frequent symbol; windows known to repeat.
FREQUENT, WINDOWS, APART, KNOWN = range(4)
_FAR = 1 << 40


def parse(h: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS, full: int = FULL) -> tuple[np.ndarray, ...]:
    """Symbols of the words h (rows: offsets of the documents): name, first word, word after the last, and the first
    and after-the-last word on which the symbol depends (beyond all words where it depends on a document's end)."""
    n = len(h)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    head = np.ones(n, bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(head)
    e = np.append(s[1:], n)
    d = doc[s]
    name = mix(h[s] + (e - s).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    first, last = np.append(True, d[1:] != d[:-1]), np.append(d[1:] != d[:-1], True)
    # A run ends where its neighbours differ, so it depends on one word at either side.
    dl, dr = np.where(first, -_FAR, s - 1), np.where(last, _FAR, e + 1)
    for k in range(rounds):
        open_ = (e - s) < full
        left = (mix(name ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        near = (d[1:] == d[:-1]) & open_[1:] & open_[:-1]
        join = np.append(near & left[:-1] & ~left[1:], False)
        joined = np.append(False, join[:-1])
        # One that stays alone depends on the neighbour it could have joined.
        alone = open_ & ~join & ~joined
        r, f = np.flatnonzero(alone & left), np.flatnonzero(alone & ~left)
        ndl, ndr = dl.copy(), dr.copy()
        ends = last[r]
        q = np.minimum(r + 1, len(s) - 1)
        ndr[r] = np.where(ends, _FAR, np.maximum(dr[r], dr[q]))
        ndl[r] = np.where(ends, dl[r], np.minimum(dl[r], dl[q]))
        begins = first[f]
        q = np.maximum(f - 1, 0)
        ndl[f] = np.where(begins, -_FAR, np.minimum(dl[f], dl[q]))
        ndr[f] = np.where(begins, dr[f], np.maximum(dr[f], dr[q]))
        p = np.flatnonzero(join)
        ndl[p] = np.minimum(dl[p], dl[p + 1])
        ndr[p] = np.maximum(dr[p], dr[p + 1])
        name[p] = mix(name[p] * np.uint64(0x9FB21C651E98DF25) + name[p + 1] + np.uint64(k + 1))
        e[p] = e[p + 1]
        last[p] = last[p + 1]
        keep = ~joined
        name, s, e, d, dl, dr, first, last = name[keep], s[keep], e[keep], d[keep], ndl[keep], ndr[keep], first[keep], last[keep]
    return name, s, e, dl, dr


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words that follow one another (documents' ends are not looked at)."""
    c = powers(np.uint64(0xC2B2AE3D27D4EB4F), size + 1)
    out, done, part, width = np.zeros(max(len(h) - size + 1, 0), np.uint64), 0, h, 1
    while width <= size:  # sums over 1, 2, 4 ... words; size is put together from its binary digits
        if size & width:
            out += part[done : done + len(out)] * c[done]
            done += width
        width *= 2
        if width <= size:
            part = part[: len(part) - width // 2] + part[width // 2 :] * c[width // 2]
    return mix(out)


def anchors(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For each window (its first word, by order): its hash, and the name and first word of the symbol it is sent
    under: of those it alone decides the longest, by hash among equals; without any, the window itself, named by another
    hash of its words, so that its name tells more than its hash does."""
    w = window_hashes(h, size)
    n = len(w)
    valid = np.zeros(n, bool)
    counts = np.maximum(np.diff(rows) - size + 1, 0)
    valid[np.repeat(rows[:-1], counts) + ragged(counts)] = True
    name, s, e, dl, dr = parse(h, rows)
    low, high = np.maximum(dr - size, 0), np.minimum(dl, n - 1)
    use = np.flatnonzero(high >= low)
    rank = (np.minimum(e - s, 7)[use].astype(np.uint64) << np.uint64(61)) | (mix(name[use]) >> np.uint64(3))
    use = use[np.argsort(rank, kind="stable")]
    count = high[use] - low[use] + 1
    owner = np.full(n, -1)
    owner[np.repeat(low[use], count) + ragged(count)] = np.repeat(use, count)  # the last, highest, stays
    own = owner >= 0
    at = np.flatnonzero(valid)
    key = np.where(own, name[owner], np.uint64(0))
    alone = at[~own[at]]
    fresh = mix(h[alone[:, None] + np.arange(size)] ^ np.uint64(0x8CB92BA72F3D8DD7)) * powers(np.uint64(0x94D049BB133111EB), size)
    key[alone] = mix(fresh.sum(1, dtype=np.uint64))
    return at, w[at], key[at], np.where(own, s[owner], np.arange(n))[at]


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, at: np.ndarray, payload: pa.Array) -> pa.RecordBatch:
    cols = [pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int8)), pa.array(doc), pa.array(at), payload]
    return pa.RecordBatch.from_arrays(cols, names=["key", "kind", "doc", "at", "payload"])


def _apart(name: np.ndarray, check: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each window by itself. name: the symbol's; check: what tells the symbol's windows apart."""
    body = np.ascontiguousarray(name).view(np.uint8)
    return _rows(APART, mix(name ^ mix(check)), doc, at, binaries(body, np.full(len(name), 8)))


def _repeats(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(doc, mark, starts) of rows sorted by the first two."""
    g = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]))) if len(doc) else np.zeros(0, int)
    size = np.diff(np.append(g, len(doc)))
    return doc[g], mark[g], binaries(start.astype(np.uint32).view(np.uint8), 4 * size)


def _pieces(h: np.ndarray, rows: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(words, offsets of documents, number of the first word): a long text in parts that share size - 1 words. A
    window's symbol is the same wherever the window stands, so parts need no more of each other."""
    if len(h) <= PIECE or len(rows) > 2:
        yield h, rows, 0
        return
    for a in range(0, len(h) - size + 1, PIECE):
        part = h[a : a + PIECE + size - 1]
        yield part, np.array([0, len(part)]), a


def _sent(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text) -> (key, kind, doc, at, payload): windows by symbol, and the windows that repeat in the slice.

    WINDOWS: key is the symbol, at its place, and the payload 4 bytes of mask, bit k for a window that starts k words
    before the symbol, and 6 bytes of hash for each. KNOWN: starts of windows (4 bytes each) that repeat an earlier one
    of the slice. A symbol with OFTEN places in a slice sends FREQUENT once, and its windows APART.
    """
    for batch in batches:
        doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in text_slices(batch.column(2), SLICE):
            words, ends = hashed_words(data, offsets)
            if len(words) < size:
                continue
            ids, marks = doc[i:j], mark[i:j]
            for h, rows, base in _pieces(words, ends, size):
                at, w, key, sym = anchors(h, rows, size)
                if not len(at):
                    continue
                of = np.searchsorted(rows, at, "right") - 1
                place = at - rows[of] + base
                # The earliest of equal windows in this slice goes on; the others are repeats for certain.
                order = np.argsort(w, kind="stable")
                same = (w[order[1:]] == w[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
                repeat = np.zeros(len(at), bool)
                if same.any():
                    hit = np.zeros(len(at), bool)
                    hit[order[1:][same]] = hit[order[:-1][same]] = True
                    x = np.flatnonzero(hit)
                    x = x[np.lexsort((place[x], marks[of[x]], ids[of[x]], w[x]))]
                    new = np.append(True, w[x[1:]] != w[x[:-1]])
                    lead = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
                    repeat[x] = (ids[of[x]] != ids[of[lead]]) | (marks[of[x]] != marks[of[lead]]) | (place[x] != place[lead])
                k = np.flatnonzero(~repeat)
                back = sym[k] - at[k]
                k = k[np.lexsort((back, sym[k], key[k]))]
                new = np.append(True, (sym[k[1:]] != sym[k[:-1]]) | (key[k[1:]] != key[k[:-1]]))
                group = np.cumsum(new) - 1
                first = k[new]
                _, symbol, places = np.unique(key[first], return_inverse=True, return_counts=True)
                frequent = places[symbol] >= OFTEN
                back = sym[k] - at[k]
                check = w[k] << np.uint64(16) | back.astype(np.uint64)  # the hash's low 48 bits and the window's place
                if frequent.any():
                    own = frequent[group]
                    x = k[own]
                    yield _apart(key[x], check[own], ids[of[x]], (marks[of[x]] << 32) | place[x])
                    names = np.unique(key[first[frequent]])
                    zero = np.zeros(len(names), np.int64)
                    yield _rows(FREQUENT, names, zero, zero, binaries(np.zeros(0, np.uint8), zero))
                    k, back, new = k[~own], back[~own], new[~own]
                if len(k):
                    g = np.flatnonzero(new)
                    count = np.diff(np.append(g, len(k)))
                    mask = np.add.reduceat(np.left_shift(np.int64(1), back), g).astype(np.uint32)
                    body = np.empty(4 * len(g) + 6 * len(k), np.uint8)
                    spot = 4 * np.arange(len(g)) + 6 * g
                    body[spot[:, None] + np.arange(4)] = mask.view(np.uint8).reshape(-1, 4)
                    there = np.repeat(spot + 4, count) + 6 * ragged(count)
                    body[there[:, None] + np.arange(6)] = w[k].view(np.uint8).reshape(-1, 8)[:, :6]
                    x = k[g]
                    yield _rows(WINDOWS, key[x], ids[of[x]], (marks[of[x]] << 32) | (place[x] + back[g]), binaries(body, 4 + 6 * count))
                x = np.flatnonzero(repeat)
                if len(x):
                    d, m, starts = _repeats(ids[of[x]], marks[of[x]], place[x])
                    yield _rows(KNOWN, mix(d.view(np.uint64)), d, m << 32, starts)
            give_back()


def _opened(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of WINDOWS rows: the row of each window, its check and its start."""
    at = t.column("at").to_numpy()
    col = t.column("payload").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    mask = np.ascontiguousarray(data[offsets[:-1, None] + np.arange(4)])
    r, back = np.nonzero(np.unpackbits(mask, axis=1, bitorder="little"))
    count = np.bincount(r, minlength=len(t))
    there = np.repeat(offsets[:-1] + 4, count) + 6 * ragged(count)
    raw = np.zeros((len(r), 8), np.uint8)
    raw[:, :6] = data[there[:, None] + np.arange(6)]
    # The mark is in the high half of at, so what comes out is (mark, start of the window).
    return r, raw.reshape(-1).view(np.uint64) << np.uint64(16) | back.astype(np.uint64), at[r] - back


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _sent(), sorted by key and kind -> the same form: KNOWN, the windows that start earlier elsewhere, and
    APART, the windows of frequent symbols. No more than HELD rows of a symbol are held; from there on it is frequent."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        key, doc = t.column("key").to_numpy().view(np.uint64), t.column("doc").to_numpy()
        r, check, place = _opened(t)
        number = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.uint64)[r]
        # Equal windows lie together in the order of a hash; whether they are equal is seen by symbol and check.
        order = np.argsort(number << np.uint64(47) | mix(check) >> np.uint64(17))
        same = (check[order[1:]] == check[order[:-1]]) & (number[order[1:]] == number[order[:-1]])
        hit = np.zeros(len(r), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        x = np.flatnonzero(hit)
        y = np.lexsort((place[x], doc[r[x]], check[x], number[x]))
        x, place = x[y], place[x][y]
        d = doc[r[x]]
        new = np.append(True, (check[x[1:]] != check[x[:-1]]) | (number[x[1:]] != number[x[:-1]]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) if len(x) else np.zeros(0, int)
        late = (d != d[lead]) | (place != place[lead])
        d, place = d[late], place[late]
        y = np.lexsort((place, d))
        d, m, starts = _repeats(d[y], place[y] >> 32, place[y] & 0xFFFFFFFF)
        return _rows(KNOWN, np.zeros(len(d), np.uint64), d, m << 32, starts)

    def parted(t: pa.Table) -> pa.RecordBatch:
        r, check, place = _opened(t)
        return _apart(t.column("key").to_numpy().view(np.uint64)[r], check, t.column("doc").to_numpy()[r], place)

    frequent: int | None = None  # the symbol that is being parted
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        kind = t.column("kind").to_numpy()
        through = t.filter(pa.array((kind == APART) | (kind == KNOWN)))
        yield from through.to_batches()
        t = t.filter(pa.array((kind == WINDOWS) | (kind == FREQUENT)))
        t = t if held is None else pa.concat_tables([held, t])
        if len(t) < HELD:
            held = t
            continue
        last = t.column("key").to_numpy()
        cut = int(np.searchsorted(last, last[-1]))  # the last symbol may go on
        yield from _split(t.slice(0, cut), frequent, judge, parted)
        held = t.slice(cut).combine_chunks()
        if len(held) >= HELD or frequent == last[-1]:
            frequent = int(last[-1])
            yield from _split(held, frequent, judge, parted)
            held = None
        give_back()
    if held is not None:
        yield from _split(held, frequent, judge, parted)


def _split(t: pa.Table, frequent: int | None, judge, parted) -> Iterator[pa.RecordBatch]:
    """Judges rows by symbol, and parts those whose symbol is frequent."""
    if not len(t):
        return
    key, kind = t.column("key").to_numpy(), t.column("kind").to_numpy()
    names = key[kind == FREQUENT]
    names = np.unique(names if frequent is None else np.append(names, frequent))
    often = np.isin(key, names)
    rest = t.filter(pa.array(~often))
    if len(rest):
        yield judge(rest)
    rest = t.filter(pa.array(often & (kind == WINDOWS)))
    for i in range(0, len(rest), HELD):
        yield parted(rest.slice(i, HELD))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """APART rows sorted by (key, payload, doc, at) -> KNOWN rows: all of a window but its first. Only the first of the
    window that a batch ends with is held."""
    lead: tuple[int, int, int, int] | None = None
    for batch in batches:
        if not len(batch):
            continue
        key, doc, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "doc", "at"))
        name = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("payload")).to_pylist()), np.int64)
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
        if lead is not None and (key[0], name[0]) == lead[:2]:
            new[0] = False
        x = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        own = np.maximum(x, 0)
        d, a = doc[own], at[own]
        if lead is not None:
            d, a = np.where(x < 0, lead[2], d), np.where(x < 0, lead[3], a)
        lead = (int(key[-1]), int(name[-1]), int(d[-1]), int(a[-1]))
        late = (doc != d) | (at != a)
        y = np.lexsort((at[late], doc[late]))
        d, a = doc[late][y], at[late][y]
        d, m, starts = _repeats(d, a >> 32, a & 0xFFFFFFFF)
        yield _rows(KNOWN, np.zeros(len(d), np.uint64), d, m << 32, starts)


def _squeezed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Replaces _text by its zstd-compressed bytes."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        cols = dict(zip(batch.schema.names, batch.columns))
        cols["_text"] = pa.array([squeeze(v.as_buffer()) if v.is_valid else None for v in cols["_text"].cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)
        give_back()


def _cut(batches: Iterator[pa.RecordBatch], size: int, names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Cuts the covered words out of each text."""
    expand = zstandard.ZstdDecompressor().decompress

    def made(part: pa.RecordBatch, n_words: list, n_removed: list, sha: list, texts: list) -> pa.RecordBatch:
        cols = dict(zip(part.schema.names, part.columns))
        cols |= {"_n_words": pa.array(n_words, pa.int64()), "_n_removed": pa.array(n_removed, pa.int64()), "_kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            cols["_kept"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        first = weight = 0
        packed_col, starts_col = (batch.column(batch.schema.get_field_index(c)) for c in ("_text", "_starts"))
        for i, (packed, starts) in enumerate(zip(packed_col, starts_col)):
            raw = b"" if not packed.is_valid else expand(packed.as_buffer())
            words = raw.split()
            kept = words
            if starts.is_valid and len(starts):
                cover = np.zeros(len(words) + 1, np.int64)
                for part in starts.as_py():
                    s = np.frombuffer(part, np.uint32)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + size, -1)
                keep = np.cumsum(cover)[:-1] == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            joined = b" ".join(kept)
            out[0].append(len(words))
            out[1].append(len(words) - len(kept))
            out[2].append(hashlib.sha256(joined).hexdigest())
            out[3].append((joined if len(kept) < len(words) else raw).decode() if with_text and packed.is_valid else None)
            weight += len(raw) if with_text else 0
            if weight > 2 * SLICE or i == len(batch) - 1:
                yield made(batch.slice(first, i + 1 - first), *out)
                first, weight, out = i + 1, 0, ([], [], [], [])
        give_back()


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_sha256, and with the text that is left.

    A word goes if a window of `window` words that covers it starts earlier too: in a row of a smaller key, or in the
    same row before. All windows are judged on the input. A text from which words went is what is left joined by
    single spaces; others stay as they are. kept_sha256 is of the words left joined by single spaces. A null text has
    no words and stays null; shorter texts than a window lose nothing; a null key is the least; rows with the same key
    and text are one document (each gets its result), rows with the same key and other texts are ordered by a
    checksum. Columns of docs named like a result are replaced. No rows give no rows.

    Exchanges: symbols with 6 bytes a window, and compressed texts by key; windows of frequent symbols have one more.
    Equal windows of a slice are told apart before the first, so that a passage in a third of all documents adds one
    row a slice. A symbol in a third of all documents adds one row a slice too; its windows meet by themselves, and
    are read in order of their documents, so that only the first of a window is held. Words are not compared: windows
    are equal if the name of their symbol (64 bits of hash, over the symbol's words), its place in them and 48 bits of a
    hash over all their words are. So 48 bits tell windows with one symbol in one place apart, and two independent hashes,
    112 bits, windows without a symbol.
    """
    if not 1 <= window <= 32:
        raise ValueError("window must be 1 to 32")
    spark = docs.sparkSession
    ready(spark)
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_sha256")]
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    mark = F.shiftright(F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")), 1)  # 31 bits, to share a long with a place
    plain = docs.select(doc.alias("doc"), mark.alias("mark"), F.col(text).alias("text"))
    kinds = "key long, kind byte, doc long, at long, payload binary"
    sent = plain.mapInArrow(lambda it: _sent(it, window), kinds)
    met = sent.repartition(partitions(spark), "key").sortWithinPartitions("key", "kind")
    judged = saved(met.mapInArrow(_judged, kinds))
    apart = judged.where(F.col("kind") == APART).repartition(partitions(spark), "key").sortWithinPartitions("key", "payload", "doc", "at")
    known = judged.where(F.col("kind") == KNOWN).unionByName(apart.mapInArrow(_later, kinds))
    found = known.groupBy("doc", F.shiftright("at", 32).alias("mark")).agg(F.collect_list("payload").alias("_starts"))
    rows = docs.select(*others, F.col(text).alias("_text"), doc.alias("_doc"), mark.alias("_mark"))
    names = [f.name for f in rows.schema]
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == '_text' else f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInArrow(lambda it: _squeezed(it, names), kinds)
    rows = rows.join(found, (rows["_doc"] == found["doc"]) & (rows["_mark"] == found["mark"]), "left").drop("doc", "mark", "_doc", "_mark")
    made = [*others, "_n_words", "_n_removed", "_kept_sha256", *["_kept"] * with_text]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others), "_n_words long", "_n_removed long", "_kept_sha256 string", *["_kept string"] * with_text])
    out = rows.mapInArrow(lambda it: _cut(it, window, made, with_text), kinds)
    kept = [F.col("_kept").alias(text)] if with_text else []
    return out.select(*[F.col(f"`{c}`") for c in others], *kept, F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)
