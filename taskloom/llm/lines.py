"""Line dedup: hashes of lines in ranges, sorted by document and place, streamed once; keep bitmaps instead of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, partitions, ready, saved

#: Rows of one key that a task holds at a time; of a key with more, the documents are counted over all tasks.
HELD = 1 << 16
#: So many keys are decided over all tasks by a broadcast; if there are more, by a join.
MOST_SMALL = 100_000
NO_DOC = -(1 << 63)
SPACES = b" \t\n\v\f\r"

_LINES = "doc long, mark long, h1 long, h2 long, places array<int>"
_STREAMED = "kind int, part int, seq int, doc long, mark long, h1 long, h2 long, places array<int>, n long, last long"


def line_key(line: bytes) -> bytes:
    """A line (UTF-8) without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def _keys(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text) -> a row for each different key of a document, with the places of its lines."""
    for batch in batches:
        out: dict[str, list] = {"doc": [], "mark": [], "h1": [], "h2": [], "places": []}
        for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found: dict[bytes, list[int]] = {}
            for place, line in enumerate((text or "").encode().split(b"\n")):
                key = line_key(line)
                if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
                    found.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
            out["doc"] += [doc] * len(found)
            out["mark"] += [mark] * len(found)
            out["h1"] += [int.from_bytes(h[:8], "big", signed=True) for h in found]
            out["h2"] += [int.from_bytes(h[8:], "big", signed=True) for h in found]
            out["places"] += found.values()
        yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("doc", "mark", "h1", "h2")), pa.array(out["places"], pa.list_(pa.int32()))], names=["doc", "mark", "h1", "h2", "places"])


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _streamed(batches: Iterator[pa.RecordBatch], least_docs: int, held_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted by key and document (the greatest first) -> what goes of them (kind 0).

    Keys that may go on in the range before or after, and those of more than held_rows rows, stay open: their rows come out
    as they are (kind 2), with their number of documents, the first and the last of them (kind 1).
    """
    part, seq, held, rows, first, over = TaskContext.get().partitionId(), 0, [], 0, True, None

    def settle(t: pa.Table, open_first: bool, open_last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seq
        h1, h2, doc = (t.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        new = _starts(h1, h2)
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        docs = np.add.reduceat(_starts(h1, h2, doc).astype(np.int64), begin)
        is_open = np.zeros(len(begin), bool)
        is_open[0] |= open_first
        is_open[-1] |= open_last
        gone = ~is_open[group] & (docs[group] >= least_docs) & (doc != doc[begin][group])
        free = np.flatnonzero(is_open)
        end = np.append(begin[1:], len(doc)) - 1
        for kind, at in ((0, np.flatnonzero(gone)), (2, np.flatnonzero(is_open[group])), (1, begin[free])):
            if not len(at):
                continue
            r, n = t.take(pa.array(at)), len(at)
            count, last = (docs[free], doc[end[free]]) if kind == 1 else (np.zeros(n, np.int64),) * 2
            cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32))]
            cols += [r.column(c).combine_chunks() for c in ("doc", "mark", "h1", "h2")] + [r.column("places").combine_chunks() if kind != 1 else pa.nulls(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count), pa.array(last)], names=["kind", "part", "seq", "doc", "mark", "h1", "h2", "places", "n", "last"])
        seq += 1

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < held_rows:
            continue
        t = pa.Table.from_batches(held)
        begin = np.flatnonzero(_starts(t.column("h1").to_numpy(), t.column("h2").to_numpy()))
        cut = int(begin[-1]) or len(t)
        head, tail = t.slice(0, cut), t.slice(cut)
        ends = (head.column("h1")[-1].as_py(), head.column("h2")[-1].as_py())
        goes_on = over == (head.column("h1")[0].as_py(), head.column("h2")[0].as_py())
        yield from settle(head, first or goes_on, not len(tail))
        over = ends if not len(tail) else None
        first, held, rows = False, tail.to_batches(), len(tail)
    if rows:
        yield from settle(pa.Table.from_batches(held), True, True)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, places) -> (doc, mark, n_dropped, keep): places in any order."""
    for batch in batches:
        lists = [np.sort(np.asarray(x, np.int64)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([packed(x) for x in lists], pa.binary())], names=["doc", "mark", "n_dropped", "keep"])


def packed(dropped: np.ndarray) -> bytes:
    """A keep bitmap from the sorted places that go: lengths of its runs, kept and dropped in turn, kept first, each as
    a number of 7 bits a byte, the lowest first; the last run of kept lines is left out."""
    cut = np.flatnonzero(np.diff(dropped, prepend=-2) > 1)
    begin, size = dropped[cut], np.diff(np.append(cut, len(dropped)))
    before = begin - np.append(0, (begin + size)[:-1])
    out = bytearray()
    for n in np.column_stack([before, size]).ravel().tolist():
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def kept_lines(keep: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each line is kept, from its keep bitmap (null: all)."""
    out, at, n, shift, kept = np.ones(n_lines, bool), 0, 0, 0, True
    for b in keep or b"":
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out[at : at + n] = kept
            at, n, shift, kept = at + n, 0, 0, not kept
    return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    doc = F.coalesce(F.col(key).cast("long"), F.lit(NO_DOC))
    return docs.select(doc.alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.col(text).alias("text"))


def line_bitmaps(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, key: str = "doc_id", text: str = "text", held_rows: int = HELD) -> DataFrame:
    """(doc, mark, n_dropped, keep) of each document that loses lines: `keep` is the bitmap of its lines, as runs.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Lines of a key of at least
    `least_chars` code points that at least `least_docs` documents hold go, but for those in the greatest document
    holding it. `doc` is the key (null: the least 64-bit number, so null is the least document), `mark` a hash of the
    text: rows with one key are one document and may differ in text; equal rows have one bitmap. Only hashes (128 bits),
    keys and places are moved, never texts.

    Hashes are dealt in ranges of (hash, document) and sorted, so a key of any number of documents is spread over many
    ranges; each task streams its range, with the first document of a key the one that keeps it. Of a key that lies in
    several ranges, only its count in each of them meets.
    """
    spark = docs.sparkSession
    ready(spark)
    keys = _rows(docs, key, text).mapInArrow(lambda it: _keys(it, least_chars), _LINES).withColumn("row", F.monotonically_increasing_id())
    # The number of the row ends the order, so that rows with one key and one document are spread too.
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("mark"), F.col("row")]
    laid = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("row")
    out = saved(laid.mapInArrow(lambda it: _streamed(it, least_docs, held_rows), _STREAMED))
    piece = Window.partitionBy("h1", "h2").orderBy("part", "seq")
    # A document at the end of one piece and the beginning of the next is one; pieces of a key are as few as ranges.
    counts = out.where("kind = 1").withColumn("again", (F.lag("last").over(piece) == F.col("doc")).cast("int"))
    split = saved(counts.groupBy("h1", "h2").agg((F.sum("n") - F.coalesce(F.sum("again"), F.lit(0))).alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= least_docs).select("h1", "h2", "keeper"))
    if split.count() <= MOST_SMALL:
        split = F.broadcast(split)
    late = out.where("kind = 2").join(split, ["h1", "h2"]).where("doc <> keeper")
    gone = out.where("kind = 0").select("doc", "mark", "places").unionByName(late.select("doc", "mark", "places"))
    # The places of one document: no more than its lines. Equal rows give equal lists, which count once.
    each = gone.groupBy("doc", "mark").agg(F.flatten(F.collect_set("places")).alias("places"))
    return each.mapInArrow(_bitmaps, "doc long, mark long, n_dropped long, keep binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, keep) and other columns -> n_lines, the text of the kept lines, and the other columns."""
    for batch in batches:
        n_lines, kept = [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            kept.append(text or "" if keep is None else "\n".join(x for x, k in zip(lines, kept_lines(keep, len(lines))) if k))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_dropped"), pa.array(n_lines, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_dropped", "n_lines", "kept"])


def dedup_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, key: str = "doc_id", text: str = "text", held_rows: int = HELD) -> DataFrame:
    """(key, n_lines, n_dropped, kept) of every row: its kept lines joined by a line break; see line_bitmaps().

    A null or empty text is one empty line; a text that loses all its lines is empty. Keys are cast to long and come back
    null where they were. Other columns are not read. No rows give no rows.
    """
    rows = _rows(docs, key, text)
    bitmaps = saved(line_bitmaps(docs, least_docs, least_chars, key, text, held_rows))
    met = rows.join(bitmaps, ["doc", "mark"], "left").select("doc", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
    out = met.mapInArrow(_joined, "doc long, n_dropped long, n_lines long, kept string")
    return out.select(F.when(F.col("doc") != NO_DOC, F.col("doc")).alias(key), "n_lines", "n_dropped", "kept")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same result in DuckDB SQL.
ORACLE = """
WITH l AS (SELECT doc_id, p, s[p] AS line, translate(trim(s[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) u(p)),
m AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN m USING (k) GROUP BY doc_id
"""
