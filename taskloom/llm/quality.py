"""Quality of documents by co-training: a view of the words and a view of the page around them teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, ready, saved
from .toxicity import held_out
from .words import hash_spans, mix, text_slices, word_places

#: Labelled rows (of either label) that the classifiers are fitted on.
LABELLED = 4000
#: Rounds; chance from which a view is sure; rows a view labels for the other in a round, of all that have no label.
ROUNDS, CONFIDENT, TAKEN = 5, 0.95, 200
#: Parts in which the surest rows are found first.
PARTS = 64
SLICE = 2 << 20
#: Rows looked at together, at most.
PART = 4000
#: Cells for hashed sources and languages, and for hashed words.
SOURCES, LANGS, WORDS = 32, 8, 256
#: Features of a view, at most, that count with their squares too: the figures, which come first.
FIGURES = 10
RIDGE = 10.0


def _byte_classes() -> np.ndarray:
    out = np.full(256, 5)
    for i in range(256):
        c = chr(i)
        out[i] = 5 if i >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:'\"?-()" else 4 if not c.isspace() else 6 if c == "\n" else 7
    return out


#: 0 small, 1 capital, 2 digit, 3 plain punctuation, 4 other symbol, 5 beyond ASCII, 6 line end, 7 other white space.
CLASS = _byte_classes()


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[rows[1:]] - total[rows[:-1]]


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the words of each text: how they repeat, how long they are, and which they are: roots of the shares
    of WORDS classes of words by hash. Characters, lines and the record are the other view's."""
    n = len(offsets) - 1
    starts, size, rows = word_places(data, offsets)
    h = hash_spans(data, starts, size)
    words = np.maximum(np.diff(rows), 1)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    share = lambda v: _per_row(v, rows) / words

    def distinct(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, count = np.unique((x >> np.uint64(14)) | of << np.uint64(50), return_counts=True)
        at = (key >> np.uint64(50)).astype(int)
        top = np.zeros(n)
        np.maximum.at(top, at, count)
        return np.bincount(at, minlength=n), top

    again = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, bool)
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    same = doc[1:] == doc[:-1]
    kinds, top = distinct(h, doc)
    pairs, top2 = distinct(two[same], doc[1:][same]) if len(h) > 1 else (np.zeros(n), np.zeros(n))
    long = np.minimum(size, 40).astype(float)
    cols = [kinds / words, top / words, pairs / words, top2 / words, share(again), share(long), np.sqrt(np.maximum(share(long**2) - share(long) ** 2, 0)), share(size == 1), np.log1p(np.diff(rows))]
    cell = (mix(h) % np.uint64(WORDS) + doc * np.uint64(WORDS)).astype(np.int64)
    counts = np.bincount(cell, minlength=n * WORDS).reshape(n, WORDS)
    return np.concatenate([np.stack(cols, 1), np.sqrt(counts / words[:, None])], 1)


def page_view(data: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> np.ndarray:
    """Features of the record around the words: source, language, length, lines and kinds of characters."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    kind = CLASS[data]
    cols = [np.log1p(np.diff(offsets)), *(_per_row(kind == c, offsets) / size for c in range(8)), np.log1p(_per_row(kind == 6, offsets))]
    out = np.zeros((n, len(cols) + SOURCES + LANGS))
    out[:, : len(cols)] = np.stack(cols, 1)
    for values, first, cells in ((source, len(cols), SOURCES), (lang, len(cols) + SOURCES, LANGS)):
        for i, v in enumerate(values):
            out[i, first + (zlib.crc32(str(v).encode()) % cells)] = 1.0
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
        for i, j, data, offsets in text_slices(get("_text"), SLICE):
            for a in range(i, j, PART):
                b = min(j, a + PART)
                part, at = data[offsets[a - i] : offsets[b - i]], offsets[a - i : b - i + 1] - offsets[a - i]
                source, lang = get("_source").slice(a, b - a).to_pylist(), get("_lang").slice(a, b - a).to_pylist()
                yield batch.slice(a, b - a), text_view(part, at), page_view(part, at, source, lang)


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, t, m in _featured(batches):
        packed = [pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary()) for v in (t, m)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *packed], names=["doc_id", "mark", "t", "m"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1).astype(np.float64)


def _chance(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class View:
    """Logistic regression on standardised features, those of the figures squared too, with a ridge, stronger for the
    features that are no figures. Newton's method with steps halved until the loss falls, so that it can't diverge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-6
        f = self._wide(x)
        self.w, wide = np.zeros(f.shape[1]), x.shape[1]
        self.scale = (1.0, 0.0)
        ridge = np.where((np.arange(f.shape[1]) > FIGURES) & (np.arange(f.shape[1]) <= wide), RIDGE, 0.5)
        loss = lambda w: weight @ (np.logaddexp(0, f @ w) - y * (f @ w)) + ridge @ w**2 / 2
        for _ in range(100):
            q = _chance(f @ self.w)
            self.slope = f.T @ (weight * (q - y)) + ridge * self.w
            if np.abs(self.slope).max() < 1e-6 * weight.sum():
                break
            step = np.linalg.solve((f * (weight * q * (1 - q))[:, None]).T @ f + np.diag(ridge), self.slope)
            size, was = 1.0, loss(self.w)
            while loss(self.w - size * step) > was - 1e-4 * size * (self.slope @ step) and size > 1e-9:
                size /= 2
            self.w = self.w - size * step

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), z, z[:, :FIGURES] ** 2 / 6], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(x) @ self.w, -30, 30)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return _chance(self.scale[0] * self.logit(x) + self.scale[1])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling on rows the view was not fitted on."""
        s, w = np.stack([self.logit(x), np.ones(len(x))], 1), np.array([1.0, 0.0])
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(30):
            q = _chance(s @ w)
            w = w - np.clip(np.linalg.solve((s * (q * (1 - q))[:, None]).T @ s + 1e-2 * np.eye(2), s.T @ (q - t) + 1e-2 * (w - [1, 0])), -1, 1)
        self.scale = (max(float(w[0]), 1e-3), float(w[1]))


#: (view that is sure, label, key of the row, its features in either view)
Taught = tuple[int, int, object, np.ndarray, np.ndarray]
Teach = Callable[[list[View], tuple[int, int]], list[Taught]]


def learned(t: np.ndarray, m: np.ndarray, y: np.ndarray, teach: Teach, rounds: int = ROUNDS, taken: int = TAKEN, seed: int = 5) -> tuple[View, View] | None:
    """The two views, from labelled rows (y is 1 or 0) and rounds of co-training; None unless both labels occur.

    teach(views, (of label 1, of label 0)) gives, for each view and label, the unlabelled rows of which the view is surest;
    the other view learns them, each once, with half the weight of a labelled row. Of either label there are up to `taken`
    in the share in which labels occur. A fifth of the labelled rows calibrates the views.
    """
    if len(set(y.tolist())) < 2:
        return None
    hold = np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        hold[np.random.default_rng(seed + c).permutation(own)[: len(own) // 5]] = True
    lab = ~hold
    share = float(np.clip(y[lab].mean(), 0.05, 0.95))
    most = max(1, int(taken * share)), max(1, int(taken * (1 - share)))
    given: list[dict[object, tuple[int, np.ndarray]]] = [{}, {}]
    views: list[View] = []
    for k in range(rounds + 1):
        views = []
        for x, own in zip((t, m), given):
            rows = np.concatenate([x[lab], *(f[None] for _, f in own.values())])
            labels = np.concatenate([y[lab], [label for label, _ in own.values()]])
            views.append(View(rows, labels, np.where(np.arange(len(rows)) < lab.sum(), 1.0, 0.5)))
        if k < rounds:
            for view, label, key, ft, fm in teach(views, most):
                given[1 - view].setdefault(key, (label, fm if view == 0 else ft))
    rows = hold if hold.any() else lab
    for v, x in zip(views, (t, m)):
        v.calibrate(x[rows], y[rows])
    return views[0], views[1]


def _surest(batches: Iterator[pa.RecordBatch], held, most: tuple[int, int], confident: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, t, m) -> of the task's rows, for each view and label, those of which the view is surest."""
    best: dict[tuple[int, int], tuple[np.ndarray, pa.Table]] = {}
    least = np.log(confident / (1 - confident))
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        mark = batch.column(1).to_numpy()
        for view, c in ((0, 2), (1, 3)):
            z = held.value[view].logit(_matrix(batch.column(c))) if len(batch) else np.zeros(0)
            for label, sure in ((1, z), (0, -z)):
                k = most[1 - label]
                at = np.flatnonzero(sure >= least)
                at = at[np.lexsort((mark[at], -sure[at]))][:k]
                was = best.get((view, label))
                s, t = sure[at], rows.take(pa.array(at))
                if was is not None:
                    s, t = np.concatenate([was[0], s]), pa.concat_tables([was[1], t])
                    at = np.lexsort((t.column("mark").to_numpy(), -s))[:k]
                    s, t = s[at], t.take(pa.array(at))
                best[view, label] = s, t
    for (view, label), (s, t) in best.items():
        t = t.combine_chunks()
        n = len(t)
        for r in t.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, view, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(s), *r.columns], names=["view", "label", "sure", "doc_id", "mark", "t", "m"])


def _teacher(free: DataFrame, confident: float) -> Teach:
    """Looks at all rows of `free` in each round; what comes to the driver is the rows that are taken."""
    kind = free.schema["doc_id"].dataType.simpleString()
    schema = f"view int, label int, sure double, doc_id {kind}, mark long, t binary, m binary"
    wide = lambda b: np.frombuffer(b, np.float32).astype(np.float64)

    def teach(views: list[View], most: tuple[int, int]) -> list[Taught]:
        held = free.sparkSession.sparkContext.broadcast(views)  # two vectors of weights
        found = free.select("doc_id", "mark", "t", "m").mapInArrow(lambda it: _surest(it, held, most, confident), schema)
        order = [F.col("sure").desc(), F.col("mark"), F.col("doc_id").asc_nulls_first()]
        # Best of each part first, so that the last groups are small whatever the number of tasks.
        rows, top = found.withColumn("_part", F.pmod("mark", F.lit(PARTS)).cast("int")), F.when(F.col("label") == 1, most[0]).otherwise(most[1])
        for by in (["view", "label", "_part"], ["view", "label"]):
            place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
            rows = rows.withColumn("_place", place).where(F.col("_place") <= max(most)).where(F.col("_place") <= top)
        return [(r["view"], r["label"], (r["doc_id"], r["mark"]), wide(r["t"]), wide(r["m"])) for r in sorted(rows.collect(), key=lambda r: (r["view"], -r["label"], r["_place"]))]

    return teach


def _scored(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, m) -> scores."""
    model = held.value
    for rows in batches:
        n = len(rows)
        a, b = (model[0].chance(_matrix(rows.column(1))), model[1].chance(_matrix(rows.column(2)))) if model and n else (np.full(n, 0.5), np.full(n, 0.5))
        logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
        both = _chance((logit(a) + logit(b)) / 2)
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(np.asarray(x, float)) for x in (both, a, b))], names=["doc_id", "score", "text_score", "page_score"])


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    or_null = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"_{c}")
    return docs.select("doc_id", *more, F.coalesce(F.col("text"), F.lit("")).alias("_text"), or_null("source"), or_null("lang"))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, t, m) of each row: a hash of the row, and its features in the views of the words and of the page."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _rows(docs)
    marked = rows.select("doc_id", F.xxhash64("_text", "_source", "_lang", F.col("_source").isNull(), F.col("_lang").isNull()).alias("mark"), "_text", "_source", "_lang")
    return marked.mapInArrow(_views, f"doc_id {kind}, mark long, t binary, m binary")


def with_labels(found: DataFrame, labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """Features with y: the greatest usable label of the row's doc_id, null where there is none."""
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return found.join(known, "doc_id", "left")


def fitted(found: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT, taken: int = TAKEN) -> tuple[View, View] | None:
    """The views, from rows of with_labels() that are saved: at most `labelled` labelled ones, those of the least hash of
    doc_id, and in each round those of all others of which the views are surest. Rows of one doc_id are rows of their own,
    in the order of their hashes, so the order in which rows arrive tells nothing. Only features of labelled rows and of
    those taken reach the driver."""
    known, low = found.where("y is not null"), -(1 << 63)
    n = known.count()
    if n > 2 * labelled:  # about half as many again as are wanted pass by their hash; a limit over all would move more
        near = known.where(F.xxhash64("doc_id") < low + int((1 << 64) * 1.5 * labelled / n))
        known = near if near.count() >= labelled else known
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(labelled).collect()
    if not some:
        return None
    t, m = (np.stack([np.frombuffer(r[c], np.float32).astype(np.float64) for r in some]) for c in ("t", "m"))
    return learned(t, m, np.array([r["y"] for r in some]), _teacher(found.where("y is null"), confident), rounds, taken)


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, **settings) -> tuple[View, View] | None:
    return fitted(saved(with_labels(features(docs), labels, label, usable)), **settings)


def scores(found: DataFrame, model: tuple[View, View] | None) -> DataFrame:
    """(doc_id, score, text_score, page_score) of each row of features()."""
    held = found.sparkSession.sparkContext.broadcast(model)  # two vectors of weights
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "t", "m").mapInArrow(lambda it: _scored(it, held), f"doc_id {kind}, score double, text_score double, page_score double")


def quality(docs: DataFrame, model: tuple[View, View] | None) -> DataFrame:
    """(doc_id, score, text_score, page_score) of each row: chances, from 0 to 1, that the document is good.

    text_score is by the words, page_score by source, language, length and layout; score joins them by the mean of
    their log-odds. The whole text is read. A null text is empty, an absent or null source or language a value of its
    own; repeated rows score alike; without a model all are 0.5. No shuffle; no rows give no rows.
    """
    return scores(features(docs), model)


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saved(with_labels(features(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels"), "quality", ~held_out()))
    return scores(found, fitted(found)).select("doc_id", held_out().alias("held_out"), "score", "text_score", "page_score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
