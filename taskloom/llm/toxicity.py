"""Toxicity of documents: a recurrent network scores every overlapping window, and the worst and the mean decide."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recurrent as net
from .common import load, ready
from .words import give_back, text_slices

#: Labelled rows of either class that the network is fitted on, and the longest text of these (bytes).
SAMPLE, LONGEST = (1200, 1600), 16_000
SLICE = 1 << 19
#: Log-likelihood ratio from which an n-gram marks a window in the first round: more than chance gives any of them.
TELLING = 22.0
#: Ridge on the weights with which a document's windows are put together.
RIDGE = 1.0
#: What a toxic text weighs there against another one: a miss is worse than a false alarm.
WEIGHT = 2.0
#: Score from which a document counts as toxic.
CUT = 0.7


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most most[1] rows of label 0 and most[0] of label 1: those of the least hash of doc_id
    among usable labelled rows with a text of 1 to LONGEST bytes. A row labelled twice takes the higher label; of rows with
    one doc_id the text of the least hash counts."""
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    size = F.octet_length("text")
    have = docs.where((size > 0) & (size <= LONGEST)).select("doc_id").join(known, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = have.where("y = 1").orderBy(*order).limit(most[0]).union(have.where("y = 0").orderBy(*order).limit(most[1]))
    # At most most[0] + most[1] ids are broadcast.
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect(), have.schema))
    rows = docs.select("doc_id", "text").where((size > 0) & (size <= LONGEST)).join(chosen, "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").cast("int").alias("y"))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, y) of the whole sample, in one task -> the model as bytes."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    model = train([(text, y) for _, text, y in rows])
    if model is not None:
        out = io.BytesIO()
        np.savez(out, **model)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])
    del rows
    give_back()


def fitted(some: DataFrame) -> dict | None:
    """The model of a sample(), whose size is bounded: fitted in one task, so that a driver of any size will do and a lost
    executor costs a second fit."""
    ready(some.sparkSession)
    found = some.repartition(1).mapInArrow(_trained, "model binary").collect()
    return dict(np.load(io.BytesIO(found[0]["model"]))) if found else None


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _seeds(v: dict, y: np.ndarray) -> np.ndarray:
    """For each distinct word, the highest log-likelihood ratio for the positive class over its n-grams, by the texts
    that hold them."""
    out = np.full(len(v["word"]), -9.0)
    for rows, count in (("grams", "n"), ("heads", "n_heads")):
        ends, hits = np.cumsum(v[count]), np.zeros((2, net.TABLE))
        for i in range(len(y)):  # a text's n-grams are many times its size, so they are counted text by text
            word = np.unique(v["at"][v["rows"][i] : v["rows"][i + 1]])
            n = v[count][word]
            hits[int(y[i]), np.unique(v[rows][np.repeat(ends[word] - n, n) + net.ragged(n)])] += 1
        b, a = hits
        p1, p0 = a / max((y == 1).sum(), 1), b / max((y == 0).sum(), 1)
        rate, xlog = (y == 1).mean(), lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(e, 1e-9)), 0)
        odds = np.where(p1 > p0, 2.0, -2.0) * (xlog(a, (a + b) * rate) + xlog(b, (a + b) * (1 - rate)))
        full = np.flatnonzero(v[count])
        if len(full):
            out[full] = np.maximum(out[full], np.maximum.reduceat(odds[v[rows]], (ends - v[count])[full]))
    return out


def train(rows: list[tuple[str, int]], seed: int = 3, steps: tuple[int, ...] = (300,)) -> dict | None:
    """The network's weights and its scale; None unless both classes have rows.

    Only texts are labelled, not windows: the first round takes from each toxic text the windows with telling n-grams;
    further rounds, if any, those that the network of the round before finds toxic. From other texts come windows at
    random and the worst one of each. A fifth of the texts is kept back, to weigh the evidence of a text's windows.
    More rounds and steps learn single words by heart, and rare ones are then found less often: one round is best.
    """
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    v = net.vocabulary(*_texts([r[0] for r in rows]))
    first, size, text = net.windows(v["rows"])
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.2
    for c in (0, 1):  # either class needs rows on both sides
        own = np.flatnonzero(y == c)
        if back[own].all() or not back[own].any():
            back[own] = np.arange(len(own)) % 5 == 0 if len(own) > 1 else False
    word = _seeds(v, np.where(back, 0, y)) if not back.all() else np.zeros(len(v["word"]))
    most, found = np.empty(len(first)), np.empty(len(first))
    for i in range(0, len(first), 8192):
        idx, mask = net.gather(v, first[i : i + 8192], size[i : i + 8192])
        cover = np.sort(np.where(mask, np.append(word, -9.0)[idx], -9.0), 0)
        most[i : i + 8192], found[i : i + 8192] = cover[-1], cover[-3:].sum(0) + cover[-1]
    p = net.fresh(seed)
    for k, n in enumerate(steps):
        order = np.lexsort((-found, text))
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        rank = np.empty(len(order), int)
        rank[order] = place
        train_side = ~back[text]
        pos = np.flatnonzero(train_side & (y[text] == 1) & ((most > TELLING) if k == 0 else (found > 0)))
        if len(pos) < 10:
            pos = np.flatnonzero(train_side & (y[text] == 1) & (rank == 0))
        neg = np.flatnonzero(train_side & (y[text] == 0) & ((rng.random(len(text)) < 0.35) | (rank == 0)))
        if not len(pos) or not len(neg):
            break
        pick = np.concatenate([pos, neg])
        net.fit(p, v, first[pick], size[pick], y[text[pick]].astype(np.float32), (found[pick] > -4) & (k > 0), n, seed + k)
        found = net.logits(p, v, first, size)
    held = back if (back & (y == 1)).any() and (back & (y == 0)).any() else np.ones(len(y), bool)
    return p | {"scale": _scale(evidence(found, text, len(y))[held], y[held])}


def evidence(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """What the windows say of each of n texts: the worst window's logit, and the logit of the mean chance over all of
    its windows; -20 for both without a window. text: the number of each window's text."""
    x = np.clip(logits, -20, 20)
    worst, total = np.full(n, -20.0), np.bincount(text, 1 / (1 + np.exp(-x)), n)
    np.maximum.at(worst, text, x)
    mean = np.clip(total / np.maximum(np.bincount(text, minlength=n), 1), 2e-9, 1 - 2e-9)
    return np.stack([worst, np.log(mean / (1 - mean))], 1)


def _scale(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the evidence and a constant, by logistic regression on kept-back texts: a chance of being toxic.
    Targets are drawn in a little from 0 and 1; a ridge holds both weights near a quarter, and none is below 0."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    each = np.where(y == 1, WEIGHT, 1.0)
    f = np.concatenate([f / 4, np.ones((len(f), 1))], 1)
    prior, free = np.array([1.0, 1.0, 0.0]), np.ones(3, bool)
    w = prior.copy()
    for _ in range(60):
        q = 1 / (1 + np.exp(-f @ w))
        grad = f.T @ (each * (q - t)) + RIDGE * (w - prior) * [1, 1, 0]
        hess = (f * (each * q * (1 - q))[:, None]).T @ f + RIDGE * np.diag([1, 1, 1e-3])
        w[free] -= np.clip(np.linalg.solve(hess[np.ix_(free, free)], grad[free]), -1, 1)
        if (w[:2] < 0).any():
            free[:2] &= w[:2] >= 0
            w[:2] = np.maximum(w[:2], 0)
    return w * [0.25, 0.25, 1]


def _scored(batches: Iterator[pa.RecordBatch], held, text_column: str, given: bool) -> Iterator[pa.RecordBatch]:
    """batches with `_score`; given: the text column is one of the result's."""
    p = held.value
    for batch in batches:
        score = np.zeros(len(batch))
        if p is not None:
            for i, j, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text_column)), SLICE):
                v = net.vocabulary(data, offsets)
                first, size, text = net.windows(v["rows"])
                f = evidence(net.logits(p, v, first, size), text, j - i)
                score[i:j] = 1 / (1 + np.exp(-(f @ p["scale"][:2] + p["scale"][2])))
                give_back()
        names = [n for n in batch.schema.names if given or n != text_column]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(score)], names=[*names, "_score"])


def toxicity(docs: DataFrame, model: dict | None, text: str = "text", score: str = "score") -> DataFrame:
    """The columns of docs and `score` (0 to 1; the name may be another): the chance that the text is toxic.

    Windows are net.WINDOW words, one every net.STRIDE, up to the end of the whole text; the worst one and the mean of
    all are weighed together (evidence()). Null and empty texts, and texts without a letter
    or digit, score as a text in which nothing was found; without a model every score is 0. Equal texts score alike,
    whatever their other columns. A column `score` of docs is replaced. No shuffle; no rows give no rows.
    """
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # the weights: tables of a fixed size
    own = [f for f in docs.schema if f.name != score]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "_score double"])
    given = text != score
    rows = docs.select(*[F.col(f"`{f.name}`") for f in own], *([] if given else [F.col(f"`{text}`").alias("_text")]))
    return rows.mapInArrow(lambda it: _scored(it, held, text if given else "_text", given), kinds).withColumnRenamed("_score", score)


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fitted(sample(docs, load(spark, sf_dir, "labels"), "toxic", ~held_out()))
    scored = toxicity(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
