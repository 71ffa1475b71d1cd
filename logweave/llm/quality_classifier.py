"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

A text's features are its words, word pairs, and the words' shapes (letter case,
digits and signs, runs collapsed) and shape pairs, hashed into ``2^18`` slots; a slot's value is
its share of the text's n-grams.  Weights are learnt by follow-the-regularised-leader
(proximal) updates; a score is the logistic of a sparse dot product.

Training uses at most ``max_train_rows`` labelled ids, the first in hash order, with one text each
(a bounded, documented sample, however many rows share an id); features are made in parallel and one task
runs the sequential updates over them.  Scoring reads every whole text once and
shuffles nothing; the weights, 1 MB, are broadcast.

Defined results: a null or empty text has no features and gets the score of the bias
alone; without labelled rows every score is 0.5; several labels of one id count
as the lowest; labels of unknown ids and null labels are ignored; repeated rows get
equal scores; an empty table gives no rows; extra columns pass through unless they
clash with a result column, which then replaces them.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import training_texts
from .hashing import MULTIPLY, groups, mix, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["held_out", "features", "ftrl", "train", "score_texts", "score_documents", "SLOTS"]

SLOTS = 1 << 18
RESULTS = ("held_out", "score", "predicted")
SCALE = 10.0  # of the shares, so that common n-grams have values about 1


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owner): the slots of all n-grams of ``texts``, and the text each belongs to."""
    w, owner, _, s = words_of(texts, shapes=True)
    both = owner[1:] == owner[:-1]
    again = (w[1:] == w[:-1]).astype(np.uint64)
    pairs, forms = w[:-1] * MULTIPLY + w[1:], (s[:-1] * MULTIPLY + s[1:]) * MULTIPLY + again
    hashes = np.concatenate([w, s, pairs[both], forms[both]])
    owners = np.concatenate([owner, owner, owner[1:][both], owner[1:][both]])
    return (mix(hashes) % np.uint64(SLOTS)).astype(np.int64), owners


def features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, counts) of each text."""
    slots, owner = grams(texts)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    slots = slots[order]
    return [np.unique(slots[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]


def _value(counts: np.ndarray) -> np.ndarray:
    return counts * (SCALE / max(1, counts.sum()))


def score_texts(texts: list, weights: np.ndarray) -> np.ndarray:
    slots, owner = grams(texts)
    sums = np.bincount(owner, weights=weights[slots], minlength=len(texts))
    n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    return 1.0 / (1.0 + np.exp(-np.clip(sums * (SCALE / n) + float(weights[SLOTS]), -35.0, 35.0)))


def ftrl(rows, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights (the bias last) after ``epochs`` passes over ``rows`` of (slots, counts, label)."""
    z, n, w = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(epochs):
        for slots, counts, label in rows:
            at = np.append(slots, SLOTS)
            x = np.append(_value(counts), 1.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(w[at] @ x, -35.0, 35.0)))
            g = (p - label) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            now = np.sqrt(n[at])
            z[at] += g - (now - root) / alpha * w[at]
            zz = z[at]
            w[at] = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + now) / alpha + l2))
    return w


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id's text leaves 0 modulo 5 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _feature_task(batches):
    for batch, first, texts in groups(batches):
        made, part = features(texts), batch.slice(first, len(texts))
        yield pa.RecordBatch.from_pydict({
            "label": part.column("label").cast(pa.int32()), "turn": part.column("turn"),
            "slots": pa.array([s.astype(np.int32) for s, _ in made], pa.list_(pa.int32())),
            "counts": pa.array([c.astype(np.int32) for _, c in made], pa.list_(pa.int32())),
        })


def _train_task(epochs):
    def run(batches):
        rows = []
        for pdf in batches:
            rows += [(np.array(s, np.int32), np.array(c, np.int32), y) for s, c, y in zip(pdf["slots"], pdf["counts"], pdf["label"])]
        if rows:
            yield pd.DataFrame({"weights": [ftrl(rows, epochs).astype(np.float32).tobytes()]})

    return run


def train(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = 10_000, epochs: int = 4, seed: int = 8) -> np.ndarray:
    """Weights from ``labels[doc_id, quality]`` outside the held-out fold and the texts of ``docs[doc_id, text]``."""
    known = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = training_texts(docs, known, max_train_rows, seed)
    made = rows.select("text", "label", "turn").mapInArrow(_feature_task, "label int, turn bigint, slots array<int>, counts array<int>")
    ordered = made.repartition(1).sortWithinPartitions("turn", "label", F.xxhash64("slots", "counts"))
    got = ordered.mapInPandas(_train_task(epochs), "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros(SLOTS + 1, np.float32)


def _score_task(weights, names):
    def run(batches):
        for batch, first, texts in groups(batches):
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_pydict({
                **{c: part.column(c) for c in names}, "score": pa.array(score_texts(texts, weights.value), pa.float64())
            })

    return run


def score_documents(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, keep_text: bool = True, **settings) -> DataFrame:
    """``docs`` plus ``held_out BOOLEAN, score DOUBLE, predicted INT`` (1 where ``score >= cut``).

    Only the text is an input of a score.  ``keep_text=False`` leaves the text out of the result."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **settings))
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    scored = docs.mapInArrow(_score_task(weights, [f.name for f in fields]), schema)
    return scored.select(
        *[F.col(f"`{f.name}`") for f in fields], held_out(F.col("doc_id")).alias("held_out"),
        "score", (F.col("score") >= cut).cast("int").alias("predicted"),
    )
