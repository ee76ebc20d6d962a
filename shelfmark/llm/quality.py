"""Quality classifier: naive Bayes support vectors.

Indicators of character n-grams, and of word n-grams reduced to which of their words are equal, are scaled
by the log ratio of their smoothed class counts; a linear hinge loss is then fitted by dual coordinate descent, and the whole text is scored with the product of both.

The model is fitted on a bounded sample: at most PER_CLASS labelled documents of each class, the first by a
seeded hash of doc_id. Everything else covers every document and its whole text. Text is the only input.

Null and empty texts have no n-gram and get the score of the intercept. Label rows with a null doc_id or
quality are left out; repeated label rows vote, and a tie is label 1. Without labels of both classes the
score is the share of label 1, or 0.5 without any. Repeated documents and null ids stay; extra columns of
the documents, whatever their names, are ignored by fit and left out by score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches
from shelfmark.llm.ngrams import ngram_ids, pattern_ids

PER_CLASS = 2000
ORDERS, BITS = (1, 2, 3), 18
WIDTH = (1 << BITS) + 64


def features(text: str | None) -> np.ndarray:
    return np.concatenate((ngram_ids(text or "", ORDERS, BITS), pattern_ids(text or "") + np.uint32(1 << BITS)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            ids = features(text)
            if len(ids):
                out[k] += self.weights[ids].sum() / np.sqrt(len(ids))
        return 1 / (1 + np.exp(-2 * np.clip(out, -300, 300)))


def hinge_dual(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a hinge loss by dual coordinate descent; row k has scale[id] / sqrt(ids) at its ids and 1 for the bias."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(scale)), 0.0
    root = np.sqrt([max(1, len(r)) for r in rows])
    square = np.array([(scale[r] ** 2).sum() for r in rows]) / root**2 + 1
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            ids = rows[k]
            values = scale[ids] / root[k]  # not kept: one copy of the sample is enough for the driver
            slope = y[k] * (w[ids] @ values + bias) - 1
            new = min(max(alpha[k] - slope / square[k], 0.0), cost)
            step = (new - alpha[k]) * y[k]
            if step:
                w[ids] += step * values
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-3 * cost:
            break
    return w, bias


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 4.0, rounds: int = 20, seed: int = 3) -> Model:
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(WIDTH), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)) / 2))
    counts = {c: np.ones(WIDTH) for c in (0, 1)}
    for ids, c in zip(rows, labels, strict=True):
        counts[int(c)][ids] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = hinge_dual(rows, np.where(labels == 1, 1.0, -1.0), ratio, cost, rounds, seed)
    return Model(w * ratio, bias)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS, seed: int = 3) -> Model:
    """labels: doc_id, quality; learnable: a condition on doc_id for the rows to learn from."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & F.coalesce(learnable, F.lit(False)))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class) for c in (0, 1)]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.sort(features(t)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["doc_id", "label", "ids"])

    chosen = parts[0].unionByName(parts[1])  # at most 2 x per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(collect, "doc_id long, label int, ids binary")
    got = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("ids").alias("ids")).toPandas().sort_values("doc_id")
    rows = [np.frombuffer(x, np.uint32) for x in got["ids"]]
    return train(rows, got["label"].to_numpy(np.int64), seed=seed)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep (the last of them text, which is replaced by score)."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(keep[:-1]).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(b.column(b.num_columns - 1).to_pylist()))], [*keep[:-1], "score"])

    return docs.select(keep).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score of 0.5 or more, all their columns as they are."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).cast(pa.string()).to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
