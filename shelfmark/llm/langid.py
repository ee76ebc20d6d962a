"""Language identification: string kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of distinct n-grams (lengths 1 to 3, of lower-case letters and their marks, the
Unicode categories L and M, with one space between words) present in both, over the root of the product of their own numbers. It is approximated
by landmark texts; ridge regression on the landmark kernel gives one score per language. The scores of a
batch are presence matrix x (landmark presence x coefficients): the inner product is the same for every
batch, so it is taken once, which changes nothing but the order of the products.

Fitted on a bounded sample: at most PER_LANG documents of each of the MAX_LANGS most frequent languages, the
first by a seeded hash of doc_id, and MAX_SAMPLE in all; MAX_LANDMARKS of them are landmarks. Every whole text is scored.

A null text or one without a letter gets `und` and score 0, and so does everything where no language was
learned. Null and repeated ids stay. Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches
from shelfmark.llm.ngrams import ngram_ids

PER_LANG, MAX_LANGS, MAX_SAMPLE, MAX_LANDMARKS = 800, 1000, 20_000, 384
ORDERS, BITS = (1, 2, 3), 17


def _classes(*kinds: str) -> str:
    """The characters of some Unicode categories (by their first letter), as ranges of a character class."""
    inside = np.array([unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


_OTHERS, _LETTER = re.compile(f"[^{_classes('L', 'M')}]+"), re.compile(f"[{_classes('L')}]")


def presence(text: str | None) -> np.ndarray | None:
    """Distinct n-gram ids, or None without a letter."""
    low = (text or "").lower()
    return ngram_ids(f" {_OTHERS.sub(' ', low).strip()} ", ORDERS, BITS) if _LETTER.search(low) else None


@dataclass
class Model:
    langs: list[str]
    product: np.ndarray  # landmark presence x coefficients: ids x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for first in range(0, len(texts), 128):
            rows = {k: r for k, t in enumerate(texts[first : first + 128], first) if (r := presence(t)) is not None}
            if not rows:
                continue
            at = list(rows)
            ids = np.concatenate([rows[k] for k in at])
            sizes = np.array([len(rows[k]) for k in at])
            sums = np.add.reduceat(self.product[ids], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / np.sqrt(sizes)[:, None]
            best = sums.argmax(1)
            for k, b, s in zip(at, best, sums[np.arange(len(at)), best], strict=True):
                names[k], scores[k] = self.langs[b], min(max((s + 1) / 2, 0.0), 1.0)
        return names, scores


def train(rows: list[np.ndarray], langs: list[str], ridge: float = 1e-3) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)))
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    each = max(1, MAX_LANDMARKS // len(names))
    marks = [k for n in names for k in [i for i, x in enumerate(langs) if x == n][:each]]
    sizes = np.array([len(r) for r in rows], np.float64)
    at, kernel = np.zeros(1 << BITS, np.float32), np.empty((len(rows), len(marks)))
    for j, k in enumerate(marks):
        at[rows[k]] = 1
        kernel[:, j] = [at[r].sum() for r in rows]
        at[rows[k]] = 0
    kernel /= np.sqrt(np.outer(sizes, sizes[marks]))
    own = kernel[marks]
    coefficients = np.linalg.lstsq(kernel.T @ kernel + ridge * len(rows) * own + 1e-8 * np.eye(len(marks)), kernel.T @ y, rcond=None)[0]
    product = np.zeros((1 << BITS, len(names)))
    for j, k in enumerate(marks):
        product[rows[k]] += coefficients[j] / np.sqrt(sizes[k])
    return Model(names, product)


def fit(docs: DataFrame, learnable: Column, seed: int = 5) -> Model:
    """learnable: a condition on doc_id for the rows to learn from."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = base.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.coalesce(learnable, F.lit(False))).select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    # a hash threshold leaves about twice as many rows as are wanted of each language, however many it has
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    near = known.join(F.broadcast(counts), "lang").where(F.shiftrightunsigned("h", 11) / float(1 << 53) * F.col("n") < 2 * PER_LANG)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= PER_LANG)
    chosen = first.orderBy("k", "lang").limit(MAX_SAMPLE).groupBy("doc_id").agg(F.min("lang").alias("known"), F.min("h").alias("h"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [presence(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([None if r is None else np.sort(r).tobytes() for r in rows], pa.binary())], ["doc_id", "known", "h", "ids"])

    found = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "known", "h", "text").mapInArrow(features, "doc_id long, known string, h long, ids binary")
    got = found.where("ids is not null").groupBy("doc_id").agg(F.min("known").alias("known"), F.min("h").alias("h"), F.min("ids").alias("ids")).toPandas().sort_values(["h", "doc_id"])
    return train([np.frombuffer(x, np.uint32) for x in got["ids"]], got["known"].tolist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
