"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits, so copies with other punctuation or case are the same. The
n-grams of every test item are counted over all documents (in how many they occur), and all that occur are seeds.
Those in at most RARE documents lead straight to an alignment. Around the others, which an item leaked to a
great part of the corpus may have alone, a part of a document is aligned if it has enough of the item's
words: a match scores MATCH and nothing else scores, so fewer words cannot reach the least score and nothing
is missed. A document is aligned with the item around
the seed's place; the local alignment score over that of a full match decides, so that edited and
paraphrased copies count as well.

Benchmarks are taken in chunks of at most CHUNK bytes of text, each broadcast on its own and held against all
documents; there is no limit on the number of chunks. An item with fewer words than a seed is found where exactly
these words follow one another, with score 1. Items with null text or without words match nothing. Null and
empty documents match nothing. Repeated documents are found each. Extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches

SEED, RARE, CHUNK = 3, 20, 4 << 20
MATCH, MISS, GAP = 2, -1, -1

_WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(items: np.ndarray, lengths: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score and its end (column after the last) of each row of items (padded by -1) against its row of windows (padded by -2)."""
    n, width = windows.shape
    above, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(items.shape[1]):
        here = np.zeros_like(above)
        step = np.where(windows == items[:, i : i + 1], MATCH, MISS).astype(np.int32)
        here[:, 1:] = np.maximum(above[:, :-1] + step, above[:, 1:] + GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope  # gaps in the item, all at once
        here[i >= lengths] = 0
        top = here.max(1)
        more = top > best
        best[more], end[more] = top[more], here[more].argmax(1)
        above = here
    return best, end


class Index:
    """One chunk of test items: their words as numbers, and their n-grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        codes, owner, place, short = [], [], [], defaultdict(list)
        for item, text in items:
            seq = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            if len(seq) >= SEED:
                grams = self.grams(seq)
                codes.append(grams)
                owner.append(np.full(len(grams), len(self.items)))
                place.append(np.arange(len(grams)))
                self.ids.append(item)
                self.items.append(seq)
            elif len(seq):
                short[len(seq), int(self.grams(seq, len(seq))[0])].append((item, len(seq)))
        self.short = {n: dict(sorted((c, found) for (m, c), found in short.items() if m == n)) for n in {n for n, _ in short}}
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes, self.owner, self.place = flat[order], (np.concatenate(owner) if owner else np.empty(0, int))[order], (np.concatenate(place) if place else np.empty(0, int))[order]
        self.common = np.zeros(len(self.codes), bool)
        self.bags = [np.unique(seq, return_counts=True) for seq in self.items]
        self.use(np.ones(len(self.codes), bool))

    @staticmethod
    def grams(seq: np.ndarray, size: int = SEED) -> np.ndarray:
        s = seq.astype(np.uint64)
        return sum(s[k : len(s) - size + 1 + k] * _FACTORS[k] for k in range(size))

    def use(self, kept: np.ndarray) -> None:
        self.codes, self.owner, self.place, self.common = self.codes[kept], self.owner[kept], self.place[kept], self.common[kept]
        self.seeds, self.at = np.unique(self.codes, return_index=True)
        self.to = np.append(self.at[1:], len(self.codes))

    def rare(self, counts: dict[int, int]) -> None:
        """Drops n-grams that no document has and marks those in more than RARE documents."""
        n = np.array([counts.get(int(c), 0) for c in self.codes.view(np.int64)], np.int64)
        self.common = n > RARE
        self.use(n > 0)

    def numbers(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    def hits(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a document's words where a seed starts, and which."""
        if len(seq) < SEED or not len(self.seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = seq > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        s = seq.astype(np.uint64)
        codes = s[at] * _FACTORS[0] + s[at + 1] * _FACTORS[1] + s[at + 2] * _FACTORS[2]
        k = np.minimum(np.searchsorted(self.seeds, codes), len(self.seeds) - 1)
        real = self.seeds[k] == codes
        return at[real], k[real]

    def enough(self, seq: np.ndarray, item: int, least: float) -> bool:
        """Whether a part of a document has so many of the item's words that an alignment can score at least so much."""
        bag, most = self.bags[item]
        at = np.searchsorted(bag, seq)
        at[at == len(bag)] = 0
        there = np.bincount(at[bag[at] == seq], minlength=len(bag))
        return np.minimum(there, most).sum() / len(self.items[item]) >= least

    def windows(self, seq: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(item, from, to): parts of a document around seeds, merged where they overlap, that can score at least so much."""
        spans = defaultdict(list)
        for at, k in zip(*(x.tolist() for x in self.hits(seq)), strict=True):
            for j in range(self.at[k], self.to[k]):
                item = int(self.owner[j])
                size, slack = len(self.items[item]), len(self.items[item]) // 3 + 4
                first = at - int(self.place[j])
                spans[item].append((max(0, first - slack), min(len(seq), first + size + slack), not self.common[j]))
        out = []
        for item, found in spans.items():
            found.sort()
            a, b, sure = found[0]
            parts = []
            for x, y, rare in found[1:]:
                if x > b or max(b, y) - a > 4 * len(self.items[item]) + 64:
                    parts.append((a, b, sure))
                    a, b, sure = x, y, rare
                else:
                    b, sure = max(b, y), sure or rare
            parts.append((a, b, sure))
            out += [(item, a, b) for a, b, sure in parts if sure or self.enough(seq[a:b], item, least)]
        return out

    def exact(self, seq: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, first, end): the first place of each item that is too short for a seed."""
        for size, found in self.short.items():
            if len(seq) >= size:
                codes, first = np.unique(self.grams(seq, size), return_index=True)
                for k in np.flatnonzero(np.isin(codes, np.array(list(found), np.uint64))).tolist():
                    if (seq[first[k] : first[k] + size] > 0).all():
                        yield from ((item, int(first[k]), int(first[k]) + n) for item, n in found[int(codes[k])])

    def matches(self, texts: list[str | None], least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item_id, score, first word, end) of the best alignment with each item that scores at least so much."""
        tasks, seqs, whole = [], {}, []
        for row, text in enumerate(texts):
            seq = self.numbers(text)
            if self.short:
                whole += [(row, item, 1.0, a, b) for item, a, b in self.exact(seq)]
            if found := self.windows(seq, least):
                seqs[row] = seq
                tasks += [(row, *w) for w in found]
        tasks.sort(key=lambda t: (len(self.items[t[1]]), t[3] - t[2]))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for at in range(0, len(tasks), 256):
            part = tasks[at : at + 256]
            lengths = np.array([len(self.items[t[1]]) for t in part])
            width = max(t[3] - t[2] for t in part)
            items, rows = np.full((len(part), lengths.max()), -1), np.full((len(part), width), -2)
            back_items, back_rows = items.copy(), rows.copy()
            for k, (row, item, a, b) in enumerate(part):
                items[k, : lengths[k]], rows[k, : b - a] = self.items[item], seqs[row][a:b]
                back_items[k, : lengths[k]], back_rows[k, : b - a] = self.items[item][::-1], seqs[row][a:b][::-1]
            score, end = align(items, lengths, rows)
            share = score / (MATCH * lengths)
            good = np.flatnonzero(share >= least)
            if len(good):
                _, back = align(back_items[good], lengths[good], back_rows[good])
                for k, e in zip(good.tolist(), back.tolist(), strict=True):
                    row, item, a, b = part[k]
                    new = (float(share[k]), b - e, a + int(end[k]))
                    if new > best.get((row, item), (-1.0, 0, 0)):
                        best[row, item] = new
        return whole + [(row, self.ids[item], *m) for (row, item), m in best.items()]


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """An index with its counted seeds for each chunk of the benchmark."""
    bounded_batches(docs.sparkSession)
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // (CHUNK // 2)))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for c in range(chunks):
        index = Index([(r["item_id"], r["text"]) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).orderBy("item_id").toLocalIterator()])

        def count(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(index.seeds), np.int64)
            for b in batches:
                for text in b.column(0).to_pylist():
                    n[np.unique(index.hits(index.numbers(text))[1])] += 1
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(index.seeds[there].view(np.int64)), pa.array(n[there])], ["seed", "n"])

        counted = texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
        index.rare(dict(zip(counted["seed"].tolist(), counted["n"].tolist(), strict=True)))
        yield index


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: test items found in documents, best place of each."""
    out = None
    for index in indexes(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = index.matches(b.column(1).to_pylist(), least)
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]], ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that hold no test item, all their columns as they are."""
    at, out = docs.columns.index("text"), docs
    for index in indexes(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in index.matches(b.column(at).cast(pa.string()).to_pylist(), least)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
