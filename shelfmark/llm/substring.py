"""Removal of passages that an earlier document already holds, by suffix automata of reference shards.

1. Routing. Every window of WINDOW words gets a 64-bit hash, a polynomial of its bytes read off prefix sums. Per
   batch of documents equal windows are combined: the smallest doc_id speaks for the batch. What is left is packed
   by bucket of the hash, one row for each batch and bucket; a bucket tells each document which windows have an
   owner, a document with a smaller id, and each owner which of its windows others hold.
2. References. Owned windows, run together to passages, are the references; they are as large as the repeated
   part of the corpus taken once, and are dealt into shards by owner, as many as keep each within SHARD bytes of text.
3. Automata. Each shard's references become one suffix automaton of words whose states know the smallest
   document they occur in. Of every document the runs of windows that have an owner in a shard stream through its
   automaton; matching statistics of WINDOW words or more in a smaller document mark the words to remove. A shard that
   many documents stream against goes to as many tasks as it needs. (Whole documents instead, once for each shard they
   touch, find the same and need more disk than there is: see README.)
4. The automaton compares words, so equal hashes of different windows remove nothing. Windows that were led to a shard
   by such a hash and found nothing there are held against each other as words, so that they lose nothing either.
5. The marked words are cut from the texts.

Automata of the whole corpus sent to every executor would neither fit nor scale (every document against every
shard); the routing sends a document only to the shards that can hold its passages.

Tasks hold a bucket or a shard at a time; both are cut by the bytes of the corpus, so that they stay as large as they
are however much it grows.

Null and empty texts have no words. A document with a null doc_id has nothing removed and removes nothing; negative
ids are ids. Rows with one doc_id are judged alike and do not remove each other's words. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches, materialize

WINDOW = 13
#: Bytes of the corpus for each bucket of hashes, each bucket of documents, each shard of references.
HASHES, TEXTS, SHARD = 24 << 20, 24 << 20, 4 << 20
#: Bytes of text whose windows are combined at once.
BATCH = 12 << 20
_MASK = np.uint64((1 << 56) - 1)
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        found = np.empty(size, np.uint64)
        found[0], have = 1, 1
        while have < size:
            found[have : 2 * have] = found[:have] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        _powers[base] = found
    return found[:n]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """Hash of each run of so many words."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    flat = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTES[flat] * _power(_STEP, len(flat)), out=sums[1:])
    a, b = starts[: len(words) - window + 1], ends[window - 1 :]
    h = (sums[b] - sums[a]) * _power(_BACK, len(flat))[a]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pack(docs: np.ndarray, owners: np.ndarray, hashes: np.ndarray) -> bytes:
    """Sorted by docs and owners: each pair once, as differences of docs and distances to owners, their counts, 7 bytes of each hash."""
    new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (owners[1:] != owners[:-1]))))
    counts = np.diff(np.append(new, len(docs))).astype(np.int32)
    low = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7]
    return np.int64(len(new)).tobytes() + np.diff(docs[new], prepend=np.int64(0)).tobytes() + (docs[new] - owners[new]).tobytes() + counts.tobytes() + low.tobytes()


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs, owners, hashes (their lower 56 bits) of all blobs."""
    out: tuple[list, list, list] = ([], [], [])
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        docs = np.cumsum(np.frombuffer(blob, np.int64, n, 8))
        owners = docs - np.frombuffer(blob, np.int64, n, 8 + 8 * n)
        counts = np.frombuffer(blob, np.int32, n, 8 + 16 * n)
        low = np.frombuffer(blob, np.uint8, -1, 8 + 20 * n).reshape(-1, 7)
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :7] = low
        for k, part in enumerate((np.repeat(docs, counts), np.repeat(owners, counts), full.view(np.uint64).ravel())):
            out[k].append(part)
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.uint64), strict=True))


def prime(n: int) -> int:
    """The first prime from n on: a modulus that leaves ids with a common factor spread out."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def packed(kind: int, bucket: np.ndarray, docs: np.ndarray, owners: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(kind, bucket, blob) for each bucket that has rows."""
    if not len(docs):
        return []
    order = np.lexsort((owners, docs, bucket))
    bucket, docs, owners, hashes = bucket[order], docs[order], owners[order], hashes[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    to = np.append(at[1:], len(bucket))
    return [(kind, int(bucket[a]), pack(docs[a:b], owners[a:b], hashes[a:b])) for a, b in zip(at.tolist(), to.tolist(), strict=True)]


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "bucket", "blob"])


def owned(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash), the smallest doc of each hash, and whether the hash has another doc."""
    order = np.lexsort((docs, hashes))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    docs, hashes = docs[new], hashes[new]
    first = np.ones(len(docs), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    group = np.cumsum(first) - 1
    return docs, hashes, docs[first][group], np.bincount(group, minlength=1)[group] > 1 if len(docs) else np.empty(0, bool)


def _scan(window: int, buckets: int, doc_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            docs, hashes, least, several = owned(np.repeat(np.array(ids, np.int64), [len(f) for f in found]), np.concatenate(found))
            ask = docs == least
            rows = packed(0, ((hashes[ask] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), docs[ask], docs[ask], hashes[ask])
            return rows_of(rows + packed(1, (docs[several] % doc_buckets).astype(np.int32), docs[several], least[several], hashes[several]))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                h = window_hashes(split(text), window)
                if len(h):
                    ids.append(doc)
                    found.append(h)
                    size += len(text)
                if size > BATCH:
                    yield flush()
                    ids, found, size = [], [], 0
        if found:
            yield flush()

    return run


def _answer(doc_buckets: int):
    """Rows of kind 0, bucket by bucket, become answers (doc, owner, hash) by bucket of doc; those of kind 1 are answers already. Answers are packed anew some millions at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, ready, held = -1, [], [], 0

        def answer() -> None:
            nonlocal blobs, held
            docs, _, hashes = unpack(blobs)
            docs, hashes, least, several = owned(docs, hashes)
            ready.append((docs[several], least[several], hashes[several]))
            held += int(several.sum())
            blobs = []

        def flush() -> pa.RecordBatch:
            nonlocal ready, held
            docs, owners, hashes = (np.concatenate([r[k] for r in ready]) for k in range(3))
            ready, held = [], 0
            return rows_of(packed(1, (docs % doc_buckets).astype(np.int32), docs, owners, hashes))

        for b in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind:
                    ready.append(unpack([blob]))
                    held += len(ready[-1][0])
                else:
                    if bucket != now and blobs:
                        answer()
                    now = bucket
                    blobs.append(blob)
                if held > 3_000_000:
                    yield flush()
        if blobs:
            answer()
        if ready:
            yield flush()

    return run


def _by_doc(docs: np.ndarray, *columns: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Columns by doc, each in the order given; docs are sorted."""
    if not len(docs):
        return {}
    at = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return dict(zip(docs[at].tolist(), zip(*(np.split(c, at[1:]) for c in columns), strict=True), strict=True))


def _passages(window: int, shards: int):
    """Runs of windows that have an owner (role 1, by the owner's shard) and of windows that others hold (role 0)."""
    runs = pa.list_(pa.int64())
    fields = (("shard", pa.int32()), ("role", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("firsts", runs), ("ends", runs), ("n_words", pa.int64()), ("words", pa.binary()))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        docs, owners, hashes = unpack(right.column("blob").to_pylist())
        out: list[tuple] = []

        def by_doc(chosen: np.ndarray) -> dict:
            d, o, h = docs[chosen], owners[chosen], hashes[chosen]
            order = np.lexsort((o, h, d))
            return _by_doc(d[order], h[order], o[order])

        copied, lent = by_doc(owners != docs), by_doc(owners == docs)
        seen = set()
        for doc, row, text in zip(*(left.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            if doc not in copied and doc not in lent or (doc, row) in seen:
                continue
            seen.add((doc, row))
            words = split(text)
            own = window_hashes(words, window) & _MASK
            if not len(own):
                continue
            for role, found in ((1, copied.get(doc)), (0, lent.get(doc))):
                if found is None:
                    continue
                at = np.searchsorted(found[0], own)  # the first of equal hashes has the smallest owner
                at[at == len(found[0])] = 0
                shard = np.where(found[0][at] == own, found[1][at] % shards, -1)  # no remainder of a positive modulus is below zero
                edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                parts: dict[int, list[tuple[int, int]]] = {}
                for a, b in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist(), strict=True):
                    if shard[a] >= 0:
                        parts.setdefault(int(shard[a]), []).append((a, b + window - 1))
                for k, spans in parts.items():
                    firsts, ends = [a for a, _ in spans], [b for _, b in spans]
                    out.append((k, role, doc, row, firsts, ends, sum(ends) - sum(firsts), b"\n".join(b" ".join(words[a:b]) for a, b in spans)))
        cols = list(zip(*out, strict=True)) if out else [[]] * len(fields)
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(fields, cols, strict=True)})

    return run


class Automaton:
    """Suffix automaton of several passages of words; a state knows the smallest document that any of its strings ends in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]
        self.ids: dict[bytes, int] = {}

    def _state(self, length: int, link: int, arcs: dict[int, int], least: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def add(self, doc: int, words: list[bytes]) -> None:
        nxt, link, length, least, ids = self.next, self.link, self.length, self.least, self.ids
        last = 0
        for word in words:
            c = ids.setdefault(word, len(ids))
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:  # an earlier passage has been here
                last = q
            else:
                new = -1 if q is not None else self._state(length[last] + 1, 0, {}, 1 << 63)
                p = last
                if q is None:
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = new
                        p = link[p]
                    q = nxt[p][c] if p >= 0 else None
                if q is None:
                    last = new
                elif length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                else:
                    twin = self._state(length[p] + 1, link[q], dict(nxt[q]), least[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = twin
                    if new >= 0:
                        link[new] = twin
                        last = new
                    else:
                        last = twin
            if doc < least[last]:
                least[last] = doc

    def finish(self) -> None:
        """What ends in a state ends in those it links to."""
        link, least = self.link, self.least
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def covered(self, doc: int, words: list[bytes], window: int) -> list[int]:
        """Places where a run of window words ends that a smaller document holds."""
        nxt, link, length, least, ids = self.next, self.link, self.length, self.least, self.ids
        s = n = 0
        out = []
        for i, word in enumerate(words):
            c = ids.get(word, -1)
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(c, -1)
            if s < 0:
                s = n = 0
                continue
            n += 1
            if n >= window:
                while length[link[s]] >= window:  # a shorter match, down to the window, is in more places
                    s = link[s]
                    n = length[s]
                if least[s] < doc:
                    out.append(i)
        return out


def _stream(window: int):
    """Spans that a smaller document holds; and windows led to this shard that are not among them, as words."""
    def run(table: pa.Table) -> pa.Table:
        automaton, names = Automaton(), ("role", "doc", "row", "firsts", "ends", "words")
        rows = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
        for role, doc, _, _, _, words in rows:
            if role == 0:
                for passage in words.split(b"\n"):
                    automaton.add(doc, passage.split(b" "))
        automaton.finish()
        found: list[tuple] = []
        for role, doc, row, firsts, ends, text in rows:
            if role == 0:
                continue
            passages = [p.split(b" ") for p in text.split(b"\n")]
            starts = np.concatenate([np.array(automaton.covered(doc, p, window), np.int64) + (first - window + 1) for first, p in zip(firsts, passages, strict=True)])
            edge = np.flatnonzero(np.diff(starts, prepend=-window - 1) > window) if len(starts) else starts
            a = starts[edge]
            b = starts[np.append(edge[1:] - 1, len(starts) - 1)] + window if len(starts) else starts
            there = set(starts.tolist())
            lost = [{"first": x, "words": b" ".join(p[x - first : x - first + window])} for first, end, p in zip(firsts, ends, passages, strict=True) for x in range(first, end - window + 1) if x not in there]
            if len(a) or lost:
                found.append((doc, row, a, b, lost))
        cols = list(zip(*found, strict=True)) if found else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.binary())])))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc", "row", "firsts", "ends", "lost"), cols, types, strict=True)})

    return run


def _cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    marked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, row, firsts, ends in zip(*(right.column(c).to_pylist() for c in ("doc", "row", "firsts", "ends")), strict=True):
        marked.setdefault((doc, row), []).extend(zip(firsts, ends, strict=True))
    n, gone, kept, spans = [], [], [], []
    for doc, row, text in zip(*(left.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
        words = split(text)
        cover = np.zeros(len(words) + 1, np.int32)
        for a, b in marked.get((doc, row), ()):
            cover[a] += 1
            cover[b] -= 1
        out = np.cumsum(cover[:-1]) > 0
        n.append(len(words))
        gone.append(int(out.sum()))
        kept.append(b" ".join(compress(words, (~out).tolist()) if gone[-1] else words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
        spans.append([{"first": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, span)})


def without_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space, in UTF-8), spans (words removed, from first to before end)."""
    spark = docs.sparkSession
    bounded_batches(spark, 16)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, doc_buckets, shards = max(4 * parts, size // HASHES), prime(max(3 * parts, size // TEXTS)), prime(max(4 * parts, size // SHARD))
    schema = "kind int, bucket int, blob binary"
    asked = base.mapInArrow(_scan(window, buckets, doc_buckets), schema).repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    answers = materialize(asked.mapInArrow(_answer(doc_buckets), schema)).select("bucket", "blob")
    # rows with one doc_id are told apart by their texts; those without are dealt by them, as nothing joins them
    text = F.xxhash64("text")
    held = base.withColumn("row", text).withColumn("bucket", F.pmod(F.coalesce("doc_id", text), F.lit(doc_buckets)).cast("int"))
    passages = held.where("doc_id is not null").groupBy("bucket").cogroup(answers.groupBy("bucket"))
    passages = materialize(passages.applyInArrow(_passages(window, shards), "shard int, role int, doc long, row long, firsts array<long>, ends array<long>, n_words long, words binary"))
    # a shard's automaton goes to as many tasks as its documents need for even shares: one row a shard decides
    load = passages.groupBy("shard").agg(F.coalesce(F.sum(F.when(F.col("role") == 1, F.col("n_words"))), F.lit(0)).alias("asked"))
    share = max(20_000, 2 * (load.agg(F.avg("asked")).first()[0] or 0))
    load = load.where("asked > 0").select("shard", F.ceil(F.col("asked") / share).cast("int").alias("tasks"))
    dealt = passages.join(load, "shard").withColumn("task", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.expr("pmod(xxhash64(doc), tasks)").cast("int")))))
    streamed = dealt.select("shard", "task", "role", "doc", "row", "firsts", "ends", "words").groupBy("shard", "task")
    streamed = materialize(streamed.applyInArrow(_stream(window), "doc long, row long, firsts array<long>, ends array<long>, lost array<struct<first:long,words:binary>>"))
    lost = streamed.select("doc", "row", F.explode("lost").alias("w")).select("doc", "row", "w.first", "w.words")
    owner = lost.groupBy("words").agg(F.min("doc").alias("owner"))
    again = lost.join(owner, "words").where("doc > owner").select("doc", "row", F.array("first").alias("firsts"), F.array(F.col("first") + window).alias("ends"))
    spans = streamed.where(F.size("firsts") > 0).drop("lost").unionByName(again).withColumn("bucket", F.pmod("doc", F.lit(doc_buckets)).cast("int"))
    return held.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<first:long,end:long>>")
