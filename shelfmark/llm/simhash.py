"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has one or more lanes of 64 bits, each from its own mix of the shingles' hashes. Two lanes that
differ in at most d bits (d < 8) agree in at least 8 - d of their eight positional bytes. The index posts each
distinct fingerprint under every choice of `posted` positions with the bytes found there: intersections of so
many single byte lists, as the lists themselves (2,048 of them) would each hold a 256th of the corpus. A pair
that meets in a posting shares `posted` bytes; all its shared positional bytes are tallied, pairs below the
guaranteed minimum 8 - d, which is more than were posted, go, and the others are verified by the number of
differing bits. Every pair that reaches the minimum meets in a posting, so nothing is missed.

For a similarity s of shingle sets (similar_groups) the expected share of differing bits is
acos(2 s / (1 + s)) / pi, too many for a guarantee: five lanes of distinct shingles with two positional bytes at
once then give each pair many chances (see README for recall). What meets there is only a candidate: texts of
candidates that hang together are gathered and linked by their exact similarity.

A posting larger than a block is dealt out as pairs of blocks, and each task returns a spanning forest of
the links it finds, never all pairs. Equal fingerprints are one class from the start.

Null or empty texts have the fingerprint zero and are linked like any other. Rows with a null doc_id link like
any other; their component's id is the smallest of the ids there, null if it has none. Repeated rows stay. Columns
besides doc_id and text are ignored, and passed through by one_of_each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfmark.llm.common import bounded_batches, connected_components, materialize, smallest

BLOCK = 2048
#: Texts and shingles of a block in which candidates are held against each other.
GROUP, SHINGLES = 512, 1 << 21
#: The node of texts without a word.
_EMPTY = int(np.array([xxhash.xxh64_intdigest(b"")], np.uint64).view(np.int64)[0])


def fingerprint(text: bytes | None, words: int, lanes: int = 1) -> np.ndarray:
    """One unsigned number a lane: bit k is set if it is set in over half of the shingles' hashes, XXH64 (seed 42) in the first lane, mixed anew in others."""
    hashes = shingles(text, words)
    return signs(hashes, lanes) if len(hashes) else np.zeros(lanes, np.uint64)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, or of all words where there are no more."""
    parts = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not parts:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(flat[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def signs(hashes: np.ndarray, lanes: int) -> np.ndarray:
    out = np.empty(lanes, np.uint64)
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            ones += np.unpackbits(mixed(hashes[at : at + 65536], lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return hashes
    h = hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def columns(lanes: int) -> list[str]:
    return [f"fp{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """doc_id, fp0, fp1, … (64 bits each as a signed long)."""
    bounded_batches(docs.sparkSession)
    names = columns(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, lanes) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fps[:, k]) for k in range(lanes)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *names]))


def near(apart: np.ndarray, bits: int, least: int) -> np.ndarray:
    """Of differences (rows of lanes): those with enough equal positional bytes that differ in few enough bits."""
    kept = (np.ascontiguousarray(apart).view(np.uint8).reshape(len(apart), 8 * apart.shape[1]) == 0).sum(1) >= least
    kept[kept] = np.bitwise_count(apart[kept]).sum(1) <= bits
    return kept


def forest(fps: np.ndarray, ids: np.ndarray, bits: int, least: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints at most so many bits apart: tally, keep, verify."""
    fps = fps.reshape(len(ids), -1)
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            found = near(fps[left] ^ fps[at], bits, least)
            if found.any():
                out += [(int(ids[at]), int(ids[x])) for x in left[found]]
                queue += list(left[found])
                left = left[~found]
    return out


class Stars:
    """Linked nodes of one task: each with the smallest node of its component there."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def join(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b, strict=True):
            x, y = self.find(x), self.find(y)
            if x < y:
                self.up[y] = x
            elif y < x:
                self.up[x] = y

    def links(self) -> Iterator[pa.RecordBatch]:
        nodes = [x for x in self.up if self.up[x] != x]
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([self.find(x) for x in part], pa.int64())], ["a", "b"])


def _link_runs(lanes: int, bits: int, least: int, small: int = 6):
    """Stars of what a task's runs link: the same few links come from different tasks, so that distinct() leaves about one for each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * (3 + lanes)  # without lanes a node is its own fingerprint
        stars = Stars()

        def take(cols: list[np.ndarray]) -> None:
            key, cell, rep = cols[:3]
            fps = np.stack(cols[3:] or cols[2:], 1).view(np.uint64)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(key)))
            size, run_of = np.repeat(n, n), np.cumsum(new) - 1
            for step in range(1, small):  # small runs: all their pairs, many runs at once
                i = np.flatnonzero((run_of[step:] == run_of[:-step]) & (size[:-step] <= small))
                i = i[near(fps[i] ^ fps[i + step], bits, least)]
                stars.join(rep[i].tolist(), rep[i + step].tolist())
            for s, m in zip(at[n > small].tolist(), n[n > small].tolist(), strict=True):
                if tree := forest(fps[s : s + m], rep[s : s + m], bits, least):
                    stars.join(*zip(*tree, strict=True))

        for batch in batches:
            new = [np.concatenate((k, np.asarray(c))) for k, c in zip(kept, batch.columns, strict=True)]
            key, cell = new[:2]
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                take([c[:end] for c in new])
            kept = [c[end:] for c in new]
        if len(kept[0]):
            take(kept)
        yield from stars.links()

    return run


def fingerprint_links(fingerprints: DataFrame, bits: int, posted: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp0) at most so many bits apart, found in postings of so many positional bytes, no more than the 8 - bits that such pairs share at least."""
    least = 8 - bits
    if not 1 <= posted <= least:
        raise ValueError("postings of more positional bytes than near fingerprints share would miss some")
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row for each choice of positions, its key computed after: an array of all keys is too much code to compile
    names = "abcd"[:posted]
    choices = [(n, *(8 * k for k in chosen)) for n, chosen in enumerate(combinations(range(8), posted))]
    choice = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(["n", *names], values, strict=True)]) for values in choices])
    key = F.col("c.n").cast("long")
    for c in names:
        key = F.shiftleft(key, 8).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp0"), F.col(f"c.{c}")).bitwiseAND(F.lit(255)))
    # a small table has few files, and each row of it becomes many
    listed = fingerprints.select("fp0").repartition(parts, "fp0").withColumn("c", F.explode(choice)).select(key.alias("key"), "fp0")
    shared = materialize(listed.groupBy("key").count().where("count > 1"))
    met = listed.join(shared.hint("merge"), "key").withColumn("n", F.ceil(F.col("count") / BLOCK).cast("long")).withColumn("k", F.expr("pmod(xxhash64(fp0), n)"))
    cell = (F.least("k", "j") * F.col("n") + F.greatest("k", "j")).alias("cell")
    dealt = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", cell, "fp0")
    return dealt.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_link_runs(0, bits, least), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 4, bits: int = 4, posted: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most so many bits, itself included)."""
    if not 4 <= bits < 8:
        raise ValueError("bits must be 4 to 7: eight positional bytes guarantee one to four that are equal")
    prints = materialize(fingerprints(docs, words))
    classes = materialize(prints.groupBy("fp0").agg(F.min("doc_id").alias("doc_id")))
    roots = connected_components(fingerprint_links(classes, bits, min(posted, 8 - bits)))
    named = classes.join(roots, classes.fp0 == roots.node, "left").select("fp0", "doc_id", F.coalesce("root", "fp0").alias("root"))
    found = smallest(named).select("fp0", "component_id")
    return prints.join(found.hint("merge"), "fp0").select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def _sketches(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """row (its number, fixed by being written), id, node (a number for the set of shingles), n (how many), fp0, fp1, … of the set, text and the whole document."""
    bounded_batches(docs.sparkSession)
    names = columns(lanes)
    made = ["node", "n", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t, words)) for t in b.column(2).cast(pa.binary()).to_pylist()]
            fps = np.array([signs(s, lanes) if len(s) else np.zeros(lanes, np.uint64) for s in sets], np.uint64).reshape(-1, lanes).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(fps[:, k]) for k in range(lanes)]], [*b.schema.names, *made])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(c, LongType()) for c in made]]))


def _candidates(nodes: DataFrame, lanes: int, bits: int) -> DataFrame:
    """(a, b): links between nodes (node, fp0, …) that share two positional bytes of a lane and differ in at most so many bits of it and the next."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    choices = [(lane, n, 8 * a, 8 * b) for lane in range(lanes) for n, (a, b) in enumerate(combinations(range(8), 2))]
    choice = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(["lane", "n", "a", "b"], values, strict=True)]) for values in choices])
    fps = F.array(*columns(lanes))
    key = (F.col("c.lane") * 100 + F.col("c.n")).cast("long")
    for c in "ab":
        key = F.shiftleft(key, 8).bitwiseOR(F.call_function("shiftrightunsigned", F.col("own"), F.col(f"c.{c}")).bitwiseAND(F.lit(255)))
    spread = nodes.repartition(parts, "node").withColumn("c", F.explode(choice))
    posted = spread.select("c", "node", F.get(fps, F.col("c.lane")).alias("own"), F.get(fps, (F.col("c.lane") + 1) % lanes).alias("next")).select(key.alias("key"), "node", "own", "next")
    large = materialize(posted.groupBy("key").count().where(F.col("count") > BLOCK))
    held = posted.join(large, "key", "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("long")).withColumn("k", F.expr("pmod(xxhash64(node), n)"))
    cell = (F.least("k", "j") * F.col("n") + F.greatest("k", "j")).alias("cell")
    dealt = held.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", cell, "node", "own", "next")
    return dealt.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_link_runs(2, bits, 2), "a long, b long")


def resembling(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of sets of distinct numbers whose similarity (Jaccard) is at least so much; none is empty."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))  # by size: what can be similar is a range
    sizes = np.array([len(sets[k]) for k in order])
    starts = np.cumsum(sizes) - sizes
    kinds, of = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    out, left, has = [], np.arange(len(sets)), np.zeros(len(kinds), bool)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            first, end = np.searchsorted(sizes[left], (similarity * sizes[at] - 1e-9, sizes[at] / similarity + 1e-9), side="left")
            if first == end:
                continue
            near = left[first:end]
            has[of[starts[at] : starts[at] + sizes[at]]] = True
            a, b = starts[near[0]], starts[near[-1]] + sizes[near[-1]]
            if 2 * sizes[near].sum() > b - a:
                both = np.add.reduceat(has[of[a:b]], starts[near[0] : near[-1] + 1] - a, dtype=np.int64)[near - near[0]]
            else:
                both = np.array([np.count_nonzero(has[of[starts[k] : starts[k] + sizes[k]]]) for k in near])
            has[of[starts[at] : starts[at] + sizes[at]]] = False
            found = both >= similarity * (sizes[near] + sizes[at] - both) - 1e-9
            out += [(order[at], order[x]) for x in near[found].tolist()]
            queue += near[found].tolist()
            left = np.concatenate((left[:first], near[~found], left[end:]))
    return out


def _verified(groups: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root): components by exact similarity of nodes (node, root, n, row) with one root; their texts come from prints. Groups with many texts or shingles are dealt as pairs of blocks."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / SHINGLES)).cast("long").alias("blocks"))
    cell = (F.least("k", "j") * F.col("blocks") + F.greatest("k", "j")).alias("cell")
    dealt = groups.join(sizes, "root").withColumn("k", F.expr("pmod(xxhash64(node), blocks)"))
    # one row stands for its node: its number is nobody else's, so no key of this join has many rows
    dealt = prints.select("row", "text").join(dealt.hint("merge"), "row").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", cell, "blocks", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, now, nodes, sets = Stars(), Stars(), None, [], []

        def take() -> None:
            for a, b in resembling(sets, similarity) if len(sets) > 1 else []:
                (whole if now[2] == 1 else part).join([nodes[a]], [nodes[b]])

        for batch in batches:
            for *key, node, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if key != now:
                    take()
                    now, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.unique(shingles(text, words)))
        take()
        for stars, done in ((whole, True), (part, False)):
            for links in stars.links():
                yield links.append_column("done", pa.array([done] * links.num_rows))

    links = materialize(dealt.repartition(parts, "root", "cell").sortWithinPartitions("root", "cell").mapInArrow(run, "a long, b long, done boolean"))
    # a group in one cell is finished there; others are joined across their cells
    return connected_components(links.where("not done").select("a", "b")).unionByName(links.where("done").select(F.col("a").alias("node"), F.col("b").alias("root")))


def _similar(docs: DataFrame, words: int, similarity: float, lanes: int) -> tuple[DataFrame, DataFrame]:
    """Sketches, and (node, root, component_id) of all their nodes.

    The limit of candidates lies three standard deviations above what the similarity makes expect, so that
    hardly a pair is lost to it; the exact similarity decides.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = int(128 * share + 3 * math.sqrt(128 * share * (1 - share)))
    names = columns(lanes)
    prints = materialize(_sketches(docs, words, lanes))
    classes = materialize(prints.where("n > 0").groupBy("node", "n", *names).agg(F.min("id").alias("id"), F.min("row").alias("row")))
    roots = connected_components(_candidates(classes.select("node", *names), lanes, bits))
    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = _verified(materialize(grouped.join(classes.select("node", "n", "row"), "node")), prints, words, similarity)
    named = classes.join(linked, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    empty = prints.where("n = 0").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).where("rows > 0").select(F.lit(_EMPTY).alias("node"), F.lit(_EMPTY).alias("root"), "component_id")
    return prints, smallest(named, "id").select("node", "root", "component_id").unionByName(empty)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 5) -> DataFrame:
    """doc_id, fingerprint of the set of shingles, component_id (smallest doc_id reachable by links), for texts whose sets have at least a similarity (Jaccard)."""
    prints, groups = _similar(docs, words, similarity, lanes)
    return prints.join(groups, "node").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 5) -> DataFrame:
    """One row of each group of similar texts, all its columns as they are: the smallest doc_id that is not null; among rows with that id the smallest hash of the text, then the first row."""
    prints, groups = _similar(docs, words, similarity, lanes)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("text").alias("text"), "row")
    # a node's first row, and of these a root's: both are combined before they are dealt out
    first = prints.groupBy("node").agg(F.min(rank).alias("rank")).join(groups.select("node", "root"), "node").groupBy("root").agg(F.min("rank").alias("rank"))
    kept = prints.join(first.select(F.col("rank.row").alias("row")).hint("merge"), "row", "left_semi")
    return kept.select("text", "rest.*").select(*[F.col(f"`{c}`") for c in docs.columns])
