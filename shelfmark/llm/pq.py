"""Near-duplicate vectors by product quantisation.

A coarse codebook deals the unit vectors into inverted lists and small codebooks encode the residuals by
subspace. Vectors of each length have codebooks of their own, fitted on a bounded sample (SAMPLE vectors in all, the
smallest by a seeded hash); every vector is indexed. A query probes each list whose border with its own list is no
farther than a link can reach (see probes), reads asymmetric distances from a table per query, and keeps a member if
its stored quantisation error can still hide a link, so the tables never discard one. What stays is ranked
by exact cosine in double precision.

A link of length r lies across the border of two lists only if r reaches it. Taken at its full length in every
direction (spread=None) the search is exact. As links point in many directions, the default takes `spread` standard
deviations of a link's component towards the other list, of which the residuals of the sample tell the share for each
direction; vectors that vary in few directions are given a longer reach there.

Equal vectors are one class from the start. Lists and their queries are dealt out in cells of at most about
MEMBERS x QUERIES, whatever a list's size; a cell returns counts and a spanning forest, never all pairs.

Null or zero vectors and those with null or non-finite components link with nothing: n_links 0, their own
component. Vectors of different lengths never link. Rows with a null vec_id count as links and lead from one vector
to another like any row; their component's id is the smallest of the ids there, null if it has none, and kept is
false. Repeated ids are rows of their own that count as links. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import connected_components, materialize, smallest

SAMPLE = 40_000
MAX_LISTS = 4096
MEMBERS, QUERIES = 2048, 4096
#: Standard deviations of a link's component towards another list.
SPREAD = 3.0


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        at = np.concatenate(([0], np.cumsum(counts)[:-1]))
        full = counts > 0
        centres[full] = np.add.reduceat(x[order], at[full], axis=0) / counts[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])


def fit(x: np.ndarray, n: int, subspaces: int, seed: int) -> dict:
    """Codebooks from unit vectors x of a corpus of n."""
    rng = np.random.default_rng(seed)
    lists = int(min(MAX_LISTS, max(1, n // 128), max(1, len(x) // 8)))
    coarse = kmeans(x, lists, 8, rng)
    residual = x - coarse[nearest(x, coarse)]
    d = x.shape[1]
    # per direction u the share of the residuals' variance is |u @ root|^2; a tenth of an even share is the least
    total = (residual**2).sum()
    share = residual.T @ residual / total if total > 0 else np.eye(d) / d
    root = np.linalg.cholesky(share + np.eye(d) * 0.1 / d)
    cuts = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
    books = [kmeans(np.ascontiguousarray(residual[:, a:b]), min(256, len(x)), 6, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return {"coarse": coarse, "cuts": cuts, "books": books, "root": root}


def encode(residual: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Codes by subspace, and how far the decoded vectors are from the real ones."""
    codes, error = np.empty((len(residual), len(model["books"])), np.uint8), np.zeros(len(residual))
    for m, (a, b, book) in enumerate(zip(model["cuts"][:-1], model["cuts"][1:], model["books"], strict=True)):
        part = np.ascontiguousarray(residual[:, a:b])
        codes[:, m] = nearest(part, book)
        error += ((part - book[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(error)


def tables(query: np.ndarray, model: dict) -> list[np.ndarray]:
    """Squared distances of every codeword (rows) from each query residual's parts (columns)."""
    return [((book**2).sum(1)[:, None] - 2 * book @ query[:, a:b].T + (query[:, a:b] ** 2).sum(1)).astype(np.float32) for a, b, book in zip(model["cuts"][:-1], model["cuts"][1:], model["books"], strict=True)]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def distances(centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """From each vector's own centre to all centres."""
    square = (centres**2).sum(1)
    return np.sqrt(np.maximum(square[own][:, None] - 2 * centres[own] @ centres.T + square, 0))


def probes(x: np.ndarray, model: dict, length: float, spread: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own list of each vector; then (row, list) of all lists that links of so much length can lead to."""
    coarse = model["coarse"]
    apart = (coarse**2).sum(1) - 2 * x @ coarse.T  # squared distance less one
    own = apart.argmin(1)
    across = distances(coarse, own)
    if spread is not None:
        across = np.minimum(across, spread * distances(coarse @ model["root"], own))
    border = apart - apart[np.arange(len(x)), own][:, None] <= 2 * length * across + 1e-9
    border[np.arange(len(x)), own] = True
    return own, *np.nonzero(border)


def small_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable in a graph of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _cell(models: dict[int, dict], threshold: float):
    eps = np.sqrt(2 - 2 * threshold)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role, node, copies, error = (np.asarray(t.column(c)) for c in ("role", "node", "copies", "error"))
        lst, model = int(t.column("list")[0].as_py()), models[int(t.column("d")[0].as_py())]
        vec = unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(len(role), -1).astype(np.float64))
        mem, que = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        if len(mem) and len(que):
            codes = np.frombuffer(b"".join(t.column("code").take(pa.array(mem)).to_pylist()), np.uint8).reshape(len(mem), -1)
            for at in range(0, len(que), 256):
                q = que[at : at + 256]
                look = tables(vec[q] - model["coarse"][lst], model)
                adc = np.zeros((len(mem), len(q)), np.float32)
                for m, table in enumerate(look):  # whole rows of a table are copied at a time
                    adc += table[codes[:, m]]
                j, i = np.nonzero(adc <= ((eps + error[mem] + 1e-4) ** 2)[:, None])
                real = node[q[i]] != node[mem[j]]
                i, j = i[real], j[real]
                near = np.concatenate([(vec[q[i[k : k + 65536]]] * vec[mem[j[k : k + 65536]]]).sum(1) for k in range(0, len(i), 65536)] or [np.empty(0)]) >= threshold
                links.append((q[i[near]], mem[j[near]]))
        a, b = (np.concatenate([x[k] for x in links] or [np.empty(0, int)]) for k in (0, 1))
        n = np.zeros(len(role), np.int64)
        np.add.at(n, a, copies[b])
        root = small_components(a, b, len(role)) if len(a) else np.arange(len(role))
        keep = np.flatnonzero((n > 0) | (node[root] != node))
        return pa.table({"node": node[keep], "n": n[keep], "root": node[root[keep]]})

    return run


def codebooks(classes: DataFrame, subspaces: int, seed: int) -> dict[int, dict]:
    """By length of vector: codebooks from its part of the sample, at least one vector of each length."""
    counts = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row a length
    each = {d: max(1, SAMPLE * n // sum(counts.values())) for d, n in counts.items()}
    most = F.lit(1)
    for d, k in each.items():
        most = F.when(F.col("d") == d, F.lit(k)).otherwise(most)
    # a hash threshold leaves about twice as many rows as are wanted, then the first of them are ranked
    h = F.xxhash64(F.lit(seed), "embedding")
    share = F.lit(0.0)
    for d, n in counts.items():
        share = F.when(F.col("d") == d, F.lit((2.0 * each[d] + 100) / n)).otherwise(share)
    near = classes.select("d", "embedding", h.alias("h")).where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("h"))).where(F.col("k") <= most)
    sample = first.select("d", "h", "embedding").toPandas().sort_values(["d", "h"])
    return {int(d): fit(unit(np.stack(part["embedding"].to_list()).astype(np.float64)), counts[d], subspaces, seed) for d, part in sample.groupby("d")}


def pq_links(vectors: DataFrame, threshold: float = 0.95, subspaces: int = 16, seed: int = 7, spread: float | None = SPREAD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding). spread: see the module; None misses no link whatever the data."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<float>")
    sound = F.coalesce(F.size(e) > 0, F.lit(False)) & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    base = vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(sound, F.lit(False)), e).alias("embedding"))
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal rows
    base = base.withColumn("embedding", F.expr("transform(embedding, x -> x + float(0))"))
    classes = base.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # the number of a class is fixed by being written
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "rep", "copies", F.size("embedding").alias("d"), "embedding"))
    models = codebooks(classes, subspaces, seed)
    if models:
        found = _search(classes, models, threshold, spread)
        counted = found.groupBy("node").agg(F.sum("n").alias("n"))
        roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    else:
        counted, roots = spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "node long, top long")
    linked = classes.join(counted, "node", "left").join(roots, "node", "left").select("embedding", "copies", "rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", "node").alias("root"))
    out = base.join(smallest(linked, "rep").select("embedding", "copies", "n", "component_id"), "embedding", "left")
    top = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    n = F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(False)).alias("kept"))


def _search(classes: DataFrame, models: dict[int, dict], threshold: float, spread: float | None) -> DataFrame:
    length = np.sqrt(2 - 2 * threshold)
    names = ["node", "copies", "d", "vec", "own", "code", "error", "probe"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(2))
            for d in np.unique(size).tolist():
                every = np.flatnonzero(size == d)
                for at in range(0, len(every), 1024):
                    b = batch.take(pa.array(every[at : at + 1024]))
                    flat = np.asarray(b.column(3).flatten()).reshape(b.num_rows, d)
                    x, model = unit(flat.astype(np.float64)), models[d]
                    own, row, to = probes(x, model, length, spread)
                    codes, error = encode(x - model["coarse"][own], model)
                    offsets = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(to.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([v.tobytes() for v in flat]), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array(error), lists], names)

    coded = materialize(classes.select("node", "copies", "d", "embedding").mapInArrow(assign, "node long, copies long, d int, vec binary, own int, code binary, error double, probe array<int>"))
    # two small tables: a row for each of at most MAX_LISTS lists of a length
    members = coded.groupBy("d", F.col("own").alias("list")).agg(F.ceil(F.count("*") / MEMBERS).alias("mb"))
    queries = coded.select("d", F.explode("probe").alias("list")).groupBy("d", "list").agg(F.ceil(F.count("*") / QUERIES).alias("qb"))
    sizes = members.join(queries, ["d", "list"])
    asked = coded.select(F.lit(1).alias("role"), "node", "copies", "d", "vec", F.lit(b"").alias("code"), F.lit(0.0).alias("error"), F.explode("probe").alias("list")).join(sizes, ["d", "list"])
    asked = asked.withColumn("qc", F.expr("pmod(xxhash64(node), qb)")).withColumn("mc", F.explode(F.expr("sequence(0, mb - 1)")))
    held = coded.select(F.lit(0).alias("role"), "node", "copies", "d", "vec", "code", "error", F.col("own").alias("list")).join(sizes, ["d", "list"])
    held = held.withColumn("mc", F.expr("pmod(xxhash64(node, 1), mb)")).withColumn("qc", F.explode(F.expr("sequence(0, qb - 1)")))
    both = held.unionByName(asked).select("d", "list", F.col("mc").cast("int"), F.col("qc").cast("int"), "role", "node", "copies", "vec", "code", "error")
    return materialize(both.groupBy("d", "list", "mc", "qc").applyInArrow(_cell(models, threshold), "node long, n long, root long"))
