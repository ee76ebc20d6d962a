"""Links and components against brute force, and every odd input."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import common, pq, simhash


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(5, k) for k in range(30)] + [(40, 41), (41, 39), (7, 7), (None, 3)], [(k, (k * 7) % 50) for k in range(50)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    got = {r["node"]: r["root"] for r in common.connected_components(df).collect()}
    want = components({x for l in real for x in l}, real)
    assert got == {k: v for k, v in want.items() if k != v}


def slow_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


TEXTS = [None, "", " \n\t ", "One", "one", "ÉCLAIR a b c d", "a b c d", "a b c d e " * 50, "x\x0by\x0cz w", "z q a b c", "word " * 3000]


@pytest.mark.parametrize("words", [1, 4, 5])
def test_fingerprints(words):
    for t in TEXTS:
        assert int(simhash.fingerprint(None if t is None else t.encode(), words)[0]) == slow_fingerprint(t, words), t


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, rep string")  # extra columns with names used inside


def test_simhash_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        base = list(rng.choice(vocabulary, 120))
        for v in range(6):
            t = base[:]
            for _ in range(v):
                t[rng.integers(120)] = "changed"
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(3, rows[3][1]), (None, "nobody knows this one at all"), (None, rows[0][1])]
    df = documents(spark, [(i, t, "x", None) for i, t in rows])
    got = simhash.simhash_groups(df, words=4, bits=4).collect()
    assert len(got) == len(rows)
    prints = [(i, slow_fingerprint(t, 4)) for i, t in rows]
    named = [p for p in prints if p[0] is not None]
    links = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[:k] if (x ^ y).bit_count() <= 4]
    want = components({i for i, _ in named}, links)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["fingerprint"] == f"{dict(named)[r['doc_id']]:016x}"
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {want[0], None}


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 8).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for _ in range(40)]))
    ids = np.arange(len(fps))
    pairs = [(i, j) for i in ids for j in ids[:i] if int(fps[i] ^ fps[j]).bit_count() <= 4]
    tree = simhash.forest(fps, ids, 4, 4)
    assert components(ids.tolist(), tree) == components(ids.tolist(), pairs) and len(tree) == len(fps) - len(set(components(ids.tolist(), pairs).values()))


@pytest.mark.parametrize("posted", [1, 3, 4])
def test_large_postings_are_dealt_in_blocks(spark, monkeypatch, posted):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(2)
    fps = sorted({int(rng.integers(1 << 12)) << 3 | 1 for _ in range(300)})  # all share most of their bytes
    at = {f: k for k, f in enumerate(fps)}
    df = spark.createDataFrame([(f,) for f in fps], "fp0 long")
    links = [(at[r["a"]], at[r["b"]]) for r in simhash.fingerprint_links(df, 4, posted).collect()]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert components(range(len(fps)), links) == components(range(len(fps)), pairs)


def test_pairs_below_the_guaranteed_count_are_dropped():
    apart = np.array([[0x01010101], [0x0101010101], [0x0F], [0x1F]], np.uint64)
    assert simhash.near(apart, 64, 4).tolist() == [True, False, True, True]  # five bytes differ in the second
    assert simhash.near(apart, 4, 4).tolist() == [True, False, True, False]


def test_rows_without_id_still_link(spark):
    a = [f"w{k}" for k in range(400)]
    rows = [(5, " ".join(a)), (None, " ".join(a)), (None, "only null ids"), (None, "only null ids"), (9, "only null ids either way")]
    got = simhash.simhash_groups(documents(spark, [(i, t, "", "") for i, t in rows])).collect()
    assert len(got) == 5 and [r["component_id"] for r in got if r["doc_id"] is None and r["component_id"] == 5] == [5]
    assert sum(r["doc_id"] is None and r["component_id"] is None for r in got) == 2


def test_one_row_of_each_group(spark):
    text = lambda k, n=60: " ".join(f"{k}w{j}" for j in range(n))
    rows = [(1, text(1)), (2, text(1) + " more"), (1, text(2)), (1, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (7, text(4)), (8, ""), (9, None), (3, text(5)), (3, text(6) + " x"), (2, text(6))]
    df = spark.createDataFrame([(i, t, k, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, node long, root string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and simhash.one_of_each(df.where("doc_id > 100")).count() == 0
    got = {r["node"] for r in out.collect()}
    assert got == {0, 2, 4, 7, 8, 10, 12}  # two documents with id 1 stay, as they are different; a null id gives way to another


def test_bits_must_leave_a_byte():
    with pytest.raises(ValueError):
        simhash.simhash_groups(None, bits=8)


def test_most_near_copies_are_grouped_and_others_are_not(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(2000)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, wanted, apart = [], [], []
    for _ in range(150):
        base = list(rng.choice(vocabulary, 250))
        copy = base[:]
        for k in rng.choice(250, int(rng.integers(1, 6)), replace=False):
            copy[k] = "changed"
        a, b = shingles(base), shingles(copy)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
        (wanted if len(a & b) / len(a | b) >= 0.8 else apart).append(rows[-1][0])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, [(i, t, "", "") for i, t in rows])).collect()}
    assert np.mean([got[i] == i - 1 for i in wanted]) > 0.85
    assert all(got[i] == i for i in range(0, len(rows), 2))


@pytest.mark.parametrize("group", [1024, 8])
def test_similar_groups_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # the smaller deals groups as pairs of blocks
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows = []
    for size in (12, 60, 250):
        for _ in range(40):
            base = list(rng.choice(vocabulary, size))
            rows.append((len(rows), " ".join(base)))
            for share in (0.02, 0.04, 0.06):  # similarities around 0.8, on both sides
                copy = base[:]
                for k in rng.choice(size, max(1, int(size * share * rng.random())), replace=False):
                    copy[k] = "changed"
                rows.append((len(rows), " ".join(copy)))
    base = list(rng.choice(vocabulary, 100))
    rows += [(len(rows) + k, " ".join([*base[:90], *rng.choice(vocabulary, 10)])) for k in range(30)]  # a large group
    line = "one line that is repeated over and over again "
    rows += [(len(rows) + k, line * 300 + " ".join(rng.choice(vocabulary, 60))) for k in range(4)]  # the line alone is not a near copy
    rows += [(len(rows) + k, line * (1 + 40 * k) + " ".join(base)) for k in range(2)]
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "two words")]
    sets = [{tuple(p[k : k + 5]) for k in range(max(1, len(p) - 4))} if (p := (t or "").split()) else set() for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (10 * len(a & b) >= 8 * len(a | b))]
    want = components(range(len(rows)), links)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(documents(spark, [(i, t, "", "") for i, t in rows])).collect()}
    lost, wrong = sum(got[i] != got[j] for i, j in links), [i for i in got if want[got[i]] != want[i]]
    assert not wrong and lost <= 0.01 * len(links)


def test_empty_documents(spark):
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long")


def brute(rows, threshold):
    ok = [(k, i, np.array(v, np.float32).astype(float)) for k, (i, v) in enumerate(rows) if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16]
    unit = [(k, i, v / np.sqrt(v @ v)) for k, i, v in ok]
    links = [(a, b) for a in range(len(unit)) for b in range(a) if unit[a][2] @ unit[b][2] >= threshold]
    n = np.zeros(len(rows), int)
    for a, b in links:
        n[unit[a][0]] += 1
        n[unit[b][0]] += 1
    root = components({i for i, _ in rows if i is not None}, [(unit[a][1], unit[b][1]) for a, b in links if unit[a][1] != unit[b][1]])
    return n, root


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(250):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), (base + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist()))
    twin = rows[0][1]
    rows += [(5000 + k, twin) for k in range(20)] + [(5100, [2 * x for x in twin]), (6000, None), (6001, [0.0] * 16), (6002, [float("nan")] + [1.0] * 15), (6003, [float("inf")] + [1.0] * 15), (6004, [None] + [1.0] * 15), (6005, []), (6006, [1.0, 2.0]), (6007, [-0.0] * 16)]
    n, root = brute(rows, 0.95)
    got = pq.pq_links(vectors(spark, [(i, v, 1, 7) for i, v in rows])).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    found = sum(by[i]["n_links"] for i, _ in rows)
    assert found >= 0.99 * n.sum() and all(by[i]["n_links"] <= n[k] for k, (i, _) in enumerate(rows))
    assert sum(by[i]["component_id"] == root[i] for i, _ in rows) >= 0.99 * len(rows)
    for i in range(6000, 6008):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_hot_lists_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(pq, "MEMBERS", 16)
    monkeypatch.setattr(pq, "QUERIES", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(scale=0.05, size=16)).astype(np.float32).tolist()) for k in range(120)]
    n, _ = brute(rows, 0.95)
    got = {r["vec_id"]: r for r in pq.pq_links(vectors(spark, [(i, v, 1, 7) for i, v in rows])).collect()}
    assert [got[k]["n_links"] for k in range(120)] == n.tolist() and {r["component_id"] for r in got.values()} == {0}


def test_every_length_and_rows_without_id(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.01]), (3, [2.0, 2.0]), (4, [1.0, -1.0])] + [(10 + k, [1.0, 0.1 * k, 0.5]) for k in range(6)]
    rows += [(None, [5.0, 0.0, 0.0, 0.1]), (20, [5.0, 0.0, 0.0, 0.0]), (None, [0.0, 7.0, 0.0, 0.0]), (None, [0.0, 7.0, 0.0, 0.0]), (None, None)]
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, *r) for r in pq.pq_links(vectors(spark, [(i, v, 1, 7) for i, v in rows])).collect()), key=str)
    by = {g[2]: g[3:] for g in got if g[2] is not None}
    assert len(got) == len(rows) and by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[3] == (2, 1, False) and by[4] == (0, 4, True)
    assert by[20] == (1, 20, True)
    assert sorted((g[3], str(g[4]), g[5]) for g in got if g[2] is None) == [(0, "None", False), (1, "20", False), (1, "None", False), (1, "None", False)]
    same = [(a, b) for a in range(4, 10) for b in range(4, a) if np.dot(rows[a][1], rows[b][1]) >= 0.95 * np.linalg.norm(rows[a][1]) * np.linalg.norm(rows[b][1])]
    assert sum(by[10 + k][0] for k in range(6)) == 2 * len(same)


@pytest.mark.parametrize("kind", ["even", "few directions"])
@pytest.mark.parametrize("spread", [pq.SPREAD, None])
def test_recall_without_clusters(spark, kind, spread, monkeypatch):
    rng = np.random.default_rng(6)
    if kind == "even":  # pairs at the very threshold, in random directions of 64
        base = rng.normal(size=(700, 64))
        other = base + rng.normal(size=base.shape) * 0.32
    else:  # everything lies near a plane of three directions
        plane = rng.normal(size=(3, 64))
        base = rng.normal(size=(700, 3)) @ plane + rng.normal(size=(700, 64)) * 0.02
        other = base + rng.normal(size=(700, 3)) * 0.1 @ plane
    x = np.concatenate((base, other)).astype(np.float32)
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pq.pq_links(vectors(spark, [(k, v.tolist(), 0, 0) for k, v in enumerate(x)]), spread=spread).collect()}
    found = np.array([got[k] for k in range(len(x))])
    assert want.sum() > 300 and (found <= want).all()
    assert (found == want).all() if spread is None else found.sum() >= 0.97 * want.sum()


def test_few_or_no_vectors(spark):
    assert pq.pq_links(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in pq.pq_links(vectors(spark, [(4, [1.0, 2.0], 0, 0)])).collect()] == [(4, 0, 4, True)]
    assert [tuple(r) for r in pq.pq_links(vectors(spark, [(4, None, 0, 0)])).collect()] == [(4, 0, 4, True)]


def test_scaled_components():
    assert pq.small_components(np.array([3, 1]), np.array([2, 2]), 5).tolist() == [0, 1, 1, 1, 4]
    assert pa.__version__ and F
