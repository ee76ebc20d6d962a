"""The pipeline's stages on a small corpus with planted cases, and the entry module with and without the subpackage."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(900)]
    item = " ".join(rng.choice([f"b{k}" for k in range(500)], 40))
    good = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, good(int(rng.integers(20, 200))), "en", f"s{k % 4}") for k in range(240)]
    rows += [(300 + k, " ".join(f"{w}!!".upper() for w in rng.choice(words, 40)), "en", "s1") for k in range(80)]
    rows += [(400 + k, rows[k][1], "en", "s2") for k in range(10)]  # copies
    rows += [(420, rows[20][1] + " more", "en", "s2")]
    rows += [(500 + k, good(30) + " " + item + " " + good(20), "en", "s3") for k in range(5)]
    rows += [(600, None, "en", "s0"), (601, "", None, None), (None, good(50), "en", "s0"), (3, rows[3][1], "en", "s3")]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 240, 2)] + [(300 + k, 0, 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    import corpus_pipeline as p

    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        docs = p.materialize(stage(spark, docs, corpus))
        seen[k] = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == columns + (["shard", "slot"] if k == 4 else []), name
    ids = [set(v) - {None} for v in seen.values()]
    assert not ids[0] & set(range(300, 380)) and len(ids[0] & set(range(240))) == 240
    assert set(range(240)) <= ids[1] | {20} and not ids[1] & set(range(400, 410)) and len(seen[1]) == len(set(seen[1])) and None in seen[1]
    assert ids[1] - ids[2] == set(range(500, 505))
    assert ids[3] <= ids[2] and all(seen[3].count(i) <= 3 for i in ids[3])
    assert sorted(map(str, seen[3])) == sorted(map(str, seen[4]))
    by = {}
    for r in docs.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(by) == 16 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run_is_the_stages_in_a_row_and_repeats(spark, corpus):
    import corpus_pipeline as p

    a, b = (sorted(map(str, p.run(spark, corpus).collect())) for _ in range(2))
    assert a == b and len(a) > 100


def test_every_operator_has_a_query():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()


def test_the_rest_stands_without_the_subpackage(tmp_path):
    for f in ("shelfmark", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{f}") else shutil.copy)(f"{ROOT}/{f}", tmp_path / f)
    shutil.rmtree(tmp_path / "shelfmark" / "llm")
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 80 and not any(x.startswith('op') or x == 'pipeline' for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
