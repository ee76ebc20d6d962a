"""Sharding, mixing and URL rules: laws, plain versions, odd inputs, and no Python in their plans."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing, sharding, urlrules


def no_python(df):
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id long, source string, size long, shard int, h string, row long, key string, before int, `a.b` int".replace(", row long, key string, before int, `a.b` int", ""))


@pytest.mark.parametrize(("n", "bucket"), [(0, 100), (1, 100), (15, 100), (1000, 16), (4001, 300)])
def test_shards_are_even_and_follow_the_mixture(spark, n, bucket, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    values = [(k, "hot" if k % 3 == 0 else None if k % 7 == 1 else f"s{k % 9}", k, 5, "x") for k in range(n)]
    df = sharding.shards(rows(spark, values), 16)
    no_python(df)
    got = df.collect()
    assert len(got) == n and sorted(r["doc_id"] for r in got) == list(range(n))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    if n >= 16:
        assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        total = Counter(r["source"] for r in got)
        for v in by.values():
            here = Counter(r["source"] for r in v)
            assert all(abs(here[s] - total[s] / 16) <= 2 for s in total)


def test_sharding_is_the_same_again_and_keeps_equal_rows(spark):
    values = [(k % 40, "a" if k % 2 else "b", 1, 0, "x") for k in range(400)] + [(None, None, None, None, None)] * 3
    a, b = (sorted(map(str, sharding.shards(rows(spark, values).repartition(p), 4).collect())) for p in (1, 7))
    assert a == b and len(a) == 403


def test_shards_pass_any_column_through(spark):
    names = ["doc_id", "source", "_h", "_s", "_b", "_r", "_f", "_q", "_before", "_n", "_start", "h", "s", "b", "r", "f", "q", "n", "key", "row", "part", "place", "a.b"]
    df = spark.createDataFrame([tuple([k, "x", *[f"{k}:{c}" for c in names[2:]]]) for k in range(50)], names)
    out = sharding.shards(df, 4)
    assert out.columns == [*names, "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == sorted(map(tuple, df.collect()))


def test_many_rows_equal_in_order_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 50)
    values = [(None, "a" if k % 2 else "b", 1, 0, "x") for k in range(1500)] + [(k, "a", 1, 0, "x") for k in range(300)]
    got = sharding.shards(rows(spark, values).repartition(5), 16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 1800 and sorted(map(len, by.values())) == sorted(1800 // 16 + (k < 1800 % 16) for k in range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter(r["doc_id"] for r in got) == Counter(v[0] for v in values)


def test_shards_equal_plain_ranks(spark):
    """All rows of a source in the order of their hash, all rows in the order of their fraction, cut into equal runs."""
    values = [(k, "hot" if k % 3 == 0 else None if k % 7 == 1 else f"s{k % 5}", k, 5, "x") for k in range(700)]
    df = rows(spark, values)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    seen = df.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h"), F.xxhash64(F.lit(11), key).alias("s")).collect()
    of = defaultdict(list)
    for r in seen:
        of[r["s"]].append(r)
    flat = []
    buckets = 16  # four times the shuffle partitions of the tests' session
    for s, found in of.items():
        found.sort(key=lambda r: ((r["h"] >> 20) % buckets, r["h"]))
        flat += [((k + (s % 1_000_003 + 0.5) / 1_000_003) / len(found), s, r["h"], r["doc_id"]) for k, r in enumerate(found)]
    flat.sort()
    want = {x[3]: k * 16 // 700 for k, x in enumerate(flat)}
    assert {r["doc_id"]: r["shard"] for r in sharding.shards(df, 16).collect()} == want


def plain_targets(sizes, weights, cap):
    """The excess goes round by weight until none is above."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in sizes if s not in full)
        out = {s: cap * sizes[s] if s in full else rest * w[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, None: 5}, {"a": 0, "b": 7}, {"x": 3}, {f"s{k}": (k * 37) % 91 + 1 for k in range(30)}, {"Z": 5, "a": 5, "é": 5, "b": 1}])
def test_targets(spark, sizes):
    df = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = plain_targets(sizes, (1.0, 2.0, 3.0), 3.0)
    for r in df.collect():
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)


def corpus(spark, values):
    return spark.createDataFrame(values, "doc_id long, source string, text string, size string")


def planned(spark, values, parts=3):
    return mixing.plan(mixing.sized(corpus(spark, values).repartition(parts)))


def test_every_source_comes_near_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    values = [(k, "hot" if k % 3 == 0 else None if k % 11 == 1 else f"s{k % 4}", "w " * (k * 7919 % 300), "clash") for k in range(900)]
    df = planned(spark, values)
    got = df.collect()
    assert len(got) == 900 and len({r["doc_id"] for r in got}) == 900
    longest = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(values[r["doc_id"]][2].split()) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert abs(r["copies"] - r["target"] / r["source_size"]) < 1 or r["size"] == 0
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
    goals = {r["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - goals[s]) <= longest[s] for s in goals)
    assert math.isclose(sum(goals.values()), sum(r["size"] for r in got), rel_tol=1e-9)
    again = planned(spark, values, 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rounding_keeps_expectations(spark):
    values = [(k, "a" if k < 30 else "b", "w " * (k % 5 + 1), "") for k in range(60)]
    sums = Counter()
    for seed in range(20):
        for r in mixing.plan(mixing.sized(corpus(spark, values)), seed=seed).collect():
            sums[r["doc_id"]] += r["copies"]
    want = {r["doc_id"]: r["target"] / r["source_size"] for r in planned(spark, values).collect()}
    assert all(abs(sums[k] / 20 - want[k]) < 0.45 for k in want)


def test_equal_rows_nulls_and_nothing(spark):
    values = [(1, "a", "x y z", "")] * 50 + [(2, "a", None, ""), (3, "a", "", ""), (None, None, "q r", ""), (4, "b", "long " * 40_000, "")]
    got = planned(spark, values).collect()
    same = [r["copies"] for r in got if r["doc_id"] == 1]
    assert len(got) == 54 and len(same) == 50 and max(same) - min(same) <= 1
    assert {r["taken"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert planned(spark, []).count() == 0
    assert planned(spark, [(1, "a", "", "")]).collect()[0]["taken"] == 0


def test_rows_that_differ_by_a_null_are_two(spark):
    df = spark.createDataFrame([(1, None, "x y"), (1, "x y", None), (2, "a", "one two three")] * 3, "doc_id long, source string, text string")
    got = Counter(tuple(r) for r in mixing.mix(df, weights=(1.0,)).collect())
    assert set(got) <= {(1, None, "x y"), (2, "a", "one two three")} and got[1, None, "x y"] <= 9
    assert mixing.mix(df.where("doc_id > 5")).count() == 0


def test_many_equal_rows_are_listed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    values = [(1, "a", "x y z", "")] * 50 + [(2, "b", "x y", "")] * 23 + [(3, "b", "q", "")]
    got = planned(spark, values).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 50, 2: 23, 3: 1}
    mixed = Counter(r["doc_id"] for r in mixing.mix(corpus(spark, values)).collect())
    assert all(abs(mixed[k] - sum(r["copies"] for r in got if r["doc_id"] == k)) <= 1 for k in (1, 2, 3))


def test_mixtures_hold_whole_documents(spark):
    values = [(k, f"s{k % 3}", f"text {k} " * (k % 6), "c") for k in range(120)] + [(7, "s1", "text 7 ", "c")] * 4
    df = mixing.mix(corpus(spark, values))
    no_python(df)
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in df.collect())
    known = Counter((i, s, t) for i, s, t, _ in values)
    assert df.columns == ["doc_id", "source", "text", "size"] and set(got) <= set(known) and all(got[k] <= 3 * known[k] for k in got)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


URLS = ["http://A.Example.com/en/x", "https://www.example.com/en/", "http://example.com/fr/", "http://example.com", "http://x.net/es/1?q=/en/", "http://x.net/es", "ftp://notcom/en/", "http://u?://com/", "no scheme", None, "", "http://", "http://com/#/en/", "x://a\nb.com/e\nn", "http://É.com/", "http://fake-example.com/en/"]


def test_listed_rules_come_first(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(0, URLS[0], ""), (None, URLS[4], "")], "page_id long, url string, host string")
    out = urlrules.judge(df, RULES)
    no_python(out)
    got = out.collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_rule(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_mined_rules_equal_counting(spark):
    urls = [(f"http://{'bad' if k % 4 == 0 else 'ok'}{k % 3}.org/{'ads' if k % 5 == 0 else 'news'}/{k}", "block" if k % 4 == 0 or (k % 5 == 0 and k % 3 == 1) else "allow") for k in range(240)]
    df = urlrules.parts(spark.createDataFrame([(k, *u) for k, u in enumerate(urls)], "row long, url string, label string")).withColumn("tokens", urlrules.tokens())
    sets = [(set(r["tokens"]), r["label"]) for r in df.collect()]
    index = {tuple(sorted(r["antecedent"])): r for r in urlrules.mine(df, 0.02, 0.9)[0].collect()}
    for rule, r in index.items():
        hit = [l for t, l in sets if set(rule) <= t]
        assert hit.count("block") / len(sets) >= 0.02 and math.isclose(hit.count("block") / len(hit), r["confidence"]) and r["confidence"] >= 0.9 and r["item"] in rule
    assert ("h:bad0",) in index and tuple(sorted(("h:ok1", "p:ads"))) in index and ("h:ok1",) not in index


def test_urls_without_rules_follow_what_was_mined(spark):
    urls = [f"http://h{k}.net/es/spam/{k}" for k in range(30)] + [f"http://h{k}.com/news/{k}" for k in range(30)] + ["http://q.org/x/spam/1", "http://q.org/news/1"]
    got = {r["page_id"]: r for r in urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    assert (got[60]["rule"], got[60]["verdict"], got[61]["verdict"]) == (None, "block", "allow")


def test_long_urls_do_not_explode(spark):
    fixed = "/".join(f"part{c}" for c in "abcdefghijklmnopqrstuvwxyz")  # 26 tokens that always come together
    urls = [f"http://h{k % 3}.net/es/{fixed}/{k}" for k in range(60)] + [f"http://h{k % 3}.com/{fixed}/{k}" for k in range(60)] + [None] * 50
    got = urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert len(got) == 170 and {r["verdict"] for r in got if r["page_id"] < 60} == {"block"} and {r["verdict"] for r in got if r["page_id"] >= 60} == {"allow"}


def test_no_pages(spark):
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert F and Counter
