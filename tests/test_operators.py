import pytest
from pyspark.sql import functions as F

from shelfmark.functions import globs as G
from shelfmark.operators import browse as B
from shelfmark.operators import exclude as E
from shelfmark.operators import extraction as X
from shelfmark.operators import planning as L
from shelfmark.operators import segments as S
from shelfmark.operators import session as N


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ITEMS = "entry long, source_path string, archive_path string, kind string"


def test_exclusion_cuts_at_the_first_match_below_the_root(spark):
    paths = [("root", "directory"), ("root/a", "directory"), ("root/a/x.tmp", "file"), ("root/tmp", "directory"), ("root/tmp/k", "file"), ("root/tmp/s/k", "file"), ("x.tmp", "file"), ("root/other/tmp/q", "file")]
    items = frame(spark, [(k, f"/s{k}", p, t) for k, (p, t) in enumerate(paths)], ITEMS)
    g = G.compile_patterns(["*.tmp", "tmp/"])
    assert [r["archive_path"] for r in E.kept(items, g).orderBy("entry").collect()] == ["root", "root/a", "x.tmp"]
    out = {r["archive_path"]: (r["source_path"], r["kind"], r["entry"]) for r in E.excluded(items, g).collect()}
    assert out == {"root/a/x.tmp": ("/s2", "file", 2), "root/tmp": ("/s3", "directory", 3), "root/other/tmp": ("", "directory", 7)}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_renumbering_does_not_depend_on_partitions(spark, parts):
    df = spark.range(0, 200_000, 7).select((F.col("id") * 3).alias("entry")).repartition(parts)
    got = E.renumber(df.withColumn("was", F.col("entry"))).orderBy("entry").collect()
    assert [r["entry"] for r in got] == list(range(len(got))) and all(a["was"] < b["was"] for a, b in zip(got, got[1:], strict=False))


PLAN = "entry long, source_path string, output_name string, kind string, codec string, size long, mtime_ns long, group_id string, channel_index int, channel_count int, original_extension string, kept_restored_name string"


def plan(spark, rows):
    full = [(k, f"/in/{k}", *r) + (None,) * (10 - len(r)) for k, r in enumerate(rows)]
    return frame(spark, full, PLAN)


def entry(name, kind="file", codec="general", size=1, mtime=0, group=None, index=None, count=None, ext=None, kept=None):
    return (name, kind, codec, size, mtime, group, index, count, ext, kept)


def conflicts(spark, rows):
    return sorted((r["kind"], r["collision_key"], r["entries"]) for r in L.conflicts(plan(spark, rows)).collect())


def test_collisions_fold_and_count_owners(spark):
    assert conflicts(spark, [entry("A"), entry("a"), entry("b")]) == [("collision", "a", [0, 1])]
    assert conflicts(spark, [entry("straße"), entry("STRASSE")]) == [("collision", "strasse", [0, 1])]
    members = [entry(f"t_ch0{k}.flac", codec="flac_mono", group="g", index=k, count=2, ext=".wav") for k in (1, 2)]
    assert conflicts(spark, members) == []
    assert conflicts(spark, [*members, entry("T.wav")]) == [("collision", "t.wav", [0, 1, 2])]
    assert conflicts(spark, [entry("a.flac", codec="flac", ext=".wav"), entry("a.wav")]) == [("collision", "a.wav", [0, 1])]
    assert conflicts(spark, [entry("d/", "directory"), entry("D/", "directory")]) == [("collision", "d", [0, 1])]


def test_parents_and_names(spark):
    assert conflicts(spark, [entry("a"), entry("A/b"), entry("a/c/d")]) == [("parent_clash", "a", [0, 1, 2])]
    assert conflicts(spark, [entry("a/", "directory"), entry("a/b")]) == []
    assert conflicts(spark, [entry("a//b"), entry("../x"), entry("ok")]) == [("invalid_name", "../x", [1]), ("invalid_name", "a//b", [0])]


def test_resolutions_hold_for_groups(spark):
    p = plan(spark, [entry("x"), *[entry(f"t_ch0{k}.flac", codec="flac_mono", group="g", index=k, count=2, ext=".wav") for k in (1, 2)], entry("y")])
    act = lambda *rows: [(r["entry"], r["output_name"], r["codec"]) for r in L.resolve(p, frame(spark, rows, "entry long, action string, new_name string")).orderBy("entry").collect()]
    assert act((2, "rename", "n")) == [(0, "x", "general"), (1, "n_ch01.flac", "flac_mono"), (2, "n_ch02.flac", "flac_mono"), (3, "y", "general")]
    assert act((1, "skip", None), (0, "rename", "z")) == [(0, "z", "general"), (1, "y", "general")]
    assert act((2, "disable_flac", None)) == [(0, "x", "general"), (1, "t.wav", "general"), (2, "y", "general")]


def test_readme_comes_and_goes(spark):
    names = lambda rows: [r["output_name"] for r in L.with_readme(plan(spark, rows)).orderBy("entry").collect()]
    assert names([entry("a.flac", codec="flac")]) == ["a.flac", L.README]
    assert names([entry("a"), entry(L.README, codec="generated")]) == ["a"]


MEMBERS = "entry long, group_id string, channel_index int, channel_count int, sha256 string, samples long, bits int"


@pytest.mark.parametrize(("rows", "good"), [
    ([(1, 3), (2, 3), (3, 3)], True), ([(1, 3), (3, 3)], False), ([(1, 3), (2, 3), (2, 3)], False), ([(1, 2), (2, 3)], False), ([(2, 3), (3, 3), (4, 3)], False), ([(1, 1)], True), ([(1, 4), (1, 4), (4, 4), (4, 4)], False), ([(1, 4), (2, 4), (2, 4), (4, 4)], False),
])
def test_group_completeness(spark, rows, good):
    df = frame(spark, [(k, "g", i, n, "s", 10, 24) for k, (i, n) in enumerate(rows)], MEMBERS)
    assert X.complete_groups(df).first()["complete"] is good
    assert X.incomplete_members(df).count() == (0 if good else len(rows))


def test_groups_must_agree(spark):
    base = [(0, "g", 1, 2, "s", 10, 24), (1, "g", 2, 2, "s", 10, 24)]
    for at, value in ((4, "t"), (5, 11), (6, 16)):
        rows = [base[0], tuple(value if k == at else v for k, v in enumerate(base[1]))]
        assert X.complete_groups(frame(spark, rows, MEMBERS)).first()["complete"] is False


def test_folders_roll_up_without_the_deleted(spark):
    rows = [("a/b/x", "file", 5, 2, False, True, True), ("a/y", "file", 7, 7, False, False, True), ("a/b/z", "file", 100, 1, True, True, True), ("e/", "directory", 0, 0, False, True, True), ("top", "file", 1, 1, False, True, True)]
    df = frame(spark, rows, "name string, kind string, size long, packed long, deleted boolean, ratio_known boolean, packed_known boolean")
    got = {r["folder"]: (r["files"], r["size"], r["packed"], r["ratio_known"]) for r in B.folder_rollup(df).collect()}
    assert got == {"a": (2, 12, 9, False), "a/b": (1, 5, 2, True), "e": (0, 0, 0, True)}


def test_common_folder_and_states(spark):
    folder = lambda names: B.common_folder(frame(spark, [(n,) for n in names], "name string")).first()["folder"]
    assert (folder(["a/b/c", "a/b/d"]), folder(["a/b/c", "a/bb/d"]), folder(["x", "a/b"]), folder(["a/b/"])) == ("a/b", "a", "", "a")
    s = frame(spark, [("a/x", "u"), ("a/y", "u"), ("b/x", "u"), ("b/y", None), ("c/d/x", "u"), ("c/y", "v")], "name string, state string")
    assert {r["folder"]: r["state"] for r in B.folder_states(s).collect()} == {"a": "u", "b": None, "c": None, "c/d": "u"}


def test_unique_paths_take_the_first_gap(spark):
    taken = frame(spark, [("a.zip",), ("a 2.zip",), ("a 4.zip",), ("b 2.zip",), ("c.zip",), ("c 02.zip",)], "taken string")
    got = {r["path"]: r["free"] for r in B.unique_path(frame(spark, [("a.zip",), ("b.zip",), ("c.zip",), ("d",)], "path string"), taken).collect()}
    assert got == {"a.zip": "a 3.zip", "b.zip": "b.zip", "c.zip": "c 2.zip", "d": "d"}


@pytest.mark.parametrize(("size", "starts"), [(0, [0]), (100, [0]), (101, [0]), (250, [0, 150]), (210, [0, 110]), (1000, [150, 450, 750]), (10**12, [199_999_999_950, 499_999_999_950, 799_999_999_950])])
def test_sample_windows(spark, size, starts):
    assert spark.range(1).select(S.sample_windows(F.lit(size).cast("long"), 100)).first()[0] == starts


def test_segments_cover_entries(spark):
    df = frame(spark, [(0, 0, 8), (1, 4 << 20, 8), (2, (4 << 20) + 1, 8), (3, 9 << 20, 0), (4, 8 << 20, 0)], "entry long, size long, method int")
    got = {}
    for r in S.segments(df).orderBy("entry", "seg").collect():
        got.setdefault(r["entry"], []).append((r["first"], r["last"]))
    assert got[0] == [(0, 0)] and got[1] == [(0, 4 << 20)] and len(got[2]) == 5 and got[2][-1] == (4 << 20, (4 << 20) + 1)
    assert got[3] == [(0, 4 << 20), (4 << 20, 8 << 20), (8 << 20, 9 << 20)] and len(got[4]) == 2
    f = S.flac_segments(frame(spark, [(0, 0), (1, 64 * 4096 + 1)], "entry long, frames long")).orderBy("entry", "seg").collect()
    assert [(r["first"], r["last"]) for r in f] == [(0, 0), (0, 262_144), (262_144, 262_145)]


@pytest.mark.parametrize(("offset", "size", "wide"), [(0, 0, False), ((1 << 32) - 2, 0, False), ((1 << 32) - 1, 0, True), (0, (1 << 32) - 2, False), (0, (1 << 32) - 1, True), (0, None, True)])
def test_wide_fields(spark, offset, size, wide):
    assert spark.range(1).select(S.entry_zip64(F.lit(offset).cast("long"), F.lit(size).cast("long"))).first()[0] is wide


@pytest.mark.parametrize(("changes", "expected"), [
    ([("a/x", "a/y")], (1, 0)), ([("a/x", "b/x")], (1, 0)), ([("a/x", "b/x"), ("a/y", "b/y")], (1, 0)), ([("a/x", "c/a/x")], (0, 1)), ([("a/x", "b/y")], (1, 1)), ([("a/x", "x")], (0, 1)), ([("a/x", "a/x")], (0, 0)),
])
def test_moves_and_renames(spark, changes, expected):
    c = frame(spark, changes, "from string, to string")
    r = N.count_moves(c, c.select(F.col("from").alias("name")), c.select(F.col("to").alias("name"))).first()
    assert (r["renames"], r["moves"]) == expected


def test_a_folder_that_stays_was_not_renamed(spark):
    c = frame(spark, [("a/x", "b/x")], "from string, to string")
    before, after = frame(spark, [("a/x",), ("a/z",)], "name string"), frame(spark, [("b/x",), ("a/z",)], "name string")
    r = N.count_moves(c, before, after).first()
    assert (r["renames"], r["moves"]) == (0, 1)


def test_sessions_replay_undo_and_report(spark):
    base = frame(spark, [(0, "s0", "a/x", "file", 1, 0), (1, "s1", "a/y", "file", 2, 0), (2, "s2", "b", "file", 3, 0)], "entry long, source string, name string, kind string, size long, mtime long")
    s = N.Session(base)
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(s.apply(N.Op("rename_folder", "a", "c"))) == ["b", "c/x", "c/y"]
    assert names(s.apply(N.Op("remove", "b"), N.Op("rename", "zz", "q"))) == ["c/x", "c/y"] and s.problems == ["rename zz: no such entry"]
    fresh = frame(spark, [(0, "n0", "?", "file", 9, 5)], "entry long, source string, name string, kind string, size long, mtime long")
    s.apply(N.Op("replace", "c/x", rows=fresh))
    assert {(r["name"], r["state"]) for r in s.view().collect()} == {("c/x", "added"), ("a/x", "removed"), ("c/y", "renamed"), ("b", "removed")}
    assert names(s.undo()) == ["c/x", "c/y"] and names(s.undo()) == ["b", "c/x", "c/y"] and names(s.redo()) == ["c/x", "c/y"]
    s.apply(N.Op("new_folder", "d"))
    assert names(s.redo()) == ["c/x", "c/y", "d/"] and [r["entry"] for r in s.commit().orderBy("entry").collect()] == [0, 1, 2]


@pytest.mark.parametrize(("policy", "winner"), [("replace", ["n", "n", "n"]), ("keep", ["o", "o", "o"]), ("replace_if_newer", ["o", "o", "n"])])
def test_policies(spark, policy, winner):
    old, new = (frame(spark, [(k, s, t) for k, t in enumerate(times)], "key long, source string, mtime long") for s, times in (("o", (5, 5, 5)), ("n", (4, 5, 6))))
    assert [r["winner"] for r in N.existing_policy(old, new, policy).orderBy("key").collect()] == winner


def test_statuses(spark):
    o = frame(spark, [(3, "io_error"), (1, "ok"), (2, "crc_mismatch")], "entry long, status string")
    assert X.outcome_status(o).first()[0] == "crc_mismatch" and X.outcome_status(o.where("entry = 1")).first()[0] == "ok" and X.outcome_status(o.where("entry = 1"), "conflicts").first()[0] == "conflicts"


def test_streamed_totals_equal_batch_totals(spark, tmp_path):
    from shelfmark.streaming import folders as T

    df = spark.range(500).select(F.concat((F.col("id") % 5).cast("string"), F.lit("/"), (F.col("id") % 3).cast("string"), F.lit("/f")).alias("name"), F.lit("file").alias("kind"), F.col("id").alias("size"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    q = T.folder_totals(T.read_entries(spark, str(tmp_path / "in"), df.schema, 1)).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    got = {r["folder"]: (r["files"], r["size"]) for r in spark.table("totals").collect()}
    want = {r["folder"]: (r["files"], r["size"]) for r in T.folder_totals(df).collect()}
    assert got == want and len(want) == 20


def test_segments_plan_takes_little_disk(spark, tmp_path):
    from shelfmark.plans import catalogue, codec_queries

    key = F.col("id")
    rows = spark.range(200_000, numPartitions=1).select(key.alias("l_orderkey"), (key % 7 + 1).cast("int").alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) + 5000).alias("l_partkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = {}
    for name, df in (("plain", S.segments(codec_queries._big(spark, str(tmp_path)))), ("query", catalogue.queries()["segments_plan"](spark, str(tmp_path)))):
        df.write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}").select(F.count("*"), F.sum(F.xxhash64("entry", "seg", "first", "last").cast("decimal(38,0)"))).first()
    took = {name: sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")) for name in seen}
    assert seen["query"] == seen["plain"] and seen["query"][0] > 7_000_000
    assert took["query"] < seen["query"][0] * 0.6 and took["query"] * 2 < took["plain"]


def test_segments_plan_equals_sql_on_odd_rows(spark, tmp_path):
    """No quantity, no part, nothing and less than nothing, one row twice, sizes around 4 MiB and whole numbers of pieces."""
    import duckdb

    from shelfmark.plans import catalogue

    rows = [(1, 1, None, 7), (1, 2, 5.0, None), (2, 1, 0.0, 9), (2, 3, -4.0, 9), (3, 1, 50.0, 20_000), (3, 1, 50.0, 20_000), (4, 3, 50.0, 20_000), (None, 1, 30.0, 400), (5, None, 30.0, 400)]
    rows += [(k, n, q, k) for k in (4206, 4207, 8413, 8414, 1048576, 4194304) for n in (1, 3) for q in (1.0, 2.0)]
    rows += [(10_000_000 + k, 1 + k % 7, 1.0 + k % 3, 6000 + k % 5) for k in range(2000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    order = lambda found: sorted(found, key=repr)
    got = catalogue.queries()["segments_plan"](spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert order(tuple(r) for r in got.collect()) == order(c.execute(catalogue.oracle_sql()["segments_plan"]).fetchall())


def test_packed_segments_of_nothing(spark):
    assert S.packed_segments(frame(spark, [], "entry long, size long, method int")).collect() == []


def test_segments_plan_is_written_as_differences_in_row_groups(spark, tmp_path):
    """Rows of less than a byte: with dictionaries and row groups by size alone, Parquet's writer looks at the sizes after every row."""
    from pyarrow.parquet import ParquetFile

    from shelfmark.plans import catalogue

    key = F.col("id")
    rows = spark.range(30_000, numPartitions=1).select(key.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(50.0).alias("l_quantity"), (F.pmod(key * 7919, F.lit(3000)) + 2000).alias("l_partkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.getAll
    got = catalogue.queries()["segments_plan"](spark, str(tmp_path))
    assert spark.conf.getAll == before and {k: got.sparkSession.conf.get(k) for k in before} == before | {k: v for k, v in S.PACKING.items() if k in before}
    got.write.parquet(f"{tmp_path}/out")
    files = [ParquetFile(p) for p in (tmp_path / "out").glob("*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == got.count() > S.GROUP_ROWS >= max(g.num_rows for g in groups)
    assert {e for g in groups for k in range(4) for e in g.column(k).encodings if e != "RLE"} == {"DELTA_BINARY_PACKED"}
    assert all(f.schema.column(k).max_definition_level == 0 for f in files for k in range(4))
    rows.limit(10).write.parquet(f"{tmp_path}/other")
    assert "DELTA_BINARY_PACKED" not in {e for p in (tmp_path / "other").glob("*.parquet") for k in range(4) for e in ParquetFile(p).metadata.row_group(0).column(k).encodings}


def test_packed_segments_deals_out_a_large_task_only(spark):
    one = spark.range(4000).select(F.col("id").alias("entry"), F.lit(1 << 33).alias("size"), F.lit(8).alias("method")).coalesce(1)
    even = spark.range(0, 4000, 1, 4).select(F.col("id").alias("entry"), F.lit(1 << 20).alias("size"), F.lit(8).alias("method"))
    for entries, dealt in ((one, True), (even, False)):
        packed = S.packed_segments(entries)
        assert ("Exchange" in packed._jdf.queryExecution().executedPlan().toString()) == dealt
        count = packed.select(F.count("*"), F.countDistinct("entry"), F.sum(F.col("last") - F.col("first"))).first()
        assert tuple(count) == (4000 * (8192 if dealt else 1), 4000, 4000 * (1 << (33 if dealt else 20)))
    nameless = S.packed_segments(frame(spark, [(None, 5 << 20, 0), (1, 7, 8), (2, None, 8)], "entry long, size long, method int"))
    assert sorted(map(tuple, nameless.collect()), key=repr) == sorted([(None, 0, 0, 4 << 20), (None, 1, 4 << 20, 5 << 20), (1, 0, 0, 7)], key=repr)
