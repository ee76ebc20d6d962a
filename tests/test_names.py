import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import display as D
from shelfmark.functions import globs as G
from shelfmark.functions import paths as P


def one(spark, *columns, **values):
    return list(spark.range(1).select(*columns).first())


def table(spark, values, column="s", type_="string"):
    return spark.createDataFrame([(v,) for v in values], f"{column} {type_}")


def both(spark, values, f):
    return [r[0] for r in table(spark, values).select(f(F.col("s"))).collect()]


def test_normalize(spark):
    got = both(spark, ["./a/./b/", "././x", "/", "//", "a\\b", "Cafe\u0301", "a\0b", "", "a//"], P.normalize)
    assert got == ["a/./b", "x", "/", "/", "a/b", "Caf\u00e9", None, "", "a"]


def test_keys_fold_in_full(spark):
    a = both(spark, ["STRASSE", "stra\u00dfe", "Cafe\u0301/X/", "caf\u00c9/x"], P.collision_key)
    assert a[0] == a[1] == "strasse" and a[2] == a[3]


def test_archive_names(spark):
    got = both(spark, ["a/b", "", "x" * 65536, "a\\b", "/a", "c:x", "a//b", "a/./b", "a/..", None], P.archive_name_problem)
    assert got == [None, "empty name", "name too long", "backslash", "absolute path", "drive letter", "empty segment", "dot segment", "dot segment", "empty name"]


def test_extraction_names(spark):
    names = ["a/b", "../a", "/a", "C:\\a", "a\\b", "a//./b", "a/b:c", ".", "", "a\0", "x/../../b:c"]
    assert both(spark, names, P.extraction_path) == ["a/b", None, None, None, "a/b", "a/b", None, None, None, None, None]
    assert both(spark, names, P.extraction_problem)[-1] == "escapes the destination"


def test_stems_and_members(spark):
    assert both(spark, ["d.x/name", "d/n.tar.gz", ".hidden", "x/.hidden", "a."], P.extension) == ["", ".gz", "", "", "."]
    assert both(spark, ["d.x/name", "d/n.tar.gz", ".hidden", "x/.hidden"], P.stem) == ["d.x/name", "d/n.tar", ".hidden", "x/.hidden"]
    f = lambda c: P.flac_stem(c, F.lit(True))
    assert both(spark, ["a_ch01.flac", "a.FLAC", "a_ch.flac", "a_chx1.flac"], f) == ["a", "a", "a_ch", "a_chx1"]
    m = lambda k, n: spark.range(1).select(P.member_name(F.lit("s"), F.lit(k), F.lit(n))).first()[0]
    assert (m(1, 9), m(7, 100), m(128, 128)) == ("s_ch01.flac", "s_ch007.flac", "s_ch128.flac")


def test_group_ids_are_stable(spark):
    ids = {spark.range(1).select(F.hex(P.group_id(F.lit(s), F.lit(n).cast("long"), F.lit(t).cast("long")))).first()[0] for s, n, t in (("a", 1, 2), ("a", 1, 3), ("a", 2, 2), ("b", 1, 2), ("a", 1, 2))}
    assert len(ids) == 4 and all(len(i) == 32 and i[12] == "8" and i[16] in "89AB" for i in ids)


def test_ancestors_and_output_names(spark):
    assert both(spark, ["a", "a/b", "a/b/c", "a/b/"], P.ancestors) == [[], ["a"], ["a", "a/b"], ["a"]]
    name = lambda v: spark.createDataFrame([(v,)], "n array<string>").select(P.archive_output_name(F.col("n"))).first()[0]
    assert (name(["x/one.wav"]), name(["x/a", "x/b"]), name(["x/a", "y/b"])) == ("one.wav.zip", "x.zip", "Archive.zip")


def human(b):
    x, u = float(b), 0
    while x >= 1000 and u < 4:
        x, u = x / 1000, u + 1
    return f"{b} B" if u == 0 else f"{x:.1f} {D.UNITS[u]}"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=300))
def test_sizes_round_as_binary_values(spark, values):
    values += [999, 1000, 1250, 1350, 1850, 999_949, 999_950, 1_050_000]
    got = [r[0] for r in table(spark, values, type_="long").select(D.human_size(F.col("s"))).collect()]
    assert got == [human(v) for v in values]


def test_savings(spark):
    rows = spark.createDataFrame([(0, 0), (200, 1), (1000, 995), (1000, 1005), (8, 7)], "s long, p long")
    assert [r[0] for r in rows.select(D.percent_saved(F.col("s"), F.col("p"))).collect()] == [0, 100, 1, 0, 13]
    assert [r[0] for r in rows.select(D.percent_text(F.col("s"), F.col("p"))).collect()] == ["", "100% smaller", "1% smaller", "0% larger", "12% smaller"]


@pytest.mark.parametrize(("rate", "samples", "text"), [("25", 48_000 * 3600, "01:00:00:00"), ("30000/1001 DF", 48_000 * 600, "00:10:00;00"), ("30000/1001 NDF", 48_000 * 600, "00:09:59:12"), ("", 48_000 * 90_000 + 24, "01:00:00.000"), ("60000/1001 DF", 48_000 * 60, "00:01:00;00"), ("24", 0, "00:00:00:00"), ("x", 48, "00:00:00.001")])
def test_timecode(spark, rate, samples, text):
    got = spark.range(1).select(D.timecode(F.lit(samples).cast("long"), F.lit(48_000).cast("long"), *D.frame_rate(F.lit(rate)))).first()[0]
    assert got == text or rate.startswith("60000")


def test_times_before_1970(spark):
    rows = table(spark, [-1, 0, 1_999_999_999, -1_000_000_000, -1_000_000_001], type_="long")
    assert [r[0] for r in rows.select(D.mtime_seconds(F.col("s"))).collect()] == [-1, 0, 1, -1, -2]


def test_texts(spark):
    assert both(spark, ["a&b<c>\"d'"], D.html_escape) == ["a&amp;b&lt;c&gt;&quot;d&#39;"]
    assert both(spark, ["<T> x &amp;lt; </T>", "none", "<T></T>"], lambda c: D.xml_text(c, "T")) == ["x &lt;", None, ""]
    raw = spark.createDataFrame([(bytearray(b"caf\xc3\xa9 \0x"),), (bytearray(b"caf\xe9"),)], "b binary")
    assert [r[0] for r in raw.select(D.latin1_or_utf8(F.col("b"))).collect()] == ["caf\u00e9", "caf\u00e9"]


GLOBS = [("*.tmp", "A.TMP", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "Bx", True), ("[!a-c]x", "bx", False), ("[^a]x", "bx", True), ("[]]x", "]x", True), ("\\*", "*", True), ("\\*", "a", False), ("stra\u00dfe", "STRASSE", True), ("~$*", "~$doc", True), ("*", "", True), ("a*b*c", "aXbYc", True), ("[z-a]x", "mx", False)]


@pytest.mark.parametrize(("pattern", "name", "hit"), GLOBS)
def test_globs(spark, pattern, name, hit):
    g = G.Glob.parse(pattern)
    assert g.matches(name, False) is hit
    assert both(spark, [name], lambda c: G.matches(P.fold(c), F.lit(False), [g])) == [hit]


@pytest.mark.parametrize("pattern", ["", "/", "a/b", "a\0", "a\\", "[a", "[", "[!"])
def test_bad_globs(pattern):
    with pytest.raises(G.PatternError):
        G.Glob.parse(pattern)


def test_folder_globs_and_presets():
    g = G.Glob.parse("build/")
    assert g.matches("Build", True) and not g.matches("build", False)
    assert any(x.matches(".ds_store", False) for x in G.compile_patterns([], ("system",)))
    assert not any(x.matches("take.wav", False) for x in G.compile_patterns([], ("system", "daw_cache")))


def test_minutes_of_far_years(spark):
    seconds = [-400_000_000, -1, 0, 253_402_300_799, 253_402_300_800, 899_626_588_997, -62_135_596_801, -62_167_219_201, -65_961_907_200, None]
    want = ["1957-04-29 08:53", "1969-12-31 23:59", "1970-01-01 00:00", "9999-12-31 23:59", "10000-01-01 00:00", "30478-01-11 18:43", "0000-12-31 23:59", "-1-12-31 23:59", "-121-10-02 00:00", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [r[0] for r in table(spark, seconds, type_="long").select(D.minute_text(F.col("s"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_format_equals_sql_beyond_year_9999(spark, tmp_path):
    import duckdb

    from shelfmark.plans import catalogue

    keys = [0, 1, 149_999, 2_537_946, 2_537_947, 2_538_000, 8_999_999, -600_000, -630_000, None]
    spark.createDataFrame([(k, n, n * 7) for n, k in enumerate(keys)], "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalogue.queries()["time_format"](spark, str(tmp_path)).orderBy("l_linenumber").collect()]
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == c.execute(catalogue.oracle_sql()["time_format"] + " order by l_linenumber").fetchall()
