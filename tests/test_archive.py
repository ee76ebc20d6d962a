import io
import os
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from fixtures import bext, crafted_zip, tone, wav
from pyspark.sql import functions as F

from shelfmark.operators import codecs as K
from shelfmark.plans import archive as V
from shelfmark.sources import archive as Z
from shelfmark.sources import filesystem as FS


def rows(data):
    names = [c.split(" ")[0] for c in Z.SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in Z.catalog(io.BytesIO(data), "a.zip")]


def unicode_path(raw, name, right=True):
    body = b"\1" + struct.pack("<I", zlib.crc32(raw) ^ (not right)) + name.encode()
    return struct.pack("<HH", 0x7075, len(body)) + body


def test_names_are_decoded_by_flag_field_or_code_page():
    got = rows(crafted_zip([
        {"name": b"caf\x82"}, {"name": "café".encode(), "flags": 0x800}, {"name": b"\xff\xfe", "flags": 0x800},
        {"name": b"x1", "extra": unicode_path(b"x1", "ü")}, {"name": b"x2", "extra": unicode_path(b"x2", "ü", False)},
    ]))
    assert [r["name"] for r in got] == ["café", "café", "\xa0■", "ü", "x2"]
    assert got[0]["raw_name"] == b"caf\x82"


def test_kinds_methods_and_modes():
    got = rows(crafted_zip([
        {"name": b"l", "made": 3 << 8, "attributes": 0o120777 << 16}, {"name": b"d/"}, {"name": b"e", "attributes": 16}, {"name": b"f", "made": 19 << 8, "attributes": 0o100640 << 16},
        {"name": b"g", "method": 12}, {"name": b"h", "flags": 1}, {"name": b"i", "made": 0, "attributes": 0o120777 << 16}, {"name": b"j", "method": 8, "data": b"abc" * 50},
    ]))
    assert [r["kind"] for r in got] == ["symlink", "directory", "directory", "file", "file", "file", "file", "file"]
    assert [r["unix_mode"] for r in got] == [0o777, None, None, 0o640, None, None, None, None]
    assert [r["method"] for r in got] == ["store"] * 4 + ["unsupported", "unsupported", "store", "deflate"]


def test_times_prefer_the_extended_field():
    stamp = struct.pack("<HHBi", 0x5455, 5, 1, -5)
    got = rows(crafted_zip([{"name": b"a", "extra": stamp}, {"name": b"b"}]))
    assert [r["mtime"] for r in got] == [-5, 315_532_800]


@pytest.mark.parametrize("data", [b"", b"PK", crafted_zip([{"name": b"a"}], truncate=5), crafted_zip([{"name": b"a"}]).replace(b"PK\x01\x02", b"PK\x01\x03")])
def test_damaged_archives_are_refused(data):
    with pytest.raises(Z.ArchiveError):
        rows(data)


def test_comments_never_fail():
    import base64

    good = b"text\nmark:" + base64.b64encode(b"MAGICrest")
    assert Z.metadata_comment(good, b"mark:", b"MAGIC") == b"MAGICrest"
    for c in (None, b"", b"mark:", b"mark:???", b"mark:" + base64.b64encode(b"other"), good + b"\nmark:x"):
        assert Z.metadata_comment(c, b"mark:", b"MAGIC") is None


def test_packed_archives_are_read_by_others():
    out = io.BytesIO()
    entries = [{"name": "d/", "kind": "directory", "method": 0, "size": 0, "crc32": 0, "mtime": 1_700_000_000, "unix_mode": 0o755, "raw": b""}, {"name": "d/ü.txt", "kind": "file", "method": 8, "size": 300, "crc32": zlib.crc32(b"abc" * 100), "mtime": 1_700_000_000, "unix_mode": 0o600, "raw": K.deflate_segment(b"abc" * 100, 6)}]
    assert Z.pack_archive(iter(entries), out, b"note") == 2
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("d/ü.txt") == b"abc" * 100 and z.comment == b"note"
    got = rows(out.getvalue())
    assert [(r["name"], r["unix_mode"], r["mtime"], r["kind"]) for r in got] == [("d/", 0o755, 1_700_000_000, "directory"), ("d/ü.txt", 0o600, 1_700_000_000, "file")]


def test_many_entries_need_wide_counts():
    out = io.BytesIO()
    one = {"kind": "file", "method": 0, "size": 0, "crc32": 0, "mtime": 0, "unix_mode": None, "raw": b""}
    Z.pack_archive(({**one, "name": str(k)} for k in range(65_536)), out)
    got = rows(out.getvalue())
    assert len(got) == 65_536 and got[0]["zip64"]


def test_checksums_combine():
    a, b = b"hello " * 99, b"world" * 7
    assert K.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert K.crc_combine(0, zlib.crc32(a), len(a)) == zlib.crc32(a) and K.crc_combine(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_segments_join_to_one_stream(spark):
    data = [b"", b"x", os.urandom(3_000_000), b"the same words " * 300_000]
    e = spark.createDataFrame([(k, 8, len(d), bytearray(d)) for k, d in enumerate(data)], "entry long, method int, size long, content binary")
    for parts in (1, 5):
        joined = K.join_segments(K.encode_segments(e.repartition(parts)))
        got = {r["entry"]: r for r in joined.collect()}
        for k, d in enumerate(data):
            assert zlib.decompress(bytes(got[k]["raw"]), -15) == d and got[k]["crc32"] == zlib.crc32(d) and got[k]["size"] == len(d)


def test_bad_data_has_a_status(spark):
    good = K.deflate_segment(b"abc", 6)
    df = spark.createDataFrame([(bytearray(good), 8), (bytearray(good[:-1]), 8), (bytearray(b"\xff\xff"), 8), (bytearray(b"x"), 0), (bytearray(b"x"), 12)], "raw binary, method int")
    assert [r[0] for r in df.select(K.decode(F.col("raw"), F.col("method"))["status"]).collect()] == ["ok", "corrupt_archive", "corrupt_archive", "ok", "unsupported_method"]


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "take"
    (root / "sub" / "empty").mkdir(parents=True)
    (root / ".DS_Store").write_bytes(b"x")
    (root / "notes.txt").write_bytes(b"some words " * 500)
    (root / "noise.bin").write_bytes(os.urandom(5000))
    (root / "sub" / "a.wav").write_bytes(wav(tone(), 16, before=bext()))
    (root / "sub" / "float.wav").write_bytes(wav(tone(), 16, tag=3))
    (root / "zero").write_bytes(b"")
    os.symlink("notes.txt", root / "link")
    return root


def test_walk_is_ordered_and_pruned(tree):
    from shelfmark.functions.globs import compile_patterns

    rows = list(FS.walk(str(tree), compile_patterns(["sub/"], ("system",))))
    assert [r[2] for r in rows if not r[8]] == ["take", "take/link", "take/noise.bin", "take/notes.txt", "take/zero"]
    assert [(r[2], r[3]) for r in rows if r[8]] == [("take/.DS_Store", "file"), ("take/sub", "directory")]  # reported once, not looked into
    assert [r[7] for r in FS.walk("..", [])] == ["a root needs a name"]


def test_what_cannot_be_listed_is_a_row(tree, monkeypatch):
    real = os.listdir

    def listdir(path):
        if str(path).endswith("sub"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "listdir", listdir)
    rows = {r[2]: r for r in FS.walk(str(tree), [])}
    assert rows["take/sub"][7] == "Permission denied" and "take/zero" in rows and "take/sub/a.wav" not in rows


def test_scans_tell_what_they_left_out(spark, tree):
    got = [(r["archive_path"], r["kind"], r["entry"]) for r in V.scan_excluded(spark, [str(tree)], ["sub/"], ("system",)).orderBy("entry").collect()]
    assert got == [("take/.DS_Store", "file", 0), ("take/sub", "directory", 1)]


def test_many_channels_make_the_round_trip(spark, tmp_path):
    root = tmp_path / "multi"
    root.mkdir()
    data = wav(tone(channels=16, frames=3000), 16, before=bext(), trailing=b"tail")
    (root / "a.WAV").write_bytes(data)
    (root / "b.wav").write_bytes(wav(tone(channels=9, frames=10), 16))
    plan = V.Plan.of(V.scan_folders(spark, [str(root)]))
    entries = plan.entries.drop("content").collect()
    assert sum(r["codec"] == "flac_mono" for r in entries) == 25 and plan.executable()
    assert {r["output_name"] for r in entries if r["channel_index"] == 16} == {"multi/a_ch16.flac"}
    assert len({r["group_id"] for r in entries if r["group_id"]}) == 2 and [r["entry"] for r in sorted(entries, key=lambda r: r["entry"])] == list(range(len(entries)))
    path = str(tmp_path / "m.zip")
    assert plan.build(path) == len(entries)
    a = V.Archive(spark, path)
    assert {r["status"] for r in a.verify().collect()} == {"ok"} and a.verify().count() == len(entries)
    assert a.preview()["restorable"] == 2
    out = tmp_path / "back"
    assert {r["status"] for r in a.extract(str(out)).collect()} == {"ok"}
    assert (out / "multi" / "a.WAV").read_bytes() == data and sorted(os.listdir(out / "multi")) == ["a.WAV", "b.wav"]
    # without one channel nothing is made of the others, and every member says why
    cut = str(tmp_path / "cut.zip")
    V.Editor(a).remove("multi/a_ch03.flac").commit(cut)
    status = Counter(r["status"] for r in V.Archive(spark, cut).verify().collect())
    assert status["incomplete_group"] == 15
    left = V.Archive(spark, cut).extract(str(tmp_path / "cut")).collect()
    assert Counter(r["status"] for r in left)["incomplete_group"] == 15 and not (tmp_path / "cut" / "multi" / "a.WAV").exists()


def test_extraction_obeys_its_decision(spark, tmp_path):
    path = tmp_path / "a.zip"
    path.write_bytes(crafted_zip([{"name": b"d/"}, {"name": b"d/old", "data": b"new"}, {"name": b"d/x", "data": b"x"}, {"name": b"f", "data": b"file"}, {"name": b"f/below", "data": b"no"}, {"name": b"README.txt", "data": b"the user's own"}]))
    a = V.Archive(spark, str(path))
    for answer, content, status in (("skip", b"old", "skipped"), ("undecided", b"old", "exists"), ("replace", b"new", "ok")):
        out = tmp_path / answer
        (out / "d").mkdir(parents=True)
        (out / "d" / "old").write_bytes(b"old")
        rows = a.extract(str(out), answer)
        done = {r["target"]: r["status"] for r in rows.collect()}
        assert done == {"d": "ok", "d/old": status, "d/x": "ok", "f": "ok", "f/below": "parent_clash", "README.txt": "ok"}
        assert (out / "d" / "old").read_bytes() == content and (out / "README.txt").read_bytes() == b"the user's own"
        assert {r["target"]: r["status"] for r in rows.collect()} == done  # asked again, not written again
    with pytest.raises(ValueError):
        a.extract(str(tmp_path), "maybe")
    with pytest.raises(FileExistsError):
        FS.write_atomic(str(tmp_path / "skip" / "d" / "old"), b"z", replace=False)


def test_modes_and_times_come_back(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "run").write_bytes(b"#!")
    os.chmod(root / "sub" / "run", 0o750)
    for p in (root / "sub" / "run", root / "sub", root):
        os.utime(p, (1_600_000_000, 1_600_000_000))
    path = str(tmp_path / "t.zip")
    V.Plan.of(V.scan_folders(spark, [str(root)])).build(path)
    V.Archive(spark, path).extract(str(tmp_path / "out")).collect()
    made = tmp_path / "out" / "src" / "sub"
    assert (made / "run").stat().st_mode & 0o777 == 0o750 and int((made / "run").stat().st_mtime) == int(made.stat().st_mtime) == 1_600_000_000


def test_round_trip_of_a_folder(spark, tree, tmp_path):
    items = V.scan_folders(spark, [str(tree)], presets=("system",))
    plan = V.Plan.of(items)
    assert [r["source_path"].rsplit("/")[-1] for r in plan.warnings.collect()] == ["link"]
    entries = {r["output_name"]: r for r in plan.entries.drop("content").collect()}
    assert entries["take/sub/a.flac"]["codec"] == "flac" and entries["take/sub/float.wav"]["fallback_reason"] == "float_samples" and "README.txt" in entries
    assert plan.executable()
    path = str(tmp_path / "out.zip")
    assert plan.build(path) == len(entries)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "take/sub/empty/" in z.namelist()
    a = V.Archive(spark, path)
    listed = {r["name"]: r for r in a.entries().collect()}
    assert listed["take/sub/a.flac"]["original_size"] == os.path.getsize(tree / "sub" / "a.wav") and listed["take/notes.txt"]["method"] == "deflate" and listed["take/noise.bin"]["method"] == "store"
    assert {r["status"] for r in a.verify().collect()} == {"ok"}
    assert {r["status"] for r in a.extract(str(tmp_path / "back")).collect()} == {"ok"}
    for name in ("notes.txt", "noise.bin", "zero", "sub/a.wav", "sub/float.wav"):
        assert (tmp_path / "back" / "take" / name).read_bytes() == (tree / name).read_bytes()
    assert (tmp_path / "back" / "take" / "sub" / "empty").is_dir()
    p = a.preview()
    assert p["restorable"] == 1 and not p["truncated"] and "a.flac" in a.preview_html()
    # an edited copy keeps what it does not touch as it is stored
    edited = str(tmp_path / "edited.zip")
    more = V.Plan.of(V.scan_memory(spark, [("new.txt", "file", b"new", 0, 0o644)]))
    V.Editor(a).remove("take/zero").rename("take/notes.txt", "n.txt").add(more).commit(edited)
    with zipfile.ZipFile(edited) as z:
        assert z.testzip() is None and z.read("n.txt") == (tree / "notes.txt").read_bytes() and z.read("new.txt") == b"new" and "take/zero" not in z.namelist()
    with pytest.raises(V.ConflictsUnresolved):
        V.Editor(a).rename("take/notes.txt", "TAKE/zero").commit(edited)


def test_hostile_archives_stay_inside(spark, tmp_path):
    path = tmp_path / "bad.zip"
    path.write_bytes(crafted_zip([{"name": b"../up"}, {"name": b"/abs"}, {"name": b"ok.txt", "data": b"fine"}, {"name": b"Same", "data": b"1"}, {"name": b"same", "data": b"2"}, {"name": b"sum", "data": b"x", "crc": 7}]))
    a = V.Archive(spark, str(path))
    there = spark.createDataFrame([("ok.txt",)], "target string")
    p = a.extraction_plan(there)
    assert {(r["target"], r["kind"]) for r in p["issues"].collect()} == {("../up", "unsafe_path"), ("/abs", "unsafe_path"), ("Same", "collision"), ("same", "collision"), ("ok.txt", "exists")}
    done = {r["target"]: r["status"] for r in a.extract(str(tmp_path / "x")).collect()}
    assert done == {"ok.txt": "ok", "../up": "unsafe_path", "/abs": "unsafe_path", "Same": "collision", "same": "collision", "sum": "crc_mismatch"} and not (tmp_path / "up").exists()
    assert {r["entry"]: r["status"] for r in a.verify().collect()}[5] == "crc_mismatch"


def test_any_store_is_listed_like_a_file(spark, tmp_path):
    path = tmp_path / "a.zip"
    path.write_bytes(crafted_zip([{"name": b"a", "data": b"1"}, {"name": b"b/"}]))
    (tmp_path / "no.zip").write_bytes(b"nothing")
    cols = ("entry", "name", "kind", "size", "crc32")
    local = V.Archive(spark, str(path)).rows().select(*cols).orderBy("entry").collect()
    any_ = Z.read_catalog(spark, f"file://{path}").select(*cols).orderBy("entry").collect()
    assert local == any_ and len(any_) == 2
    assert Z.read_catalog(spark, f"file://{tmp_path}/no.zip").first()["error"]
    assert V.Archive(spark, str(tmp_path / "missing.zip")).rows().first()["error"]
