import json
import os
import zipfile

from pyspark.sql import functions as F

from shelfmark.__main__ import main
from shelfmark.functions import display as D
from shelfmark.plans import archive as V


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.txt").write_text("words " * 400)
    (root / "b.tmp").write_text("x")
    path = str(tmp_path / "a.zip")
    assert main(["create", path, str(root), "--exclude", "*.tmp"]) == 0
    with zipfile.ZipFile(path) as z:
        assert sorted(z.namelist()) == ["src/", "src/a.txt"]
    assert main(["verify", path]) == 0
    assert main(["list", path]) == 0
    assert main(["preview", path]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["files"] == 1
    assert main(["--json", "extract", path, str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "src" / "a.txt").read_text() == "words " * 400
    twin = tmp_path / "SRC"
    twin.mkdir()
    assert main(["create", str(tmp_path / "b.zip"), str(root), str(twin)]) == 3


def test_callbacks(spark, tmp_path):
    items = V.scan_memory(spark, [("a", "file", None, 0, 0), ("b", "file", None, 0, 0), ("d", "directory", None, 0, 0)]).drop("content")

    def read(path):
        if path.endswith("b"):
            raise OSError("gone")
        return path.encode()

    got = {r["archive_path"]: r["content"] for r in V.scan_callback(items, read).collect()}
    assert got == {"a": bytearray(b"memory:a"), "b": None, "d": None}
    out = str(tmp_path)
    rows = spark.createDataFrame([("x", bytearray(b"1")), ("y", None)], "target string, content binary")
    V.write_callback(rows, lambda target, data: open(f"{out}/{target}", "wb").write(data) and None)
    assert sorted(os.listdir(out)) == ["x", "y"]


def test_files_of_any_store_are_listed_without_their_bytes(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"123")
    df = V.scan_files(spark, f"file://{tmp_path}")
    assert df.select("size", "kind").first() == (3, "file")
    assert "content" not in df.select("size")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_templates_fill_once(spark):
    t = spark.createDataFrame([("Hi {name}, {app}!\n{other}", "{app}")], "t string, n string")
    assert t.select(D.render(F.col("t"), {"name": F.col("n"), "app": F.lit("S")})).first()[0] == "Hi {app}, S!\r\n{other}"


def test_plans_describe_and_predict(spark):
    items = V.scan_memory(spark, [("d", "directory", None, 5, 0o755), ("d/t", "file", b"text " * 500, 5, 0o644), ("d/r", "file", os.urandom(3000), 5, 0o644), ("l", "symlink", None, 0, 0)])
    plan = V.Plan.of(items)
    names = {r["entry"]: r["output_name"] for r in plan.entries.collect()}
    methods = {names[r["entry"]]: r["method"] for r in plan.methods().collect()}
    assert methods == {"d/": "Folder", "d/t": "Deflate", "d/r": "Store"} and plan.total_bytes() == 5500
    assert json.loads(plan.describe().where("entry = 1").first()["json"])["codec"] == "general"
