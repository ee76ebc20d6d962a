"""Folders as rows: a Python data source that walks without following links, and a writer that replaces files whole."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.globs import Glob, compile_patterns

SCHEMA = "seq long, source_path string, archive_path string, kind string, size long, mtime_ns long, unix_mode int, error string, excluded boolean"


def lstat_kind(path: str) -> tuple[str, os.stat_result]:
    """file, directory, symlink or other, of the path itself."""
    s = os.lstat(path)
    for test, kind in ((stat.S_ISLNK, "symlink"), (stat.S_ISREG, "file"), (stat.S_ISDIR, "directory")):
        if test(s.st_mode):
            return kind, s
    return "other", s


def walk(root: str, globs: list[Glob]) -> Iterator[tuple]:
    """Rows of SCHEMA below one root, children in byte order. What a pattern excludes is a row that says so and, if it is a folder, is not listed; a root is never excluded. What cannot be read is a row with an error."""
    clean = root.rstrip("/") or "/"
    name = os.path.basename(clean)
    if name in ("", ".", ".."):
        yield 0, root, None, "other", 0, 0, 0, "a root needs a name", False
        return
    seq, stack = 0, [(clean, name, False)]
    while stack:
        path, arc, cut = stack.pop()
        try:
            kind, s = lstat_kind(path)
        except OSError as e:
            yield seq, path, arc, "other", 0, 0, 0, e.strerror, cut
            seq += 1
            continue
        if kind == "other" and path != clean and not cut:
            continue
        found, error = [], "not a file, folder or link" if kind == "other" else None
        if kind == "directory" and not cut:
            try:
                children = sorted(os.listdir(path), key=os.fsencode, reverse=True)
            except OSError as e:
                children, error = [], e.strerror
            for child in children:
                full = f"{path}/{child}"
                folder = os.path.isdir(full) and not os.path.islink(full)
                found.append((full, f"{arc}/{child}", any(g.matches(child, folder) for g in globs)))
        yield seq, path, arc, kind, s.st_size if kind == "file" else 0, s.st_mtime_ns, stat.S_IMODE(s.st_mode), error, cut
        seq += 1
        stack += found


class _Root(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], patterns: list[str], presets: tuple[str, ...]) -> None:
        self.roots, self.patterns, self.presets = roots, patterns, presets

    def partitions(self) -> list[InputPartition]:
        return [_Root(r) for r in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return walk(partition.value, compile_patterns(self.patterns, self.presets))


class FolderSource(DataSource):
    """spark.read.format("folders").option("roots", "a\\nb").option("exclude", "*.tmp\\nbuild/").option("presets", "system")"""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        lines = lambda key: [x for x in self.options.get(key, "").split("\n") if x]
        return _Reader(lines("roots"), lines("exclude"), tuple(lines("presets")))


def write_atomic(path: str, data: bytes, replace: bool = True, mode: int | None = None, mtime: int | None = None) -> None:
    """All of a file or nothing: a temporary file beside it, flushed, given its attributes, then put in place; its folder is flushed too. Without replace a file that is there stays, and FileExistsError is raised."""
    temporary = f"{path}.{os.getpid()}.part"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if mode:
            os.chmod(temporary, mode & 0o777)
        if mtime is not None:
            os.utime(temporary, (mtime, mtime))
        if replace:
            os.replace(temporary, path)
        else:
            os.link(temporary, path)
        folder = os.open(os.path.dirname(path) or ".", os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def existing(targets: DataFrame, root: str) -> DataFrame:
    """target of those (target) that are there below a shared folder."""
    def run(batches):
        for pdf in batches:
            yield pdf[[os.path.lexists(f"{root}/{t}") for t in pdf["target"]]]

    return targets.select("target").where("target is not null").mapInPandas(run, "target string")


def write_tree(items: DataFrame, root: str) -> DataFrame:
    """Writes items (entry, target, kind, content, decision, unix_mode, mtime) below a shared folder, each by one task; entry, target, status of each. Links on the way are refused; only the decision `replace` replaces a file."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for entry, target, kind, content, decision, mode, mtime in zip(*(pdf[c] for c in names), strict=True):
                path, status = f"{root}/{target}", "ok"
                parts = target.strip("/").split("/")
                try:
                    if any(os.path.islink("/".join([root, *parts[:k]])) for k in range(1, len(parts) + 1)):
                        raise OSError("a link is in the way")
                    os.makedirs(path if kind == "directory" else os.path.dirname(path), exist_ok=True)
                    if kind != "directory":
                        write_atomic(path, bytes(content if content is not None else b""), decision == "replace", None if pd.isna(mode) else int(mode), None if pd.isna(mtime) else int(mtime))
                except FileExistsError:
                    status = "exists"
                except OSError as e:
                    status = f"io_error: {e}"
                out.append((entry, target, status))
            yield pd.DataFrame(out, columns=["entry", "target", "status"])

    names = ("entry", "target", "kind", "content", "decision", "unix_mode", "mtime")
    return items.select(*names).mapInPandas(run, "entry long, target string, status string")


def finish_folders(items: DataFrame, root: str) -> DataFrame:
    """Sets modes and times of folders (target, unix_mode, mtime), once all that lies in them is written; target, status."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for target, mode, mtime in zip(pdf["target"], pdf["unix_mode"], pdf["mtime"], strict=True):
                status = "ok"
                try:
                    if not pd.isna(mtime):
                        os.utime(f"{root}/{target}", (int(mtime), int(mtime)))
                    if not pd.isna(mode) and int(mode):
                        os.chmod(f"{root}/{target}", int(mode) & 0o777)
                except OSError as e:
                    status = f"io_error: {e}"
                out.append((target, status))
            yield pd.DataFrame(out, columns=["target", "status"])

    return items.select("target", "unix_mode", "mtime").mapInPandas(run, "target string, status string")


def discard(items: DataFrame) -> None:
    """Runs everything and keeps nothing."""
    items.write.format("noop").mode("overwrite").save()
