"""Zip archives as rows: the catalogue without the data, entries decoded on demand, and a writer of encoded entries."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.operators.codecs import CODECS

SCHEMA = "archive string, entry long, name string, raw_name binary, kind string, raw_method int, method string, encrypted boolean, packed long, size long, crc32 long, mtime long, unix_mode int, offset long, zip64 boolean, comment binary, error string"

_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL = 0xFFFFFFFF


class ArchiveError(ValueError):
    """An archive that cannot be listed."""


def _extras(data: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(data):
        tag, n = struct.unpack_from("<HH", data, at)
        out.setdefault(tag, data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def entry_name(raw: bytes, flags: int, extras: dict[int, bytes]) -> str:
    """UTF-8 if flagged and valid, else the Unicode-path field if it is about these bytes, else code page 437."""
    if flags & 0x800:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
    field = extras.get(0x7075, b"")
    if len(field) > 5 and field[0] == 1 and struct.unpack_from("<I", field, 1)[0] == zlib.crc32(raw):
        try:
            return field[5:].decode()
        except UnicodeDecodeError:
            pass
    return raw.decode("cp437")


def entry_time(date: int, clock: int, extras: dict[int, bytes]) -> int:
    """Seconds since 1970: the extended timestamp, else NTFS, else the DOS fields taken as UTC."""
    field = extras.get(0x5455, b"")
    if len(field) >= 5 and field[0] & 1:
        return struct.unpack_from("<i", field, 1)[0]
    field = extras.get(0x000A, b"")
    if len(field) >= 16 and struct.unpack_from("<HH", field, 4) == (1, 24):
        return struct.unpack_from("<q", field, 8)[0] // 10_000_000 - 11_644_473_600
    try:
        return int(datetime(1980 + (date >> 9), date >> 5 & 15, date & 31, clock >> 11, clock >> 5 & 63, min(2 * (clock & 31), 59), tzinfo=timezone.utc).timestamp())
    except ValueError:
        return 0


def kind_of(name: str, host: int, attributes: int) -> str:
    mode = attributes >> 16 & 0o170000 if host in (3, 19) else 0
    if mode == 0o120000:
        return "symlink"
    return "directory" if name.endswith(("/", "\\")) or attributes & 16 or mode == 0o040000 else "file"


def catalog(f: BinaryIO, archive: str) -> Iterator[tuple]:
    """Rows of SCHEMA of a seekable archive: reads its end and its central directory only."""
    size = f.seek(0, io.SEEK_END)
    f.seek(max(0, size - 65_557))
    tail = f.read()
    at = tail.rfind(_EOCD)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(_EOCD, 0, at)
    if at < 0:
        raise ArchiveError("no end of central directory")
    count, length, start, n = struct.unpack_from("<HIIH", tail, at + 10)
    comment = tail[at + 22 : at + 22 + n]
    large = count == 0xFFFF or length == _FULL or start == _FULL
    if large and at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        f.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        end = f.read(56)
        if end[:4] != _EOCD64:
            raise ArchiveError("no 64-bit end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    if start + length > size:
        raise ArchiveError("the central directory lies outside the file")
    f.seek(start)
    data, at = f.read(length), 0
    for entry in range(count):
        if data[at : at + 4] != _CENTRAL or at + 46 > len(data):
            raise ArchiveError("the central directory is damaged")
        made, _, flags, method, clock, date, crc, packed, plain, names, extra, remark, _, _, attributes, offset = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        raw = data[at + 46 : at + 46 + names]
        extras = _extras(data[at + 46 + names : at + 46 + names + extra])
        wide, k = extras.get(1, b""), 0
        full = _FULL in (plain, packed, offset)
        values = []
        for v in (plain, packed, offset):
            if v == _FULL and k + 8 <= len(wide):
                v = struct.unpack_from("<Q", wide, k)[0]
                k += 8
            values.append(v)
        name = entry_name(raw, flags, extras)
        mode = attributes >> 16 & 0o7777 if made >> 8 in (3, 19) and attributes >> 16 else None
        label = "unsupported" if flags & 1 or method not in CODECS else {0: "store", 8: "deflate"}[method]
        yield archive, entry, name, raw, kind_of(name, made >> 8, attributes), method, label, bool(flags & 1), values[1], values[0], crc, entry_time(date, clock, extras), mode, values[2], large or full or count >= 0xFFFF, comment if entry == 0 else None, None
        at += 46 + names + extra + remark


def _failed(archive: str, error: str) -> tuple:
    return archive, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, error


def raw_entry(f: BinaryIO, offset: int, packed: int) -> bytes | None:
    """Encoded bytes of an entry, found past its local header; None if they are not all there."""
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != _LOCAL:
        return None
    names, extra = struct.unpack_from("<HH", head, 26)
    f.seek(offset + 30 + names + extra)
    data = f.read(packed)
    return data if len(data) == packed else None


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(partition.value, "rb") as f:
                yield from catalog(f, partition.value)
        except (ArchiveError, OSError, struct.error) as e:
            yield _failed(partition.value, str(e))


class ZipCatalog(DataSource):
    """spark.read.format("zipcatalog").option("paths", "a.zip\\nb.zip"): one task per archive, on files that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "zipcatalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([x for x in self.options.get("paths", "").split("\n") if x])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from any store that Spark reads; an archive is one binary cell, so it must be below 2 GiB."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += list(catalog(io.BytesIO(content), archive))
                except (ArchiveError, struct.error) as e:
                    rows.append(_failed(archive, str(e)))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int64" for c in ("entry", "packed", "size", "crc32", "mtime", "offset", "raw_method", "unix_mode")} | {"encrypted": "boolean", "zip64": "boolean"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_entries(entries: DataFrame, raw: bool = False) -> DataFrame:
    """archive, entry, content, status of catalogue rows; raw leaves the bytes as they are stored. Rows of an archive are read in the order of their offsets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for archive, part in pdf.groupby("archive"):
                with open(archive, "rb") as f:
                    for e in part.sort_values("offset").itertuples():
                        data = raw_entry(f, int(e.offset), int(e.packed))
                        if data is None:
                            out.append((archive, e.entry, None, "corrupt_archive"))
                        elif raw or e.raw_method not in CODECS or e.encrypted:
                            out.append((archive, e.entry, data if raw else None, "ok" if raw else "unsupported_method"))
                        else:
                            content, status = CODECS[e.raw_method][1](data)
                            if status == "ok" and len(content) != e.size:
                                status = "too_short" if len(content) < e.size else "too_long"
                            elif status == "ok" and zlib.crc32(content) != e.crc32:
                                status = "crc_mismatch"
                            out.append((archive, e.entry, content, status))
            yield pd.DataFrame(out, columns=["archive", "entry", "content", "status"])

    return entries.select("archive", "entry", "raw_method", "encrypted", "packed", "size", "crc32", "offset").mapInPandas(run, "archive string, entry long, content binary, status string")


def metadata_comment(comment: bytes | None, marker: bytes, magic: bytes) -> bytes | None:
    """The record after the last marker in an archive's comment, in base64, if it starts with its magic; else None, whatever the comment holds."""
    import base64
    import binascii

    at = (comment or b"").rfind(marker)
    if at < 0:
        return None
    text = comment[at + len(marker) :].split(b"\n")[0].strip()
    try:
        record = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None
    return record if record.startswith(magic) else None


def _dos(mtime: int) -> tuple[int, int]:
    t = datetime.fromtimestamp(min(max(mtime, 315_532_800), 4_354_819_198), timezone.utc)
    return (t.year - 1980) << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2


def pack_archive(rows: Iterator[dict], out: BinaryIO, comment: bytes = b"") -> int:
    """Writes encoded entries (name, kind, method, size, crc32, mtime, unix_mode, raw) in their order; the number written.

    Fields that do not fit 32 bits go to a 64-bit field, and so do the counts of the end record.
    """
    from shelfmark.operators.segments import LIMIT16, LIMIT32

    directory, n = [], 0
    for r in rows:
        at, name, raw = out.tell(), r["name"].encode(), bytes(r["raw"] or b"")
        date, clock = _dos(int(r["mtime"]))
        stamp = struct.pack("<HHBi", 0x5455, 5, 1, max(-(1 << 31), min(int(r["mtime"]), (1 << 31) - 1)))
        wide = r["size"] >= LIMIT32 or len(raw) >= LIMIT32
        big = struct.pack("<HHQQ", 1, 16, r["size"], len(raw)) if wide else b""
        sizes = (LIMIT32, LIMIT32) if wide else (len(raw), r["size"])
        common = struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, r["method"], clock, date, r["crc32"], *sizes, len(name), len(stamp) + len(big))
        out.write(_LOCAL + common + name + stamp + big + raw)
        kind = {"directory": 0o040000, "symlink": 0o120000}.get(r["kind"], 0o100000)
        attributes = (kind | (r["unix_mode"] or 0) & 0o7777) << 16 | (16 if r["kind"] == "directory" else 0)
        fields = [v for v, over in ((r["size"], wide), (len(raw), wide), (at, at >= LIMIT32)) if over]
        big = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
        common = common[:-2] + struct.pack("<H", len(stamp) + len(big))
        directory.append(_CENTRAL + struct.pack("<H", 3 << 8 | 45) + common + struct.pack("<HHHII", 0, 0, 0, attributes, min(at, LIMIT32)) + name + stamp + big)
        n += 1
    start = out.tell()
    for d in directory:
        out.write(d)
    length = out.tell() - start
    if n >= LIMIT16 or start >= LIMIT32 or length >= LIMIT32:
        at = out.tell()
        out.write(_EOCD64 + struct.pack("<QHHIIQQQQ", 44, 3 << 8 | 45, 45, 0, 0, n, n, length, start) + _LOCATOR + struct.pack("<IQI", 0, at, 1))
    out.write(_EOCD + struct.pack("<HHHHIIH", 0, 0, min(n, LIMIT16), min(n, LIMIT16), min(length, LIMIT32), min(start, LIMIT32), len(comment)) + comment)
    return n


def write_archive(encoded: DataFrame, path: str, comment: bytes = b"") -> int:
    """One archive from encoded entries (entry, name, kind, method, size, crc32, mtime, unix_mode, raw) in order of entry.

    Encoding is done on the executors; the writer streams rows in order, a partition at a time, and replaces the
    file only when it is complete.
    """
    import os

    ordered = encoded.select("entry", "name", "kind", "method", "size", "crc32", "mtime", "unix_mode", "raw").orderBy("entry")
    temporary = f"{path}.{os.getpid()}.part"
    try:
        with open(temporary, "wb") as f:
            n = pack_archive((r.asDict() for r in ordered.toLocalIterator(prefetchPartitions=True)), f, comment)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    return n


def flac_candidates(entries: DataFrame) -> DataFrame:
    """Rows whose header is worth reading: supported files with a .flac name. Filtered before any bytes are read."""
    return entries.where((F.col("kind") == "file") & (F.col("method") != "unsupported") & F.col("name").rlike(r"(?i)\.flac$"))
