"""Whole verbs: scan, plan, resolve, build; open, list, extract, verify; edit; preview."""

from __future__ import annotations

import html
import json
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import display as D
from shelfmark.functions import paths as P
from shelfmark.operators import browse as B
from shelfmark.operators import codecs as K
from shelfmark.operators import exclude as E
from shelfmark.operators import extraction as X
from shelfmark.operators import planning as L
from shelfmark.operators import segments as S
from shelfmark.sources import archive as Z
from shelfmark.sources import filesystem as FS
from shelfmark.sources import flac, pcm


#: How the generated readme begins: an entry of its name with another beginning is the user's.
README_START = "Files with the name .flac in this archive hold audio"


class ConflictsUnresolved(ValueError):
    """A plan whose conflicts must be resolved before it is built."""


def register(spark: SparkSession) -> None:
    """Makes the data sources known to a session."""
    spark.dataSource.register(FS.FolderSource)
    spark.dataSource.register(Z.ZipCatalog)


def _walked(spark: SparkSession, roots: list[str], exclude: list[str], presets: tuple[str, ...]) -> DataFrame:
    register(spark)
    rows = spark.read.format("folders").option("roots", "\n".join(roots)).option("exclude", "\n".join(exclude)).option("presets", "\n".join(presets)).load()
    known = F.array(*[F.lit(r.rstrip("/") or "/") for r in roots])
    root = F.element_at(F.filter(known, lambda r: (F.col("source_path") == r) | F.startswith(F.col("source_path"), F.concat(r, F.lit("/")))), 1)
    return rows.withColumn("entry", F.array_position(known, root) * F.lit(1 << 40) + F.col("seq")).drop("seq")


def scan_folders(spark: SparkSession, roots: list[str], exclude: list[str] = (), presets: tuple[str, ...] = ()) -> DataFrame:
    """entry, source_path, archive_path, kind, size, mtime_ns, unix_mode, error: the roots in order, each walked by one task."""
    return E.renumber(_walked(spark, list(roots), list(exclude), tuple(presets)).where("not excluded").drop("excluded"))


def scan_excluded(spark: SparkSession, roots: list[str], exclude: list[str] = (), presets: tuple[str, ...] = ()) -> DataFrame:
    """entry, source_path, archive_path, kind: what the patterns left out, each topmost path once, in the order of the walk."""
    return E.renumber(_walked(spark, list(roots), list(exclude), tuple(presets)).where("excluded").select("entry", "source_path", "archive_path", "kind"))


def scan_memory(spark: SparkSession, items: list[tuple]) -> DataFrame:
    """Items (archive_path, kind, content, mtime_ns, unix_mode) given as values."""
    rows = [(k, f"memory:{p}", p, kind, len(c or b""), m, mode, c) for k, (p, kind, c, m, mode) in enumerate(items)]
    return spark.createDataFrame(rows, "entry long, source_path string, archive_path string, kind string, size long, mtime_ns long, unix_mode int, content binary")


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the checkpoint folder: nothing behind them runs again. A local session without such a folder takes a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()


def scan_callback(items: DataFrame, read: Callable[[str], bytes]) -> DataFrame:
    """Items whose bytes a function gives, called on the executors with each source_path; one that fails leaves no content."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path: str) -> bytes | None:
            try:
                return read(path)
            except OSError:
                return None

        for pdf in batches:
            yield pdf.assign(content=[one(p) if k == "file" else None for p, k in zip(pdf["source_path"], pdf["kind"], strict=True)])

    return items.mapInPandas(run, items.withColumn("content", F.lit(None).cast("binary")).schema)


def write_callback(items: DataFrame, write: Callable[[str, bytes], None]) -> None:
    """Gives each item (target, content) to a function, on the executors."""
    def run(rows: Iterator) -> None:
        for r in rows:
            write(r["target"], bytes(r["content"] or b""))

    items.select("target", "content").foreachPartition(run)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of any store that Spark reads; no empty folders, links or modes there. content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ns = F.unix_micros("modificationTime") * 1000
    return files.select(F.xxhash64("path").alias("entry"), F.col("path").alias("source_path"), F.regexp_replace("path", r"^[a-z]+:/*", "").alias("archive_path"), F.lit("file").alias("kind"), F.col("length").alias("size"), ns.alias("mtime_ns"), F.lit(0o644).alias("unix_mode"), "content")


def with_content(items: DataFrame) -> DataFrame:
    """Reads the bytes of local or shared files beside their rows."""
    if "content" in items.columns:
        return items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for path, kind in zip(pdf["source_path"], pdf["kind"], strict=True):
                try:
                    data.append(open(path, "rb").read() if kind == "file" else None)
                except OSError:
                    data.append(None)
            yield pdf.assign(content=data)

    return items.mapInPandas(run, items.withColumn("content", F.lit(None).cast("binary")).schema)


@dataclass
class Plan:
    """entries and what stands in their way; every method gives a new plan or a DataFrame."""

    entries: DataFrame
    warnings: DataFrame

    @classmethod
    def of(cls, items: DataFrame, audio: bool = True) -> Plan:
        warn = lambda d, kind, detail: d.select(F.lit(kind).alias("kind"), "source_path", detail.alias("detail"))
        links = warn(items.where("kind = 'symlink'"), "symlink_skipped", F.lit("symbolic links are not archived"))
        if "error" in items.columns:
            links = links.unionByName(warn(items.where("error is not null"), "unreadable", F.col("error")))
            items = items.where("error is null or kind = 'directory'").drop("error")
        rows = with_content(items.where("kind in ('file', 'directory')"))
        seen = pcm.scan_column(F.when((F.col("kind") == "file") & F.lit(audio), F.col("content")))
        rows = rows.withColumn("scan", seen)
        good = F.col("scan.recognised") & F.col("scan.reason").isNull()
        many = F.coalesce(good & (F.col("scan.channels") > L.MAX_STEREO_LIKE), F.lit(False))
        name = P.normalize(F.col("archive_path"))
        whole = rows.select(
            "entry", "source_path", F.when(many, name).when(good, F.concat(P.stem(name), F.lit(".flac"))).when(F.col("kind") == "directory", F.concat(name, F.lit("/"))).otherwise(name).alias("output_name"), "kind", F.when(many, "flac_mono").when(good, "flac").otherwise("general").alias("codec"), "size", "mtime_ns", "unix_mode",
            F.when(many, F.hex(P.group_id(P.stem(name), F.col("size"), F.col("mtime_ns")))).alias("group_id"), F.when(good, P.extension(name)).alias("original_extension"), F.lit(None).cast("string").alias("kept_restored_name"),
            F.when(F.col("scan.recognised"), F.col("scan.reason")).alias("fallback_reason"), F.when(many, F.col("scan.channels")).otherwise(1).alias("channels"), "content",
        )
        # one row for each channel of a file with more than a stream can hold; the first carries the bytes for all
        each = L.explode_channels(whole)
        each = each.withColumn("content", F.when(F.coalesce("channel_index", F.lit(1)) == 1, F.col("content")))
        columns = ["entry", "source_path", "output_name", "kind", "codec", "size", "mtime_ns", "unix_mode", "group_id", "channel_index", "channel_count", "original_extension", "kept_restored_name", "fallback_reason", "content"]
        # sources are read and parsed once, whatever is asked of the plan
        return cls(settled(E.renumber(L.with_readme(settled(each.select(*columns))), then="channel_index")), links)

    def conflicts(self) -> DataFrame:
        return L.conflicts(self.entries)

    def executable(self) -> bool:
        return self.conflicts().isEmpty()

    def total_bytes(self) -> int:
        return L.total_input_bytes(self.entries).first()["total_bytes"]

    def resolve(self, resolutions: DataFrame) -> Plan:
        return Plan(L.resolve(self.entries, resolutions), self.warnings)

    def methods(self) -> DataFrame:
        """entry, method: what each entry will be."""
        stored = K.predict_store(self.entries)
        return self.entries.join(stored, "entry").select("entry", D.planned_method(F.col("kind"), F.col("codec"), F.col("channel_index"), F.col("channel_count"), F.col("stored")).alias("method"))

    def encoded(self, level: int = 6) -> DataFrame:
        """Entries encoded on the executors: FLAC stored, others deflated segment by segment where that pays off, else stored."""
        e = self.entries.withColumn("content", F.coalesce("content", F.when(F.col("codec") == "generated", F.encode(F.lit(README_START + "; extraction restores the originals.\r\n"), "UTF-8")), F.lit(b"")))
        e = e.withColumn("made", F.when(F.col("codec") == "flac", flac.to_flac(F.col("content"), F.col("original_extension"))))
        # what cannot be encoded after all goes in as it is, under its own name
        failed = (F.col("codec") == "flac") & (F.col("made.status") != "ok")
        e = e.withColumn("output_name", F.when(failed, P.restored_name(F.col("output_name"), F.lit(False), F.col("original_extension"), F.col("kept_restored_name"))).otherwise(F.col("output_name")))
        e = e.withColumn("codec", F.when(failed, "general").otherwise(F.col("codec"))).withColumn("content", F.when(F.col("made.status") == "ok", F.col("made.content")).otherwise(F.col("content"))).drop("made")
        first = e.where("codec = 'flac_mono' and channel_index = 1")
        members = first.select("group_id", F.posexplode(flac.to_members(F.col("content"), F.col("original_extension"))).alias("at", "stream")).select("group_id", (F.col("at") + 1).alias("channel_index"), "stream")
        mono = e.where("codec = 'flac_mono'").drop("content").join(members, ["group_id", "channel_index"], "left")
        mono = mono.withColumn("content", F.coalesce("stream", F.raise_error(F.concat(F.lit("no stream for "), "output_name")).cast("binary"))).select(*e.columns)
        e = settled(e.where("codec <> 'flac_mono'").unionByName(mono).withColumn("size", F.octet_length("content").cast("long")))
        pays = (F.col("codec") == "general") & (F.col("size") > 0) & F.col("fallback_reason").isNull()
        packed = F.when(pays, K.deflated_size(F.col("content"), level)).otherwise(F.col("size"))
        e = e.withColumn("method", F.when(pays & S.pays_off(packed, F.col("size")), 8).otherwise(0))
        joined = K.join_segments(K.encode_segments(e.select("entry", "method", "size", "content"), level))
        return e.select("entry", F.col("output_name").alias("name"), "kind", D.mtime_seconds(F.coalesce("mtime_ns", F.lit(0).cast("long"))).alias("mtime"), "unix_mode").join(joined, "entry")

    def build(self, path: str, level: int = 6, comment: bytes = b"") -> int:
        """Writes the archive and returns the number of entries; refuses a plan with conflicts."""
        if not self.executable():
            raise ConflictsUnresolved("the plan has conflicts")
        return Z.write_archive(self.encoded(level), path, comment)

    def describe(self) -> DataFrame:
        """One JSON text per entry."""
        return self.entries.select("entry", F.to_json(F.struct(*[c for c in self.entries.columns if c != "content"])).alias("json"))


@dataclass
class Archive:
    """An archive to read: listing touches its directory only."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        register(self.spark)
        return self.spark.read.format("zipcatalog").option("paths", self.path).load()

    def zip64(self) -> bool:
        return bool(self.rows().agg(F.bool_or("zip64")).first()[0])

    def entries(self) -> DataFrame:
        """Rows with what FLAC headers say, read only for names that end in .flac; restores_to: the name of the file that a restorable entry becomes."""
        rows = self.rows().where("error is null")
        heads = flac.header_rows(Z.read_entries(Z.flac_candidates(rows)).where("content is not null").select(F.col("entry").cast("string").alias("path"), "content"))
        found = heads.where("flac.error is null").select(F.col("path").cast("long").alias("entry"), "flac")
        e = rows.join(found, "entry", "left")
        e = e.withColumns({"group_id": F.col("flac.group_id"), "channel_index": F.col("flac.channel_index"), "channel_count": F.col("flac.channel_count"), "sha256": F.col("flac.group_id"), "samples": F.col("flac.samples"), "bits": F.col("flac.bits")})
        whole = X.complete_groups(e.where("group_id is not null"))
        e = e.join(whole, "group_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
        mono = F.col("group_id").isNotNull()
        e = e.withColumn("original_size", F.col("flac.original_size")).withColumn("restorable", F.when(mono, F.col("complete")).otherwise(F.col("original_size").isNotNull()))
        return settled(e.withColumn("restores_to", F.when(F.col("restorable"), P.restored_name(F.col("name"), mono, F.coalesce("flac.original_extension", F.lit("")), F.lit(None).cast("string")))))

    def extraction_plan(self, there: DataFrame, base: str | None = None, selected: DataFrame | None = None, entries: DataFrame | None = None) -> dict[str, DataFrame]:
        """items and issues; there: targets that exist."""
        e = self.entries() if entries is None else entries
        notes = Z.read_entries(self.rows().where((F.col("name") == L.README) & F.col("error").isNull() & (F.col("size") < 1 << 20)))
        ours = notes.where(F.startswith(F.col("content").cast("string"), F.lit(README_START))).select("entry", F.lit(True).alias("generated"))
        e = e.withColumns({"supported": (F.col("method") != "unsupported") & (F.col("kind") != "symlink"), "name": F.coalesce("restores_to", "name")}).join(ours, "entry", "left").withColumn("generated", F.coalesce("generated", F.lit(False)))
        return X.extraction_plan(e, there, base, selected)

    def decoded(self, restore: bool = True, entries: DataFrame | None = None) -> DataFrame:
        """entry, name, kind, content, status, members, unix_mode, mtime: every file to be, restorable audio as its original under its own name, a group of channels as one row."""
        e = self.entries() if entries is None else entries
        if not restore:
            e = e.withColumns({"restorable": F.lit(False), "group_id": F.lit(None).cast("string"), "restores_to": F.lit(None).cast("string")})
        facts = ["entry", F.coalesce("restores_to", "name").alias("name"), "kind", "unix_mode", "mtime"]
        data = e.join(Z.read_entries(self.rows().where("error is null")).select("entry", "content", "status"), "entry")
        alone = data.where("group_id is null or not complete").withColumn("back", F.when(F.col("restorable") & (F.col("status") == "ok"), flac.from_flac(F.col("content"))))
        short = F.col("group_id").isNotNull() & (F.col("status") == "ok")
        status = F.when(short, "incomplete_group").otherwise(F.coalesce("back.status", "status"))
        alone = alone.select(*facts, F.when(status == "ok", F.coalesce("back.content", "content")).alias("content"), status.alias("status"), F.array("entry").alias("members"))
        groups = data.where("group_id is not null and complete").groupBy("group_id").agg(
            F.min("entry").alias("entry"), F.min("restores_to").alias("name"), F.min("kind").alias("kind"), F.min("unix_mode").alias("unix_mode"), F.min("mtime").alias("mtime"),
            F.min(F.when(F.col("status") != "ok", F.col("status"))).alias("bad"), F.array_sort(F.collect_list(F.struct("channel_index", "entry", "content"))).alias("m"),
        )
        groups = groups.withColumn("back", F.when(F.col("bad").isNull(), flac.from_members(F.transform("m", lambda x: x["content"]))))
        groups = groups.select("entry", "name", "kind", "unix_mode", "mtime", F.col("back.content").alias("content"), F.coalesce("bad", "back.status").alias("status"), F.transform("m", lambda x: x["entry"]).alias("members"))
        return alone.unionByName(groups)

    def extract(self, root: str, overwrite: str = "skip", base: str | None = None, selected: DataFrame | None = None) -> DataFrame:
        """Writes what may be written below a folder, at once, and tells the outcome: entry, target, status, a row for every file to be and for every entry that is none.

        A file that is there already stays (`skip`, `undecided`) unless overwrite is `replace`. Entries with unsafe,
        colliding or clashing targets, of incomplete groups or that do not decode are not written.
        """
        if overwrite not in ("skip", "replace", "undecided"):
            raise ValueError(f"not a decision: {overwrite}")
        e = self.entries()
        names = e.select(P.extraction_path(F.coalesce("restores_to", "name")).alias("target"))
        if base:
            prefix = base.rstrip("/") + "/"
            names = names.select(F.when(F.startswith("target", F.lit(prefix)), F.expr(f"substring(target, {len(prefix) + 1})")).otherwise(F.col("target")).alias("target"))
        plan = self.extraction_plan(settled(FS.existing(names, root)), base, selected, e)
        items = settled(X.decide(plan["items"], overwrite)).join(self.decoded(entries=e).select("entry", "content", "status", "unix_mode", "mtime"), "entry")
        refused = plan["issues"].where("kind <> 'exists'").select("entry", "target", F.col("kind").alias("status"))
        write = F.col("decision").isin("write", "replace")
        bad = items.where(write & (F.col("status") != "ok") & (F.col("kind") != "directory")).select("entry", "target", "status")
        left = items.where(~write).select("entry", "target", F.when(F.col("decision") == "skip", "skipped").otherwise("exists").alias("status"))
        done = FS.write_tree(items.where(write & ((F.col("status") == "ok") | (F.col("kind") == "directory"))), root)
        rows = done.unionByName(bad).unionByName(left).unionByName(refused)
        # written once: what is asked of the outcome later does not write again
        rows = settled(rows)
        FS.discard(FS.finish_folders(items.where("kind = 'directory'"), root))
        return rows

    def verify(self) -> DataFrame:
        """entry, status, from decoding and restoring everything and keeping nothing; the channels of a group share what became of it."""
        status = F.when(F.col("kind") == "directory", "ok").otherwise(F.col("status"))
        return self.decoded().select(F.explode("members").alias("entry"), status.alias("status"))

    def preview(self, rows: int = B.PREVIEW_ROWS) -> dict:
        e = self.entries()
        t = B.preview_totals(e).first()
        audio = B.restorable_audio(e).first()
        label = D.preview_method(F.col("raw_method"), F.col("flac").isNotNull())
        first = B.preview(e, rows).select("name", "kind", "size", "packed", label.alias("method"), "truncated").collect()
        return {"files": t["files"], "size": t["size"], "packed": t["packed"], "restorable": audio["restorable"], "partial": audio["partial"], "truncated": any(r["truncated"] for r in first), "entries": [{k: r[k] for k in ("name", "kind", "size", "packed", "method")} for r in first]}

    def preview_json(self) -> str:
        return json.dumps(self.preview())

    def preview_html(self) -> str:
        """A page of its own, every text escaped."""
        p = self.preview()
        line = lambda r: "".join(f"<td>{html.escape(str(r[k]))}</td>" for k in ("name", "size", "packed", "method"))
        body = "".join(f"<tr>{line(r)}</tr>" for r in p["entries"])
        more = "<p>and more</p>" if p["truncated"] else ""
        return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(self.path)}</title><p>{p['files']} files, {p['size']} bytes, {p['packed']} packed, {p['restorable']} restorable</p><table>{body}</table>{more}"

    def listing(self) -> DataFrame:
        """entry, line: size, packed size, method, time and name in fixed columns, with what a restorable entry becomes."""
        method = D.cli_method(F.col("raw_method"), F.coalesce("restorable", F.lit(False)), F.coalesce("channel_count", F.lit(1)))
        return self.entries().select("entry", B.listing_line(F.col("size"), F.col("packed"), method, D.minute_text(F.col("mtime")), F.col("name"), F.col("restores_to")).alias("line"))

    def listing_totals(self) -> str:
        return B.listing_totals(self.rows().where("error is null")).first()["line"]


class Editor:
    """Entries of an archive to keep, add, remove, rename or replace; kept ones are copied as they are stored."""

    def __init__(self, archive: Archive) -> None:
        self.archive = archive
        rows = archive.rows().where("error is null and kind <> 'symlink'")
        bad = rows.where("method = 'unsupported'")
        if not bad.isEmpty():
            raise ValueError("unsupported_method")
        self.kept = rows.join(Z.read_entries(rows, raw=True).select("entry", F.col("content").alias("raw")), "entry").select("entry", "name", "kind", F.col("raw_method").alias("method"), "size", "crc32", "mtime", "unix_mode", "raw")
        self.added: DataFrame | None = None

    def remove(self, name: str) -> Editor:
        self.kept = self.kept.where(F.col("name") != name)
        return self

    def rename(self, old: str, new: str) -> Editor:
        if self.kept.where(F.col("name") == old).isEmpty():
            raise ValueError("no such entry")
        self.kept = self.kept.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))
        return self

    def add(self, plan: Plan) -> Editor:
        fresh = plan.encoded()
        there = self.kept.where("kind = 'directory'").select("name")
        fresh = fresh.join(there, "name", "left_anti").select(*self.kept.columns)
        self.added = fresh if self.added is None else self.added.unionByName(fresh)
        return self

    def replace(self, name: str, plan: Plan) -> Editor:
        """What was known of the entry's audio goes with it."""
        return self.remove(name).add(plan)

    def rows(self) -> DataFrame:
        if self.added is None:
            return E.renumber(self.kept)
        top = self.kept.agg(F.coalesce(F.max("entry") + 1, F.lit(0))).first()[0]
        return E.renumber(self.kept.unionByName(self.added.withColumn("entry", F.col("entry") + F.lit(top))))

    def commit(self, path: str) -> int:
        rows = self.rows()
        keys = rows.groupBy(P.collision_key(F.col("name")).alias("k")).count().where("count > 1")
        if not keys.isEmpty():
            raise ConflictsUnresolved("two entries have one name")
        return Z.write_archive(rows, path)
