"""Cutting entries into segments of work, guessing what compression saves, and the numbers of the zip format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.display import div

STORE_SEGMENT, DEFLATE_SEGMENT, FLAC_BLOCK = 4 << 20, 1 << 20, 4096
WINDOW_PERCENT = (20, 50, 80)
LIMIT32, LIMIT16 = (1 << 32) - 1, 65_535
MIN_SAVING = 0.20
#: Of packed_segments(): rows of a task where entries are dealt anew, and of a row group (28 bytes a row at most: what a row group may hold in memory).
TASK_ROWS, GROUP_ROWS = 1 << 23, 1 << 22
#: Of packing_session(): differences instead of dictionaries, and sizes looked at by row groups. Parquet's writer looks at them after every row once rows take less than a byte.
PACKING = {
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.size.statistics.enabled": "false", "spark.sql.parquet.compression.codec": "zstd",
    "parquet.block.row.count.limit": str(GROUP_ROWS), "parquet.page.size.row.check.min": str(GROUP_ROWS),
}


def segments(entries: DataFrame, small: int = 4 << 20) -> DataFrame:
    """entry, seg, first, last of each entry (entry, size, method): store in 4 MiB, deflate in 1 MiB pieces; a small or empty one whole."""
    step = F.when(F.col("method") == 0, STORE_SEGMENT).otherwise(DEFLATE_SEGMENT)
    whole = F.col("size") <= small
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), step.cast("long")))
    each = entries.select("entry", "size", step.alias("step"), whole.alias("whole"), F.posexplode(starts).alias("seg", "first"))
    return each.select("entry", "seg", "first", F.when(F.col("whole"), F.col("size")).otherwise(F.least(F.col("first") + F.col("step"), F.col("size"))).alias("last"))


def packing_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, with its settings and PACKING, for a result of very many rows of few whole numbers.

    What is read in it is written with PACKING; the given session writes as before. Views of its results are views of this session.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in PACKING.items():
        own.conf.set(key, value)
    return own


def packed_segments(entries: DataFrame, small: int = 4 << 20) -> DataFrame:
    """The rows of segments() in an order that takes little disk and time; an entry without a size has none.

    Each task gives its entries by step and number of pieces, so that the same runs of differences recur. Rows are counted first:
    entries are dealt anew only where a task would have too large a share of the rows, and a column without nulls is declared so.
    """
    step = F.when(F.col("method") == 0, STORE_SEGMENT).otherwise(DEFLATE_SEGMENT).cast("long")
    pieces = F.when(F.col("size") <= small, 1).otherwise((div(F.col("size") - 1, F.col("step")) + 1).cast("int"))
    cut = entries.select("entry", "size", step.alias("step")).where("size is not null").withColumn("pieces", pieces)
    tasks = cut.groupBy(F.spark_partition_id()).agg(F.sum("pieces").alias("rows"), F.count_if(F.isnull("entry")).alias("unnamed"))
    rows, most, unnamed = (x or 0 for x in tasks.agg(F.sum("rows"), F.max("rows"), F.sum("unnamed")).first())
    if most > max(TASK_ROWS, rows // (4 * entries.sparkSession.sparkContext.defaultParallelism)):
        cut = cut.repartition(-(-rows // TASK_ROWS))
    kind = dict(cut.dtypes)["entry"]
    entry = F.col("entry") if unnamed else F.coalesce("entry", F.lit(0).cast(kind))
    each = cut.sortWithinPartitions("step", "pieces").select(entry.alias("entry"), "size", "step", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("seg"))
    first = F.col("seg").cast("long") * F.col("step")
    last = F.when(F.col("seg") == F.col("pieces") - 1, F.col("size")).otherwise(first + F.col("step"))
    return each.select("entry", "seg", first.alias("first"), F.coalesce(last, F.lit(0).cast("long")).alias("last"))


def flac_segments(tracks: DataFrame, blocks: int = 64) -> DataFrame:
    """entry, seg, first, last in frames of tracks (entry, frames): so many blocks of 4096 a segment."""
    step = blocks * FLAC_BLOCK
    starts = F.when(F.col("frames") > 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("frames") - 1, F.lit(0)), F.lit(step).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return tracks.select("entry", "frames", F.posexplode(starts).alias("seg", "first")).select("entry", "seg", "first", F.least(F.col("first") + step, F.col("frames")).alias("last"))


def sample_windows(size: Column, window: int) -> Column:
    """Starts of at most three windows around 20, 50 and 80 percent, inside the entry and without overlap; [0] for a small one."""
    def start(p: int) -> Column:
        centre = div(size, F.lit(100)) * p + div(F.pmod(size, F.lit(100)) * p, F.lit(100))
        return F.least(centre - F.least(centre, F.lit(window // 2)), size - window)

    a, b, c = (start(p) for p in WINDOW_PERCENT)
    second = b >= a + window
    last = F.when(second, b).otherwise(a)
    three = F.array_compact(F.array(a, F.when(second, b), F.when(c >= last + window, c)))
    return F.when(size <= window, F.array(F.lit(0).cast("long"))).otherwise(three)


def deflate_hint(size: Column) -> Column:
    """Most bytes that deflate may write."""
    return size + div(size, F.lit(256)) + (1 << 20)


def flac_hint(frames: Column, channels: Column, width: Column) -> Column:
    blocks = div(frames + (FLAC_BLOCK - 1), F.lit(FLAC_BLOCK))
    return frames * channels * width + blocks * (F.lit(32) + channels * 2)


def pays_off(compressed: Column, original: Column, saving: float = MIN_SAVING) -> Column:
    return (original > 0) & (compressed.cast("double") <= original.cast("double") * (1.0 - saving))


def entry_zip64(offset: Column, size: Column, cushion: int = 0) -> Column:
    """Whether an entry needs 64-bit fields: far into the file, or of unknown or very large size."""
    return (offset >= LIMIT32) | size.isNull() | (size >= LIMIT32 - cushion)


def archive_zip64(entries: DataFrame) -> DataFrame:
    """zip64: any 32-bit field at its limit, or too many entries."""
    full = (F.col("size") >= LIMIT32) | (F.col("packed") >= LIMIT32) | (F.col("offset") >= LIMIT32)
    return entries.agg((F.coalesce(F.bool_or(full), F.lit(False)) | (F.count("*") >= LIMIT16)).alias("zip64"))


def external_attributes(kind: Column, mode: Column) -> Column:
    """Unix type and permissions in the upper half, the DOS folder bit in the lower."""
    type_ = F.when(kind == "directory", 0o040000).when(kind == "symlink", 0o120000).otherwise(0o100000)
    upper = type_.bitwiseOR(mode.bitwiseAND(F.lit(0o7777))).cast("long") * 65_536
    return upper + F.when(kind == "directory", 16).otherwise(0)


def unix_mode(made_by: Column, attributes: Column) -> Column:
    """Permissions of an entry from a Unix (3) or Darwin (19) host with any upper bits; else null."""
    high = F.shiftrightunsigned(attributes, 16)
    host = F.shiftrightunsigned(made_by.cast("int"), 8)
    return F.when(host.isin(3, 19) & (high != 0), high.bitwiseAND(F.lit(0o7777))).cast("int")


def entry_kind(name: Column, made_by: Column, attributes: Column) -> Column:
    high = F.shiftrightunsigned(attributes, 16).bitwiseAND(F.lit(0o170000))
    unix = F.shiftrightunsigned(made_by.cast("int"), 8).isin(3, 19)
    folder = name.endswith("/") | name.endswith("\\") | (attributes.bitwiseAND(F.lit(16)) != 0) | (unix & (high == 0o040000))
    return F.when(unix & (high == 0o120000), "symlink").when(folder, "directory").otherwise("file")


def method_class(raw: Column, encrypted: Column) -> Column:
    return F.when(encrypted, "unsupported").when(raw == 0, "store").when(raw == 8, "deflate").otherwise("unsupported")


def frame_minmax(segments_: DataFrame) -> DataFrame:
    """entry, min_frame, max_frame over segments; a minimum of 0 means unknown."""
    return segments_.groupBy("entry").agg(F.min(F.nullif("min_frame", F.lit(0))).alias("min_frame"), F.max("max_frame").alias("max_frame"))


def deinterleave(samples: DataFrame, channels: int) -> DataFrame:
    """id, channel, frame_values: arrays of interleaved samples taken apart."""
    pick = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.size("samples") - 1), lambda i: i % channels == k), lambda i: F.get("samples", i))
    arrays = F.array(*[F.struct(F.lit(k).alias("channel"), pick(k).alias("frame_values")) for k in range(channels)])
    return samples.where(F.size("samples") > 0).select("id", F.explode(arrays).alias("c")).select("id", "c.channel", "c.frame_values")


def interleave(tracks: DataFrame) -> DataFrame:
    """id, samples from (id, channel, frame_values); channels of one length."""
    grouped = tracks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("channel", "frame_values"))).alias("t"))
    frames = F.size(F.col("t")[0]["frame_values"])
    samples = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(1)) - 1), lambda i: F.transform("t", lambda c: F.get(c["frame_values"], i))))
    return grouped.select("id", F.when(frames > 0, samples).otherwise(F.array().cast("array<float>")).alias("samples"))
