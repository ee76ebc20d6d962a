"""Leaving things out of a scan by patterns, and saying what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import globs as G
from shelfmark.functions import paths as P


def _cut(items: DataFrame, globs: list[G.Glob], ascii_only: bool) -> DataFrame:
    """Adds top: the shortest prefix below the root whose last name matches (null if none)."""
    items = items.withColumn("_low", F.lower("archive_path") if ascii_only else P.fold(F.col("archive_path")))
    path = F.regexp_replace("archive_path", r"/+$", "")
    names, low = F.split(path, "/"), F.split(F.regexp_replace("_low", r"/+$", ""), "/")
    inner = F.col("kind") == "directory"
    # the root itself, the first name, is never excluded
    hit = F.filter(F.sequence(F.lit(2), F.greatest(F.size(names), F.lit(2))), lambda k: (k <= F.size(names)) & G.matches(F.get(low, k - 1), (k < F.size(names)) | inner, globs))
    return items.withColumn("_n", F.get(hit, F.lit(0))).withColumn("top", F.when(F.col("_n").isNotNull(), F.array_join(F.slice(names, 1, F.coalesce("_n", F.lit(1))), "/"))).withColumn("_own", F.col("_n") == F.size(names)).drop("_n", "_low")


def kept(items: DataFrame, globs: list[G.Glob], ascii_only: bool = False) -> DataFrame:
    """items (entry, archive_path, kind, …) whose path no pattern cuts. No shuffle."""
    return _cut(items, globs, ascii_only).where("top is null").drop("top", "_own")


def excluded(items: DataFrame, globs: list[G.Glob], ascii_only: bool = False) -> DataFrame:
    """source_path, archive_path, kind, entry: each topmost excluded path once, in the place of the first item below it.

    A folder that only its contents name has an empty source_path.
    """
    cut = _cut(items, globs, ascii_only).where("top is not null")
    own = F.max(F.when(F.col("_own"), F.struct(F.col("source_path"), F.col("kind")))).alias("own")
    out = cut.groupBy("top").agg(F.min("entry").alias("entry"), own)
    return out.select(F.coalesce("own.source_path", F.lit("")).alias("source_path"), F.col("top").alias("archive_path"), F.coalesce("own.kind", F.lit("directory")).alias("kind"), "entry")


def under_folder(items: DataFrame, folder: str) -> DataFrame:
    """All paths moved below a folder; kept and excluded items alike."""
    return items.withColumn("archive_path", P.with_prefix(F.lit(folder), F.col("archive_path")))


def renumber(items: DataFrame, order: str = "entry", then: str | None = None) -> DataFrame:
    """entry counted from 0 again in the same order; then: a column that orders rows of one number.

    Ranks come from range partitions and running sums of their sizes, so that no task sees the whole table:
    items are dealt by ranges of the old number, ranked inside, and offset by the counts before.
    """
    block = F.floor(F.col(order) / 65_536)
    a = items.withColumn("_b", block)
    before = a.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = a.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order, *([then] if then else []))) - 1).join(before, "_b")
    return ranked.withColumn("entry", (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")
