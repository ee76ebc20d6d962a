"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of a source are put in the order of a seeded hash; row r of n gets the fraction (r + offset) / n with an
offset in (0, 1) of the source. All rows sorted by fraction interleave the sources in proportion, so any run
of rows matches the mixture; equal runs (counts at most one apart) are the shards.

Both ranks are taken without gathering a source or the table in one task: rows are dealt into buckets, by
hash within a source and by fraction overall, each of about BUCKET rows, and ranked inside; running sums of the bucket
counts (one row per bucket) give the offsets. More than BUCKET rows that are equal in all columns of `order` (many
null ids, say) would share a bucket: these are dealt by the task that reads them instead.

Law `rows`: counts decide, so equal texts are not kept together; they are rows of their own and go where their ranks
lead. Null source is a source of its own; null text has size 1 and crc32 0 bytes' worth (0). Rows equal in `order` are
ranked in any order among themselves. Null and repeated ids stay. Columns of any name pass through; shard and slot
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 16_384


def shards(rows: DataFrame, n_shards: int = 16, seed: int = 11, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows (source and any other columns) with shard int and slot long; order: columns that tell rows apart."""
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    total = rows.select(F.lit(1)).count()
    # enough buckets for every task, however small the table, and none too large, however large
    buckets = max(1, -(-total // BUCKET), min(total, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # the user's columns ride in one struct, so that none can clash with those made here
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(order)])
    source = F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    a = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), key.alias("key"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order]).alias("h"), source.alias("s"))
    a = a.withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int"))
    counted = a.groupBy("s", "b").agg(F.count("*").alias("c"))
    # a bucket is far too large only by rows equal in all of order: those are numbered per task that read them
    full = counted.where(F.col("c") > 4 * BUCKET)
    a = a.withColumn("part", F.lit(0))
    if not full.isEmpty():
        heavy = a.join(full.select("s", "b"), ["s", "b"]).groupBy("s", "b", "h").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET).select("s", "h", F.lit(True).alias("heavy"))
        a = a.withColumn("task", F.spark_partition_id()).join(heavy, ["s", "h"], "left").withColumn("part", F.when(F.coalesce("heavy", F.lit(False)), F.col("task") + 1).otherwise(0)).drop("heavy", "task")
    # within a bucket: the rows numbered by hash, then those of each task
    inside = ["s", "b", "part"]
    counted = a.groupBy(*inside).agg(F.count("*").alias("c"))
    of = Window.partitionBy("s")
    sums = counted.select(*inside, F.coalesce(F.sum("c").over(of.orderBy("b", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(of).alias("n"))
    a = a.withColumn("r", F.row_number().over(Window.partitionBy(*inside).orderBy("h", "key")) - 1).join(sums, inside)
    offset = (F.pmod("s", F.lit(1_000_003)) + 0.5) / 1_000_003
    a = a.withColumn("f", (F.col("r") + F.col("before") + offset) / F.col("n"))
    a = a.withColumn("q", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("int")).drop("r", "before", "n", "b", "part")
    counted = a.groupBy("q").agg(F.count("*").alias("c"))
    sums = counted.select("q", F.coalesce(F.sum("c").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    a = a.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("f", "s", "h", "key")) - 1).join(sums, "q")
    place = (F.col("r") + F.col("start")).cast("long")
    a = a.select("row", place.alias("place")).withColumn("shard", F.expr(f"cast(place * {n_shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}")
    return a.select("row.*", "shard", (F.col("place") - first).cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text plus one), text_crc32."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
