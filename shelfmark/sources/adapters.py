"""The driver's tables seen as relations of an archive: entries, channel groups, plans, listings.

Each adapter is a DataFrame function with its twin in SQL beside it, so that a query and its check start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of an archive: source/lang/id.txt, and a folder for each source. Sizes come from the length of the text; every third entry is deleted or unknown by rule of its id."""
    d = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    files = d.select(
        F.col("doc_id").alias("entry"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".flac").otherwise(".txt")).alias("name"),
        F.lit("file").alias("kind"),
        size.alias("size"),
        F.expr("octet_length(text) * (20L + doc_id % 90) div 100").alias("packed"),
        F.when(F.col("doc_id") % 5 == 0, 0).when(F.col("doc_id") % 11 == 3, 12).otherwise(8).alias("method"),
        (F.lit(1_700_000_000) + F.col("doc_id") * 3607).cast("long").alias("mtime"),
        (F.col("doc_id") % 7 == 0).alias("restorable"),
        F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 2 == 0), size * 2).alias("original_size"),
        (F.col("doc_id") % 13 == 5).alias("deleted"),
        (F.col("doc_id") % 17 != 4).alias("ratio_known"),
        (F.col("doc_id") % 19 != 6).alias("packed_known"),
        F.lit(None).cast("long").alias("group_id"),
        F.lit(None).cast("int").alias("channel_index"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))).alias("restores_to"),
        (F.col("doc_id") == 0).alias("generated"),
    )
    folders = d.groupBy("source").agg(F.max("doc_id").alias("last")).select(
        (F.col("last") + 1_000_000_000).alias("entry"), F.concat("source", F.lit("/")).alias("name"), F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("packed"), F.lit(0).alias("method"),
        F.lit(1_700_000_000).cast("long").alias("mtime"), F.lit(False).alias("restorable"), F.lit(None).cast("long").alias("original_size"), F.lit(False).alias("deleted"), F.lit(True).alias("ratio_known"), F.lit(True).alias("packed_known"),
        F.lit(None).cast("long").alias("group_id"), F.lit(None).cast("int").alias("channel_index"), F.lit(None).cast("string").alias("restores_to"), F.lit(False).alias("generated"),
    )
    return files.unionByName(folders)


CATALOG = """
select doc_id as entry, source || '/' || lang || '/' || cast(doc_id as varchar) || case when doc_id % 7 = 0 then '.flac' else '.txt' end as name, 'file' as kind, cast(strlen(text) as bigint) as size,
  strlen(text) * (20 + doc_id % 90) // 100 as packed, case when doc_id % 5 = 0 then 0 when doc_id % 11 = 3 then 12 else 8 end as method, 1700000000 + doc_id * 3607 as mtime, doc_id % 7 = 0 as restorable,
  case when doc_id % 7 = 0 and doc_id % 2 = 0 then cast(strlen(text) as bigint) * 2 end as original_size, doc_id % 13 = 5 as deleted, doc_id % 17 <> 4 as ratio_known, doc_id % 19 <> 6 as packed_known,
  cast(null as bigint) as group_id, cast(null as integer) as channel_index, case when doc_id % 7 = 0 then cast(doc_id as varchar) || '.wav' end as restores_to, doc_id = 0 as generated
from documents
union all
select max(doc_id) + 1000000000, source || '/', 'directory', 0, 0, 0, 1700000000, false, null, false, true, true, null, null, null, false from documents group by source
"""


def groups(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """conversations as channel groups: a turn is a channel. broken leaves out the second turn of every fifth."""
    c = table(spark, sf_dir, "conversations")
    if broken:
        c = c.where(~((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1)))
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("channel_count"))
    size = F.octet_length("text").cast("long")
    return c.join(counts, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry"),
        F.concat(F.lit("take"), F.col("conv_id").cast("string"), F.lit("_ch"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit(".flac")).alias("name"),
        F.col("conv_id").alias("group_id"),
        (F.col("turn") + 1).cast("int").alias("channel_index"),
        "channel_count",
        size.alias("size"),
        F.expr("octet_length(text) * 3L div 5").alias("packed"),
        (F.lit(1_600_000_000) + F.col("conv_id") * 86_413 + F.col("turn") * 7).cast("long").alias("mtime"),
        F.when(F.col("conv_id") % 3 != 1, F.col("conv_id") * 4096).cast("long").alias("original_size"),
        F.col("conv_id").cast("string").alias("sha256"),
        (F.col("conv_id") * 48_000).cast("long").alias("samples"),
        F.when((F.col("conv_id") % 7 == 2) & (F.col("turn") == 0), 16).otherwise(24).alias("bits"),
        F.concat(F.lit("take"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("restores_to"),
    )


def groups_sql(broken: bool = False) -> str:
    return f"""
select c.conv_id * 1000 + c.turn as entry, 'take' || cast(c.conv_id as varchar) || '_ch' || lpad(cast(c.turn + 1 as varchar), 2, '0') || '.flac' as name, c.conv_id as group_id, cast(c.turn + 1 as integer) as channel_index, k.n as channel_count,
  cast(strlen(c.text) as bigint) as size, strlen(c.text) * 3 // 5 as packed, 1600000000 + c.conv_id * 86413 + c.turn * 7 as mtime, case when c.conv_id % 3 <> 1 then c.conv_id * 4096 end as original_size,
  cast(c.conv_id as varchar) as sha256, c.conv_id * 48000 as samples, case when c.conv_id % 7 = 2 and c.turn = 0 then 16 else 24 end as bits, 'take' || cast(c.conv_id as varchar) || '.wav' as restores_to
from conversations c join (select conv_id, cast(max(turn) + 1 as integer) as n from conversations group by conv_id) k on c.conv_id = k.conv_id
{"where not (c.conv_id % 5 = 0 and c.turn = 1)" if broken else ""}
"""


def parts_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a plan: few names for many rows, in mixed case; every tenth is converted audio, some are folders or lie below another's name."""
    p = table(spark, sf_dir, "part")
    upper = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    flac = F.col("p_partkey") % 10 == 0
    name = F.concat(F.col("p_brand"), F.lit("/"), upper, F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".bin"))).otherwise(F.lit("")))
    number = F.concat(F.lit("/"), (F.col("p_partkey") % 97).cast("string"))
    return p.select(
        F.col("p_partkey").alias("entry"),
        F.concat(F.lit("/in/"), F.col("p_partkey").cast("string")).alias("source_path"),
        F.when(flac, F.concat(name, number, F.lit(".flac"))).when(F.col("p_partkey") % 4 == 2, F.concat(name, number, F.lit(".wav"))).otherwise(name).alias("output_name"),
        F.when(F.col("p_partkey") % 50 == 7, "directory").otherwise("file").alias("kind"),
        F.when(flac, "flac").otherwise("general").alias("codec"),
        F.col("p_size").cast("long").alias("size"),
        (F.col("p_partkey") * 1_000_000_007).cast("long").alias("mtime_ns"),
        F.lit(None).cast("long").alias("group_id"),
        F.lit(None).cast("int").alias("channel_index"),
        F.lit(None).cast("int").alias("channel_count"),
        F.when(flac, ".wav").alias("original_extension"),
        F.lit(None).cast("string").alias("kept_restored_name"),
        F.lit(None).cast("string").alias("fallback_reason"),
    )


_PART_NAME = "p_brand || '/' || (case when p_partkey % 3 = 0 then upper(p_name) else p_name end) || (case when p_partkey % 4 = 1 then '/' || cast(p_partkey as varchar) || '.bin' else '' end)"
PARTS = f"""
select p_partkey as entry, '/in/' || cast(p_partkey as varchar) as source_path,
  case when p_partkey % 10 = 0 then {_PART_NAME} || '/' || cast(p_partkey % 97 as varchar) || '.flac' when p_partkey % 4 = 2 then {_PART_NAME} || '/' || cast(p_partkey % 97 as varchar) || '.wav' else {_PART_NAME} end as output_name,
  case when p_partkey % 50 = 7 then 'directory' else 'file' end as kind, case when p_partkey % 10 = 0 then 'flac' else 'general' end as codec, cast(p_size as bigint) as size, p_partkey * 1000000007 as mtime_ns
from part
"""


def hostile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages' URLs as entry names, some made unsafe by a rule of the id: id, name."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("u"))
    r = F.col("page_id") % 12
    name = (
        F.when(r == 0, F.concat(F.lit("../"), "u")).when(r == 1, F.concat(F.lit("/"), "u")).when(r == 2, F.concat(F.lit("C:\\"), "u")).when(r == 3, F.concat(F.lit("./"), "u", F.lit("/")))
        .when(r == 4, F.concat("u", F.lit("//x"))).when(r == 5, F.replace("u", F.lit("/"), F.lit("\\"))).when(r == 6, F.concat("u", F.lit("/a:b"))).when(r == 7, F.lit("./.")).when(r == 8, F.concat("u", F.lit("/.."), F.lit("/y")))
        .otherwise(F.col("u"))
    )
    return p.select("page_id", name.alias("name"))


HOSTILE = r"""
select page_id, case page_id % 12 when 0 then '../' || u when 1 then '/' || u when 2 then 'C:\' || u when 3 then './' || u || '/' when 4 then u || '//x' when 5 then replace(u, '/', '\') when 6 then u || '/a:b' when 7 then './.' when 8 then u || '/../y' else u end as name
from (select page_id, regexp_replace(url, '^[a-z]+://', '') as u from pages)
"""
