"""Audio containers and FLAC, over files made from the embeddings table; and the last of the small verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import display as D
from shelfmark.functions import paths as P
from shelfmark.operators import browse as B
from shelfmark.operators import codecs as K
from shelfmark.operators import extraction as X
from shelfmark.operators import planning as L
from shelfmark.plans.catalogue import query
from shelfmark.sources import adapters as A
from shelfmark.sources import flac, pcm


def takes(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a WAVE file of 64 mono samples and a title for each vector."""
    id_ = F.col("vec_id")
    title = F.hex(F.encode(F.lpad(id_.cast("string"), 8, "0"), "UTF-8"))
    sample = lambda k: F.lpad(F.hex(F.pmod(id_ * 31 + k * k * 7, F.lit(65_536))), 4, "0")
    audio = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), sample), "")
    parts = ("52494646C000000057415645", "666D742010000000010001008" "0BB00000077010002001000", "4C49535414000000494E464F494E414D08000000", title, "6461746180000000", audio)
    return A.table(spark, d, "embeddings").select(id_.cast("string").alias("path"), F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).alias("content"))


@query("select cast(vec_id as varchar) as path, true as recognised, 'WAVE' as container, 1 as channels, 48000 as rate, 16 as bits, 64 as frames from embeddings")
def pcm_layout(spark: SparkSession, d: str) -> DataFrame:
    return takes(spark, d).select("path", pcm.scan_column(F.col("content")).alias("s")).select("path", "s.recognised", "s.container", "s.channels", "s.rate", "s.bits", "s.frames")


@query("""select cast(vec_id as varchar) as path, c.pos, c.id, c.first, c.length, c.audio from embeddings, (values (0, 'head', 0, 12, false), (1, 'fmt ', 12, 24, false), (2, 'LIST', 36, 28, false), (3, 'data', 64, 8, true)) c(pos, id, first, length, audio)""")
def chunk_list(spark: SparkSession, d: str) -> DataFrame:
    return pcm.chunk_rows(takes(spark, d))


@query("select cast(vec_id as varchar) as path, 0 as pos, 'TITLE' as key, lpad(cast(vec_id as varchar), 8, '0') as value from embeddings")
def tags_extract(spark: SparkSession, d: str) -> DataFrame:
    return pcm.tag_rows(takes(spark, d))


@query("select cast(vec_id as varchar) as path, 200 as size, 'ok' as status, true as same from embeddings")
def flac_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """To FLAC and back: the same bytes."""
    made = takes(spark, d).withColumn("f", flac.to_flac(F.col("content"))).withColumn("b", flac.from_flac(F.col("f.content")))
    return made.select("path", F.octet_length("b.content").cast("long").alias("size"), F.col("b.status").alias("status"), (F.col("b.content") == F.col("content")).alias("same"))


@query("select cast(vec_id as varchar) as path, 48000 as rate, 1 as channels, 16 as bits, 64 as samples, 200 as original_size, lpad(cast(vec_id as varchar), 8, '0') as title from embeddings")
def flac_headers(spark: SparkSession, d: str) -> DataFrame:
    made = takes(spark, d).select("path", flac.to_flac(F.col("content"))["content"].alias("content"))
    title = F.element_at(F.filter("flac.comments", lambda c: F.upper(c["key"]) == "TITLE"), 1)["value"]
    return flac.header_rows(made).select("path", "flac.rate", "flac.channels", "flac.bits", "flac.samples", "flac.original_size", title.alias("title"))


_SYNTHETIC = """select p_partkey as entry, p_partkey % 31 <> 7 as parsed, p_partkey % 13 = 4 as float, p_partkey % 17 <> 5 as integer, p_size % 4 as channels, p_size % 6 as container_bytes, p_size % 40 as bits, p_partkey * 997 as rate, p_partkey * 90000000 as frames, p_partkey * 10007 as largest_block from part"""


@query(f"""with s as ({_SYNTHETIC}) select entry, case when not parsed then 'not_parsable' when float then 'float_samples' when not integer then 'unsupported_encoding' when channels < 1 or container_bytes < 1 or container_bytes > 4 then 'unsupported_encoding'
 when bits < 4 or bits > 32 then 'bit_depth' when rate < 1 or rate > 1048575 then 'sample_rate' when frames >= 68719476736 then 'too_many_samples' when largest_block > 16777211 then 'chunk_too_large' end as reason from s""")
def pcm_eligibility(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    s = F.struct((k % 31 != 7).alias("parsed"), (k % 13 == 4).alias("float"), (k % 17 != 5).alias("integer"), (n % 4).alias("channels"), (n % 6).alias("container_bytes"), (n % 40).alias("bits"), (k * 997).alias("rate"), (k * 90_000_000).alias("frames"), (k * 10_007).alias("largest_block"))
    return A.table(spark, d, "part").select(k.alias("entry"), s.alias("s")).select("entry", L.ineligible(F.col("s")).alias("reason"))


@query("""with t as (select event_id as entry, cast(event_id * 977 as bigint) as done, cast(event_id * 977 + event_id % 97 * 1000 as bigint) as total, value from events), r as (select *, value >= 0.5 and done > 0 as known from t)
select entry, case when known then cast(ceil((total - done) / (done / value)) as bigint) // 60 || ':' || lpad(cast(cast(ceil((total - done) / (done / value)) as bigint) % 60 as varchar), 2, '0') end as remaining from r""")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select(F.col("event_id").alias("entry"), (F.col("event_id") * 977).alias("done"), (F.col("event_id") * 977 + F.col("event_id") % 97 * 1000).alias("total"), "value")
    return e.select("entry", D.throughput(F.col("done"), F.col("total"), F.col("value"))[1].alias("remaining"))


@query("""with g as (select p_size, p_type, list('in/' || p_brand || '/' || p_name order by p_partkey) as n from part group by p_size, p_type)
select p_size, p_type, case when len(n) = 1 then string_split(n[1], '/')[3] when len(list_distinct(list_transform(n, lambda x: string_split(x, '/')[2]))) = 1 then string_split(n[1], '/')[2] else 'Archive' end || '.zip' as name from g""")
def output_name(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("in/"), "p_brand", F.lit("/"), "p_name").alias("n")))), lambda x: x["n"])
    return p.groupBy("p_size", "p_type").agg(names.alias("n")).select("p_size", "p_type", P.archive_output_name(F.col("n")).alias("name"))


@query("select case when count(distinct source) = 1 then min(source) end as folder from documents")
def finalize_extraction(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    return X.single_top_folder(docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("target"), F.lit("file").alias("kind")))


@query("select doc_id as entry, cast(strlen(text) as bigint) as size, true as same from documents")
def crc_combine(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of 700-byte pieces, combined in order, against that of the whole."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.col("text").cast("binary").alias("b"))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(700))
    each = docs.select("entry", "b", F.posexplode(starts).alias("seg", "at")).select("entry", "seg", F.expr("substring(b, at + 1, 700)").alias("p"))
    parts = each.select("entry", "seg", F.crc32("p").alias("crc32"), F.octet_length("p").cast("long").alias("size"))
    return K.combine_crcs(parts).join(docs.select("entry", F.crc32("b").alias("whole")), "entry").select("entry", "size", (F.col("crc32") == F.col("whole")).alias("same"))


@query("with n as (select c_custkey as entry, c_name || ' {{name}}' as name from customer) select entry, replace(replace('Made by {app}' || chr(10) || 'for {name}', '{app}', 'x'), '{name}', name) as text from n")
def template(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("entry"), F.concat("c_name", F.lit(" {{name}}")).alias("name"))
    return c.select("entry", F.replace(D.render(F.lit("Made by {app}\nfor {name}"), {"app": F.lit("x"), "name": F.col("name")}), F.lit("\r\n"), F.lit("\n")).alias("text"))


@query("""select p_partkey as entry, format('{:>12} {:>12} {:<10} {:<16} {}{}', p_partkey, p_partkey % 21, case when p_partkey % 5 = 0 then 'flac' else 'deflate' end, '2024-05-06 07:08', p_name, case when p_partkey % 5 = 0 then '  -> ' || p_name || '.wav' else '' end) as line from part""")
def text_listing(spark: SparkSession, d: str) -> DataFrame:
    k, audio = F.col("p_partkey"), F.col("p_partkey") % 5 == 0
    line = B.listing_line(k, k % 21, F.when(audio, "flac").otherwise("deflate"), F.lit("2024-05-06 07:08"), F.col("p_name"), F.when(audio, F.concat("p_name", F.lit(".wav"))))
    return A.table(spark, d, "part").select(k.alias("entry"), line.alias("line"))


@query("with c as (select doc_id as entry, source || '/' || lang as name from documents) select string_split(name, '/')[1] as top, count(*) as n from c where contains(lower(name), 'en') group by 1")
def filtered_tops(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.concat("source", F.lit("/"), "lang").alias("name"), F.lit(None).cast("string").alias("restores_to"))
    return rows.where(B.text_filter("EN")).groupBy(F.split("name", "/")[0].alias("top")).agg(F.count("*").alias("n"))
