"""Segments, sampling, sizes and byte kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import codecs as K
from shelfmark.operators import extraction as X
from shelfmark.operators import segments as S
from shelfmark.plans.catalogue import query
from shelfmark.sources import adapters as A

_BIG = "select l_orderkey * 10 + l_linenumber as entry, l_partkey, cast(l_quantity as bigint) * l_partkey * 997 as size, case when l_linenumber % 3 = 0 then 0 else 8 end as method from lineitem"


def _big(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry"), "l_partkey", (F.col("l_quantity").cast("long") * F.col("l_partkey") * 997).alias("size"), F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(8).alias("method"))


@query(f"""with b as ({_BIG}), s as (select entry, size, case when method = 0 then 4194304 else 1048576 end as step from b), e as (select entry, size, step, unnest(case when size <= 4194304 then [0] else range(0, size, step) end) as first from s)
select entry, cast(first // step as integer) as seg, cast(first as bigint) as first, cast(case when size <= 4194304 then size else least(first + step, size) end as bigint) as last from e""")
def segments_plan(spark: SparkSession, d: str) -> DataFrame:
    return S.packed_segments(_big(S.packing_session(spark), d))


_START = lambda p: f"least(size // 100 * {p} + size % 100 * {p} // 100 - least(size // 100 * {p} + size % 100 * {p} // 100, 32768), size - 65536)"


@query(f"""with b as ({_BIG}), s as (select entry, l_partkey, size, {_START(20)} as a, {_START(50)} as b, {_START(80)} as c from b), t as (select *, b >= a + 65536 as hb from s), u as (select *, c >= case when hb then b else a end + 65536 as hc from t)
select entry, l_partkey, case when size <= 65536 then '0' else cast(a as varchar) || case when hb then ',' || cast(b as varchar) else '' end || case when hc then ',' || cast(c as varchar) else '' end end as starts from u""")
def sample_windows(spark: SparkSession, d: str) -> DataFrame:
    return _big(spark, d).select("entry", "l_partkey", F.array_join(S.sample_windows(F.col("size"), 65_536).cast("array<string>"), ",").alias("starts"))


@query(f"with b as ({_BIG}) select entry, l_partkey, size + size // 256 + 1048576 as deflate, size * 2 * 3 + (size + 4095) // 4096 * (32 + 2 * 2) as flac from b")
def size_hints(spark: SparkSession, d: str) -> DataFrame:
    return _big(spark, d).select("entry", "l_partkey", S.deflate_hint(F.col("size")).alias("deflate"), S.flac_hint(F.col("size"), F.lit(2), F.lit(3)).alias("flac"))


@query(f"with b as ({_BIG}) select entry, l_partkey, entry * 100000 >= 4294967295 or size * 1000 >= 4294967295 - 1000000 as zip64 from b")
def zip64_policy(spark: SparkSession, d: str) -> DataFrame:
    return _big(spark, d).select("entry", "l_partkey", S.entry_zip64(F.col("entry") * 100_000, F.col("size") * 1000, 1_000_000).alias("zip64"))


@query("""select doc_id, (((case doc_id % 3 when 0 then 16384 when 1 then 40960 else 32768 end) | (cast(doc_id * 7 as bigint) & 4095)) << 16) + case when doc_id % 3 = 0 then 16 else 0 end as attributes from documents""")
def external_attrs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "directory").when(k == 1, "symlink").otherwise("file")
    return A.table(spark, d, "documents").select("doc_id", S.external_attributes(kind, (F.col("doc_id") * 7).cast("int")).cast("long").alias("attributes"))


@query("""with a as (select doc_id, case doc_id % 3 when 0 then 3 * 256 when 1 then 19 * 256 + 20 else 0 end as made_by, ((case doc_id % 4 when 0 then 16384 when 1 then 40960 when 2 then 32768 else 0 end + doc_id % 512) << 16) + case when doc_id % 5 = 0 then 16 else 0 end as attributes, case when doc_id % 8 = 6 then 'a/' else 'a' end as name from documents),
u as (select *, made_by // 256 in (3, 19) as unix, (attributes >> 16) & 61440 as type from a)
select doc_id, case when unix and type = 40960 then 'symlink' when name like '%/' or attributes & 16 <> 0 or (unix and type = 16384) then 'directory' else 'file' end as kind, cast(case when unix and attributes >> 16 <> 0 then (attributes >> 16) & 4095 end as integer) as mode from u""")
def entry_kinds(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("doc_id")
    made = F.when(id_ % 3 == 0, 3 * 256).when(id_ % 3 == 1, 19 * 256 + 20).otherwise(0)
    type_ = F.when(id_ % 4 == 0, 0o040000).when(id_ % 4 == 1, 0o120000).when(id_ % 4 == 2, 0o100000).otherwise(0)
    attributes = F.shiftleft(type_ + id_ % 512, 16) + F.when(id_ % 5 == 0, 16).otherwise(0)
    name = F.when(id_ % 8 == 6, "a/").otherwise("a")
    return A.table(spark, d, "documents").select("doc_id", S.entry_kind(name, made, attributes).alias("kind"), S.unix_mode(made, attributes).alias("mode"))


@query("""with e as (select vec_id as id, embedding from embeddings), x as (select id, cast(k as integer) as channel, list_transform(range(0, 16), lambda i: embedding[i * 4 + k + 1]) as v from e, range(0, 4) r(k))
select id, channel, len(v) as n, v[1] as first, v[16] as last from x""")
def deinterleave(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"))
    v = F.col("frame_values")
    return S.deinterleave(e, 4).select("id", "channel", F.size(v).cast("long").alias("n"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"))


@query("select vec_id as id, embedding[1] as a, embedding[2] as b, embedding[63] as y, embedding[64] as z, len(embedding) as n from embeddings")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"))
    s = F.col("samples")
    back = S.interleave(S.deinterleave(e, 4))
    return back.select("id", F.element_at(s, 1).alias("a"), F.element_at(s, 2).alias("b"), F.element_at(s, 63).alias("y"), F.element_at(s, 64).alias("z"), F.size(s).cast("long").alias("n"))


@query("select l_orderkey as entry, cast(min(nullif(l_partkey % 90, 0)) as bigint) as min_frame, cast(max(l_partkey % 90) as bigint) as max_frame from lineitem group by l_orderkey")
def frame_minmax(spark: SparkSession, d: str) -> DataFrame:
    return S.frame_minmax(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), (F.col("l_partkey") % 90).alias("min_frame"), (F.col("l_partkey") % 90).alias("max_frame")))


#: CRC-32 of texts, a byte at a time by a table made from the polynomial.
_CRC = """with recursive z(i, k, v) as (select i, 0, i::uinteger from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::uinteger) else v >> 1 end from z where k < 8),
t as (select list(v order by i) as t from z where k = 8),
b as (select doc_id, strlen(text) as n, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::uinteger) as b from documents),
s as (select doc_id, n, xor(list_reduce(list_prepend(4294967295::uinteger, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::uinteger)::bigint as crc from b, t)"""


@query(f"""{_CRC}, c as (select doc_id, n, n + case when doc_id % 9 = 0 then 1 when doc_id % 9 = 1 and n > 0 then -1 else 0 end as size, crc, crc + case when doc_id % 10 = 3 then 1 else 0 end as said from s)
select doc_id as entry, crc, case when n < size then 'too_short' when n > size then 'too_long' when crc <> said then 'crc_mismatch' else 'ok' end as status from c""")
def crc_verify(spark: SparkSession, d: str) -> DataFrame:
    """One in nine entries is said to be longer, one in nine shorter, one in ten has another sum."""
    docs, text = A.table(spark, d, "documents"), F.col("text").cast("binary")
    size = F.octet_length("text") + F.when(F.col("doc_id") % 9 == 0, 1).when((F.col("doc_id") % 9 == 1) & (F.octet_length("text") > 0), -1).otherwise(0)
    crc = F.crc32(text) + F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)
    found = X.verify(docs.select(F.col("doc_id").alias("entry"), size.alias("size"), crc.alias("crc32"), text.alias("content")))
    return found.join(docs.select(F.col("doc_id").alias("entry"), F.crc32(text).alias("crc")), "entry")


@query()
def store_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Whether whole-text deflate saves a fifth, and what the sample windows predict."""
    docs, text = A.table(spark, d, "documents"), F.col("text").cast("binary")
    size = F.octet_length("text").cast("long")
    packed = K.deflated_size(text)
    return docs.select("doc_id", size.alias("size"), packed.alias("packed"), K.sampled_store(text, size, 4096).alias("predicted_store")).withColumn("deflate", S.pays_off(F.col("packed"), F.col("size")))


@query("select doc_id, cast(strlen(text) as bigint) as size, 'ok' as status, sha256(text) as sha256 from documents")
def deflate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut into segments, each encoded on its own, joined, decoded: what comes out has the digest of what went in."""
    docs = A.table(spark, d, "documents")
    entries = docs.select(F.col("doc_id").alias("entry"), F.lit(8).alias("method"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
    joined = K.join_segments(K.encode_segments(entries))
    decoded = joined.select("entry", "size", K.decode(F.col("raw"), F.col("method")).alias("d"), "crc32")
    status = F.when(F.col("d.status") != "ok", F.col("d.status")).when(F.crc32("d.content") != F.col("crc32"), "crc_mismatch").otherwise("ok")
    return decoded.select(F.col("entry").alias("doc_id"), F.octet_length("d.content").cast("long").alias("size"), status.alias("status"), F.sha2("d.content", 256).alias("sha256"))
