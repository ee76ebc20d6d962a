"""Paths, names and text made of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import display as D
from shelfmark.functions import globs as G
from shelfmark.functions import paths as P
from shelfmark.operators import exclude as E
from shelfmark.plans.catalogue import folded, query
from shelfmark.sources import adapters as A

H = f"with h as ({A.HOSTILE})"
_NORM = r"(case when regexp_full_match(m, '/+') then '/' else regexp_replace(m, '/+$', '') end)"
_M = r"regexp_replace(replace(nfc_normalize(name), '\', '/'), '^(\./)+', '')"


@query(f"{H}, a as (select page_id, {_M} as m from h) select page_id, {_NORM} as name from a")
def path_normalize_ascii(spark: SparkSession, d: str) -> DataFrame:
    return A.hostile_names(spark, d).select("page_id", P.normalize(F.col("name")).alias("name"))


@query(f"""{H}, a as (select page_id, {_M} as m from h), n as (select page_id, {_NORM} as s from a)
select page_id, case when s = '' then 'empty name' when starts_with(s, '/') then 'absolute path' when regexp_matches(s, '^[A-Za-z]:') then 'drive letter' when list_contains(string_split(s, '/'), '') then 'empty segment'
 when list_contains(string_split(s, '/'), '.') or list_contains(string_split(s, '/'), '..') then 'dot segment' end as problem from n""")
def path_validate(spark: SparkSession, d: str) -> DataFrame:
    return A.hostile_names(spark, d).select("page_id", P.archive_name_problem(P.normalize(F.col("name"))).alias("problem"))


_SEG = "list_filter(string_split(s, '/'), lambda x: x <> '' and x <> '.')"
_BAD = f"list_filter({_SEG}, lambda x: x = '..' or contains(x, ':'))"


@query(rf"""{H}, n as (select page_id, replace(name, '\', '/') as s from h), b as (select page_id, s, {_SEG} as parts, {_BAD} as bad from n),
r as (select page_id, parts, case when starts_with(s, '/') then 'absolute path' when regexp_matches(s, '^[A-Za-z]:') then 'drive letter' when len(bad) > 0 and bad[1] = '..' then 'escapes the destination' when len(bad) > 0 then 'contains a colon' when len(parts) = 0 then 'no usable name' end as problem from b)
select page_id, problem, case when problem is null then array_to_string(parts, '/') end as path from r""")
def path_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return A.hostile_names(spark, d).select("page_id", P.extraction_problem(F.col("name")).alias("problem"), P.extraction_path(F.col("name")).alias("path"))


@query(f"with p as ({A.PARTS}) select entry, regexp_extract(output_name, '[^/](\\.[^./]*)$', 1) as extension, case when regexp_matches(output_name, '[^/]\\.[^./]*$') then regexp_extract(output_name, '^(.*)\\.[^./]*$', 1) else output_name end as stem from p")
def split_extension(spark: SparkSession, d: str) -> DataFrame:
    return A.parts_plan(spark, d).select("entry", P.extension(F.col("output_name")).alias("extension"), P.stem(F.col("output_name")).alias("stem"))


@query(f"with g as ({A.groups_sql()}) select entry, regexp_replace(regexp_replace(name, '\\.flac$', ''), '_ch[0-9]+$', '') as mono, regexp_replace(name, '\\.flac$', '') as plain from g")
def flac_stem(spark: SparkSession, d: str) -> DataFrame:
    g = A.groups(spark, d)
    return g.select("entry", P.flac_stem(F.col("name"), F.lit(True)).alias("mono"), P.flac_stem(F.col("name"), F.lit(False)).alias("plain"))


@query("select p_partkey as entry, p_name || '_ch' || lpad(cast(p_partkey % 120 + 1 as varchar), cast(greatest(2, length(cast(120 + p_size * 30 as varchar))) as integer), '0') || '.flac' as name from part")
def member_name(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("entry"), P.member_name(F.col("p_name"), F.col("p_partkey") % 120 + 1, F.lit(120) + F.col("p_size") * 30).alias("name"))


@query(f"with p as ({A.PARTS}) select entry, case when codec = 'flac' then regexp_replace(output_name, '\\.flac$', '') || '.wav' else output_name end as restored from p")
def restored_names(spark: SparkSession, d: str) -> DataFrame:
    name = P.restored_name(F.col("output_name"), F.lit(False), F.col("original_extension"), F.col("kept_restored_name"))
    return A.parts_plan(spark, d).select("entry", F.when(F.col("codec") == "flac", name).otherwise(F.col("output_name")).alias("restored"))


@query(f"with p as ({A.PARTS}) select entry, case when kind = 'directory' then 'Folder' when codec = 'flac' then case when size > 20 then 'FLAC channel ' || cast(entry % 9 as varchar) || '/9' else 'FLAC' end when size % 3 = 0 then 'Store' else 'Deflate' end as method from p")
def planned_method(spark: SparkSession, d: str) -> DataFrame:
    codec = F.when((F.col("codec") == "flac") & (F.col("size") > 20), "flac_mono").otherwise(F.col("codec"))
    return A.parts_plan(spark, d).select("entry", D.planned_method(F.col("kind"), codec, F.col("entry") % 9, F.lit(9), F.col("size") % 3 == 0).alias("method"))


def _human(v: str) -> str:
    """printf rounds the exact binary value, as the reference formatting does."""
    return f"case when {v} < 1000 then cast({v} as varchar) || ' B' when {v} < 1000000 then printf('%.1f', {v}::double / 1000) || ' KB' when {v} < 1000000000 then printf('%.1f', {v}::double / 1000 / 1000) || ' MB' when {v} < 1000000000000 then printf('%.1f', {v}::double / 1000 / 1000 / 1000) || ' GB' else printf('%.1f', {v}::double / 1000 / 1000 / 1000 / 1000) || ' TB' end"


_SIZES = "select o_orderkey as entry, cast(round(o_totalprice * 100) as bigint) * (o_orderkey % 7 * o_orderkey % 11 * 997 + 1) as size, cast(round(o_totalprice * 63) as bigint) * (o_orderkey % 7 * o_orderkey % 11 * 997 + 1) * (o_custkey % 3) as packed from orders"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    factor = F.expr("o_orderkey % 7 * o_orderkey % 11 * 997 + 1")
    o = A.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("entry"), (F.round(F.col("o_totalprice") * 100).cast("long") * factor).alias("size"), (F.round(F.col("o_totalprice") * 63).cast("long") * factor * (F.col("o_custkey") % 3)).alias("packed"))


_PCT = "case when size = 0 then 0 else cast(round((1.0::double - packed::double / size::double) * 100.0::double) as integer) end"


@query(f"with s as ({_SIZES}) select entry, {_human('size')} as text from s")
def human_size(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).select("entry", D.human_size(F.col("size")).alias("text"))


@query(f"with s as ({_SIZES}) select entry, {_PCT} as saved from s")
def percent_saved(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).select("entry", D.percent_saved(F.col("size"), F.col("packed")).alias("saved"))


@query(f"with s as ({_SIZES}) select entry, case when size = 0 then '' else cast(cast(round_even(abs((1.0::double - packed::double / size::double) * 100.0::double), 0) as bigint) as varchar) || case when packed <= size then '% smaller' else '% larger' end end as text from s")
def percent_text(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).select("entry", D.percent_text(F.col("size"), F.col("packed")).alias("text"))


@query(f"with s as ({_SIZES}) select entry, ({_human('size')}) || ' → ' || ({_human('packed')}) || ', ' || cast(abs({_PCT}) as varchar) || '% ' || case when {_PCT} >= 0 then 'smaller' else 'larger' end as text from s")
def savings_text(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(spark, d).select("entry", D.savings_text(F.col("size"), F.col("packed")).alias("text"))


_TAKES = "select event_id as entry, cast(round(value * 1000) as bigint) * (event_id % 400 + 1) as samples, case event_id % 4 when 0 then 44100 when 1 then 48000 when 2 then 96000 else 0 end as rate from events"


def _takes(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("event_id") % 4
    return A.table(spark, d, "events").select(F.col("event_id").alias("entry"), (F.round(F.col("value") * 1000).cast("long") * (F.col("event_id") % 400 + 1)).alias("samples"), F.when(r == 0, 44100).when(r == 1, 48000).when(r == 2, 96000).otherwise(0).cast("long").alias("rate"))


_TWO = lambda e: f"lpad(cast({e} as varchar), 2, '0')"


@query(f"""with t as ({_TAKES}), m as (select entry, rate, samples * 1000 // greatest(rate, 1) as ms from t)
select entry, case when rate = 0 then '' when ms // 3600000 > 0 then cast(ms // 3600000 as varchar) || ':' || {_TWO('ms // 60000 % 60')} || ':' || {_TWO('ms // 1000 % 60')} || '.' || lpad(cast(ms % 1000 as varchar), 3, '0')
 else cast(ms // 60000 as varchar) || ':' || {_TWO('ms // 1000 % 60')} || '.' || lpad(cast(ms % 1000 as varchar), 3, '0') end as text from m""")
def duration(spark: SparkSession, d: str) -> DataFrame:
    return _takes(spark, d).select("entry", D.duration(F.col("samples"), F.col("rate")).alias("text"))


_CLOCK = lambda s: f"{_TWO(f'({s}) // 3600 % 24')} || ':' || {_TWO(f'({s}) // 60 % 60')} || ':' || {_TWO(f'({s}) % 60')}"


@query(f"""with t as ({_TAKES}), f as (select entry, samples, rate, entry % 3 as how, case entry % 3 when 0 then 25 when 1 then 30 else 0 end as nominal, case entry % 3 when 0 then samples * 25 // greatest(rate, 1) when 1 then samples * 30000 // (greatest(rate, 1) * 1001) else 0 end as frames from t),
c as (select *, case when how = 1 then frames + 18 * (frames // 17982) + case when frames % 17982 > 2 then 2 * ((frames % 17982 - 2) // 1798) else 0 end else frames end as n from f)
select entry, case when rate = 0 then '' when how = 2 then {_CLOCK('samples * 1000 // greatest(rate, 1) // 1000')} || '.' || lpad(cast(samples * 1000 // greatest(rate, 1) % 1000 as varchar), 3, '0')
 else {_CLOCK('n // greatest(nominal, 1)')} || case when how = 1 then ';' else ':' end || {_TWO('n % greatest(nominal, 1)')} end as text from c""")
def timecode(spark: SparkSession, d: str) -> DataFrame:
    how = F.col("entry") % 3
    text = F.when(how == 0, "25").when(how == 1, "30000/1001 DF").otherwise("")
    num, den, drop = D.frame_rate(text)
    return _takes(spark, d).select("entry", D.timecode(F.col("samples"), F.col("rate"), num, den, drop).alias("text"))


@query("select l_orderkey, l_linenumber, l_partkey, strftime(make_timestamp((l_orderkey * 100003 - 400000000) * 1000000), '%Y-%m-%d %H:%M') as text from lineitem")
def time_format(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.minute_text(F.col("l_orderkey") * 100_003 - 400_000_000).alias("text"))


@query("with n as (select event_id as entry, (event_id - 5000) * 1234567891 as ns from events) select entry, (ns - ((ns % 1000000000) + 1000000000) % 1000000000) // 1000000000 as mtime from n")
def mtime_floor(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select(F.col("event_id").alias("entry"), D.mtime_seconds((F.col("event_id") - 5000) * 1_234_567_891).alias("mtime"))


@query("select doc_id, sha256(text) as sha256, md5(text) as md5 from documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from pages""")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", D.html_escape(F.col("html")).alias("escaped"))


@query("""select page_id, case when contains(html, '<title>') and contains(html, '</title>') then trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), chr(32) || chr(9) || chr(10) || chr(13)) end as title from pages""")
def xml_text(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", D.xml_text(F.col("html"), "title").alias("title"))


_ITEMS = "select page_id as entry, '/web/' || cast(page_id as varchar) as source_path, 'root/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as archive_path from pages"
_PATTERNS = ("blog.*", "6??", "*.html", "f[q-s]/")
# the folded names that the patterns match, and whether the pattern is for folders only
_HIT = "(regexp_full_match(x, 'blog\\..*') or regexp_full_match(x, '6..') or regexp_full_match(x, '.*\\.html') or (folder and regexp_full_match(x, 'f[q-s]')))"
_CUTS = f"""with i as ({_ITEMS}), p as (select *, string_split(rtrim(archive_path, '/'), '/') as parts from i), k as (select entry, source_path, archive_path, parts, unnest(range(2, len(parts) + 1)) as k from p),
h as (select entry, min(k) as k from (select entry, k, lower(parts[k]) as x, k < len(parts) as folder from k) where {_HIT} group by entry)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return A.table(spark, d, "pages").select(F.col("page_id").alias("entry"), F.concat(F.lit("/web/"), F.col("page_id").cast("string")).alias("source_path"), F.concat(F.lit("root/"), path).alias("archive_path"), F.lit("file").alias("kind"))


@query(f"{_CUTS} select i.entry, i.archive_path from i left join h using (entry) where h.k is null")
def exclude_kept(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    return E.kept(_items(spark, d), G.compile_patterns(_PATTERNS), ascii_only=ascii_key).select("entry", "archive_path")


@query(f"""{_CUTS}, t as (select p.entry, p.source_path, array_to_string(list_slice(parts, 1, h.k), '/') as archive_path, h.k = len(parts) as own from p join h using (entry))
select archive_path, min(entry) as entry, coalesce(max(source_path) filter (own), '') as source_path, case when bool_or(own) then 'file' else 'directory' end as kind from t group by archive_path""")
def exclude_topmost(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    return E.excluded(_items(spark, d), G.compile_patterns(_PATTERNS), ascii_only=ascii_key)


@query(f"with i as ({_ITEMS}) select entry, 'backup/2024/' || archive_path as archive_path from i")
def prefix_paths(spark: SparkSession, d: str) -> DataFrame:
    return E.under_folder(_items(spark, d), "backup/2024/").select("entry", "archive_path")


# Bytes and whether they are UTF-8 (plain, two and four bytes; cut short, overlong, a surrogate, beyond the last code point, a lone continuation).
_BYTES = (("6162", True), ("C3A9", True), ("F09F8EB5", True), ("C3", False), ("C080", False), ("EDA080", False), ("F4908080", False), ("80", False))


@query(f"""select p_partkey as entry, list_extract([{", ".join(str(ok).lower() for _, ok in _BYTES)}], cast(p_partkey % {len(_BYTES)} as integer) + 1) as valid from part""")
def utf8_validity(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with bytes behind them that are UTF-8 or not."""
    raw = F.element_at(F.array(*[F.unhex(F.lit(h)) for h, _ in _BYTES]), (F.col("p_partkey") % len(_BYTES) + 1).cast("int"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("entry"), P.valid_utf8(F.concat(F.col("p_name").cast("binary"), raw)).alias("valid"))


folded(exclude_kept, exclude_topmost)
