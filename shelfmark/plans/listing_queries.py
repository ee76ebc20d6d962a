"""Catalogue listing, totals, roll-ups, filters and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import display as D
from shelfmark.functions import paths as P
from shelfmark.operators import browse as B
from shelfmark.operators import extraction as X
from shelfmark.operators import planning as L
from shelfmark.operators import segments as S
from shelfmark.plans.catalogue import query
from shelfmark.sources import adapters as A

C = f"with c as ({A.CATALOG})"
G = f"with g as ({A.groups_sql()})"
#: All proper folder prefixes of column name, in SQL.
PREFIXES = "list_transform(range(1, len(string_split(rtrim(name, '/'), '/'))), lambda k: array_to_string(list_slice(string_split(rtrim(name, '/'), '/'), 1, k), '/'))"


@query(f"{C} select entry, name, kind, size, packed, method, mtime, restorable from c")
def catalog_list(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(spark, d).select("entry", "name", "kind", "size", "packed", "method", "mtime", "restorable")


@query(f"{C} select count(*) as entries, cast(sum(size) as bigint) as size, cast(sum(packed) as bigint) as packed from c")
def cli_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.cli_totals(A.catalog(spark, d))


@query(f"{C} select count(*) as files, cast(sum(size) as bigint) as size, cast(sum(packed) as bigint) as packed from c where kind <> 'directory'")
def preview_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.preview_totals(A.catalog(spark, d))


@query(f"{C} select count(*) as files, cast(sum(coalesce(original_size, size)) as bigint) as size, cast(sum(packed) as bigint) as packed, bool_and(original_size is not null or not restorable) as ratio_known from c where kind <> 'directory'")
def gui_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.gui_totals(A.catalog(spark, d))


@query(f"{G} select count(*) filter (channel_index = 1) as files, cast(sum(case when channel_index > 1 then 0 else coalesce(original_size, size) end) as bigint) as size, cast(sum(packed) as bigint) as packed, bool_and(original_size is not null or channel_index > 1) as ratio_known from g")
def gui_totals_groups(spark: SparkSession, d: str) -> DataFrame:
    return B.gui_totals(A.groups(spark, d).withColumn("kind", F.lit("file")).withColumn("restorable", F.lit(True)))


_ROLL = f"""{C}, live as (select kind <> 'directory' as file, size, packed, ratio_known, packed_known, unnest(case when kind = 'directory' then list_append({PREFIXES}, rtrim(name, '/')) else {PREFIXES} end) as folder from c where not deleted)
select folder, count(*) filter (file) as files, cast(coalesce(sum(size) filter (file), 0) as bigint) as size, cast(coalesce(sum(packed) filter (file), 0) as bigint) as packed,
  coalesce(bool_and(ratio_known) filter (file), true) as ratio_known, coalesce(bool_and(packed_known) filter (file), true) as packed_known from live group by folder"""


@query(_ROLL)
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return B.folder_rollup(A.catalog(spark, d))


@query(f"""{C}, s as (select c.name, case when l.quality is null then 'unknown' when l.quality = 1 then 'good' else 'bad' end as state from c left join labels l on c.entry = l.doc_id where kind = 'file'), e as (select state, unnest({PREFIXES}) as folder from s)
select folder, case when min(state) = max(state) then min(state) end as state from e group by folder""")
def folder_shared_state(spark: SparkSession, d: str) -> DataFrame:
    labels = A.table(spark, d, "labels").select(F.col("doc_id").alias("entry"), "quality")
    state = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "good").otherwise("bad")
    return B.folder_states(A.catalog(spark, d).where("kind = 'file'").join(labels, "entry", "left").withColumn("state", state))


_BROWSER = "case when restorable then 'FLAC' when method = 0 then 'Store' when method = 8 then 'Deflate' else 'Unsupported' end"


@query(f"{C} select {_BROWSER} as method, count(*) as files from c where kind <> 'directory' group by 1")
def method_histogram(spark: SparkSession, d: str) -> DataFrame:
    label = D.browser_method(F.col("kind"), F.col("method"), F.col("restorable"), F.lit(1))
    return B.method_histogram(A.catalog(spark, d).withColumn("method", label))


@query(f"""{C} select entry, {_BROWSER} as browser, case when restorable then 'flac' when method = 0 then 'store' when method = 8 then 'deflate' else 'unsupported(' || cast(method as varchar) || ')' end as cli,
  case when {_BROWSER} = 'Unsupported' then 'Other' else {_BROWSER} end as summary, case when restorable then 'FLAC' when method = 0 then 'Stored' when method = 8 then 'Deflate' else 'Method ' || cast(method as varchar) end as preview,
  case when {_BROWSER} = 'FLAC' then 'flac' else lower({_BROWSER}) end as key from c where kind = 'file'""")
def method_labels(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1)
    browser = D.browser_method(F.col("kind"), F.col("method"), F.col("restorable"), one)
    c = A.catalog(spark, d).where("kind = 'file'")
    return c.select("entry", browser.alias("browser"), D.cli_method(F.col("method"), F.col("restorable"), one).alias("cli"), D.summary_method(browser).alias("summary"), D.preview_method(F.col("method"), F.col("restorable")).alias("preview"), D.method_key(browser).alias("key"))


@query(f"{C} select bool_or(size >= 4294967295 or packed >= 4294967295 or mtime >= 4294967295) or count(*) >= 65535 as zip64 from c")
def zip64_flag(spark: SparkSession, d: str) -> DataFrame:
    return S.archive_zip64(A.catalog(spark, d).withColumn("offset", F.col("mtime")))


@query(f"{C}, hits as (select name from c where kind = 'file' and restorable and not deleted), up as (select distinct unnest({PREFIXES}) as name from hits) select name, true as matches from hits union all select name, false from up")
def browser_method_filter_with_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return B.filter_tree(A.catalog(spark, d), (F.col("kind") == "file") & F.col("restorable") & ~F.col("deleted"))


@query(f"with g as ({A.groups_sql()}) select entry, group_id from g where size > 200 or group_id in (select group_id from g group by group_id having coalesce(max(original_size), sum(size)) > 200)")
def browser_members_of_matching_groups(spark: SparkSession, d: str) -> DataFrame:
    members = A.groups(spark, d)
    return B.member_filter(members, B.group_rows(members), F.col("size") > 200).select("entry", "group_id")


@query(f"{C}, hits as (select name from c where kind = 'file' and (contains(lower(name), 'fr/1') or coalesce(contains(lower(restores_to), 'fr/1'), false))), up as (select distinct unnest({PREFIXES}) as name from hits) select name, true as matches from hits union all select name, false from up")
def browser_text_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.filter_tree(A.catalog(spark, d), (F.col("kind") == "file") & B.text_filter("FR/1"))


_SAVED = "case when size = 0 then 0 else cast(round((1.0::double - packed::double / size::double) * 100.0::double) as integer) end"


@query(f"{C}, k as (select entry, case when ratio_known then {_SAVED} else -2147483648 end as ratio from c) select entry, ratio, row_number() over (order by ratio desc, entry) as place from k order by place limit 200")
def browser_sort(spark: SparkSession, d: str) -> DataFrame:
    """A report of the first 200 rows by ratio: a top-k, then numbered."""
    from pyspark.sql import Window

    top = B.sort_rows(A.catalog(spark, d), "ratio", descending=True).limit(200).select("entry", B.ratio_key().alias("ratio"))
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ratio"), "entry")))


@query(f"{C} select entry, name, (select count(*) from c) > 500 as truncated from c order by entry limit 500")
def preview_top500(spark: SparkSession, d: str) -> DataFrame:
    return B.preview(A.catalog(spark, d)).select("entry", "name", "truncated")


@query(f"{C} select entry, name from c where lower(name) like '%.flac' order by entry limit 100")
def probe_cap(spark: SparkSession, d: str) -> DataFrame:
    return X.probe(A.catalog(spark, d), 100).select("entry", "name")


@query(f"{C}, f as (select entry from c where lower(name) like '%.flac' and kind = 'file' order by entry limit 60) select count(*) as restorable, (select count(*) from c where lower(name) like '%.flac') > 60 as partial from f")
def restorable_count(spark: SparkSession, d: str) -> DataFrame:
    return B.restorable_audio(A.catalog(spark, d), 60)


@query(f"{G}, p as (select * from g order by entry limit 300) select count(distinct group_id) as restorable, (select count(*) from g) > 300 as partial from p")
def restorable_groups(spark: SparkSession, d: str) -> DataFrame:
    return B.restorable_audio(A.groups(spark, d).withColumn("restorable", F.lit(True)), 300)


_DIRS = f"{C}, f as (select distinct unnest({PREFIXES}) as folder from c where kind = 'file')"


@query(f"{_DIRS} select folder, len(string_split(folder, '/')) as depth from f")
def deepest_first(spark: SparkSession, d: str) -> DataFrame:
    """Folders by falling depth, in the order of a range-partitioned sort."""
    folders = A.catalog(spark, d).where("kind = 'file'").select(F.explode(P.ancestors(F.col("name"))).alias("target")).distinct().withColumn("kind", F.lit("directory")).withColumn("entry", F.col("target"))
    return X.deepest_first(folders).select(F.col("target").alias("folder"), F.size(F.split("target", "/")).cast("long").alias("depth"))


@query(f"{G} select group_id, min(entry) as entry, cast(coalesce(max(original_size), sum(size)) as bigint) as size, cast(sum(packed) as bigint) as packed, max(mtime) as mtime, count(*) as channels, array_to_string(list(entry order by channel_index), ',') as children from g group by group_id")
def group_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.group_rows(A.groups(spark, d)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


_COMPLETE = """, q as (select group_id, count(*) = max(channel_count) and min(channel_count) = max(channel_count) and count(distinct channel_index) = count(*) and min(channel_index) = 1 and max(channel_index) = count(*)
 and min(sha256) is not distinct from max(sha256) and min(samples) is not distinct from max(samples) and min(bits) is not distinct from max(bits) as complete from g group by group_id)"""
GB = f"with g as ({A.groups_sql(True)})"


@query(f"{GB}{_COMPLETE} select group_id, complete from q")
def group_complete(spark: SparkSession, d: str) -> DataFrame:
    return X.complete_groups(A.groups(spark, d, broken=True))


@query(f"{GB}{_COMPLETE} select g.entry, g.group_id from g join q using (group_id) where not complete")
def group_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return X.incomplete_members(A.groups(spark, d, broken=True)).select("entry", "group_id")


@query(f"{G} select entry, group_id from g where group_id in (select group_id from g where entry % 9 = 4)")
def select_pulls_group(spark: SparkSession, d: str) -> DataFrame:
    g = A.groups(spark, d)
    return X.pull_groups(g, g.where(F.col("entry") % 9 == 4).select("entry")).select("entry", "group_id")


@query(f"""{G}, r as (select min(entry) as entry, min_by(name, channel_index) || ' ... ' || max_by(name, channel_index) || ' (' || cast(count(*) as varchar) || ' channels)' as label, max(restores_to) as restores_to from g group by group_id)
select entry, rpad(label, cast((select max(length(label)) from r) as integer), ' ') || '  ' || restores_to as line from r""")
def readme_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.readme_rows(A.groups(spark, d))


@query("""with x as (select p_partkey as entry, 'mix/' || cast(p_partkey as varchar) as stem, p_size % 40 as n from part), e as (select entry, stem, n, unnest(range(1, n + 1)) as k from x where n > 8)
select entry, stem || '_ch' || lpad(cast(k as varchar), 2, '0') || '.flac' as output_name, cast(k as integer) as channel_index, cast(n as integer) as channel_count from e
union all select entry, stem || '.wav', null, null from x where n <= 8""")
def channel_explode(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.concat(F.lit("mix/"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("output_name"), (F.col("p_size") % 40).alias("channels"))
    return L.explode_channels(p).select("entry", "output_name", "channel_index", "channel_count")


@query(f"{C}, p as (select string_split(regexp_extract(name, '^(.*)/[^/]*$', 1), '/') as a from c where kind = 'file'), e as (select min(a) as lo, max(a) as hi from p), n as (select lo, hi, (select count(*) from range(1, least(len(lo), len(hi)) + 1) t(k) where list_slice(lo, 1, k) = list_slice(hi, 1, k)) as k from e) select case when k = 0 then '' else array_to_string(list_slice(lo, 1, k), '/') end as folder from n")
def common_folder(spark: SparkSession, d: str) -> DataFrame:
    return B.common_folder(A.catalog(spark, d).where(F.col("kind") == "file"))


@query(f"""{G}, r as (select entry, case when entry % 4 = 1 then 'crc_mismatch' when entry % 6 = 0 then 'too_short' else 'ok' end as status from g), m as (select group_id as entry, r.status from g join r using (entry))
select entry, array_to_string(list(distinct status order by status), ', ') as verified from m group by entry""")
def verification_join(spark: SparkSession, d: str) -> DataFrame:
    g = A.groups(spark, d)
    status = F.when(F.col("entry") % 4 == 1, "crc_mismatch").when(F.col("entry") % 6 == 0, "too_short").otherwise("ok")
    rows = B.group_rows(g).select(F.col("group_id").alias("entry"), F.col("children").alias("members"))
    return B.verification(rows, g.select("entry", status.alias("status")))


@query(f"{C}, o as (select entry, case when size % 41 = 7 then 'crc_mismatch' when size % 53 = 9 then 'io_error' else 'ok' end as status from c) select coalesce((select status from o where status <> 'ok' order by entry limit 1), 'ok') as status")
def outcome_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("size") % 41 == 7, "crc_mismatch").when(F.col("size") % 53 == 9, "io_error").otherwise("ok")
    return X.outcome_status(A.catalog(spark, d).select("entry", status.alias("status")))


@query(f"{C} select count(*) filter (method = 12) as errors from c")
def error_count(spark: SparkSession, d: str) -> DataFrame:
    return X.count_errors(A.catalog(spark, d).select((F.col("method") == 12).alias("is_error")))


_DROPS = "select p_partkey % 3 as intent, p_name || case when p_partkey % 3 = 2 and p_partkey % 2 = 0 then '.ZIP' else '' end as name from part"


def _drops(spark: SparkSession, d: str, intent: int) -> DataFrame:
    k = F.col("p_partkey")
    n = A.table(spark, d, "part").select((k % 3).alias("intent"), F.concat("p_name", F.when((k % 3 == 2) & (k % 2 == 0), ".ZIP").otherwise("")).alias("name"))
    return n.where(F.col("intent") == intent).select("name")


@query(f"with n as ({_DROPS}) select 'auto' as intent, case when bool_and(lower(name) like '%.zip') then 'extract' else 'compress' end as action from n where intent = 0 union all select 'compress', 'compress' union all select 'extract', case when bool_or(lower(name) like '%.zip') then 'extract' else 'none' end from n where intent = 2 union all select 'nothing', 'none'")
def drop_intents(spark: SparkSession, d: str) -> DataFrame:
    """Parts dropped with each intent, and nothing dropped at all."""
    said = {"auto": B.drop_rule(_drops(spark, d, 0)), "compress": B.drop_rule(_drops(spark, d, 1), "compress"), "extract": B.drop_rule(_drops(spark, d, 2), "extract"), "nothing": B.drop_rule(_drops(spark, d, 0).where("false"))}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("intent"), "action") for name, rows in said.items()])


@query(f"with n as ({_DROPS}) select name from n where intent = 2 and lower(name) like '%.zip'")
def drop_items(spark: SparkSession, d: str) -> DataFrame:
    return B.drop_items(_drops(spark, d, 2), "extract")


@query("select case when bool_and(lower(p_name) like '%.zip') then 'extract' else 'compress' end as action from part")
def drop_rule(spark: SparkSession, d: str) -> DataFrame:
    return B.drop_rule(A.table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("""with w as (select distinct p_name || '.zip' as path from part), t as (select distinct p_name || case when p_partkey % 3 = 0 then '' else ' ' || cast(2 + p_partkey % 5 as varchar) end || '.zip' as taken from part where p_partkey % 2 = 0)
select path, case when path not in (select taken from t) then path else (select regexp_replace(path, '\\.zip$', '') || ' ' || cast(min(k) as varchar) || '.zip' from range(2, 5000) r(k) where regexp_replace(path, '\\.zip$', '') || ' ' || cast(k as varchar) || '.zip' not in (select taken from t)) end as free from w""")
def unique_path(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), (F.col("p_partkey") % 5 + 2).cast("string")))
    taken = p.where(F.col("p_partkey") % 2 == 0).select(F.concat("p_name", tail, F.lit(".zip")).alias("taken"))
    return B.unique_path(p.select(F.concat("p_name", F.lit(".zip")).alias("path")), taken)
