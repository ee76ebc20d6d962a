"""Selection, conflicts, resolutions, extraction decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import extraction as X
from shelfmark.operators import planning as L
from shelfmark.plans.catalogue import folded, query
from shelfmark.plans.listing_queries import PREFIXES, C
from shelfmark.sources import adapters as A

P = f"with p as ({A.PARTS})"
G = f"with g as ({A.groups_sql()})"


def _group_plan(spark: SparkSession, d: str) -> DataFrame:
    """Channel groups and, every eleventh group, ordinary files, as a plan."""
    g = A.groups(spark, d)
    mono = F.col("group_id") % 11 != 0
    return g.select(
        "entry", F.concat(F.lit("/in/"), F.col("group_id").cast("string")).alias("source_path"), F.col("name").alias("output_name"), F.lit("file").alias("kind"), F.when(mono, "flac_mono").otherwise("general").alias("codec"), "size", "mtime",
        F.when(mono, F.col("group_id")).alias("group_id"), F.when(mono, F.col("channel_index")).alias("channel_index"), F.when(mono, F.col("channel_count")).alias("channel_count"), F.when(mono, ".wav").alias("original_extension"), F.lit(None).cast("string").alias("kept_restored_name"),
    )


_GP = f"""{G}, p as (select entry, name as output_name, 'file' as kind, case when group_id % 11 <> 0 then 'flac_mono' else 'general' end as codec, size, mtime, case when group_id % 11 <> 0 then group_id end as group_id,
  case when group_id % 11 <> 0 then channel_index end as channel_index, case when group_id % 11 <> 0 then channel_count end as channel_count from g)"""


@query(f"{_GP} select cast(sum(size) filter (codec <> 'flac_mono' or coalesce(channel_index, 1) = 1) as bigint) as total_bytes from p")
def total_input_bytes(spark: SparkSession, d: str) -> DataFrame:
    return L.total_input_bytes(_group_plan(spark, d))


@query(f"{_GP} select coalesce(max(mtime) filter (kind <> 'directory' and codec <> 'generated'), 0) as newest from p")
def newest_mtime(spark: SparkSession, d: str) -> DataFrame:
    return L.newest_mtime(_group_plan(spark, d))


@query(f"{_GP} select bool_or(codec in ('flac', 'flac_mono')) as any_converted from p")
def any_converted(spark: SparkSession, d: str) -> DataFrame:
    return L.any_converted(_group_plan(spark, d))


@query(f"{P} select entry, output_name, codec from p union all select max(entry) + 1, 'README.txt', 'generated' from p where codec = 'flac' having count(*) > 0")
def ensure_readme(spark: SparkSession, d: str) -> DataFrame:
    plan = A.parts_plan(spark, d)
    flac_last = plan.where("codec = 'flac'")  # the generated row follows the last converted entry here, so that the check is not about a constant
    return L.with_readme(flac_last).select("entry", "output_name", "codec").unionByName(plan.where("codec <> 'flac'").select("entry", "output_name", "codec"))


_CLAIMS = f"""{P}, o as (select distinct lower(rtrim(n, '/')) as collision_key, entry, kind <> 'directory' as is_file from (select entry, kind, unnest(case when codec = 'flac' then [output_name, regexp_replace(output_name, '\\.flac$', '') || '.wav'] else [output_name] end) as n from p))"""


@query(f"{_CLAIMS} select collision_key, array_to_string(list(entry order by entry), ',') as entries from o group by collision_key having count(distinct entry) > 1")
def collision_groups(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    found = L.collisions(A.parts_plan(spark, d), ascii_key=ascii_key)
    return found.select("collision_key", F.array_join(F.col("entries").cast("array<string>"), ",").alias("entries"))


@query(f"{_CLAIMS} select o.entry, o.collision_key, o.is_file from o join p using (entry) where p.codec = 'flac'")
def dual_key_owners(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    plan = A.parts_plan(spark, d).where("codec = 'flac'")
    return L.owners(plan, F.lit(1) if ascii_key else None).select("entry", "collision_key", "is_file")


_CLASH = f"""a as (select entry, collision_key as name from o), e as (select entry, unnest({PREFIXES}) as collision_key from a),
h as (select e.collision_key, e.entry, f.entry as file from e join o f on e.collision_key = f.collision_key and f.is_file where e.entry <> f.entry),
m as (select collision_key, unnest([entry, file]) as entry from h)"""


@query(f"{_CLAIMS}, {_CLASH} select collision_key, array_to_string(list(distinct entry order by entry), ',') as entries from m group by collision_key")
def parent_clash(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    found = L.parent_clashes(A.parts_plan(spark, d), ascii_key=ascii_key)
    return found.select("collision_key", F.array_join(F.col("entries").cast("array<string>"), ",").alias("entries"))


@query(f"""{_CLAIMS}, {_CLASH}, r as (select 'collision' as kind, collision_key, list(entry order by entry) as entries from o group by collision_key having count(distinct entry) > 1
union all select 'parent_clash', collision_key, list(distinct entry order by entry) from m group by collision_key) select kind, collision_key, len(entries) as n, entries[1] as first_entry from r""")
def all_conflicts(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    return L.conflicts(A.parts_plan(spark, d), ascii_key=ascii_key).select("kind", "collision_key", F.size("entries").cast("long").alias("n"), "first_entry")


@query(f"{C}, k as (select entry, kind, lower(rtrim(regexp_extract(name, '[^/]*/([^/]*)/?$', 1), '/')) as k from c), n as (select k, count(*) as n, bool_and(kind = 'directory') as dirs, min(entry) as first from k group by k) select entry, n.n > 1 and not dirs as refused, n.n > 1 and dirs and entry <> first as merged from k join n using (k)")
def extraction_collisions(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    """Entries put into one folder per language: most collide, and the sources' folders merge."""
    target = F.regexp_extract("name", r"[^/]*/([^/]*)/?$", 1)
    return X.refuse_collisions(A.catalog(spark, d).select("entry", "kind", target.alias("target")), ascii_key=ascii_key).select("entry", "refused", "merged")


@query(f"{_CLAIMS}, t as (select entry, output_name as name, kind from p), e as (select entry, unnest({PREFIXES}) as prefix from (select entry, lower(name) as name from t)), f as (select distinct lower(name) as prefix from t where kind <> 'directory') select entry, min_by(prefix, length(prefix)) as clash from e join f using (prefix) group by entry")
def extraction_parent_clash(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    items = A.parts_plan(spark, d).select("entry", "kind", F.col("output_name").alias("target"), F.lit(False).alias("refused"), F.lit(False).alias("merged"))
    return X.refuse_below_files(items, ascii_key=ascii_key)


@query(f"{C} select entry, name from c where entry in (select doc_id from labels where quality = 0)")
def select_by_index(spark: SparkSession, d: str) -> DataFrame:
    chosen = A.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("entry"))
    return X.select_indices(A.catalog(spark, d), chosen).select("entry", "name")


@query(f"{C}, w as (select distinct source || case when doc_id % 2 = 0 then '' else '/en/' || cast(doc_id as varchar) || '.txt' end as name from documents) select w.name, min(c.entry) as entry from w left join (select entry, regexp_replace(name, '/$', '') as name from c) c using (name) group by w.name")
def select_by_name(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    names = docs.select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("/en/"), F.col("doc_id").cast("string"), F.lit(".txt")))).alias("name"))
    return X.select_names(A.catalog(spark, d), names)


_SELECTORS = "select distinct case p_partkey % 4 when 0 then '#' || cast(p_partkey * 3 as varchar) when 1 then p_brand || '/' || p_name when 2 then '/in/' || cast(p_partkey as varchar) else p_brand || '/' || p_name || '/7.wav' end as selector from part"


@query(f"""{P}, s as ({_SELECTORS}), k as (select '#' || cast(entry as varchar) as selector, 0 as rank, entry from p union all select output_name, 1, entry from p union all select case when codec = 'flac' then regexp_replace(output_name, '\\.flac$', '') || '.wav' end, 2, entry from p union all select source_path, 2, entry from p)
select s.selector, (select entry from k where k.selector = s.selector order by rank, entry limit 1) as entry from s""")
def selector_priority(spark: SparkSession, d: str) -> DataFrame:
    from shelfmark.functions import paths

    restored = F.when(F.col("codec") == "flac", paths.restored_name(F.col("output_name"), F.lit(False), F.col("original_extension"), F.col("kept_restored_name")))
    part = A.table(spark, d, "part")
    k, own = F.col("p_partkey") % 4, F.concat("p_brand", F.lit("/"), "p_name")
    wanted = part.select(F.when(k == 0, F.concat(F.lit("#"), (F.col("p_partkey") * 3).cast("string"))).when(k == 1, own).when(k == 2, F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"))).otherwise(F.concat(own, F.lit("/7.wav"))).alias("selector"))
    return X.resolve_selectors(A.parts_plan(spark, d).withColumn("restored_name", restored), wanted)


@query(f"{C} select entry from c where not (entry = 0)")
def readme_skip(spark: SparkSession, d: str) -> DataFrame:
    named = A.catalog(spark, d).withColumn("name", F.when(F.col("generated"), L.README).otherwise(F.col("name")))
    return X.skip_readme(named, selected=False).select("entry")


@query(f"{C} select entry, case when starts_with(name, 'src3/') then substr(name, 6) else name end as target from c where name <> 'src3/'")
def base_folder(spark: SparkSession, d: str) -> DataFrame:
    return X.strip_base(A.catalog(spark, d), "src3").select("entry", "target")


@query(f"{C}, t as (select source || '/en/' || cast(doc_id as varchar) || '.txt' as target from documents where doc_id % 3 = 0 union select source || '/' from documents), m as (select c.entry, c.kind <> 'directory' and t.target is not null as e from c left join t on c.name = t.target) select entry, e as exists, case when e then 'skip' else 'write' end as decision from m")
def exists_decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    there = docs.where(F.col("doc_id") % 3 == 0).select(F.concat("source", F.lit("/en/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("target")).unionByName(docs.select(F.concat("source", F.lit("/")).alias("target")))
    items = A.catalog(spark, d).select("entry", "kind", F.col("name").alias("target"))
    return X.decide(X.mark_existing(items, there), "skip").select("entry", "exists", "decision")


@query("""with o as (select o_orderkey as entry, '/o/' || cast(o_orderkey as varchar) as source_path, o_custkey as size, o_orderkey * 1000 as mtime_ns from orders),
n as (select source_path, size + case when entry % 9 = 0 then 1 else 0 end as size, mtime_ns + case when entry % 14 = 3 then 5 else 0 end as mtime_ns from o where entry % 25 <> 7) select o.entry, not (n.source_path is not null and o.size = n.size and o.mtime_ns = n.mtime_ns) as changed from o left join n using (source_path)""")
def source_changed(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("source_path"), F.col("o_custkey").alias("size"), (F.col("o_orderkey") * 1000).alias("mtime_ns"))
    now = o.where(F.col("entry") % 25 != 7).withColumn("size", F.col("size") + F.when(F.col("entry") % 9 == 0, 1).otherwise(0)).withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("entry") % 14 == 3, 5).otherwise(0))
    return X.source_changed(o, now)


_RES = "select entry, case entry % 3000 when 0 then 'rename' when 1001 then 'skip' else 'disable_flac' end as action, 'renamed/' || cast(entry as varchar) as new_name from p where entry % 3000 in (0, 1001, 2000)"


def _resolutions(plan: DataFrame) -> DataFrame:
    r = F.col("entry") % 3000
    return plan.where(r.isin(0, 1001, 2000)).select("entry", F.when(r == 0, "rename").when(r == 1001, "skip").otherwise("disable_flac").alias("action"), F.concat(F.lit("renamed/"), F.col("entry").cast("string")).alias("new_name"))


def _resolved_sql(columns: str, where: str = "true") -> str:
    return f"""{_GP}, r as ({_RES}), gr as (select p.group_id, max(struct_pack(action := r.action, new_name := r.new_name)) as g from p join r using (entry) where p.group_id is not null group by p.group_id),
b as (select p.*, coalesce(gr.g.action, r.action) as action, coalesce(gr.g.new_name, r.new_name) as new_name from p left join r using (entry) left join gr on p.group_id = gr.group_id),
k as (select * from b where action is distinct from 'skip' and (action is distinct from 'disable_flac' or coalesce(channel_index, 1) = 1)),
o as (select row_number() over (order by entry) - 1 as entry, entry as was, action, case when action = 'rename' then case when codec = 'flac_mono' then new_name || '_ch' || lpad(cast(channel_index as varchar), 2, '0') || '.flac' else new_name end
   when action = 'disable_flac' and codec = 'flac_mono' then regexp_replace(regexp_replace(output_name, '\\.flac$', ''), '_ch[0-9]+$', '') || '.wav' else output_name end as output_name,
   case when action = 'disable_flac' and codec = 'flac_mono' then 'general' else codec end as codec, case when action = 'disable_flac' then null else group_id end as group_id from k)
select {columns} from o where {where}"""


@query(_resolved_sql("entry, output_name", "starts_with(output_name, 'renamed/')"))
def resolve_rename(spark: SparkSession, d: str) -> DataFrame:
    plan = _group_plan(spark, d)
    return L.resolve(plan, _resolutions(plan)).where(F.col("output_name").startswith("renamed/")).select("entry", "output_name")


@query(_resolved_sql("entry, output_name, codec, group_id"))
def resolve_all(spark: SparkSession, d: str) -> DataFrame:
    plan = _group_plan(spark, d)
    return L.resolve(plan, _resolutions(plan)).select("entry", "output_name", "codec", "group_id")


@query(f"{_GP} select row_number() over (order by entry) - 1 as entry, output_name from p where entry % 3000 <> 1001 and coalesce(group_id, -1) not in (select group_id from p where entry % 3000 = 1001 and group_id is not null)")
def resolve_skip(spark: SparkSession, d: str) -> DataFrame:
    plan = _group_plan(spark, d)
    return L.resolve(plan, _resolutions(plan).where("action = 'skip'")).select("entry", "output_name")


@query(_resolved_sql("output_name, codec", "action = 'disable_flac'"))
def resolve_disable(spark: SparkSession, d: str) -> DataFrame:
    plan = _group_plan(spark, d)
    answers = _resolutions(plan).where("action = 'disable_flac'")
    # plain entries that nothing was asked of are the same before and after
    before = plan.where("codec = 'general'").join(answers, "entry", "left_anti").select("output_name")
    return L.resolve(plan, _resolutions(plan)).where("codec = 'general' and not startswith(output_name, 'renamed/')").join(before, "output_name", "left_anti").select("output_name", "codec")


@query(f"{P} select row_number() over (order by entry desc) - 1 as entry, output_name from p where entry % 4 <> 1")
def reindex(spark: SparkSession, d: str) -> DataFrame:
    from shelfmark.operators.exclude import renumber

    kept = A.parts_plan(spark, d).where(F.col("entry") % 4 != 1)
    top = kept.agg(F.max("entry")).first()[0] or 0
    return renumber(kept.withColumn("entry", F.lit(top) - F.col("entry"))).select("entry", "output_name")


@query(f"""{C}, a as (select distinct on (name) max(doc_id) over (partition by source) as e, source || '/' as name, 'directory' as kind from documents where doc_id % 2 = 0), n as (select 'new/' as name), j as (select entry, name from c)
select count(*) as entries, count(*) filter (name = 'new/') as folders, cast(max(entry) as bigint) as last from (select row_number() over (order by entry) - 1 as entry, name from (select entry, name from j union all select 9000000000, 'new/' union all select 9000000001 + doc_id, 'new/' || cast(doc_id as varchar) from documents where doc_id % 10 = 0))""")
def dirs_merge(spark: SparkSession, d: str, ascii_key: bool = True) -> DataFrame:
    base = A.catalog(spark, d).select("entry", F.col("name").alias("output_name"), "kind")
    docs = A.table(spark, d, "documents")
    again = docs.groupBy("source").agg(F.max("doc_id").alias("entry")).select("entry", F.concat("source", F.lit("/")).alias("output_name"), F.lit("directory").alias("kind"))
    new = docs.where(F.col("doc_id") % 10 == 0).select((F.col("doc_id") + 1_000_000).alias("entry"), F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("output_name"), F.lit("file").alias("kind"))
    folder = docs.limit(1).select(F.lit(999_999).cast("long").alias("entry"), F.lit("new/").alias("output_name"), F.lit("directory").alias("kind"))
    merged = L.merge_added(base, again.unionByName(new).unionByName(folder), ascii_key=ascii_key)
    return merged.agg(F.count("*").alias("entries"), F.count_if(F.col("output_name") == "new/").alias("folders"), F.max("entry").alias("last"))


folded(collision_groups, dual_key_owners, parent_clash, all_conflicts, extraction_collisions, extraction_parent_clash, dirs_merge)
