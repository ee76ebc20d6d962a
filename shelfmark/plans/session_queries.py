"""Edits: what changed, who wins, what was moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import browse as B
from shelfmark.operators import session as S
from shelfmark.plans.catalogue import query
from shelfmark.sources import adapters as A

_B = "b as (select '/d/' || cast(doc_id as varchar) as source, source || '/' || cast(doc_id as varchar) || '.txt' as name, cast(strlen(text) as bigint) as size, doc_id from documents where doc_id % 6 <> 5)"
_P = """p as (select case when doc_id % 6 = 4 and doc_id % 4 = 0 then '/new/' else '/d/' end || cast(doc_id as varchar) as source, case when doc_id % 6 = 2 then 'moved/' else '' end || source || '/' || cast(doc_id as varchar) || '.txt' as name,
  cast(strlen(text) as bigint) as size from documents where doc_id % 6 <> 3)"""
_DIFF = f"""with {_B}, {_P}, j as (select coalesce(b.source, p.source) as source, b.name as old_name, p.name as new_name, coalesce(p.size, b.size) as size, b.source is not null as in_base, p.source is not null as in_plan from b full join p on b.source = p.source),
g as (select distinct old_name from j where not in_plan), f as (select distinct new_name from j where not in_base),
s as (select source, coalesce(new_name, old_name) as name, size, case when not in_base and new_name in (select old_name from g) then 'replaced' when not in_base then 'added' when not in_plan then 'removed' when old_name <> new_name then 'renamed' else 'unchanged' end as state,
  old_name, in_plan from j), r as (select * from s where not (not in_plan and old_name in (select new_name from f)))"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = A.table(spark, d, "documents")
    k, size = F.col("doc_id") % 6, F.octet_length("text").cast("long").alias("size")
    id_ = F.col("doc_id").cast("string")
    name = F.concat("source", F.lit("/"), id_, F.lit(".txt"))
    base = docs.where(k != 5).select(F.concat(F.lit("/d/"), id_).alias("source"), name.alias("name"), size)
    plan = docs.where(k != 3).select(F.concat(F.when((k == 4) & (F.col("doc_id") % 4 == 0), "/new/").otherwise("/d/"), id_).alias("source"), F.concat(F.when(k == 2, "moved/").otherwise(""), name).alias("name"), size)
    return base, plan


@query(f"{_DIFF} select source, name, state, case when state = 'renamed' then old_name end as previous_name from r")
def session_diff(spark: SparkSession, d: str) -> DataFrame:
    return S.diff(*_sides(spark, d))


@query(f"""{_DIFF} select count(*) filter (state = 'added') as added, cast(coalesce(sum(size) filter (state in ('added', 'replaced')), 0) as bigint) as added_bytes, count(*) filter (state = 'removed') as removed, count(*) filter (state = 'replaced') as replaced, count(*) filter (state <> 'removed') as entries from r""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    base, plan = _sides(spark, d)
    rows = S.diff(base, plan).join(plan.select("source", "size"), "source", "left")
    return S.summary(rows)


_NAMES = "select doc_id, source || '/' || lang || '/' || cast(doc_id as varchar) || '.txt' as name from documents"
_TO = "case doc_id % 5 when 0 then name when 1 then replace(name, '/en/', '/english/') when 2 then 'attic/' || name when 3 then replace(name, '.txt', '.md') else replace(name, 'src1', 'source1') end"
_PARTS = lambda c: f"list_filter(string_split({c}, '/'), lambda x: x <> '')"
_PRE = lambda c: f"list_transform(range(1, len(string_split({c}, '/'))), lambda k: array_to_string(list_slice(string_split({c}, '/'), 1, k), '/'))"
_SL = lambda c, n: f"case when {n} <= 0 then '' else array_to_string(list_slice({c}, 1, {n}), '/') end"


@query(f"""with n as ({_NAMES}), c as (select name as f, {_TO} as t from n), fb as (select distinct unnest({_PRE('f')}) as folder from c), fa as (select distinct unnest({_PRE('t')}) as folder from c),
q as (select {_PARTS('f')} as p, {_PARTS('t')} as n from c), z as (select p, n, (select count(*) from range(1, least(len(p), len(n)) + 1) r(k) where list_slice(list_reverse(p), 1, k) = list_slice(list_reverse(n), 1, k)) as k from q where p <> n),
y as (select *, len(p) - k as a, len(n) - k as b from z), x as (select *, {_SL('p', 'a')} as old, {_SL('n', 'b')} as new from y),
w as (select *, a = b and a >= 1 and ({_SL('p', 'a - 1')}) = ({_SL('n', 'b - 1')}) and old not in (select folder from fa) and new not in (select folder from fb) as fr, len(p) = len(n) and ({_SL('p', 'len(p) - 1')}) = ({_SL('n', 'len(n) - 1')}) as place from x),
r as (select distinct case when k = 0 then array_to_string(p, '/') else old end as x, case when k = 0 then array_to_string(n, '/') else new end as y from w where k = 0 or fr),
m as (select distinct case when k = 0 then array_to_string(p, '/') else {_SL('p', 'a + 1')} end as x, case when k = 0 then array_to_string(n, '/') else {_SL('n', 'b + 1')} end as y from w where (k = 0 and not place) or (k > 0 and not fr))
select (select count(*) from r) as renames, (select count(*) from m) as moves""")
def count_moves(spark: SparkSession, d: str) -> DataFrame:
    id_ = F.col("doc_id").cast("string")
    n = A.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), id_, F.lit(".txt")).alias("from"))
    k, name = F.col("doc_id") % 5, F.col("from")
    to = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit("/en/"), F.lit("/english/"))).when(k == 2, F.concat(F.lit("attic/"), name)).when(k == 3, F.replace(name, F.lit(".txt"), F.lit(".md"))).otherwise(F.replace(name, F.lit("src1"), F.lit("source1")))
    c = n.select("from", to.alias("to"))
    return S.count_moves(c, c.select(F.col("from").alias("name")), c.select(F.col("to").alias("name")))


@query(f"with n as ({_NAMES}) select doc_id, name from n where not starts_with(name, 'src4/')")
def remove_folder(spark: SparkSession, d: str) -> DataFrame:
    return S.remove_folder(_names(spark, d), "src4")


@query(f"with n as ({_NAMES}) select doc_id, case when starts_with(name, 'src5/en/') then 'src5/english/' || substr(name, 9) else name end as name from n")
def rename_folder(spark: SparkSession, d: str) -> DataFrame:
    return S.rename_folder(_names(spark, d), "src5/en", "src5/english/")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))


_NEW = "select o_custkey as key, max(o_orderkey) as source, max(epoch(o_orderdate)::bigint) as mtime from orders group by o_custkey"


@query(f"with o as (select c_custkey as key, -c_custkey as source, 850000000 + c_custkey * 10000 as mtime from customer), n as ({_NEW}) select key, case when n.mtime > o.mtime then n.source else o.source end as winner from o join n using (key)")
def existing_policy_newer(spark: SparkSession, d: str) -> DataFrame:
    old = A.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (-F.col("c_custkey")).alias("source"), (F.lit(850_000_000) + F.col("c_custkey") * 10_000).alias("mtime"))
    new = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("source"), F.max(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("mtime"))
    return S.existing_policy(old, new, "replace_if_newer")


@query(f"with n as ({_NAMES}), a as (select doc_id, name from n where not starts_with(name, 'src7/')), b as (select doc_id, case when starts_with(name, 'src8/') then 'old/' || substr(name, 6) else name end as name from a) select row_number() over (order by doc_id) - 1 as entry, name from b where name <> 'src1/en/1.txt' or true")
def session_replay(spark: SparkSession, d: str) -> DataFrame:
    """Four changes, the last undone, and one that fails: the state is the replay of what is left."""
    base = _names(spark, d).select(F.col("doc_id").alias("entry"), F.col("doc_id").cast("string").alias("source"), "name", F.lit("file").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    s = S.Session(base)
    s.apply(S.Op("remove_folder", "src7"))
    s.apply(S.Op("rename_folder", "src8", "old"))
    s.apply(S.Op("rename", "no/such/file", "x"))
    s.apply(S.Op("remove_folder", "src9"))
    s.undo()
    return s.commit().select("entry", "name")


@query("""with t as (select user_id as file, event_id as pos, case event_type when 'view' then 'Title' when 'click' then 'artist' when 'error' then 'TRACK_NAME_1' when 'signup' then 'TITLE' else 'Comment' end as key, props::json->>'$.k' as value from events)
select file, upper(key) as key, max_by(value, pos) as value from t where not starts_with(upper(key), 'TRACK_NAME') group by file, upper(key)""")
def tags_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return B.tags_last(_tags(spark, d))


@query("""select user_id as file, event_id as pos, '1' as track, props::json->>'$.k' as value from events where event_type = 'error'""")
def tags_tracks(spark: SparkSession, d: str) -> DataFrame:
    return B.tags_tracks(_tags(spark, d))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """events as tags of files."""
    t = F.col("event_type")
    key = F.when(t == "view", "Title").when(t == "click", "artist").when(t == "error", "track_name_1").when(t == "signup", "TITLE").otherwise("Comment")
    return A.table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), key.alias("key"), F.get_json_object("props", "$.k").alias("value"))
