"""From a catalogue of entries to an extraction plan: selection, targets, groups, collisions, decisions, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths as P

ERRORS = ("unsafe_path", "collision", "incomplete_group", "parent_clash")


def select_indices(entries: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Entries whose number is in chosen (entry); none or an empty table means all."""
    if chosen is None or chosen.isEmpty():
        return entries
    return entries.join(chosen.select("entry").distinct(), "entry", "left_semi")


def select_names(entries: DataFrame, names: DataFrame) -> DataFrame:
    """For each wanted name, the entry called so or so with a slash; entry is null where there is none."""
    wanted = names.select("name").distinct()
    plain = entries.select("entry", F.regexp_replace("name", r"/$", "").alias("name"))
    return wanted.join(plain, "name", "left").groupBy("name").agg(F.min("entry").alias("entry"))


def resolve_selectors(plan: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector, entry: by #number, else by output name, else by restored name or source; the first match."""
    by_number = plan.select(F.concat(F.lit("#"), F.col("entry").cast("string")).alias("selector"), F.lit(0).alias("rank"), "entry")
    by_name = plan.select(F.col("output_name").alias("selector"), F.lit(1).alias("rank"), "entry")
    by_source = plan.select(F.explode(F.array("restored_name", "source_path")).alias("selector"), F.lit(2).alias("rank"), "entry")
    every = by_number.unionByName(by_name).unionByName(by_source).where("selector is not null")
    best = every.groupBy("selector").agg(F.min(F.struct("rank", "entry")).alias("m"))
    return selectors.select("selector").distinct().join(best, "selector", "left").select("selector", "m.entry")


def skip_readme(entries: DataFrame, selected: bool, readme: str = "README.txt") -> DataFrame:
    """Without an explicit selection the generated readme stays in the archive."""
    return entries if selected else entries.where(~((F.col("name") == readme) & F.col("generated")))


def strip_base(entries: DataFrame, base: str) -> DataFrame:
    """Targets relative to a folder: the folder itself goes, names below it lose its prefix, others stay as they are."""
    prefix = base.rstrip("/") + "/"
    return entries.where(F.col("name") != prefix).withColumn("target", F.when(F.col("name").startswith(prefix), F.substring("name", len(prefix) + 1, 1 << 20)).otherwise(F.col("name")))


def complete_groups(members: DataFrame) -> DataFrame:
    """group_id, complete: every channel from 1 to the count there once, with one count, digest, length and width."""
    n = F.count("*")
    return members.groupBy("group_id").agg(
        (
            (n == F.max("channel_count"))
            & (F.min("channel_count") == F.max("channel_count"))
            # n channels between 1 and n without a repeat, told by sums that combine before the shuffle
            & (F.min("channel_index") == 1)
            & (F.max("channel_index") == n)
            & (F.sum("channel_index") == (n * (n + 1) / 2))
            & (F.sum(F.col("channel_index") * F.col("channel_index")) == (n * (n + 1) * (2 * n + 1) / 6))
            & F.min("sha256").eqNullSafe(F.max("sha256"))
            & F.min("samples").eqNullSafe(F.max("samples"))
            & F.min("bits").eqNullSafe(F.max("bits"))
        ).alias("complete")
    )


def incomplete_members(members: DataFrame) -> DataFrame:
    """Every member of a group that is not complete."""
    bad = complete_groups(members).where("not complete").select("group_id")
    return members.join(bad, "group_id", "left_semi")


def pull_groups(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen entries (entry), and all members of the groups that any of them belongs to."""
    picked = entries.join(chosen.select("entry").distinct(), "entry", "left_semi")
    groups = picked.where("group_id is not null").select("group_id").distinct()
    whole = entries.join(groups, "group_id", "left_semi").select(*entries.columns)
    return picked.where("group_id is null").unionByName(whole)


def group_targets(entries: DataFrame) -> DataFrame:
    """One row per file to write: group members in channel order, others alone."""
    own = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("e"), F.col("entry").cast("string")))
    grouped = entries.groupBy(own.alias("unit")).agg(F.min("entry").alias("entry"), F.min_by("target", "entry").alias("target"), F.min_by("kind", "entry").alias("kind"), F.array_sort(F.collect_list(F.struct("channel_index", F.col("entry").alias("member")))).alias("m"))
    return grouped.select("entry", "target", "kind", F.transform("m", lambda x: x["member"]).alias("members"))


def refuse_collisions(items: DataFrame, ascii_key: bool = False) -> DataFrame:
    """Adds refused and merged: equal targets are all refused unless all are folders, of which the first stays."""
    key = F.lower(F.regexp_replace("target", r"/+$", "")) if ascii_key else P.collision_key(F.col("target"))
    keyed = items.withColumn("_k", key)
    facts = keyed.groupBy("_k").agg(F.count("*").alias("_n"), F.bool_and(F.col("kind") == "directory").alias("_dirs"), F.min("entry").alias("_first"))
    both = keyed.join(facts, "_k")
    clash = (F.col("_n") > 1) & ~F.col("_dirs")
    return both.withColumn("refused", clash).withColumn("merged", (F.col("_n") > 1) & F.col("_dirs") & (F.col("entry") != F.col("_first"))).drop("_k", "_n", "_dirs", "_first")


def refuse_below_files(items: DataFrame, ascii_key: bool = False) -> DataFrame:
    """entry, clash: the shortest proper prefix of an accepted item's target that is an accepted file's target."""
    key = F.lower(F.regexp_replace("target", r"/+$", "")) if ascii_key else P.collision_key(F.col("target"))
    open_ = items.where("not refused and not merged").select("entry", "kind", key.alias("k"))
    files = open_.where("kind <> 'directory'").select(F.col("k").alias("prefix")).distinct()
    above = open_.select("entry", F.explode(P.ancestors(F.col("k"))).alias("prefix"))
    return above.join(files, "prefix").groupBy("entry").agg(F.min(F.struct(F.length("prefix"), "prefix")).alias("m")).select("entry", F.col("m.prefix").alias("clash"))


def mark_existing(items: DataFrame, there: DataFrame) -> DataFrame:
    """Adds exists: whether a file target is in there (target); folders merge with existing ones."""
    known = there.select("target").distinct().withColumn("_e", F.lit(True))
    return items.join(known, "target", "left").withColumn("exists", F.coalesce(F.col("_e") & (F.col("kind") != "directory"), F.lit(False))).drop("_e")


def decide(items: DataFrame, answer: str) -> DataFrame:
    """Undecided existing targets get skip or replace; all others are written."""
    if answer not in ("skip", "replace", "undecided"):
        raise ValueError(f"not a decision: {answer}")
    return items.withColumn("decision", F.when(F.col("exists"), answer).otherwise("write"))


def extraction_plan(entries: DataFrame, there: DataFrame, base: str | None = None, selected: DataFrame | None = None, ascii_key: bool = False) -> dict[str, DataFrame]:
    """items and issues of extracting entries (entry, name, kind, supported, generated, group_id, channel_index, channel_count, sha256, samples, bits)."""
    some = selected is not None and not selected.isEmpty()
    chosen = skip_readme(pull_groups(entries, selected) if some else entries, some)
    named = strip_base(chosen, base) if base else chosen.withColumn("target", F.col("name"))
    unsafe = P.extraction_problem(F.col("target"))
    checked = named.withColumn("problem", unsafe).withColumn("target", P.extraction_path(F.col("target")))
    members = checked.where("group_id is not null")
    short = incomplete_members(members).select("entry").withColumn("_short", F.lit(True))
    judged = checked.join(short, "entry", "left")
    kind = F.when(F.col("problem").isNotNull(), "unsafe_path").when(~F.col("supported"), "unsupported").when(F.coalesce("_short", F.lit(False)), "incomplete_group")
    judged = judged.withColumn("issue", kind)
    units = group_targets(judged.where("issue is null"))
    refused = refuse_collisions(units, ascii_key)
    below = refuse_below_files(refused, ascii_key)
    items = mark_existing(refused.join(below, "entry", "left"), there)
    issue = F.when(F.col("refused"), "collision").when(F.col("clash").isNotNull(), "parent_clash").when(F.col("exists"), "exists")
    found = items.withColumn("issue", issue)
    issues = judged.where("issue is not null").select("entry", F.col("name").alias("target"), F.col("issue").alias("kind")).unionByName(found.where("issue is not null").select("entry", "target", F.col("issue").alias("kind")))
    issues = issues.withColumn("is_error", F.col("kind").isin(*ERRORS))
    good = found.where("issue is null or issue = 'exists'").where("not merged").select("entry", "target", "kind", "members", "exists")
    return {"items": decide(good, "undecided"), "issues": issues}


def outcome_status(outcomes: DataFrame, plan_error: str | None = None) -> DataFrame:
    """status: the first outcome by entry that is not ok, else an error of the plan, else ok."""
    first = F.min(F.when(F.col("status") != "ok", F.struct("entry", "status")))["status"]
    return outcomes.agg(F.coalesce(first, F.lit(plan_error), F.lit("ok")).alias("status"))


def count_errors(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("is_error")).alias("errors"))


def verify(entries: DataFrame) -> DataFrame:
    """entry, status: length and CRC-32 of content against what the catalogue says (entry, size, crc32, content)."""
    length = F.octet_length("content")
    status = F.when(F.col("content").isNull(), "corrupt_archive").when(length < F.col("size"), "too_short").when(length > F.col("size"), "too_long").when(F.crc32("content") != F.col("crc32"), "crc_mismatch").otherwise("ok")
    return entries.select("entry", status.alias("status"))


def source_changed(entries: DataFrame, now: DataFrame) -> DataFrame:
    """entry, changed: size or time differ from those planned, or the source is gone."""
    seen = now.select("source_path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"), F.lit(True).alias("_there"))
    same = F.col("_there") & F.col("size").eqNullSafe(F.col("_s")) & F.col("mtime_ns").eqNullSafe(F.col("_m"))
    return entries.join(seen, "source_path", "left").select("entry", (~F.coalesce(same, F.lit(False))).alias("changed"))


def deepest_first(items: DataFrame) -> DataFrame:
    """Folders in the order in which their attributes can be set: the contents of a folder before it."""
    return items.where("kind = 'directory'").orderBy(F.desc(F.size(F.split("target", "/"))), "entry")


def single_top_folder(items: DataFrame) -> DataFrame:
    """folder: the one first segment that all targets lie below, or null."""
    first, inside = F.split("target", "/")[0], F.contains(F.col("target"), F.lit("/")) | (F.col("kind") == "directory")
    return items.agg(F.min(first).alias("a"), F.max(first).alias("b"), F.bool_and(inside).alias("in")).select(F.when((F.col("a") == F.col("b")) & F.col("in"), F.col("a")).alias("folder"))


def ordered(items: DataFrame) -> DataFrame:
    return items.orderBy("entry")


def probe(entries: DataFrame, most: int = 2000) -> DataFrame:
    """The first so many entries with a .flac name in archive order, chosen as a top-k."""
    return entries.where(F.col("name").rlike(r"(?i)\.flac$")).orderBy("entry").limit(most)


def unique_rank(entries: DataFrame, by: str) -> DataFrame:
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("entry")))
