"""From scanned items to an archive plan: entries, channel members, conflicts, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.operators.exclude import renumber

README = "README.txt"
MAX_STEREO_LIKE = 8
#: Plans' rows: entry, source_path, output_name, kind, codec, size, mtime_ns, group_id, channel_index, channel_count, original_extension, kept_restored_name, fallback_reason.
CONVERTED = ("flac", "flac_mono")


def ineligible(s: Column) -> Column:
    """Why a parsed PCM layout (a struct) cannot become FLAC; null if it can. Limits are the FLAC format's."""
    return (
        F.when(~F.coalesce(s["parsed"], F.lit(False)), "not_parsable")
        .when(s["float"], "float_samples")
        .when(~s["integer"], "unsupported_encoding")
        .when((s["channels"] < 1) | (s["container_bytes"] < 1) | (s["container_bytes"] > 4), "unsupported_encoding")
        .when((s["bits"] < 4) | (s["bits"] > 32), "bit_depth")
        .when((s["rate"] < 1) | (s["rate"] > 1_048_575), "sample_rate")
        .when(s["frames"] >= 1 << 36, "too_many_samples")
        .when(s["largest_block"] > 16_777_211, "chunk_too_large")
    )


def explode_channels(entries: DataFrame, channels: str = "channels", most: int = MAX_STEREO_LIKE) -> DataFrame:
    """More than eight channels become one member row each, named after the stem; others stay one row."""
    many = F.col(channels) > most
    out = entries.withColumn("channel_index", F.explode(F.when(many, F.sequence(F.lit(1), F.col(channels))).otherwise(F.array(F.lit(None).cast("int")))))
    stem = P.stem(F.col("output_name"))
    name = F.when(many, P.member_name(stem, F.col("channel_index"), F.col(channels))).otherwise(F.col("output_name"))
    return out.withColumn("output_name", name).withColumn("channel_count", F.when(many, F.col(channels)))


def with_readme(plan: DataFrame) -> DataFrame:
    """Generated rows go; one readme comes if anything is converted, as new as the newest file."""
    plain = plan.where("codec <> 'generated'")
    facts = plain.agg(
        F.coalesce(F.bool_or(F.col("codec").isin(*CONVERTED) | F.col("kept_restored_name").isNotNull()), F.lit(False)).alias("any"),
        F.coalesce(F.max(F.when(F.col("kind") != "directory", F.col("mtime_ns"))), F.lit(0)).alias("newest"),
        F.coalesce(F.max("entry") + 1, F.lit(0)).alias("next"),
    )
    values = {"entry": F.col("next"), "source_path": F.lit("generated:readme"), "output_name": F.lit(README), "kind": F.lit("file"), "codec": F.lit("generated"), "size": F.lit(0), "mtime_ns": F.col("newest")}
    row = facts.where("any").select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in plain.schema])
    return plain.unionByName(row)


def owners(plan: DataFrame, key: Column | None = None) -> DataFrame:
    """(collision_key, owner, entry, is_file): the names each entry claims, its output name and, if converted, the name it is restored to.

    The members of a channel group are one owner.
    """
    fold = (lambda c: P.collision_key(c)) if key is None else (lambda c: F.lower(c))
    owner = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("e"), F.col("entry").cast("string")))
    mono = F.col("codec") == "flac_mono"
    converted = F.col("codec").isin(*CONVERTED) | F.col("kept_restored_name").isNotNull()
    restored = P.restored_name(F.col("output_name"), mono, F.col("original_extension"), F.col("kept_restored_name"))
    base = plan.select("entry", owner.alias("owner"), (F.col("kind") != "directory").alias("is_file"), F.array(F.col("output_name"), F.when(converted, restored)).alias("names"))
    each = base.select("entry", "owner", "is_file", F.explode(F.array_compact("names")).alias("name"))
    return each.select(fold(F.regexp_replace("name", r"/+$", "")).alias("collision_key"), "owner", "entry", "is_file").distinct()


def collisions(plan: DataFrame, ascii_key: bool = False) -> DataFrame:
    """kind, collision_key, entries: keys that two or more owners claim."""
    claims = owners(plan, F.lit(1) if ascii_key else None)
    # owners are counted by their extremes: two different ones are enough, and both ends combine before the shuffle
    found = claims.groupBy("collision_key").agg(F.array_sort(F.collect_set("entry")).alias("entries"), F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b")
    return found.select(F.lit("collision").alias("kind"), "collision_key", "entries")


def parent_clashes(plan: DataFrame, ascii_key: bool = False) -> DataFrame:
    """kind, collision_key, entries: entries below a path that is also a file."""
    claims = owners(plan, F.lit(1) if ascii_key else None)
    files = claims.where("is_file").select("collision_key", F.col("entry").alias("file"))
    above = claims.select("entry", F.explode(P.ancestors(F.col("collision_key"))).alias("collision_key"))
    hit = above.join(files, "collision_key").where("entry <> file")
    return hit.groupBy("collision_key").agg(F.array_sort(F.array_union(F.collect_set("entry"), F.collect_set("file"))).alias("entries")).select(F.lit("parent_clash").alias("kind"), "collision_key", "entries")


def invalid_names(plan: DataFrame) -> DataFrame:
    problem = P.archive_name_problem(F.regexp_replace("output_name", r"/+$", ""))
    return plan.select(F.lit("invalid_name").alias("kind"), F.col("output_name").alias("collision_key"), F.array("entry").alias("entries"), problem.alias("detail")).where("detail is not null").drop("detail")


def conflicts(plan: DataFrame, ascii_key: bool = False) -> DataFrame:
    """All three kinds, with first_entry to sort by."""
    sound = plan.join(invalid_names(plan).select(F.explode("entries").alias("entry")), "entry", "left_anti")
    every = invalid_names(plan).unionByName(collisions(sound, ascii_key)).unionByName(parent_clashes(sound, ascii_key))
    return every.withColumn("first_entry", F.element_at("entries", 1))


def resolve(plan: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Applies (entry, action, new_name) at once: skip, rename, disable_flac; an answer for one member holds for its group.

    The last answer given for an entry or group counts (by order of action and name, if a table repeats one).
    """
    answers = resolutions.groupBy("entry").agg(F.max(F.struct("action", "new_name")).alias("r")).select("entry", "r.action", "r.new_name")
    own = plan.join(answers, "entry", "left")
    groups = own.where("group_id is not null and action is not null").groupBy("group_id").agg(F.max(F.struct("action", "new_name")).alias("g"))
    both = own.join(groups, "group_id", "left")
    action, name = F.coalesce("g.action", "action"), F.coalesce("g.new_name", "new_name")
    kept = both.withColumn("action", action).withColumn("new_name", name).where("action is null or action <> 'skip'")
    # a group that loses FLAC becomes one ordinary entry: its first channel stands for the whole file
    kept = kept.where("not (action <=> 'disable_flac') or coalesce(channel_index, 1) = 1")
    plain = F.col("action") == "disable_flac"
    mono = F.col("codec") == "flac_mono"
    renamed = F.when(mono, P.member_name(F.col("new_name"), F.col("channel_index"), F.col("channel_count"))).otherwise(F.col("new_name"))
    original = P.restored_name(F.col("output_name"), mono, F.col("original_extension"), F.col("kept_restored_name"))
    out = kept.withColumn("output_name", F.when(F.col("action") == "rename", renamed).when(plain & F.col("codec").isin(*CONVERTED), original).otherwise(F.col("output_name")))
    for column in ("group_id", "channel_index", "channel_count"):
        out = out.withColumn(column, F.when(F.coalesce(plain, F.lit(False)), F.lit(None)).otherwise(F.col(column)))
    out = out.withColumn("codec", F.when(F.coalesce(plain, F.lit(False)) & F.col("codec").isin(*CONVERTED), "general").otherwise(F.col("codec")))
    return renumber(out.select(*plan.columns))


def total_input_bytes(plan: DataFrame) -> DataFrame:
    return plan.agg(F.coalesce(F.sum(F.when((F.col("codec") != "flac_mono") | (F.coalesce("channel_index", F.lit(1)) == 1), F.col("size"))), F.lit(0)).alias("total_bytes"))


def newest_mtime(plan: DataFrame) -> DataFrame:
    return plan.agg(F.coalesce(F.max(F.when((F.col("kind") != "directory") & (F.col("codec") != "generated"), F.col("mtime"))), F.lit(0)).alias("newest"))


def any_converted(plan: DataFrame) -> DataFrame:
    return plan.agg(F.coalesce(F.bool_or(F.col("codec").isin(*CONVERTED)), F.lit(False)).alias("any_converted"))


def merge_added(plan: DataFrame, added: DataFrame, ascii_key: bool = False) -> DataFrame:
    """Existing entries and added ones after them; an added folder that is already there is left out."""
    key = lambda d: d.withColumn("_k", F.lower(F.regexp_replace("output_name", r"/+$", "")) if ascii_key else P.collision_key(F.col("output_name")))
    there, new = key(plan), key(added)
    folders = new.where("kind = 'directory'").join(there.where("kind = 'directory'").select("_k"), "_k", "left_anti").dropDuplicates(["_k"])
    more = folders.unionByName(new.where("kind <> 'directory'"))
    top = plan.agg(F.coalesce(F.max("entry") + 1, F.lit(0))).first()[0]
    return renumber(there.unionByName(more.withColumn("entry", F.col("entry") + F.lit(top))).drop("_k"))
