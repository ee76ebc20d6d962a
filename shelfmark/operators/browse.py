"""What an archive browser shows: totals, rows by group and folder, filters, sorting, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import display as D
from shelfmark.functions import paths as P

PREVIEW_ROWS, PREVIEW_PROBES = 500, 2000


def cli_totals(entries: DataFrame) -> DataFrame:
    """All entries, folders too."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("packed"), F.lit(0)).alias("packed"))


def preview_totals(entries: DataFrame) -> DataFrame:
    """Files only."""
    file = F.col("kind") != "directory"
    return entries.agg(F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(file, F.col("packed"))), F.lit(0)).alias("packed"))


def gui_totals(entries: DataFrame) -> DataFrame:
    """Original sizes where known, a group's once (on its first channel); the ratio is known if every file's original size is."""
    file = F.col("kind") != "directory"
    other = F.coalesce(F.col("channel_index"), F.lit(1)) > 1
    size = F.when(other, F.lit(0)).otherwise(F.coalesce("original_size", "size"))
    known = F.col("original_size").isNotNull() | ~F.col("restorable")
    return entries.where(file).agg(
        F.count_if(~other).alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).alias("size"),
        F.coalesce(F.sum("packed"), F.lit(0)).alias("packed"),
        F.coalesce(F.bool_and(known | other), F.lit(True)).alias("ratio_known"),
    )


def method_histogram(entries: DataFrame) -> DataFrame:
    return entries.where("kind <> 'directory'").groupBy("method").agg(F.count("*").alias("files"))


def restorable_audio(entries: DataFrame, most: int = PREVIEW_PROBES) -> DataFrame:
    """Distinct groups and single files among the first so many probed, and whether there were more."""
    flac = entries.where(F.col("name").rlike(r"(?i)\.flac$"))
    probed = flac.orderBy("entry").limit(most).where("restorable")
    unit = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("e"), F.col("entry").cast("string")))
    # the top-k above is bounded, so the distinct count is over a bounded table
    return probed.agg(F.countDistinct(unit).alias("restorable")).withColumn("partial", F.lit(flac.count() > most))


def group_rows(entries: DataFrame) -> DataFrame:
    """One row per channel group, in the place of its first member: packed summed, original size if known else the sum, newest time, members in channel order."""
    members = F.array_sort(F.collect_list(F.struct("channel_index", "entry", "name")))
    return entries.where("group_id is not null").groupBy("group_id").agg(
        F.min("entry").alias("entry"),
        F.coalesce(F.max("original_size"), F.sum("size")).alias("size"),
        F.sum("packed").alias("packed"),
        F.max("mtime").alias("mtime"),
        F.count("*").alias("channels"),
        F.transform(members, lambda m: m["entry"]).alias("children"),
    )


def folder_rollup(entries: DataFrame) -> DataFrame:
    """folder, files, size, packed, ratio_known, packed_known of everything below each folder, deleted rows left out.

    Each entry adds to every folder above it; sums combine before the shuffle, so a folder that holds all
    entries costs one row per task.
    """
    file = F.col("kind") != "directory"
    own = F.when(file, P.ancestors(F.col("name"))).otherwise(F.concat(P.ancestors(F.col("name")), F.array(F.regexp_replace("name", r"/+$", ""))))
    live = entries.where("not deleted").select(file.alias("file"), "size", "packed", "ratio_known", "packed_known", F.explode(own).alias("folder"))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("file"), F.col(c))), F.lit(0)).alias(c)
    return live.groupBy("folder").agg(
        F.count_if("file").alias("files"), count("size"), count("packed"),
        F.coalesce(F.bool_and(F.when(F.col("file"), F.col("ratio_known"))), F.lit(True)).alias("ratio_known"),
        F.coalesce(F.bool_and(F.when(F.col("file"), F.col("packed_known"))), F.lit(True)).alias("packed_known"),
    )


def folder_states(entries: DataFrame) -> DataFrame:
    """folder, state: the state that everything below a folder shares, else null."""
    each = entries.select("state", F.explode(P.ancestors(F.col("name"))).alias("folder"))
    return each.groupBy("folder").agg(F.when((F.min("state") == F.max("state")) & (F.count("state") == F.count("*")), F.min("state")).alias("state"))


def filter_tree(entries: DataFrame, leaf: Column) -> DataFrame:
    """Rows a browser keeps: those that match, and every folder above one that does."""
    hits = entries.where(leaf)
    above = hits.select(F.explode(P.ancestors(F.col("name"))).alias("name")).distinct()
    return hits.select(F.col("name"), F.lit(True).alias("matches")).unionByName(above.select("name", F.lit(False).alias("matches")))


def member_filter(members: DataFrame, groups: DataFrame, leaf: Column, key: str = "group_id") -> DataFrame:
    """Channels a browser keeps: those that match, and those whose group's own row (groups: key and the columns of leaf) does."""
    matching = groups.where(leaf).select(key, F.lit(True).alias("_group")).distinct()
    return members.join(matching, key, "left").where(F.coalesce(leaf, F.lit(False)) | F.coalesce("_group", F.lit(False))).drop("_group")


def text_filter(text: str) -> Column:
    low = F.lit(text.lower())
    return F.contains(F.lower("name"), low) | F.coalesce(F.contains(F.lower("restores_to"), low), F.lit(False))


def ratio_key() -> Column:
    """What the ratio column sorts by: unknown before everything."""
    return F.when(F.col("ratio_known"), D.percent_saved(F.col("size"), F.col("packed"))).otherwise(F.lit(-(1 << 31)).cast("int"))


def sort_rows(entries: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Numbers by value, anything else by its lower-case text; ties in archive order."""
    key = {"ratio": ratio_key()}.get(column, F.col(column) if column in ("size", "packed", "mtime") else F.lower(F.col(column)))
    return entries.orderBy(key.desc() if descending else key.asc(), "entry")


def preview(entries: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in archive order, each with whether the list was cut."""
    cut = entries.count() > rows
    return entries.orderBy("entry").limit(rows).withColumn("truncated", F.lit(cut))


def readme_rows(entries: DataFrame) -> DataFrame:
    """Lines of the generated readme: one per file or group, names padded to the widest."""
    group = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("e"), F.col("entry").cast("string")))
    found = entries.groupBy(group.alias("unit")).agg(F.min("entry").alias("entry"), F.min_by("name", "channel_index").alias("a"), F.max_by("name", "channel_index").alias("b"), F.max("group_id").alias("g"), F.min("name").alias("only"), F.count("*").alias("n"), F.max("restores_to").alias("restores_to"))
    label = F.when(F.col("g").isNull(), F.col("only")).otherwise(F.concat("a", F.lit(" ... "), "b", F.lit(" ("), F.col("n").cast("string"), F.lit(" channels)")))
    lines = found.select("entry", label.alias("label"), "restores_to")
    width = lines.agg(F.coalesce(F.max(F.char_length("label")), F.lit(0))).first()[0]
    return lines.select("entry", F.concat(F.rpad("label", max(width, 1), " "), F.lit("  "), F.coalesce("restores_to", F.lit(""))).alias("line"))


def verification(rows: DataFrame, results: DataFrame) -> DataFrame:
    """entry, verified: distinct statuses of a row's members in order of their names, joined by a comma."""
    each = rows.select("entry", F.explode("members").alias("member")).join(results.select(F.col("entry").alias("member"), "status"), "member")
    return each.groupBy("entry").agg(F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("verified"))


def common_folder(entries: DataFrame) -> DataFrame:
    """folder: the deepest folder that all rows' parents share. The common prefix of all is that of the least and the greatest."""
    parents = F.split(P.parent(F.regexp_replace("name", r"/+$", "")), "/")
    ends = entries.agg(F.min(parents).alias("a"), F.max(parents).alias("b"))
    same = F.transform(F.arrays_zip("a", "b"), lambda x: x["a"].eqNullSafe(x["b"]))
    upto = F.array_position(same, False)
    n = F.when(upto > 0, upto - 1).otherwise(F.size(same)).cast("int")
    return ends.select(F.when(n > 0, F.array_join(F.slice("a", 1, F.greatest(n, F.lit(1))), "/")).otherwise("").alias("folder"))


def drop_rule(names: DataFrame, intent: str = "auto") -> DataFrame:
    """action for dropped files: extract if all are zip archives, else compress; a user who says compress or extract gets that, if any archive is there to extract. Nothing dropped: none."""
    zipped = F.lower("name").endswith(".zip")
    rules = {
        "auto": F.when(F.bool_and(zipped), "extract").otherwise("compress"),
        "compress": F.lit("compress"),
        "extract": F.when(F.bool_or(zipped), "extract").otherwise("none"),
    }
    if intent not in rules:
        raise ValueError(f"not an intent: {intent}")
    return names.agg(F.when(F.count("*") == 0, "none").otherwise(rules[intent]).alias("action"))


def drop_items(names: DataFrame, action: str) -> DataFrame:
    """The dropped names an action takes: all to compress, the zip archives to extract, none for none."""
    return names.where({"compress": F.lit(True), "extract": F.lower("name").endswith(".zip"), "none": F.lit(False)}[action])


def listing_line(size: Column, packed: Column, method: Column, modified: Column, name: Column, restores_to: Column) -> Column:
    """A line of a listing, in fixed columns."""
    return F.format_string("%12d %12d %-10s %-16s %s%s", size, packed, method, modified, name, F.coalesce(F.concat(F.lit("  -> "), restores_to), F.lit("")))


def listing_totals(entries: DataFrame) -> DataFrame:
    """line: what stands below a listing."""
    return cli_totals(entries).select(F.concat(F.col("entries").cast("string"), F.lit(" entries, "), D.human_size(F.col("size")), F.lit(" -> "), D.human_size(F.col("packed"))).alias("line"))


def unique_path(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """path, free: the path, or with " 2", " 3" … before its extension: the first that is not taken.

    The first gap in the numbers that are taken: a number n is before a gap if it is the n-th of them.
    """
    stem, ext = P.stem(F.col("path")), P.extension(F.col("path"))
    base = wanted.select("path", stem.alias("s"), ext.alias("e")).distinct()
    t_stem, t_ext = P.stem(F.col("taken")), P.extension(F.col("taken"))
    known = taken.select("taken").distinct().select("taken", t_stem.alias("ts"), t_ext.alias("e"))
    number = F.regexp_extract("ts", r" ([1-9][0-9]*)$", 1)
    numbered = known.where(number != "").select(F.regexp_replace("ts", r" [1-9][0-9]*$", "").alias("s"), "e", F.expr("try_cast(regexp_extract(ts, ' ([1-9][0-9]*)$', 1) as bigint)").alias("n")).where("n >= 2")
    plain = known.select(F.col("ts").alias("s"), "e", F.lit(1).cast("long").alias("n"))
    used = numbered.unionByName(plain).join(base.select("s", "e").distinct(), ["s", "e"], "left_semi").distinct()
    row = F.row_number().over(Window.partitionBy("s", "e").orderBy("n"))
    filled = used.withColumn("r", row).where("n = r").groupBy("s", "e").agg(F.max("n").alias("last"))
    out = base.join(filled, ["s", "e"], "left")
    next_ = F.coalesce("last", F.lit(0)) + 1
    return out.select("path", F.when(next_ == 1, F.col("path")).otherwise(F.concat("s", F.lit(" "), next_.cast("string"), "e")).alias("free"))


def tags_last(tags: DataFrame) -> DataFrame:
    """file, key, value of the tags (file, pos, key, value): keys in upper case, the last of a key wins; track names are left out."""
    key = F.upper("key")
    return tags.where(~key.startswith("TRACK_NAME")).groupBy("file", key.alias("key")).agg(F.max_by("value", "pos").alias("value"))


def tags_tracks(tags: DataFrame) -> DataFrame:
    """file, pos, track, value: the track names among the tags, all of them; track is what follows the key's word, empty where nothing does."""
    key = F.upper("key")
    return tags.where(key.startswith("TRACK_NAME")).select("file", "pos", F.substring(key, len("TRACK_NAME_") + 1, 1 << 20).alias("track"), "value")
