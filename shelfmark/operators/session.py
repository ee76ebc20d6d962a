"""Editing an archive: an operation log replayed over its rows, and what changed against the base."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.operators.exclude import renumber

STATES = ("unchanged", "added", "removed", "replaced", "renamed")


def existing_policy(old: DataFrame, new: DataFrame, policy: str) -> DataFrame:
    """key, winner of rows (key, source, mtime) present on both sides: replace, keep, or the newer if strictly newer."""
    both = old.select("key", F.col("source").alias("old"), F.col("mtime").alias("old_mtime")).join(new.select("key", F.col("source").alias("new"), F.col("mtime").alias("new_mtime")), "key")
    takes = {"replace": F.lit(True), "keep": F.lit(False), "replace_if_newer": F.col("new_mtime") > F.col("old_mtime")}
    if policy not in takes:
        raise ValueError(f"not a policy: {policy}")
    return both.select("key", F.when(takes[policy], F.col("new")).otherwise(F.col("old")).alias("winner"))


def diff(base: DataFrame, plan: DataFrame) -> DataFrame:
    """source, name, state, previous_name of base (source, name) against plan (source, name).

    A base row that is gone while a new source has its name is replaced: it shows once, on the new row.
    """
    b = base.select("source", F.col("name").alias("old_name"), F.lit(True).alias("in_base"))
    p = plan.select("source", F.col("name").alias("new_name"), F.lit(True).alias("in_plan"))
    both = b.join(p, "source", "full")
    gone = both.where("in_plan is null").select(F.col("old_name").alias("gone_name")).distinct()
    fresh = both.where("in_base is null").select(F.col("new_name").alias("fresh_name")).distinct()
    marked = both.join(gone, F.col("in_base").isNull() & (F.col("new_name") == F.col("gone_name")), "left").join(fresh, F.col("in_plan").isNull() & (F.col("old_name") == F.col("fresh_name")), "left")
    state = (
        F.when(F.col("in_base").isNull() & F.col("gone_name").isNotNull(), "replaced")
        .when(F.col("in_base").isNull(), "added")
        .when(F.col("in_plan").isNull(), "removed")
        .when(F.col("old_name") != F.col("new_name"), "renamed")
        .otherwise("unchanged")
    )
    shown = marked.where(~(F.col("in_plan").isNull() & F.col("fresh_name").isNotNull()))
    return shown.select("source", F.coalesce("new_name", "old_name").alias("name"), state.alias("state"), F.when(state == "renamed", F.col("old_name")).alias("previous_name"))


def summary(rows: DataFrame) -> DataFrame:
    """added, added_bytes, removed, replaced, entries of diffed rows with sizes."""
    is_ = lambda s: F.col("state") == s
    return rows.agg(
        F.count_if(is_("added")).alias("added"),
        F.coalesce(F.sum(F.when(is_("added") | is_("replaced"), F.col("size"))), F.lit(0)).alias("added_bytes"),
        F.count_if(is_("removed")).alias("removed"),
        F.count_if(is_("replaced")).alias("replaced"),
        F.count_if(~is_("removed")).alias("entries"),
    )


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _join(parts: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/")).otherwise("")


def folders_of(names: DataFrame) -> DataFrame:
    """folder: every folder that names imply, those with a slash at the end included."""
    own = F.when(F.col("name").endswith("/"), F.concat(P.ancestors(F.col("name")), F.array(F.regexp_replace("name", r"/+$", "")))).otherwise(P.ancestors(F.col("name")))
    return names.select(F.explode(own).alias("folder")).distinct()


def count_moves(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """renames, moves: distinct changes of a last name, and of a place.

    Of a change from one path to another the common end is set aside. If nothing is left over but one
    folder's name, and the old folder is gone and the new one was not there, that folder was renamed.
    """
    c = changes.select(_parts(F.col("from")).alias("p"), _parts(F.col("to")).alias("n")).where((F.size("p") > 0) & (F.size("n") > 0) & (F.col("p") != F.col("n")))
    same = F.zip_with(F.reverse("p"), F.reverse("n"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    k = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    c = c.withColumn("k", k).withColumn("a", F.size("p") - F.col("k")).withColumn("b", F.size("n") - F.col("k"))
    old, new = _join(F.col("p"), F.col("a")), _join(F.col("n"), F.col("b"))
    c = c.withColumn("old", old).withColumn("new", new)
    still = folders_of(after).select(F.col("folder").alias("old"), F.lit(True).alias("still"))
    was = folders_of(before).select(F.col("folder").alias("new"), F.lit(True).alias("was"))
    c = c.join(still, "old", "left").join(was, "new", "left")
    beside = (F.col("a") == F.col("b")) & (F.col("a") >= 1) & (_join(F.col("p"), F.col("a") - 1) == _join(F.col("n"), F.col("b") - 1))
    renamed = beside & F.col("still").isNull() & F.col("was").isNull()
    whole = F.struct(F.array_join("p", "/").alias("x"), F.array_join("n", "/").alias("y"))
    in_place = (F.size("p") == F.size("n")) & (_join(F.col("p"), F.size("p") - 1) == _join(F.col("n"), F.size("n") - 1))
    moved = F.struct(_join(F.col("p"), F.col("a") + 1).alias("x"), _join(F.col("n"), F.col("b") + 1).alias("y"))
    pair = F.struct(F.col("old").alias("x"), F.col("new").alias("y"))
    rename = F.when(F.col("k") == 0, whole).when(renamed, pair)
    move = F.when((F.col("k") == 0) & ~in_place, whole).when((F.col("k") > 0) & ~renamed, moved)
    each = c.select(F.explode(F.array(F.struct(F.lit("r").alias("t"), rename.alias("v")), F.struct(F.lit("m").alias("t"), move.alias("v")))).alias("e")).where("e.v is not null").select("e.t", "e.v").distinct()
    return each.agg(F.count_if(F.col("t") == "r").alias("renames"), F.count_if(F.col("t") == "m").alias("moves"))


def remove_folder(rows: DataFrame, folder: str) -> DataFrame:
    prefix = folder.rstrip("/") + "/"
    return rows.where(~(F.col("name").startswith(prefix) | (F.col("name") == prefix)))


def rename_folder(rows: DataFrame, old: str, new: str) -> DataFrame:
    a, b = old.rstrip("/") + "/", new.rstrip("/") + "/"
    return rows.withColumn("name", F.when(F.col("name").startswith(a), F.concat(F.lit(b), F.substring("name", len(a) + 1, 1 << 20))).otherwise(F.col("name")))


@dataclass(frozen=True)
class Op:
    """One operation: add, new_folder, rename, rename_folder, remove, remove_folder, replace, resolve."""

    kind: str
    name: str = ""
    to: str = ""
    rows: DataFrame | None = None


@dataclass
class Session:
    """An archive being edited: the base stays, and the state is the base with the applied operations replayed.

    Each state is a DataFrame lineage; undo and redo only move a pointer. Operations that fail against the state
    they meet are left out and named in problems.
    """

    base: DataFrame  # entry, source, name, kind, size, mtime
    log: list[list[Op]] = field(default_factory=list)
    applied: int = 0
    problems: list[str] = field(default_factory=list)

    def apply(self, *ops: Op) -> DataFrame:
        del self.log[self.applied :]
        self.log.append(list(ops))
        self.applied += 1
        return self.rows()

    def undo(self) -> DataFrame:
        self.applied = max(0, self.applied - 1)
        return self.rows()

    def redo(self) -> DataFrame:
        self.applied = min(len(self.log), self.applied + 1)
        return self.rows()

    def rows(self) -> DataFrame:
        now, self.problems = self.base, []
        for change in self.log[: self.applied]:
            for op in change:
                try:
                    now = self._step(now, op)
                except ValueError as e:
                    self.problems.append(f"{op.kind} {op.name}: {e}")
        return now

    def view(self) -> DataFrame:
        return diff(self.base, self.rows())

    def _step(self, rows: DataFrame, op: Op) -> DataFrame:
        there = lambda name: not rows.where(F.col("name") == name).isEmpty()
        if op.kind == "add":
            top = rows.agg(F.coalesce(F.max("entry") + 1, F.lit(0))).first()[0]
            more = op.rows.join(rows.where("kind = 'directory'").select("name"), "name", "left_anti") if op.rows is not None else None
            if more is None:
                raise ValueError("nothing to add")
            return rows.unionByName(more.withColumn("entry", F.col("entry") + F.lit(top)).select(*rows.columns))
        if op.kind == "new_folder":
            if there(op.name.rstrip("/") + "/"):
                raise ValueError("it is there already")
            values = {"source": F.lit(f"folder:{op.name}"), "name": F.lit(op.name.rstrip("/") + "/"), "kind": F.lit("directory"), "size": F.lit(0), "mtime": F.lit(0)}
            row = rows.agg(F.coalesce(F.max("entry") + 1, F.lit(0)).alias("entry")).select(*[values.get(f.name, F.col("entry") if f.name == "entry" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
            return rows.unionByName(row)
        if op.kind in ("rename", "remove", "replace") and not there(op.name):
            raise ValueError("no such entry")
        if op.kind == "rename":
            return rows.withColumn("name", F.when(F.col("name") == op.name, op.to).otherwise(F.col("name")))
        if op.kind == "remove":
            return rows.where(F.col("name") != op.name)
        if op.kind == "replace":
            if op.rows is None:
                raise ValueError("nothing to put in its place")
            return self._step(rows.where(F.col("name") != op.name), Op("add", rows=op.rows.withColumn("name", F.lit(op.name))))
        if op.kind == "remove_folder":
            return remove_folder(rows, op.name)
        if op.kind == "rename_folder":
            return rename_folder(rows, op.name, op.to)
        if op.kind == "resolve":
            if op.to == "skip":
                return rows.where(F.col("name") != op.name)
            return rows.withColumn("name", F.when(F.col("name") == op.name, op.to).otherwise(F.col("name")))
        raise ValueError("no such operation")

    def commit(self) -> DataFrame:
        """The final rows, numbered from 0."""
        return renumber(self.rows())
