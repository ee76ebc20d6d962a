"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source of size S and target T asks each of its documents for T / S copies. The whole part is given to all;
what is left over, one probability per source, is rounded by the pivotal method: two documents meet, and
probability mass, measured in words, moves from one to the other at random, up or down with chances that
keep every expectation, until one of them has a whole number of copies and leaves. The words a source
takes stay what they were in every step, so that it ends within one document of its target.

Steps run inside blocks of about BLOCK documents of a source. The one document that a block cannot settle goes
up to the next level, where up to FAN blocks meet, and so on: a reduction tree without a task that sees a whole
source. The last document of a source is rounded by its own probability. All randomness is a hash of seed and
ids, so reruns agree.

Null text and texts without words have size 0, take nothing and are given the whole part of their copies and a
hashed rounding of the rest. Null source is a source, last in order. Null and repeated ids stay: equal rows are
rounded together, each within one copy of the others, and however many they are, listed in runs of at most COPIES. In
mix() a document is told from others by two 64-bit hashes of its columns and of which are null; columns of any name pass through. Empty tables stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialize

BLOCK, FAN = 192, 64
#: Equal rows that one task lists at most.
COPIES = 65_536
CAP = 3.0


def words(text: str = "text") -> F.Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """source, source_size, target, from (source, source_size): one row for each source.

    Sources in order of code points, null last, get the weights in turn. A target stops at cap times its
    source's size; the excess is shared by weight again until none is above. With sources in the order in
    which they reach the cap, that is one scan: the first k are at the cap for the smallest k with which
    the rest's share lies below the next one's limit.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    a = sizes.withColumn("w", w).withColumn("place", F.row_number().over(every)).withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    a = a.withColumn("full", F.coalesce(F.sum("limit").over(order), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    a = a.withColumn("level", (F.sum("source_size").over(whole) - F.col("full")) / (F.sum("w").over(whole) - F.col("used")))
    a = a.withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole)["level"])
    return a.select("source", "source_size", F.least("limit", F.coalesce(F.col("share") * F.col("w"), F.col("limit"))).alias("target"))


_DOC = "struct<u:bigint,doc_id:bigint,size:bigint,row:bigint,m:bigint,whole:bigint,p:double>"
_PAIR = """
aggregate(docs,
  named_struct('open', cast(null as {doc}), 'done', cast(array() as array<struct<d:{doc},up:boolean>>)),
  (acc, x) -> case
    when x.p <= 1e-12 or x.p >= 1 - 1e-12 then named_struct('open', acc.open, 'done', concat(acc.done, array(named_struct('d', x, 'up', x.p > 0.5))))
    when acc.open is null then named_struct('open', x, 'done', acc.done)
    else transform(array(named_struct(
        'a', acc.open, 'b', x,
        -- words that can move from a to b, and from b to a
        'ab', least(acc.open.p * acc.open.size, (1 - x.p) * x.size),
        'ba', least(x.p * x.size, (1 - acc.open.p) * acc.open.size),
        'z', (pmod(xxhash64({seed}, acc.open.u, x.u, acc.open.doc_id, x.doc_id, acc.open.row, x.row), 1000000007) + 0.5) / 1000000007)),
      t -> transform(array(named_struct('t', t, 'm', if(t.z * (t.ab + t.ba) < t.ba, t.ab, -t.ba))),
        s -> transform(array(named_struct(
            'a', named_struct('u', s.t.a.u, 'doc_id', s.t.a.doc_id, 'size', s.t.a.size, 'row', s.t.a.row, 'm', s.t.a.m, 'whole', s.t.a.whole, 'p', s.t.a.p - s.m / s.t.a.size),
            'b', named_struct('u', s.t.b.u, 'doc_id', s.t.b.doc_id, 'size', s.t.b.size, 'row', s.t.b.row, 'm', s.t.b.m, 'whole', s.t.b.whole, 'p', s.t.b.p + s.m / s.t.b.size))),
          r -> case
            when (r.a.p <= 1e-12 or r.a.p >= 1 - 1e-12) and (r.b.p <= 1e-12 or r.b.p >= 1 - 1e-12)
              then named_struct('open', cast(null as {doc}), 'done', concat(acc.done, array(named_struct('d', r.a, 'up', r.a.p > 0.5), named_struct('d', r.b, 'up', r.b.p > 0.5))))
            when r.a.p <= 1e-12 or r.a.p >= 1 - 1e-12
              then named_struct('open', r.b, 'done', concat(acc.done, array(named_struct('d', r.a, 'up', r.a.p > 0.5))))
            else named_struct('open', r.a, 'done', concat(acc.done, array(named_struct('d', r.b, 'up', r.b.p > 0.5))))
          end)[0])[0])[0]
  end)"""


def plan(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP, seed: int = 13) -> DataFrame:
    """doc_id, source, row, size, source_size, target, copies, taken for every row of docs (doc_id, source, size, row: a long that tells rows apart).

    Rows equal in all four are rounded together and share the outcome, each within one copy of the others.
    """
    return _plan(docs, weights, cap, seed)[0]


def listed(rows: DataFrame, number: str, most: int, name: str = "k") -> DataFrame:
    """Each row as often as its number says (at most `most`), numbered from 1. Rows with more than COPIES go out in runs of so many."""
    if most <= COPIES:
        return rows.where(f"{number} > 0").withColumn(name, F.explode(F.expr(f"sequence(1L, {number})")))
    few = rows.where((F.col(number) > 0) & (F.col(number) <= COPIES)).withColumn(name, F.explode(F.expr(f"sequence(1L, {number})")))
    runs = rows.where(F.col(number) > COPIES).withColumn("run", F.explode(F.expr(f"sequence(0L, ({number} - 1) div {COPIES})"))).repartition("run")
    return few.unionByName(runs.withColumn(name, F.explode(F.expr(f"sequence(run * {COPIES} + 1, least({number}, (run + 1) * {COPIES}))"))).drop("run"))


def _plan(docs: DataFrame, weights: tuple[float, ...], cap: float, seed: int) -> tuple[DataFrame, int]:
    """The plan, and how many equal rows there are at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"), F.col("row").cast("long").alias("row"))
    a = rows.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("m"))
    sums = a.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"), F.max("m").alias("most"))
    # a key without nulls; one row for each source, so a join with it adds no rows
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("g")
    sums = materialize(sums.select(key, "source", "source_size", "n", "most"))
    most = sums.agg(F.max("most")).first()[0] or 0
    goals = sums.select("g", "n").join(targets(sums.select("source", "source_size"), weights, cap).select(key, "source_size", "target"), "g")
    a = a.select(key, "*").join(goals, "g")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m")
    a = a.withColumn("want", want).withColumn("whole", F.floor("want").cast("long")).withColumn("p", F.col("want") - F.col("whole"))
    a = a.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "row", "size"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    doc = F.struct("u", "doc_id", "size", "row", "m", "whole", "p").cast(_DOC)
    info = ("source", "source_size", "target", "blocks")
    pair = F.expr(_PAIR.format(doc=_DOC, seed=seed))
    now = a.where(open_).withColumn("blocks", blocks).select("g", *info, F.pmod(F.xxhash64(F.lit(seed + 1), "u"), blocks).alias("block"), doc.alias("d"))
    chance = lambda u, more: (F.pmod(F.xxhash64(F.lit(seed + more), u), F.lit(1_000_003)) + 0.5) / 1_000_003
    last = ("doc_id", "source", "row", "size", "m", "source_size", "target", "whole", "up")
    out = [a.where(~open_).withColumn("up", (F.col("p") > 0) & (chance(F.col("u"), 2) < F.col("p"))).select(*last)]
    flat = [F.col(f"d.{c}").alias(c) if c in ("doc_id", "row", "size", "m", "whole") else F.col(c) for c in last]
    while True:
        # dealt by both columns even if a join above has dealt by g alone: a source is never in one task
        met = now.repartition("g", "block").groupBy("g", "block").agg(F.array_sort(F.collect_list("d")).alias("docs"), *[F.first(c).alias(c) for c in info])
        done = materialize(met.withColumn("made", pair).drop("docs"))
        out.append(done.select("source", "source_size", "target", F.explode("made.done").alias("x")).select("source", "source_size", "target", F.col("x.d").alias("d"), F.col("x.up").alias("up")).select(*flat))
        rest = done.where("made.open is not null").select("g", *info, "block", F.col("made.open").alias("d"))
        left = rest.agg(F.max("blocks")).first()[0]
        if left is None or left <= 1:
            break
        now = rest.withColumn("block", F.expr(f"block div {FAN}")).withColumn("blocks", F.ceil(F.col("blocks") / FAN).cast("long"))
    out.append(rest.withColumn("up", chance(F.col("d.u"), 2) < F.col("d.p")).select(*flat))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    every = every.withColumn("all", F.col("whole") + F.col("up").cast("long"))
    every = listed(every, "m", most)
    every = every.withColumn("copies", F.expr("cast(all div m + if(k <= pmod(all, m), 1, 0) as long)"))
    return every.select("doc_id", "source", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), most


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, row (hash of the text) for plan()."""
    return docs.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("row"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = CAP, seed: int = 13) -> DataFrame:
    """The mixture: every document as many times as its copies, all columns as they are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # nulls alone would not change a hash; a second one, of what the plan knows of a row, makes 128 bits of it
    row = F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns])
    more = F.xxhash64(F.lit(seed + 3), "id", "of", "n", F.col("id").isNull(), F.col("of").isNull())
    keyed = docs.select(F.struct(*columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), words().alias("n"), row.alias("row")).withColumn("more", more)
    planned, most = _plan(materialize(keyed.select(F.col("id").alias("doc_id"), F.col("of").alias("source"), F.col("n").alias("size"), "row")), weights, cap, seed)
    copies = planned.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("n"), "row", "copies").withColumn("more", more).groupBy("row", "more").agg(F.sum("copies").alias("copies")).where("copies > 0")
    # equal rows are one here: their copies are summed above
    one = keyed.groupBy("row", "more").agg(F.first("doc").alias("doc"))
    return listed(one.join(copies, ["row", "more"]), "copies", most * (math.ceil(cap) + 1)).select("doc.*")
