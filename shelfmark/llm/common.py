"""What several operators share: tables that cut lineage, bounded Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Edges that a task of connected_components writes at least, if there are so many.
EDGES = 100_000
#: Tables by application.
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session takes a temporary one; others have no folder that all machines see, and fail."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of each query in this block as the query ends: the disk holds those of one step, not of all. The session's own setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor costs nothing but a new read. The shuffle files behind it go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelfmark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_shelfmark_path", None)
    if path:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)


def written(spark: SparkSession) -> set[str]:
    """Paths of the tables that materialize() has made and nobody dropped."""
    return set(_written.get(spark.sparkContext.applicationId, ()))


def clear(spark: SparkSession, before: set[str] = frozenset(), keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables made since written() gave before, but those to keep: for callers that have stored the result built on them."""
    kept = before | {getattr(d, "_shelfmark_path", None) for d in keep}
    for path in written(spark) - kept:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written[spark.sparkContext.applicationId].discard(path)


def bounded_batches(spark: SparkSession, mb: int = 32) -> None:
    """Python sees texts in batches of so many MB at most, whatever their length, unless the session sets its own limit.

    Results are lazy and read this when they run, so the setting stays: it holds for later Arrow batches of the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b") or 0) >= 2**31 - 1:
        spark.conf.set(key, str(mb << 20))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node that links reach.

    Large-star and small-star in turn until nothing changes. A star takes the minimum of a node's
    neighbours (combined before the shuffle) and joins it back to the edges, so a node with very many
    neighbours is never gathered in one task. Edges with a null end or equal ends are left out.
    """
    def apart(by_node: DataFrame) -> DataFrame:
        # a key that is not seen to be the one just grouped by: both sides of the join are shuffled for it,
        # which is when Spark can split the partition of a node with very many neighbours
        return by_node.withColumn("u", F.greatest("u", "m"))  # m is never the greater

    def store(df: DataFrame, tasks: int | None = None) -> tuple[DataFrame, tuple[int, int]]:
        """Writes edges, by fewer tasks if they are few, and tells their number and a mark of them as they pass."""
        seen = Observation()
        df = df if tasks is None else df.coalesce(tasks)
        out = materialize(df.observe(seen, F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")))
        return out, (seen.get["n"], seen.get["x"])

    links = edges.where("a is not null and b is not null and a <> b")
    now, mark = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while mark != before and mark[0]:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # no more rows than there are edges: equal ones wait for the distinct below
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, mark = store(small, max(1, mark[0] // EDGES))
        drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def smallest(named: DataFrame, value: str = "doc_id") -> DataFrame:
    """named (root and others) with component_id, the smallest value of its root. A root's rows may be many: both sides of the join are shuffled for it, so that its partition can be split."""
    least = named.groupBy("root").agg(F.min(value).alias("component_id")).withColumn("root", F.col("root").bitwiseOR(F.lit(0).cast("long")))
    return named.join(least, "root")
