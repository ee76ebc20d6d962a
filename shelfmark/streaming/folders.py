"""Roll-ups of a growing set of entries: the batch operators over a stream of catalogue files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions import paths as P


def read_entries(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def folder_totals(entries: DataFrame) -> DataFrame:
    """folder, files, size so far; update or complete mode."""
    each = entries.where("kind = 'file'").select("size", F.explode(P.ancestors(F.col("name"))).alias("folder"))
    return each.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def arrivals(entries: DataFrame, time: str = "arrived", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, kind, entries, size by arrival; windows close when the watermark passes them."""
    return entries.withWatermark(time, late).groupBy(F.window(time, width), "kind").agg(F.count("*").alias("entries"), F.sum("size").alias("size"))
