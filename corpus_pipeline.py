"""From raw documents to shards: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes all documents that the one before kept and returns the columns of documents; the last adds
shard and slot. Different documents may share an id or have none: no stage takes an id for a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, mixing, quality, sharding, simhash
from shelfmark.llm.common import clear, drop, materialize, written

SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this corpus, scores at 0.5 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.keep_good(docs, model)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8): the one with the smallest id."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix_sources),
    ("sharding", cut_shards),
]

#: A fitted classifier and alignments are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = written(spark)
        made = materialize(stage(spark, docs, sf_dir))
        clear(spark, before, (made,))  # what the stage wrote on its way
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
