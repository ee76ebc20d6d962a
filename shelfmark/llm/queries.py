"""The queries of these operators; SQL only where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Listed URL rules of op7: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.pq import pq_links

    return pq_links(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), words=4, bits=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = quality.score(docs.withColumn("held_out", F.coalesce(remainder(3) == 1, F.lit(False))), model, ["doc_id", "held_out", "text"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm import sharding

    placed = sharding.shards(sharding.digest(table(spark, sf_dir, "documents")), 16, order=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.mainhtml import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, remainder(4) != 2))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.urlrules import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.substring import without_copies

    found = without_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm import mixing
    from shelfmark.llm.common import materialize

    planned = mixing.plan(materialize(mixing.sized(table(spark, sf_dir, "documents"))))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Links of equal vectors are those of a pair, so rows are joined as rows; components by a recursive union.
OP1_SQL = """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v where list_inner_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a), n as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept from v join c on v.vec_id = c.a left join n on v.vec_id = n.a"""

OP9_SQL = r"""with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13)),
m as (select s, min(doc_id) as first from g group by s),
c as (select distinct g.doc_id, g.k + j.j as p from g join m using (s), range(0, 13) j(j) where m.first < g.doc_id),
e as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select doc_id, string_agg(word, ' ' order by p) as kept from e anti join c using (doc_id, p) group by doc_id),
r as (select doc_id, count(*) as n from c group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(r.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join r using (doc_id) left join k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pq": OP1_SQL, "op9_substring": OP9_SQL}
