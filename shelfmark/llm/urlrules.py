"""URL filtering by association rules, in DataFrame operations only.

FP-growth mines combinations of URL tokens together with the label; rules that end in the label `block` with
enough support and confidence are kept. A URL is matched by an inverted index: each rule is posted under its
rarest token alone, URLs look their tokens up, and a rule found this way is kept if the URL has all of its
tokens. Listed rules (host, path, verdict) come before mined ones: one fits its host and all subdomains if
the URL's path starts with its path, and the longest wins. They are a list on the driver, looked up in each row.

Every page is a row of its own from first to last, so a URL that many pages share, or a null one, makes no large
group. Tokens that occur in exactly the same labelled pages are one item to FP-growth, and a URL with any of them has
that item: a long URL's fixed parts would else be mined in all their combinations, whose rules are the same.

A null URL or one without `://` has an empty host and path, no token and the verdict allow. Repeated rows stay; null
ids stay; other columns are ignored. No labelled URL, no mined rule.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(url, _URL, 2))


def tokens() -> F.Column:
    """Distinct tokens of host labels, path segments and query names, from columns url, host and path."""
    labels = F.split("host", r"\.")
    label = F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    top = F.array(F.concat(F.lit("t:"), F.element_at(labels, -1)))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    # numbers are one token: they tell pages apart, not kinds of pages
    segment = F.transform(segments, lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"^\d+"), F.regexp_replace(x, r"\d+", "0")).otherwise(F.lower(x))))
    query = F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    found = F.array_distinct(F.concat(label, top, segment, F.coalesce(names, F.array().cast("array<string>"))))
    return F.when(F.col("host") != "", found).otherwise(F.array().cast("array<string>"))


def listed(rules: list[tuple[str, str, str]]) -> F.Column:
    """struct(n, rule, listed) of the longest of the rules (host, path, verdict) that fits columns host and path; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,listed:string>")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    one = lambda host, path, verdict: F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("listed"), F.lit(path).alias("start"))
    table = F.create_map(*[x for host, found in by_host.items() for x in (F.lit(host), F.array(*[one(host, p, v) for p, v in found]))])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(fits, lambda x: F.startswith(F.col("path"), x["start"])))
    return F.when(best.isNotNull(), F.struct(best["n"].alias("n"), best["rule"].alias("rule"), best["listed"].alias("listed")))


def alike(labelled: DataFrame) -> DataFrame:
    """token, item: the smallest of the tokens that occur in the same rows of labelled (row, tokens); sets of rows are told apart by their number and two sums of hashes."""
    each = labelled.select(F.explode("tokens").alias("token"), "row")
    # halves of a hash, whose sums cannot overflow
    half = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "row"), 32))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), half(1).alias("a"), half(2).alias("b"))
    item = marks.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return marks.join(item, ["n", "a", "b"]).select("token", "item", F.col("n").alias("freq"))


def items_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """row, found: the items that the tokens of rows (row, tokens) stand for; only rows that have any."""
    each = rows.select("row", F.explode("tokens").alias("token")).join(items, "token")
    return each.groupBy("row").agg(F.collect_set("item").alias("found"))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9) -> tuple[DataFrame, DataFrame] | None:
    """antecedent (items), confidence, support, item (the rarest) of the rules for block, from labelled (row, tokens, label); and the frequent items (token, item, freq)."""
    if labelled.where(F.size("tokens") > 0).isEmpty():
        return None
    total = labelled.where(F.size("tokens") > 0).count()
    least = math.ceil(support * total)
    items = materialize(alike(labelled).where(F.col("freq") >= least))  # at most tokens in a row / support
    # rows without a frequent token count in the supports
    rows = labelled.where(F.size("tokens") > 0).select("row", "label").join(items_of(labelled, items), "row", "left")
    rows = rows.select(F.array_append(F.coalesce("found", F.array().cast("array<string>")), F.concat(F.lit("="), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = model.associationRules.where("consequent[0] = '=block'").select("antecedent", "confidence", "support")
    posted = rules.select("*", F.explode("antecedent").alias("item")).join(items.where("token = item").select("item", "freq"), "item")
    rarest = posted.groupBy("antecedent").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min(F.struct("freq", "item")).alias("m"))
    return materialize(rarest.select("antecedent", "confidence", "support", "m.item")), items


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], support: float = 0.005, confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (confidence of the best mined rule that matches, else null)."""
    named = parts(pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")))
    best = listed(rules)
    # the number of a row is fixed by being written
    seen = materialize(named.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", tokens().alias("tokens"), best["rule"].alias("rule"), best["listed"].alias("listed")))
    mined = mine(seen.where("listed is not null").select("row", "tokens", F.col("listed").alias("label")), support, confidence)
    if mined is not None:
        index, items = mined
        met = items_of(seen, items).select("row", "found", F.explode("found").alias("item")).join(index, "item").where(F.size(F.array_except("antecedent", "found")) == 0)
        seen = seen.join(met.groupBy("row").agg(F.max("confidence").alias("mined")), "row", "left")
    else:
        seen = seen.withColumn("mined", F.lit(None).cast("double"))
    verdict = F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return seen.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined")
