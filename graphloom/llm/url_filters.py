"""URL filters by association rules, in DataFrame expressions and Spark's own FP-growth.

A url is a set of tokens: host labels, path segments (digits folded), query keys.  FP-growth over
labelled urls mines token combinations that imply a bad label; rules under the support, confidence
or lift limits go.  Rules stand in an inverted index under their rarest token, so a url meets only
the rules whose rarest token it holds.  A fixed rule list (host and path prefix) comes first.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"


@dataclass(frozen=True)
class PrefixRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """A rule blocks what is more likely bad than not, if enough urls hold it (a count, alike at every size) and it says more than the share of bad urls does."""

    least_urls: int = 20
    confidence: float = 0.5
    lift: float = 1.2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[PrefixRule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; none for null or without ``://``."""
    fold = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    part = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), fold(x)))
    host = part("host:", F.split(host_of(url), r"\."))
    path = part("path:", F.split(path_of(url), r"[/.]"))
    query = part("query:", F.regexp_extract_all(F.regexp_extract(_rest(url), r"\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), 1))
    return F.array_distinct(F.concat(host, path, query))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens array<string>, bad boolean) -> (rule_id, antecedent, confidence, support, key): pruned rules.

    An empty or one-sided input gives no rules.  Support counts rows, repeats included.
    """
    spark = labelled.sparkSession
    baskets = labelled.where("tokens is not null and bad is not null and size(tokens) > 0")
    baskets = baskets.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    n = baskets.count()
    if n < mining.least_urls:
        return spark.createDataFrame([], "rule_id string, antecedent array<string>, confidence double, support double, key string")
    model = FPGrowth(itemsCol="items", minSupport=(mining.least_urls - 0.5) / n, minConfidence=mining.confidence).fit(baskets)  # a set counts from least_urls rows on
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= mining.lift))
    rules = rules.select(F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"), "antecedent", "confidence", "support")
    single = model.freqItemsets.where("size(items) = 1").select(F.element_at("items", 1).alias("token"), "freq")
    rare = rules.select("rule_id", F.explode("antecedent").alias("token")).join(single, "token")
    keys = rare.groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    return rules.join(keys, "rule_id")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, tokens) -> (url, confidence): the urls that hold all tokens of a rule, with the best rule's confidence."""
    held = urls.select("url", "tokens", F.explode("tokens").alias("key"))
    index = rules.select("key", "antecedent", "confidence")
    met = held.join(index, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return met.groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, prefix_rules: Sequence[PrefixRule], *, url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id", mining: Mining = Mining()) -> DataFrame:
    """``pages`` with host, path, rule, confidence (of the best mined rule, else null) and verdict (allow or block).

    A page is labelled by the labels row of its id: bad if quality is 0 or toxic is 1 (nulls count as neither).
    Null urls have an empty host and path, no tokens and are allowed.  Repeated rows are judged alike; of fixed rules of one
    length the last in order of names wins, of mined ones the most confident; very long urls are read whole; an
    empty table gives an empty result; columns of ``pages`` with the names of result columns are replaced.
    """
    pages = pages.drop("host", "path", "rule", "confidence", "verdict")
    bad = labels.groupBy(F.col(label_id).alias("id")).agg((F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")) == 1).alias("bad"))
    known = pages.select(F.col(id_col).alias("id"), tokens(F.col(url_col)).alias("tokens")).join(bad, "id")
    rules = mine(known.select("tokens", "bad"), mining)
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    own, first = f"url_{uuid.uuid4().hex}", f"first_{uuid.uuid4().hex}"
    met = match(urls, rules).withColumnRenamed("url", own)
    key = F.coalesce(F.col(url_col), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))  # null urls match nothing and shall not meet in one task
    asked = f"key_{uuid.uuid4().hex}"
    out = pages.withColumn(asked, key).join(met, F.col(asked) == F.col(own), "left").drop(own, asked)
    out = out.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    out = out.withColumn(first, first_rule(F.col("host"), F.col("path"), prefix_rules))
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": F.col(f"{first}.rule"), "verdict": F.coalesce(F.col(f"{first}.verdict"), mined)}).drop(first)
