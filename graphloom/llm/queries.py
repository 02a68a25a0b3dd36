"""The registered queries of this subpackage: thin digests of each operator's output over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ball_kmeans, compact_windows, conversation_repair, decontam, line_dedup, minhash, mixing, quality_classifier, quality_rules, suffix_dedup, suffix_tree_lm, top_k, url_filters
from .sql import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_links").alias("n_links"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The fixed host and path rules of the query.
PREFIX_RULES = [url_filters.PrefixRule(*x) for x in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filters.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), _read(spark, sf_dir, "labels"), PREFIX_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_classifier.score(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), _read(spark, sf_dir, "labels"), keep_text=False)
    return rows.select("doc_id", F.round("_evidence", 6).alias("evidence"), F.round("_prior", 6).alias("prior"), F.round("_posterior", 6).alias("posterior"), F.col("_kept").alias("kept"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.expected(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hits.item_ids", lambda i: i.cast("string"))), ",")
    return rows.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_texts(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = ball_kmeans.cluster(_read(spark, sf_dir, "embeddings"))
    sums = centroids.select("cluster", "cluster_inertia", F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"), "centroid_sha256")  # 40 rows
    return members.join(F.broadcast(sums), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(rows))
    every = rows.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return top_k.search(rows.where(F.col("vec_id") % 50 == 0), rows)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filters, op3_quality_rules, op4_compact_windows, op5_minhash, op6_quality_classifier, op7_mixing, op8_suffix_dedup, op9_decontamination, op10_lm_scoring, op11_ball_kmeans, op12_conversation_repair, op13_top_k)}
