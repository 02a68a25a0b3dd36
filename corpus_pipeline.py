"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, mixing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor kept; run()
writes each result as Parquet into the shared folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, line_dedup, minhash, mixing, quality_classifier
from graphloom.llm.scratch import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being bad (low quality or toxic) is under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.score(docs, labels).where("_kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; a document that consisted of such lines alone goes."""
    found = line_dedup.dedup_lines(docs)
    changed = F.col("_n_dropped") > 0
    found = found.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates."""
    return minhash.keep_one(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled mix: each document once for each of its copies, numbered from 1."""
    return mixing.mix_sources(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix)]

#: SQL can't fit the classifier; tests hold the pipeline against a plain version stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
