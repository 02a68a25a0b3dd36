"""Sinks: snapshots by project, and newline-delimited JSON slices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_dir


def export_slice(parts: dict[str, DataFrame], spark: SparkSession, path: str | None = None) -> str:
    """Each frame as JSON lines in a folder of its own, and a manifest of them; returns the folder."""
    path = path or f"{shared_dir(spark)}/slice-{uuid.uuid4().hex}"
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark.createDataFrame([(n,) for n in parts], "part string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def read_slice(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The parts again, one after the other, with their name as ``part``."""
    out = None
    for name in names:
        part = spark.read.json(f"{path}/{name}").withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def save_run(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the runs in ``df`` alone; other projects and runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "run_id").parquet(path)
