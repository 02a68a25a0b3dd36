"""Envelopes of extracted facts: validated JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "parser_id string, schema_version string, project_id string, analysis_run_id string, generated_at string, files_analyzed array<string>, model string"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One envelope a file; ``model`` stays JSON text."""
    return parse_envelopes(spark.read.option("wholetext", True).text(path), "value")


def parse_envelopes(rows: DataFrame, column: str, run_id: str | None = None) -> DataFrame:
    """Rows whose JSON is an envelope (ids and version given), of one run if that is named; others go."""
    found = rows.withColumn("_e", F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"})).drop(column)
    good = F.col("_e.parser_id").isNotNull() & F.col("_e.analysis_run_id").isNotNull() & F.col("_e.schema_version").isNotNull()
    if run_id is not None:
        good = good & (F.col("_e.analysis_run_id") == run_id)
    return found.where(good).select("*", "_e.*").drop("_e")


def invalid_envelopes(rows: DataFrame, column: str) -> DataFrame:
    """The rows that :func:`parse_envelopes` lets go."""
    e = F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"})
    return rows.where(e["parser_id"].isNull() | e["analysis_run_id"].isNull() | e["schema_version"].isNull())


def latest_envelopes(rows: DataFrame) -> DataFrame:
    """One envelope for each run and parser, the last generated."""
    from ..operators.dedupe import first_by

    return first_by(rows, ["analysis_run_id", "parser_id"], [F.col("generated_at").desc_nulls_last(), F.col("model").asc()])
