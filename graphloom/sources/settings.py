"""Settings files: JSON, .env, .properties and YAML into (key, value) rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(value, prefix: str = "") -> Iterator[tuple[str, str]]:
    """Keys joined by two underscores; nulls, empty strings and arrays are left out."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}__{k}" if prefix else str(k))
    elif value is not None and value != "" and not isinstance(value, list):
        yield prefix, str(value).lower() if isinstance(value, bool) else str(value)


def _rows(df: DataFrame, parse) -> DataFrame:
    keep = [c for c in df.columns if c != "content"]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    found = list(parse(row.content or ""))
                except (ValueError, RecursionError):
                    continue
                out += [(*[getattr(row, c) for c in keep], k, v) for k, v in found]
            yield pd.DataFrame(out, columns=schema.names)

    return df.mapInPandas(run, schema)


def flatten_json(df: DataFrame) -> DataFrame:
    """(.., content) -> (.., key, value) of nested JSON objects; unreadable contents give no rows."""
    return _rows(df, lambda text: flatten(json.loads(text or "{}")))


def parse_env(df: DataFrame) -> DataFrame:
    """KEY=value lines; comments, ``export`` and quotes aside. In the JVM."""
    line = F.explode(F.split("content", r"\r?\n"))
    rows = df.withColumn("_l", line).drop("content").where(~F.col("_l").rlike(r"^\s*(#|$)"))
    rows = rows.withColumns({"key": F.regexp_extract("_l", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=", 1), "value": F.regexp_replace(F.trim(F.regexp_extract("_l", r"=(.*)$", 1)), "^[\"']|[\"']$", "")})
    return rows.where("key <> ''").drop("_l")


def parse_properties(df: DataFrame) -> DataFrame:
    """key=value or key: value lines."""
    rows = df.withColumn("_l", F.explode(F.split("content", r"\r?\n"))).drop("content").where(~F.col("_l").rlike(r"^\s*([#!]|$)"))
    rows = rows.withColumns({"key": F.trim(F.regexp_extract("_l", r"^([^=:]+)[=:]", 1)), "value": F.trim(F.regexp_extract("_l", r"^[^=:]+[=:](.*)$", 1))})
    return rows.where("key <> ''").drop("_l")
