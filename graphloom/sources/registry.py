"""Parser plugins: manifests of extractors that run elsewhere, checked and chosen by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(manifests: DataFrame) -> DataFrame:
    """Manifests (directory, id, languages, command, schema_version, timeout_ms) that are named like their directory and say all that is needed."""
    known = F.coalesce(F.size("languages") > 0, F.lit(False)) & (F.coalesce(F.length("command"), F.lit(0)) > 0) & (F.coalesce("schema_version", F.lit(0)) > 0) & (F.coalesce("timeout_ms", F.lit(0)) > 0)
    return manifests.where((F.col("id") == F.col("directory")) & known)


def by_language(manifests: DataFrame) -> DataFrame:
    """(language, parser_id): of several parsers of a language that of the last directory."""
    return valid(manifests).select("directory", "id", F.explode("languages").alias("language")).groupBy("language").agg(F.max_by("id", "directory").alias("parser_id"))
