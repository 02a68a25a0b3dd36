"""Settings as bindings: environments laid over the base, sections folded into one binding each, secrets masked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import binding_type, engine_of, redact, target_host

#: What a section's name says that it is, and what a leaf's name says that it holds; the first that fits counts (fixed values).
SECTION_KINDS = (("cache", "redis|cache"), ("search", "elastic|opensearch|search$"), ("storage", "minio|s3|filestorage|objectstorage|blobstorage"), ("broker", r"rabbit|kafka|masstransit|amqp|\bbus\b|bus$"), ("database", "mongo"))
LEAF_ROLES = (
    ("scalar", "timeout|interval|ttl|retry|prefetch|pool|flush|batch|size|count"), ("credential", "user|password|pwd|secret|token|login|accesskey|secretkey"), ("port", "port$"),
    ("endpoint", "host|server|address|endpoint|url|uri|bootstrap"), ("resource", "index|bucket|vhost|virtual|database|catalog|region|prefix"),
)
#: Engines of kinds whose section names none.
ENGINES = {"cache": "redis", "search": "elasticsearch", "storage": "minio"}


def first_match(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    """The first name whose pattern a text meets, in lower case; null if none does."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(table):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def effective(settings: DataFrame, environments: Sequence[str] = ()) -> DataFrame:
    """settings (scope, environment or null for the base, key, value) -> (scope, key, value): of each key the value of the last of
    ``environments`` that sets it, else the base's; other environments are left out, null values too, and of several
    values at one place the greatest counts."""
    rank = F.when(F.col("environment").isNull(), 0)
    for n, name in enumerate(environments, 1):
        rank = rank.when(F.col("environment") == name, n)
    rows = settings.withColumn("_rank", rank).where("_rank is not null and value is not null")
    return rows.groupBy("scope", "key").agg(F.max(F.struct("_rank", "value"))["value"].alias("value"))


def section_bindings(settings: DataFrame, environments: Sequence[str] = ()) -> DataFrame:
    """(scope, key, type, engine, target, value): a binding for each section of infrastructure, and for each other setting that names a store, bus or address.

    A section's endpoint and port make its target; resources and scalars are listed behind it in order of their keys, credentials never.
    Of several endpoints, or ports, the last by key counts.  Values are masked.
    """
    flat = effective(settings, environments)
    section = F.when(F.contains("key", F.lit("__")), F.substring_index("key", "__", 1))
    flat = flat.withColumns({"section": section, "leaf": F.when(section.isNotNull(), F.substr("key", F.length(section) + 3)).otherwise(F.col("key"))})
    kind = F.when(F.lower("section") != "connectionstrings", first_match(F.col("section"), SECTION_KINDS))
    flat = flat.withColumns({"kind": kind, "role": F.coalesce(first_match(F.col("leaf"), LEAF_ROLES), F.lit("other"))})
    held = lambda role: F.col("role") == role
    last = lambda role: F.max(F.when(held(role), F.struct("key", "value")))["value"]
    listed = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(held(role), F.struct("key", F.concat_ws("=", "leaf", "value").alias("said"))))), lambda x: x["said"]), ";")
    one = flat.where("kind is not null").groupBy("scope", "section", "kind").agg(last("endpoint").alias("endpoint"), last("port").alias("port"), listed("resource").alias("resources"), listed("scalar").alias("scalars"))
    host = F.coalesce(target_host(F.col("endpoint")), F.trim("endpoint"))
    bare = F.col("port").isNotNull() & ~host.rlike(r":\d+") & ~host.rlike("(?i)^https?://")
    one = one.withColumn("target", F.when(bare, F.concat_ws(":", host, "port")).otherwise(host))
    said = F.coalesce(F.nullif(F.concat_ws("|", "target", F.nullif("resources", F.lit("")), F.nullif("scalars", F.lit(""))), F.lit("")), F.col("section"))
    named = engine_of(F.col("section"), F.concat_ws(" ", F.coalesce("target", F.lit("")), "resources"))
    usual = F.when(F.col("kind") == "broker", F.when(F.lower("section").contains("kafka"), "kafka").otherwise("rabbitmq"))
    for name, engine in ENGINES.items():
        usual = usual.when(F.col("kind") == name, engine)
    sections = one.select("scope", F.col("section").alias("key"), F.col("kind").alias("type"), F.coalesce(named, usual).alias("engine"), "target", redact(said).alias("value"))
    type_ = binding_type(F.col("key"), F.col("value"))
    alone = flat.where("kind is null").where(type_ != "other")
    return sections.unionByName(alone.select("scope", "key", type_.alias("type"), engine_of(F.col("key"), F.col("value")).alias("engine"), target_host(F.col("value")).alias("target"), redact(F.col("value")).alias("value")))
