"""Predicates and projections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths
from ..schema import ANALYSED_STATUSES, CODE_KINDS, PEER_KINDS, READY_STATUSES


def public(rows: DataFrame) -> DataFrame:
    """Without what is no reader's business: when a row was written."""
    return rows.drop("ingested_at")


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def stamped(rows: DataFrame, at: str | Column | None = None) -> DataFrame:
    """``ingested_at``: an ISO time in UTC, now if none is given; ``at`` is a UTC time, whatever the session's zone is."""
    if at is None:
        moment = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), ISO)
    else:
        moment = F.date_format((F.lit(at) if isinstance(at, str) else at).cast("timestamp_ntz"), ISO)
    return rows.withColumn("ingested_at", moment)


#: What the UI sees of nodes and edges (fixed values).
UI_NODE, UI_EDGE = ("id", "kind", "name", "qualified_name", "path", "signature", "parent_id", "metadata"), ("id", "src", "dst", "type", "metadata")


def ui_public(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The UI's fields; null where the rows have none."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fields])


def with_layer(metadata: Column, layer: str) -> Column:
    """The metadata map with the layer as an entry."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rest = F.map_filter(F.coalesce(metadata, empty), lambda k, _: k != "layer")
    return F.map_concat(rest, F.create_map(F.lit("layer"), F.lit(layer)))


def is_root(parent: Column) -> Column:
    return parent.isNull() | (parent == "")


def any_contains(columns: list[str], text: str) -> Column:
    """Case-insensitive substring of any of the columns; the text is taken literally."""
    return reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(text))) for c in columns])


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(any_contains(["name", "qualified_name", "path", "kind"], text))


def search_edges(edges: DataFrame, text: str) -> DataFrame:
    return edges.where(any_contains(["type", "src", "dst", "path"], text))


def path_like(nodes: DataFrame, segment: str, kinds: list[str] | None = None) -> DataFrame:
    """Substring match on the path, with wildcards of the input dropped."""
    found = nodes.where(any_contains(["path"], segment.replace("*", "").replace("?", "")))
    return found.where(F.col("kind").isin(kinds)) if kinds else found


def of_kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("kind").isin(kinds)) if kinds else nodes.limit(0)


def is_code(kind: Column, layer: Column) -> Column:
    return kind.isin(CODE_KINDS) | (layer == "code")


def is_system(layer: Column, kind: Column) -> Column:
    return (layer == "system") | kind.isin(PEER_KINDS)


def in_layer(nodes: DataFrame, layer: str) -> DataFrame:
    """code holds UI nodes too; all keeps everything."""
    if layer == "all":
        return nodes
    code = is_code(F.col("kind"), F.coalesce("layer", F.lit(""))) | F.col("kind").startswith("ui_")
    return nodes.where(code if layer == "code" else ~code)


def family(type_: Column, protocol: Column) -> Column:
    """System edge family: http, grpc, rpc_bus or infra; null for others."""
    return (
        F.when((type_ == "http_calls") & (protocol == "grpc"), "grpc").when((type_ == "http_calls") & (protocol == "http"), "http")
        .when(type_.isin("publishes", "consumes", "rpc_handles"), "rpc_bus").when(type_.isin("connects_to", "depends_on"), "infra")
    )


def families_present(edges: DataFrame) -> DataFrame:
    return edges.select(family(F.col("type"), F.coalesce("protocol", F.lit(""))).alias("family")).where("family is not null").distinct()


def analysed(elements: DataFrame) -> DataFrame:
    """Elements whose own status and every known ancestor's are analysed ones: one anti join on exploded ancestors."""
    out = elements.where(~F.col("status").isin(ANALYSED_STATUSES)).select(F.col("path").alias("a")).distinct()
    paths = elements.select("path", F.explode(F.concat(F.array("path"), ancestor_paths(F.col("path")))).alias("a"))
    hidden = paths.join(out, "a", "left_semi").select("path").distinct()
    return elements.join(hidden, "path", "left_anti")


def ready(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(READY_STATUSES) & F.col("ingest_status").isin(READY_STATUSES))


def production_code(path: Column) -> Column:
    """Neither tests, mocks nor generated files."""
    return ~F.lower(path).rlike(r"(^|/)(tests?|__tests__|mocks?|__mocks__|spec|generated|node_modules)/|\.(test|spec|generated|g)\.[a-z]+$")


def hinted(text: Column, hints: list[str], within: int = 32_000) -> Column:
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.substring(text, 1, within), h))


def view_node(df: DataFrame, role: str, stub: bool) -> DataFrame:
    return df.withColumns({"role": F.lit(role), "stub": F.lit(stub)}).drop("location", "signature")
