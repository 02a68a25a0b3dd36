"""Ranking, deduplication and budgeted truncation; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import PEER_KINDS


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def one_element(elements: DataFrame) -> DataFrame:
    """One element a path: active first, then manually set, then least id."""
    return first_by(elements, ["path"], [F.col("is_active").desc(), F.col("status_manually_set").desc(), F.col("id").asc()])


def element_by_path(elements: DataFrame) -> DataFrame:
    """As :func:`one_element`, but manual settings come before activity."""
    return first_by(elements, ["path"], [F.col("status_manually_set").desc(), F.col("is_active").desc(), F.col("id").asc()])


def superseded(elements: DataFrame) -> DataFrame:
    """Active elements whose path another active element wins: those to deactivate."""
    active = elements.where("is_active")
    n = F.row_number().over(W.partitionBy("path").orderBy(F.col("status_manually_set").desc(), "id"))
    return active.withColumn("_n", n).where("_n > 1").drop("_n")


def stable_ids(df: DataFrame, base: str, order: list[str]) -> DataFrame:
    """``id``: the base id, with its rank in the order behind it from the second on."""
    n = F.row_number().over(W.partitionBy(base).orderBy(*order))
    return df.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws(":dup:", base, F.col("_n").cast("string")))).drop("_n")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a self loop counts twice, no edge counts 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_peers(peers: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Services first, then by degree; ties by kind, name and id."""
    rows = peers.join(degrees(peers, edges), "id")
    service = F.col("kind") == "service"
    return rows.orderBy(service.desc(), F.when(service, 0).otherwise(F.col("degree")).desc(), "kind", "name", "id").limit(most)


def inside_rank(kind: Column) -> Column:
    return F.when(kind == "message_topic", 1).when(kind.isin("dotnet_project", "message_type"), 2).when(kind == "http_endpoint", 3).otherwise(0)


def top_inside(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.orderBy(inside_rank(F.col("kind")), "id").limit(most)


def peer_rank(kind: Column) -> Column:
    return F.when(kind.isin(PEER_KINDS), 0).otherwise(1)


def budget(max_nodes):
    """(external reserve, most insides) of a focused view, for a number or a column."""
    if isinstance(max_nodes, Column):
        reserve = F.least(F.lit(40), F.greatest(F.lit(8), F.floor(max_nodes / 5)))
        return reserve, F.greatest(F.lit(0), max_nodes - 1 - reserve)
    reserve = min(40, max(8, max_nodes // 5))
    return reserve, max(0, max_nodes - 1 - reserve)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order; the total is a count of its own."""
    return df.orderBy(*order).offset(offset).limit(limit)


def current_job(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """A running job, else the latest finished one."""
    return first_by(jobs, keys, [(F.col("status") == "running").desc(), F.col("updated_at").desc(), F.col("id").asc()])


def chunk_numbers(df: DataFrame, order: list[str], size: int, total: int) -> DataFrame:
    """``chunk`` from 0; a last chunk under a tenth of ``size`` joins the one before."""
    chunks = -(-total // size) if size > 0 else 1
    last = max(0, chunks - 1)
    short = chunks > 1 and total - last * size < size / 10
    if size <= 0:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    n = F.floor(F.col("_place") / size)
    return places(df, order).withColumn("chunk", F.least(n, F.lit(last - 1 if short else last)).cast("long")).drop("_place")


def places(df: DataFrame, order: list[str]) -> DataFrame:
    """``_place``: each row's number from 0 in a total order: rows of a range are numbered in it, and ranges begin where those before end."""
    from ..plans.lineage import table

    ranges = table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_start"))  # one row a range
    inner = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_inner", inner).join(starts, "_range").withColumn("_place", F.col("_inner") + F.col("_start")).drop("_range", "_inner", "_start")


def external_order(nodes: DataFrame, most: int) -> DataFrame:
    """The first ``most`` nodes, peers first, then by id, with their ``place`` from 1: numbered once cut, so in a bounded view."""
    first = nodes.orderBy(peer_rank(F.col("kind")), "id").limit(most)
    return first.withColumn("place", F.row_number().over(W.orderBy(peer_rank(F.col("kind")), "id")).cast("long"))
