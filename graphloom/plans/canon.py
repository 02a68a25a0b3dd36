"""Binding of a star schema onto the property graph: nodes, edges, runs, elements and files as DataFrames.

Regions are brokers, nations services, suppliers external APIs, customers endpoints, parts message
types, orders classes and line items methods; page urls give a file tree and events give runs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import stable_ids
from .lineage import stored

#: Tables that nodes and edges come from.
TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]
LANGUAGES = ["typescript", "python", "java", "csharp", "cpp"]
STATUSES = ["auto_found", "needed", "found", "not_needed", "ignored"]


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


class Canon:
    """Lazily built frames over one directory of tables; only what a query uses is read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _stored(self, name: str, build) -> DataFrame:
        return stored(self.spark, name, [f"{self.dir}/{t}.parquet" for t in TABLES], build)

    def _node(self, df: DataFrame, kind: str, key: str, name: Column, path: Column, parent: Column | None, layer: str = "system", language: Column | None = None) -> DataFrame:
        null = F.lit(None).cast("string")
        return df.select(
            _id(kind, key).alias("id"), F.lit("canon").alias("parser_id"), F.lit(kind).alias("kind"), name.alias("name"), F.concat(F.lit(kind + "."), name).alias("qualified_name"),
            (null if language is None else language).alias("language"), path.alias("path"), (null if parent is None else parent).alias("parent_id"), F.lit(layer).alias("layer"),
        )

    @cached_property
    def places(self) -> DataFrame:
        """(n_nationkey, place): nations with their path."""
        nation = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return nation.select("n_nationkey", "n_name", "r_regionkey", F.concat_ws("/", "r_name", "n_name").alias("place"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.read("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_nationkey", F.concat_ws("/", "place", "c_name").alias("c_path"))

    @cached_property
    def brokers(self) -> DataFrame:
        return self._node(self.read("region"), "broker", "r_regionkey", F.col("r_name"), F.col("r_name"), None)

    @cached_property
    def services(self) -> DataFrame:
        return self._node(self.places, "service", "n_nationkey", F.col("n_name"), F.col("place"), None)

    @cached_property
    def apis(self) -> DataFrame:
        supplier = self.read("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
        return self._node(supplier, "external_api", "s_suppkey", F.col("s_name"), F.concat_ws("/", "place", "s_name"), _id("service", "s_nationkey"))

    @cached_property
    def endpoints(self) -> DataFrame:
        return self._node(self.customers, "http_endpoint", "c_custkey", F.col("c_name"), F.col("c_path"), _id("service", "n_nationkey"))

    @cached_property
    def message_types(self) -> DataFrame:
        return self._node(self.read("part"), "message_type", "p_partkey", F.col("p_name"), F.col("p_brand"), None)

    @cached_property
    def classes(self) -> DataFrame:
        orders = self.read("orders").join(self.customers, F.col("o_custkey") == F.col("c_custkey"))
        name = F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"))
        return self._node(orders, "class", "o_orderkey", name, F.concat_ws("/", "c_path", name), _id("http_endpoint", "o_custkey"), "code", _pick(LANGUAGES, F.col("o_orderkey")))

    @cached_property
    def system(self) -> DataFrame:
        """System-layer nodes."""
        out = self.brokers
        for part in (self.services, self.apis, self.endpoints, self.message_types):
            out = out.unionByName(part)
        return out

    @cached_property
    def nodes(self) -> DataFrame:
        """All nodes, written once for each state of the tables."""
        return self._stored("nodes", lambda: self.system.unionByName(self.classes).unionByName(self.method_nodes))

    @cached_property
    def methods(self) -> DataFrame:
        """Line items as methods; their natural key repeats, so ids get a rank suffix."""
        rows = self.read("lineitem").withColumn("base_id", F.concat(F.lit("method:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")))
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        return stable_ids(rows, "base_id", order).select("id", "base_id", F.lit("method").alias("kind"), _id("class", "l_orderkey").alias("parent_id"), F.col("l_returnflag").alias("name"))

    @cached_property
    def method_nodes(self) -> DataFrame:
        null = F.lit(None).cast("string")
        return self.methods.select("id", F.lit("canon").alias("parser_id"), "kind", "name", F.concat(F.lit("method."), "name").alias("qualified_name"), null.alias("language"), null.alias("path"), "parent_id", F.lit("code").alias("layer"))

    def _edge(self, df: DataFrame, kind: str, src: Column, dst: Column, layer: str, protocol: Column | None = None, path: Column | None = None) -> DataFrame:
        null = F.lit(None).cast("string")
        return df.select(
            F.concat_ws(":", F.lit("canon"), F.lit(kind), F.concat(src, F.lit("->"), dst)).alias("id"), F.lit("canon").alias("parser_id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"),
            (null if path is None else path).alias("path"), F.lit(layer).alias("layer"), (null if protocol is None else protocol).alias("protocol"),
        )

    @cached_property
    def connects(self) -> DataFrame:
        return self._edge(self.places, "connects_to", _id("service", "n_nationkey"), _id("broker", "r_regionkey"), "system")

    @cached_property
    def exposes(self) -> DataFrame:
        return self._edge(self.customers, "exposes", _id("service", "n_nationkey"), _id("http_endpoint", "c_custkey"), "system", None, F.col("c_path"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.read("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def calls(self) -> DataFrame:
        rows = self.lines.join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "o_custkey").distinct()
        return self._edge(rows, "http_calls", _id("service", "s_nationkey"), _id("http_endpoint", "o_custkey"), "system", F.when(F.col("o_custkey") % 2 == 0, "http"))

    @cached_property
    def consumes(self) -> DataFrame:
        rows = self.lines.select("o_custkey", "l_partkey").distinct()
        return self._edge(rows, "consumes", _id("http_endpoint", "o_custkey"), _id("message_type", "l_partkey"), "system")

    @cached_property
    def contains(self) -> DataFrame:
        """Endpoints to classes, and classes to methods."""
        return self._edge(self.read("orders"), "contains", _id("http_endpoint", "o_custkey"), _id("class", "o_orderkey"), "code").unionByName(self._edge(self.methods, "contains", F.col("parent_id"), F.col("id"), "code"))

    @cached_property
    def edges(self) -> DataFrame:
        """All edges, written once for each state of the tables."""

        def build() -> DataFrame:
            out = self.connects
            for part in (self.exposes, self.calls, self.consumes, self.contains):
                out = out.unionByName(part)
            return out

        return self._stored("edges", build)

    @cached_property
    def runs(self) -> DataFrame:
        """One run a day of events, newest counts as given."""
        day = self.read("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("node_count"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.count_distinct("user_id").alias("users"))
        return day.select(
            F.concat(F.lit("run:"), F.col("day")).alias("id"), F.col("day").alias("started_at"), _pick(["success", "partial", "failed"], F.col("node_count")).alias("status"),
            _pick(["success", "partial", "success", "failed"], F.col("users")).alias("ingest_status"), "node_count", (F.col("node_count") % 2 == 1).alias("incremental"), (F.col("users") % 3).alias("deleted"),
            _pick(["parsers", "ai"], F.col("users")).alias("graph_builder"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """(path, mtime_ms, size, page_id) of page urls, host and path without query and fragment; the least page of a path."""
        path = F.regexp_replace(F.regexp_extract("url", "^[^:]*://([^?#]*)", 1), "/$", "")
        rows = self.read("pages").select(path.alias("path"), (F.col("page_id") * 1000).alias("mtime_ms"), F.length("html").cast("long").alias("size"), "page_id")
        return rows.groupBy("path").agg(F.min_by("mtime_ms", "page_id").alias("mtime_ms"), F.min_by("size", "page_id").alias("size"), F.min("page_id").alias("page_id"))

    @cached_property
    def elements(self) -> DataFrame:
        """The file tree: one file a path, and all ancestor directories."""
        from ..functions.paths import ancestor_paths

        file = self.files.select("path", F.lit("file").alias("type"), F.col("page_id").alias("n"))
        folders = self.files.select(F.explode(ancestor_paths(F.col("path"))).alias("path")).distinct().join(file.select("path"), "path", "left_anti")
        all_ = file.unionByName(folders.select("path", F.lit("directory").alias("type"), F.length("path").cast("long").alias("n")))
        return all_.select(
            F.concat(F.lit("el:"), F.col("path")).alias("id"), "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent_path"), "type", _pick(STATUSES, F.col("n")).alias("status"),
            (F.col("n") % 7 != 0).alias("is_active"), (F.col("n") % 3 == 0).alias("status_manually_set"),
        )
