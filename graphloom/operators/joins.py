"""Joins of edges, nodes and elements; no plan here needs a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths
from ..plans.lineage import table
from ..schema import CODE_KINDS, INSIDE_KINDS, OPEN_ENDED_EDGES, PEER_KINDS
from .dedupe import element_by_path


#: Kinds of ids (what stands before the first colon) that a filter lists at most.
MOST_KINDS = 200


class _Ids:
    """The distinct ids of nodes, written first: the joins then know their size, so a small set is broadcast and the edges stay where they are."""

    def __init__(self, nodes: DataFrame):
        self.ids = table(nodes.select("id").where("id is not null").distinct(), "ids")
        found = self.ids.select(self.kind("id").alias("kind")).distinct().limit(MOST_KINDS + 1).collect()
        self.kinds = [r["kind"] for r in found] if len(found) <= MOST_KINDS else None

    @staticmethod
    def kind(name: str) -> Column:
        return F.regexp_extract(name, "^([^:]*):", 1)

    def at(self, edges: DataFrame, end: str) -> DataFrame:
        """Edges with an end in the set; those whose end has no kind of the set never reach the join."""
        near = edges if self.kinds is None else edges.where(self.kind(end).isin(self.kinds))
        return near.join(self.ids.withColumnRenamed("id", end), end, "left_semi").select(edges.columns)


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end in the set: two semi joins, so that no OR reaches a join condition."""
    ids = _Ids(nodes)
    return ids.at(edges, "src").unionByName(ids.at(edges, "dst")).dropDuplicates(["id"]).select(edges.columns)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the set; both kinds are looked at before the first join."""
    ids = _Ids(nodes)
    near = edges if ids.kinds is None else edges.where(ids.kind("dst").isin(ids.kinds))
    return ids.at(ids.at(near, "src"), "dst")


def sound(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges between known nodes, and open-ended types with both ends given."""
    full = edges.where("src is not null and dst is not null")
    exempt = F.col("type").isin(OPEN_ENDED_EDGES)
    return full.where(exempt).unionByName(within(full.where(~exempt), known))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends of edges that are no node of the set."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti")


def stub_kind(id_: Column) -> Column:
    """Kind that an id's second or first part names; unknown otherwise."""
    parts = F.split(id_, ":")
    second, head = F.get(parts, 1), F.get(parts, 0)
    known = [*PEER_KINDS, *INSIDE_KINDS]
    return F.when((F.size(parts) >= 3) & (second.isin([*known, *CODE_KINDS]) | second.startswith("ui_")), second).when((F.size(parts) >= 2) & head.isin(known), head).otherwise("unknown")


def stubs(ids: DataFrame) -> DataFrame:
    """View nodes for ids without a node."""
    tail = F.element_at(F.split("id", ":"), -1)
    name = F.when(tail != "", tail).otherwise(F.col("id"))
    return ids.select("id", F.lit("stub").alias("parser_id"), stub_kind(F.col("id")).alias("kind"), name.alias("name"), name.alias("qualified_name"), F.lit("system").alias("language"), F.lit("").alias("path"), F.lit("system").alias("layer"), F.lit("external").alias("role"), F.lit(True).alias("stub"))


def with_children_flag(page: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("_n")).withColumnRenamed("parent_id", "_parent")
    return page.join(counts, page.id == F.col("_parent"), "left").withColumn("has_children", F.coalesce(F.col("_n") > 0, F.lit(False))).drop("_parent", "_n")


def linked_elements(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """``element_id``: of the element on the node's path, one of them if there are several; null if there is none."""
    return nodes.join(element_by_path(elements).select("path", F.col("id").alias("element_id")), "path", "left")


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key stands once."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n = 1").drop("_n")


def resolve_parents(symbols: DataFrame) -> DataFrame:
    """(id, parent_id): the symbol of the parent's name in the same path, else the only one of that name, else the path's module."""
    key = symbols.select("id", "path", "kind", F.col("qualified_name").alias("qn"), "parent_qualified_name")
    local = symbols.groupBy("path", F.col("qualified_name").alias("p")).agg(F.min("id").alias("a"))
    alone = unique_by(symbols.select(F.col("qualified_name").alias("p"), F.col("id").alias("b")), ["p"])
    module = symbols.where("kind = 'module'").groupBy("path").agg(F.min("id").alias("c"))
    key = key.withColumnRenamed("parent_qualified_name", "p")
    out = key.join(local, ["path", "p"], "left").join(alone, "p", "left").join(module, "path", "left")
    parent = F.coalesce("a", "b", F.when(F.col("kind") != "module", F.col("c")))
    return out.select("id", F.when(parent != F.col("id"), parent).alias("parent_id"))


def resolve_usages(usages: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, type): usages whose two names each stand for one symbol."""
    alone = unique_by(symbols.select("qualified_name", "id"), ["qualified_name"])
    src = alone.select(F.col("qualified_name").alias("from"), F.col("id").alias("src"))
    dst = alone.select(F.col("qualified_name").alias("to"), F.col("id").alias("dst"))
    return usages.join(src, "from").join(dst, "to").select("src", "dst", "type")


def only_match(left: DataFrame, right: DataFrame, keys: list[str], hint: str | None = None) -> DataFrame:
    """left with ``match``: right's id where the keys (and the hint, if left has one) fit exactly one; else null."""
    plain = unique_by(right.select(*keys, F.col("id").alias("_all")), keys)
    out = left.join(plain, keys, "left")
    if hint:
        scoped = unique_by(right.select(*keys, hint, F.col("id").alias("_scoped")), [*keys, hint])
        out = out.join(scoped, [*keys, hint], "left")
        return out.withColumn("match", F.when(F.col(hint).isNotNull(), F.col("_scoped")).otherwise(F.col("_all"))).drop("_all", "_scoped")
    return out.withColumnRenamed("_all", "match")


def call_targets(calls: DataFrame, endpoints: DataFrame, parser_id: str) -> DataFrame:
    """calls (service, method, path, ..) with ``dst``, the id that the endpoint they call has, and whether ``endpoints`` (id) hold it."""
    from ..functions.text import endpoint_id

    rows = calls.withColumn("dst", endpoint_id(F.lit(parser_id), F.col("service"), F.col("method"), F.col("path")))
    held = endpoints.select(F.col("id").alias("dst"), F.lit(True).alias("known")).distinct()
    return rows.join(held, "dst", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def longest_prefix(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, owner): the owner whose path is the longest that is the row's path or an ancestor of it.

    Ancestors are exploded, so the prefix condition is an equality join.
    """
    steps = rows.select("id", F.explode(F.concat(F.array("path"), ancestor_paths(F.col("path")))).alias("at"))
    found = steps.join(owners.where("path <> ''").select(F.col("path").alias("at"), F.col("id").alias("owner")), "at")
    best = found.groupBy("id").agg(F.max(F.struct(F.length("at").alias("n"), "owner")).alias("b")).select("id", F.col("b.owner").alias("owner"))
    return rows.select("id").join(best, "id", "left")


def vanished(elements: DataFrame, seen: DataFrame) -> DataFrame:
    """Active elements whose path a scan did not meet."""
    return elements.where("is_active").join(seen.select("path").distinct(), "path", "left_anti").select(elements.columns)


def helper_calls(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(screen, target): calls that the functions make which a screen imports, by module and exported name.

    imports: (screen, module, name, used); a helper that the screen imports but does not use calls nothing.
    exports: (module, name, target), one row for each call of an exported function.
    """
    return imports.where("used").select("screen", "module", "name").distinct().join(exports, ["module", "name"]).select("screen", "target").distinct()


def file_edges(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Edges that stand in a file or touch its nodes."""
    return edges.where(F.col("path") == path).unionByName(incident(edges, nodes.where(F.col("path") == path))).dropDuplicates(["id"])
