"""Reachability over parent links and edges: joins level by level near the start, pointer jumping beyond.

The first NEAR levels are joins of what was reached last.  Deeper graphs go on with pointers that double their reach in each
round, so that a chain of n links costs log n rounds.  No depth is cut; each round's table is cut from its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table
from .joins import incident

#: Levels that are walked one by one.
NEAR = 8


def _parents(nodes: DataFrame) -> DataFrame:
    """(at, up): each node's parent; of several rows of one id the least parent."""
    return nodes.where("parent_id is not null and parent_id <> ''").groupBy(F.col("id").alias("at")).agg(F.min("parent_id").alias("up"))


def _all_ancestors(up: DataFrame, starts: DataFrame) -> DataFrame:
    """up (at, up); starts (at) -> (at, ancestor, depth): by doubling. A cycle's nodes are met once, the start itself is none."""
    jump = table(up, "jump")
    found = table(starts.distinct().join(up, "at").where("at <> up").select("at", F.col("up").alias("ancestor"), F.lit(1).alias("depth")), "closure")
    reach = 1
    while True:
        ahead = found.join(jump.select(F.col("at").alias("ancestor"), F.col("up").alias("far")), "ancestor")
        more = ahead.select("at", F.col("far").alias("ancestor"), (F.col("depth") + reach).alias("depth")).where("at <> ancestor")
        more = table(more.groupBy("at", "ancestor").agg(F.min("depth").alias("depth")).join(found, ["at", "ancestor"], "left_anti"), "closure")
        if more.isEmpty():
            return found
        found = found.unionByName(more)
        jump = table(jump.join(jump.select(F.col("at").alias("up"), F.col("up").alias("far")), "up").select("at", F.col("far").alias("up")), "jump")
        reach *= 2


def ancestors(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, ancestor, depth from 1): known ancestors of each start; a missing parent ends a walk, a cycle too."""
    ids = nodes.select(F.col("id").alias("up"))
    level = starts.select("id", F.col("id").alias("at"), F.array("id").alias("seen")).distinct()
    out = None
    for depth in range(1, NEAR + 1):
        up = _parents(nodes.join(level.select(F.col("at").alias("id")).distinct(), "id", "left_semi")).join(ids, "up", "left_semi")
        level = level.join(up, "at").where(~F.array_contains("seen", F.col("up"))).select("id", F.col("up").alias("at"), F.concat("seen", F.array("up")).alias("seen"))
        level = table(level, "level")
        found = level.select("id", F.col("at").alias("ancestor"), F.lit(depth).alias("depth"))
        out = found if out is None else out.unionByName(found)
        if level.isEmpty():
            return out
    up = _parents(nodes).join(ids.distinct(), "up", "left_semi").select("at", "up")
    far = level.select("id", "at").join(_all_ancestors(up, level.select("at")), "at").select("id", "ancestor", (F.col("depth") + NEAR).alias("depth")).where("id <> ancestor")
    far = far.groupBy("id", "ancestor").agg(F.min("depth").alias("depth")).join(out, ["id", "ancestor"], "left_anti")
    return out.unionByName(far.select("id", "ancestor", "depth"))


def nearest_ancestor(nodes: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    """(id, ancestor): the start itself if it is of the kind, else its nearest ancestor that is."""
    steps = ancestors(nodes, starts).unionByName(starts.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    of_kind = steps.join(nodes.where(F.col("kind") == kind).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return of_kind.groupBy("id").agg(F.min_by("ancestor", "depth").alias("ancestor"))


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth): the roots and all nodes below them, each once at its least depth; safe against cycles."""
    down = nodes.where("parent_id is not null").select(F.col("parent_id").alias("at"), F.col("id").alias("child"))
    reached = level = table(roots.select("id", F.lit(0).alias("depth")).distinct(), "level")
    for depth in range(1, NEAR + 1):
        level = level.select(F.col("id").alias("at")).join(down, "at").select(F.col("child").alias("id")).distinct()
        level = table(level.join(reached, "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)
    # Deeper: every node looks up, twice as far in each round, for the nearest root. A root's nodes stand at all depths down
    # to the last, so a round that finds none is the end, also where a cycle goes on.
    tops = roots.select(F.col("id").alias("up"), F.lit(1).alias("hit")).distinct()
    look = table(_parents(nodes).join(tops, "up", "left").select(F.col("at").alias("id"), "up", "hit"), "look")
    reach, count = 1, -1
    while (now := look.where("hit is not null").count()) != count:
        count = now
        ahead = look.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("hit").alias("far_hit"))
        look = table(look.join(ahead, "up", "left").select("id", F.col("far").alias("up"), F.coalesce("hit", F.col("far_hit") + reach).alias("hit")), "look")
        reach *= 2
    deep = look.where("hit is not null").select("id", F.col("hit").alias("depth")).join(reached, "id", "left_anti")
    return reached.unionByName(deep)


def neighbours(edges: DataFrame, node_id: str, direction: str = "both", limit: int = 500) -> DataFrame:
    """Edges out of, into or at a node, by type and id."""
    out, into = F.col("src") == node_id, F.col("dst") == node_id
    return edges.where({"out": out, "in": into, "both": out | into}[direction]).orderBy("type", "id").limit(limit)


def affiliated_roots(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Members whose parent is no member."""
    own = nodes.join(members.select("id"), "id", "left_semi")
    return own.join(members.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(nodes.columns)


def code_of_service(service_id: str, service_name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, mode): code nodes tied to a service by parent, ancestor or edge (explicit); only if there are none, by a path segment of its name."""
    from ..functions.paths import has_segment
    from .filters import is_code

    code = nodes.where(is_code(F.col("kind"), F.coalesce("layer", F.lit(""))))
    service = nodes.where(F.col("id") == service_id)
    below = subtree(nodes, service).where("depth > 0").select("id")
    touching = incident(edges, service).select(F.explode(F.array("src", "dst")).alias("id"))
    explicit = code.select("id").join(below.unionByName(touching).distinct(), "id", "left_semi").select("id", F.lit("explicit").alias("mode"))
    by_path = code.where(has_segment(F.col("path"), F.lit(service_name))).select("id", F.lit("path_match").alias("mode"))
    none = explicit.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("path_match").alias("mode"))
    return explicit.unionByName(by_path.join(none, "mode", "left_semi"))
