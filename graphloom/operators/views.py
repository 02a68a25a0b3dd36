"""Size-budgeted graph views: root overview, focused slice, family filter, rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table
from ..schema import HIERARCHY_EDGES, INSIDE_KINDS, MAX_EDGES, MAX_NODES, PEER_KINDS
from .dedupe import budget, inside_rank, peer_rank, top_inside, top_peers
from .filters import family, is_code, is_system
from .joins import incident, missing_ends, stub_kind, stubs, within

VIEW = ["id", "parser_id", "kind", "name", "qualified_name", "language", "path", "layer", "role", "stub"]


def peers(nodes: DataFrame) -> DataFrame:
    """Peer kinds; topics and message types only where no broker exists."""
    no_broker = nodes.where("kind = 'broker'").agg(F.count("*").alias("n")).where("n = 0").select(F.explode(F.array(F.lit("message_topic"), F.lit("message_type"))).alias("kind"))
    loose = nodes.where(F.col("kind").isin("message_topic", "message_type")).join(no_broker, "kind", "left_semi")
    return nodes.where(F.col("kind").isin(PEER_KINDS)).unionByName(loose.select(nodes.columns))


#: Most peers, insides and children that a view loads (fixed values).
LOADED_PEERS, LOADED_INSIDES = 500, 2000


def load(nodes: DataFrame, edges: DataFrame, focus_id: str | None = None, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a view is made of: the first peers and, unless it is the root view, the first insides, the focus with its
    ancestors and children, and the edges that touch any of them with the nodes at their other ends."""
    from .graph import ancestors

    first = lambda rows, most: rows.orderBy("id").limit(most)
    found = first(peers(nodes), LOADED_PEERS)
    if focus_id is not None:
        focus = nodes.where(F.col("id") == focus_id)
        above = nodes.join(ancestors(nodes, focus).select(F.col("ancestor").alias("id")), "id", "left_semi").select(nodes.columns)
        found = found.unionByName(first(nodes.where(F.col("kind").isin(INSIDE_KINDS)), LOADED_INSIDES)).unionByName(focus).unionByName(above)
        found = found.unionByName(first(nodes.where(F.col("parent_id") == focus_id), LOADED_INSIDES))
    found = table(found.dropDuplicates(["id"]), "loaded")
    shown = table(incident(edges, found).orderBy("type", "id").limit(max(3 * max_edges, 2000)), "shown")
    others = nodes.join(missing_ends(shown, found), "id", "left_semi").select(nodes.columns)
    return found.unionByName(others), shown


def _view(nodes: DataFrame, role: str, stub: bool = False) -> DataFrame:
    return nodes.withColumns({"role": F.lit(role), "stub": F.lit(stub)}).select(VIEW)


def overview_targets(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends that may stand beside peers on the root overview: system nodes that are no insides, or unknown ids that name none."""
    known = ids.join(nodes.select("id", "kind", "layer"), "id", "left")
    code = is_code(F.col("kind"), F.coalesce("layer", F.lit(""))) | F.col("kind").startswith("ui_")
    real = ~code & ~F.col("kind").isin(INSIDE_KINDS) & is_system(F.coalesce("layer", F.lit("")), F.col("kind"))
    guess = stub_kind(F.col("id"))
    named = (guess == "unknown") | guess.isin(PEER_KINDS)
    return known.where(F.when(F.col("kind").isNotNull(), real).otherwise(named)).select("id")


def root_overview(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(view nodes, view edges): top peers, system nodes next to them, and stubs for what is left at the ends of kept edges."""
    all_peers = table(peers(nodes), "peers")
    touching = table(incident(edges, all_peers), "touching")
    kept = table(top_peers(all_peers, within(touching, all_peers), max_nodes).select(nodes.columns), "kept")
    ends = touching.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(kept.select("id"), "id", "left_anti")
    system = is_system(F.coalesce("layer", F.lit("")), F.col("kind")) & ~F.col("kind").isin([*PEER_KINDS, "http_endpoint"])
    room = max_nodes - kept.count()
    beside = nodes.where(system).join(ends, "id", "left_semi").orderBy("kind", "id").limit(room).select(nodes.columns) if room > 0 else nodes.limit(0)
    mark = kept.select("id", F.lit(True).alias("peer"))
    sided = touching.join(mark.withColumnsRenamed({"id": "src", "peer": "a"}), "src", "left").join(mark.withColumnsRenamed({"id": "dst", "peer": "b"}), "dst", "left")
    both = sided.where("a and b")
    one = sided.where(F.coalesce("a", F.lit(False)) != F.coalesce("b", F.lit(False))).where(~F.col("type").isin(HIERARCHY_EDGES)).withColumn("other", F.when(F.col("a"), F.col("dst")).otherwise(F.col("src")))
    allowed = overview_targets(one.select(F.col("other").alias("id")).distinct(), nodes).withColumnRenamed("id", "other")
    relevant = table(both.select(edges.columns).unionByName(one.join(allowed, "other", "left_semi").select(edges.columns)), "relevant")
    shown = relevant.orderBy("type", "id").limit(max_edges)
    selected = kept.unionByName(beside)
    extra = stubs(missing_ends(relevant, selected)).select(VIEW)
    return _view(selected, "inside").unionByName(extra), shown


def inside_of_system(focus: dict, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a focused system node holds, by its kind (focus: its id, kind and path)."""
    if focus["kind"] in ("database", "storage", "external_api"):
        return nodes.limit(0)
    children = nodes.where(F.col("parent_id") == focus["id"])
    inside = nodes.where(F.col("kind").isin(INSIDE_KINDS))
    if focus["kind"] == "broker":
        return nodes.where(F.col("kind").isin("message_topic", "message_type"))
    if focus["kind"] == "service":
        near = incident(edges, nodes.where(F.col("id") == focus["id"])).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        by_path = inside.where(F.col("path").startswith((focus["path"] or "\x00") + "/"))
        found = children.where(F.col("kind").isin(INSIDE_KINDS)).unionByName(inside.join(near, "id", "left_semi").select(nodes.columns)).unionByName(by_path)
        return found.where(F.col("id") != focus["id"]).dropDuplicates(["id"])
    return children


def inside_of_code(focus: dict, nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("parent_id") == focus["id"]) & is_code(F.col("kind"), F.coalesce("layer", F.lit(""))))


def beyond(core: DataFrame, nodes: DataFrame, touching: DataFrame, layer: str = "system") -> DataFrame:
    """What edges lead to from the ids of a view's core, whole: node columns with ``_known`` (it is a node) and ``_guess`` (its id's kind).
    The system layer hides code."""
    ends = touching.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(core, "id", "left_anti")
    outer = ends.join(nodes, "id", "left").withColumn("_known", F.col("kind").isNotNull()).withColumn("_guess", stub_kind(F.col("id")))
    if layer == "system":
        shown_kind = F.coalesce("kind", "_guess")
        code = is_code(shown_kind, F.when(F.col("_known"), F.coalesce("layer", F.lit(""))).otherwise(F.lit(""))) | shown_kind.startswith("ui_")
        outer = outer.where(~code)
    return outer


def externals(core: DataFrame, nodes: DataFrame, edges: DataFrame, layer: str = "system") -> DataFrame:
    """View nodes of all that one hop from the core (id) reaches: the candidates of which a focused view shows as many as it has room for."""
    core = core.select("id").distinct()
    outer = beyond(core, nodes, incident(edges, core), layer)
    return _view(outer.where("_known").select(nodes.columns), "external", True).unionByName(stubs(outer.where("not _known").select("id")).select(VIEW))


def focused(focus_id: str, inside: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, layer: str = "system") -> tuple[DataFrame, DataFrame]:
    """(view nodes, view edges): the focus, its first insides and, within the budget, what one hop reaches (peers first)."""
    _, most_inside = budget(max_nodes)
    kept = table(top_inside(inside, most_inside), "kept")
    focus = nodes.where(F.col("id") == focus_id)
    core = focus.select("id").unionByName(kept.select("id"))
    touching = table(incident(edges, core), "touching")
    outer = beyond(core, nodes, touching, layer)
    room = max_nodes - core.count()
    outer = table(outer.orderBy(peer_rank(F.coalesce("kind", F.lit(""))), "id").limit(max(room, 0)), "outer")
    known = _view(outer.where("_known").select(nodes.columns), "external", True)
    unknown = stubs(outer.where("not _known").select("id")).select(VIEW)
    shown = _view(focus, "focus").unionByName(_view(kept, "inside")).unionByName(known).unionByName(unknown)
    return shown, within(touching, shown).orderBy("type", "id").limit(max_edges)


def summary(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, by role too."""
    n = shown.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("role") == r).alias(r) for r in ("focus", "inside", "external")])
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # two one-row frames


def only_family(shown: DataFrame, edges: DataFrame, name: str, focus_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A view cut down to one edge family, its ends and the focus; ends without a node become unknown stubs."""
    kept = edges.where(family(F.col("type"), F.coalesce("protocol", F.lit(""))) == name)
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = ends if focus_id is None else ends.unionByName(shown.where(F.col("id") == focus_id).select("id")).distinct()
    known = shown.join(ids, "id", "left_semi").select(VIEW)
    blank = missing_ends(kept, shown).select("id", F.lit("stub").alias("parser_id"), F.lit("unknown").alias("kind"), F.col("id").alias("name"), F.col("id").alias("qualified_name"), F.lit("system").alias("language"), F.lit("").alias("path"), F.lit("system").alias("layer"), F.lit("external").alias("role"), F.lit(True).alias("stub"))
    return known.unionByName(blank.select(VIEW)), kept


def rollup_endpoints(nodes: DataFrame, edges: DataFrame, least: int = 300) -> tuple[DataFrame, DataFrame]:
    """(groups, edges): with ``least`` endpoints or more, those without an http call fold into their parent's group and edges follow."""
    endpoints = nodes.where("kind = 'http_endpoint'")
    called = edges.where("type = 'http_calls' and protocol = 'http'").select(F.col("dst").alias("id")).distinct()
    enough = endpoints.agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.lit("http_endpoint").alias("kind"))
    folded = endpoints.join(called, "id", "left_anti").join(enough, "kind", "left_semi").select("id", F.concat(F.lit("group:"), F.coalesce("parent_id", F.lit("external"))).alias("group"))
    groups = folded.groupBy(F.col("group").alias("id")).agg(F.count("*").alias("members"))
    a, b = folded.select(F.col("id").alias("src"), F.col("group").alias("ga")), folded.select(F.col("id").alias("dst"), F.col("group").alias("gb"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ga", "src").alias("src"), F.coalesce("gb", "dst").alias("dst"), "type").where("src <> dst").distinct()
    return groups, moved


def lanes(nodes: DataFrame) -> DataFrame:
    """(id, lane, row): services in the middle lane, stores and brokers right of it, others left; rows by id."""
    from pyspark.sql import Window as W

    lane = F.when(F.col("kind") == "service", 1).when(F.col("kind").isin("broker", "database", "cache", "storage", "search"), 2).otherwise(0)
    return nodes.select("id", lane.alias("lane"), (F.row_number().over(W.partitionBy("kind").orderBy("id")) - 1).cast("long").alias("row"))


OVERVIEW_UI = ["ui_app", "ui_module", "ui_route", "ui_screen"]
DRILL_UI = ["ui_frame", "ui_component", "ui_control"]
CROSS_UI = ["navigates_to", "invokes_api", "opens_flow", "uses_style", "binds_field"]


def ui_overview(app_id: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): an app's overview kinds below it; edges among them, and service bindings out of them."""
    from .graph import subtree

    inside = nodes.join(subtree(nodes, nodes.where(F.col("id") == app_id)).select("id"), "id", "left_semi").where(F.col("kind").isin(OVERVIEW_UI))
    bound = edges.where("type = 'binds_service'").join(inside.select(F.col("id").alias("src")), "src", "left_semi").select(edges.columns)
    return inside, within(edges, inside).unionByName(bound).dropDuplicates(["id"])


def ui_screen(screen_id: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes below the screen, its ancestors from the root down, edges that leave it)."""
    from .graph import ancestors, subtree

    own = nodes.where(F.col("id") == screen_id)
    inside = nodes.join(subtree(nodes, own).select("id"), "id", "left_semi")
    crumbs = ancestors(nodes, own).select(F.col("ancestor").alias("id"), "depth").orderBy(F.col("depth").desc())
    cross = incident(edges.where(F.col("type").isin(CROSS_UI)), inside)
    return inside, crumbs, cross


def api_binds(node_id: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """invokes_api edges at a node, or anywhere below a screen, component or frame."""
    from .graph import subtree

    own = nodes.where(F.col("id") == node_id)
    wide = own.where(F.col("kind").isin("ui_screen", "ui_component", "ui_frame"))
    members = own.select("id").unionByName(subtree(nodes, wide).select("id")).distinct()
    return incident(edges.where("type = 'invokes_api'"), members)


def route_cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, route, screen_id, screen): a card for each screen that a route contains."""
    routes = nodes.where("kind = 'ui_route'").select(F.col("id").alias("route_id"), F.col("name").alias("route"))
    screens = nodes.where("kind = 'ui_screen'").select(F.col("id").alias("screen_id"), F.col("name").alias("screen"))
    held = edges.where("type = 'contains'").select(F.col("src").alias("route_id"), F.col("dst").alias("screen_id")).distinct()
    return held.join(routes, "route_id").join(screens, "screen_id").select("route_id", "route", "screen_id", "screen")


def drill_cards(focus_id: str, nodes: DataFrame) -> DataFrame:
    """Nodes below a focus that a drill-down shows: frames, components and controls."""
    from .graph import subtree

    below = subtree(nodes, nodes.where(F.col("id") == focus_id)).where("depth > 0").select("id")
    return nodes.where(F.col("kind").isin(DRILL_UI)).join(below, "id", "left_semi")


def view(nodes: DataFrame, edges: DataFrame, focus_id: str | None = None, resolve_from: str | None = None, layer: str = "system", max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, status): the focused view that the ids ask for, else the root overview."""
    from .graph import affiliated_roots, code_of_service, nearest_ancestor

    status = "none"
    if resolve_from:
        start = nodes.where(F.col("id") == resolve_from).first()
        if start is None:
            focus_id, status = None, "system_fallback"
        elif start["layer"] == "code":
            focus_id, status = resolve_from, "exact_code"
        elif start["kind"] in (*PEER_KINDS, "message_topic"):
            focus_id, status = resolve_from, "exact"
        else:
            found = nearest_ancestor(nodes, nodes.where(F.col("id") == resolve_from), "service").first()
            focus_id, status = (found["ancestor"], "resolved_service") if found else (None, "system_fallback")
    elif focus_id:
        status = "exact"
    focus = nodes.where(F.col("id") == focus_id).first() if focus_id else None
    if focus is None:
        return *root_overview(nodes, edges, max_nodes, max_edges), status if not focus_id else "none"
    if focus["layer"] == "code":
        return *focused(focus_id, inside_of_code(focus.asDict(), nodes), nodes, edges, max_nodes, max_edges, "code"), status
    if focus["kind"] == "service" and layer == "code":
        roots = affiliated_roots(nodes, code_of_service(focus_id, focus["name"], nodes, edges))
        return *focused(focus_id, roots, nodes, edges, max_nodes, max_edges, "code"), status
    return *focused(focus_id, inside_of_system(focus.asDict(), nodes, edges), nodes, edges, max_nodes, max_edges), status
