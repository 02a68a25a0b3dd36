"""React applications from the facts of all their files: apps, routes, screens with their parts, and what they call.

A package.json that needs React is an application's root; files belong to every root above them.  Routes come from the
router files; a route's element is followed through imports to its file, and through a wrapper that returns a ...Page to that
one's.  Screens take over styles, controls, navigation and surfaces of their file (surfaces also of the files that it imports),
and call the API directly or through the helpers that they import from files in ``api`` folders.

All of that are joins on paths and names: a hint without extension becomes a list of candidates, the first that exists is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths, fit_id
from ..functions.text import bound_service
from .lineage import table

PARSER = "react-ui"
#: Where a hint without extension can stand, best first; entries of an application, best first (fixed values).
ENDINGS = ["", ".tsx", ".ts", ".jsx", ".js", "/index.tsx", "/index.ts"]
ENTRIES = ["src/main.tsx", "src/main.jsx", "src/index.tsx", "src/index.jsx"]
#: Files whose presence makes the flow of confirmations (fixed values): step and pattern.
CONFIRMATIONS = [("LanguagesConfirmModal", r"LanguagesConfirmModal\.(tsx|jsx|ts|js)$"), ("ChangesConfirmModal", r"ChangesConfirm(Modal)?\.(tsx|jsx|ts|js)$")]


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def node_id(kind: str, *keys: Column | str) -> Column:
    return fit_id(F.concat(F.lit(f"{PARSER}:{kind}:"), F.concat_ws("/", *keys)))


def titled(name: Column) -> Column:
    """A component's name in words, without Page."""
    bare = F.regexp_replace(name, "Page$", "")
    words = F.trim(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2"))
    return F.coalesce(F.nullif(words, F.lit("")), name)


def route_key(pattern: Column, screen: Column) -> Column:
    """A route's stable key: of a few known paths their own, else its screen's name, else its last segment."""
    p = F.coalesce(F.nullif(F.regexp_replace(pattern, "/+$", ""), F.lit("")), F.lit("/"))
    leaf = F.coalesce(F.nullif(F.regexp_extract(p, r"([^/]*)$", 1), F.lit("")), F.lit("route"))
    named = F.lower(F.regexp_replace(F.regexp_replace(screen, "Page$", ""), "([a-z])([A-Z])", "$1-$2"))
    usable = (screen != "") & ~screen.isin("Navigate", "AppLayout") & (named != "") & (named != "app-layout")
    return (
        F.when(p == "/", "root").when(p.rlike("(?i)graph-ui$"), "graph-ui").when(p.rlike("(?i)graph-view$"), "graph-view").when(p == "/graph", "graph-legacy").when(p.rlike("(?i)/graph$"), "graph")
        .when(p.rlike("(?i)/projects/:[^/]+$"), "workspace").when(p.rlike("(?i)/projects$"), "projects").when(p.rlike("(?i)/import$"), "import")
        .when(usable, named).otherwise(F.replace(leaf, F.lit(":"), F.lit("")))
    )


def existing(hints: DataFrame, files: DataFrame) -> DataFrame:
    """hints (hint) -> (hint, file): the first candidate that is a file; packages and unknown paths have no row.

    Files are named by the hints that could mean them, two or so each; a hint has as many candidates as there are endings.
    """
    own = hints.where("hint is not null and contains(hint, '/') and not startswith(hint, '@')").distinct()
    meant = F.array(*[F.when(F.endswith("path", F.lit(e)), F.struct(F.substr("path", F.lit(1), F.length("path") - len(e)).alias("hint"), F.lit(at).alias("at"))) for at, e in enumerate(ENDINGS)])
    named = files.select("path", F.explode(F.array_compact(meant)).alias("m")).select("path", "m.hint", "m.at")
    return named.join(own, "hint").groupBy("hint").agg(F.min_by("path", "at").alias("file"))


#: Facts of which applications, routes and screens are made, and those of the parts below screens.
ROUTE_FACTS = ["ui_file", "ui_package", "ui_import", "ui_router", "ui_route", "ui_function"]
PART_FACTS = ["ui_surface", "ui_form", "ui_control", "ui_call"]


def tree(facts: DataFrame, endpoints: DataFrame | None = None, kinds: list[str] | None = None, app: str | None = None) -> tuple[DataFrame, DataFrame]:
    """facts of the react-ui extractor -> (nodes, edges).

    nodes: id, kind, name, path, parent_id, signature; edges: id, type, src, dst, path.  endpoints: (method, template, endpoint), known ends of
    calls; calls of others lead to a hint node of their own.  Applications without a route are left out.  Of routes of
    one key the first by file and line stays; a screen of several routes hangs below the first of them.  Facts are written once, by their
    kind; nodes and edges are not, since many ask for one of the two only.

    kinds: only nodes of these kinds, and edges between them (or from them to what is no node of a tree).  app: only the application of this name, whose files may import any others
    (a hint node's path is then the least of its own callers').
    """
    facts = table(facts.select("path", "fact", "name", "qualified_name", "line", "target", "attrs"), "facts", by="fact")
    of = lambda kind: facts.where(F.col("fact") == kind)
    files = of("ui_file").select("path").distinct()
    roots = of("ui_package").select(F.col("target").alias("dir"), "name")
    folder = F.regexp_replace("dir", "^.*/", "")
    apps = roots.select("dir", F.coalesce(F.when(F.col("dir") == ".", F.col("name")).otherwise(folder), F.lit("app")).alias("app"), F.coalesce("name", F.when(F.col("dir") == ".", F.lit("app")).otherwise(F.col("dir"))).alias("title"))
    if app is not None:
        apps = apps.where(F.col("app") == app)

    wanted = lambda *of_: kinds is None or not set(of_).isdisjoint(kinds)
    written = lambda df, name, *of_: table(df, name) if wanted(*of_) else df  # noqa: E731  what is not asked is not computed

    def owned(paths: DataFrame, by: DataFrame) -> DataFrame:
        """(app, dir, path): the applications of files; each step asks for those of few files."""
        return paths.select("path", F.explode(F.concat(ancestor_paths(F.col("path")), F.array(F.lit(".")))).alias("dir")).join(by.select("dir", "app"), "dir").select("app", "dir", "path")

    # Imports with the file that each leads to, for the files that a step asks about.
    imports = of("ui_import").select("path", F.col("name").alias("local"), F.col("target").alias("hint"), attr("exported").alias("exported"))

    def led(paths: DataFrame) -> DataFrame:
        own = imports.join(paths.select("path").distinct(), "path", "left_semi")
        own = own if app is None else table(own, "own")  # those of one application are few, and then known to be
        return own.join(existing(own.select("hint"), files), "hint").select("path", "local", "exported", "file")

    # Routes: of named router files if an application has any, else of all that look like one.
    marked = of("ui_router").groupBy("path").agg(F.max(attr("named")).alias("named"))
    routers = owned(marked, apps).join(marked, "path")
    best = routers.groupBy("app").agg(F.max("named").alias("best"))
    routers = table(routers.join(best, "app").where("named = best").select("app", "path"), "routers")
    routes = of("ui_route").where("not contains(name, '*') and coalesce(target, '') <> 'Navigate'").select("path", "line", F.col("name").alias("pattern"), F.coalesce("target", F.lit("Unknown")).alias("element"))
    routes = routes.join(routers, "path")
    step = routes.join(led(routers).select("path", F.col("local").alias("element"), F.col("file").alias("source")), ["path", "element"], "left")
    bodies = of("ui_function").groupBy(F.col("path").alias("source"), F.col("name").alias("function")).agg(F.max("target").alias("page"), F.count("*").alias("n"))
    own = bodies.where("function is not null").select("source", F.col("function").alias("element"), F.col("page").alias("own_page"), F.lit(True).alias("has_own"))
    whole = bodies.where("function is null").select("source", F.col("page").alias("any_page"))
    step = step.join(own, ["source", "element"], "left").join(whole, "source", "left").withColumn("inner", F.when(F.col("has_own"), F.col("own_page")).otherwise(F.col("any_page")))
    step = table(step, "elements")
    step = step.join(led(step.where("inner is not null").select(F.col("source").alias("path"))).select(F.col("path").alias("source"), F.col("local").alias("inner"), F.col("file").alias("inner_file")), ["source", "inner"], "left")
    step = step.select("app", "path", "line", "pattern", F.coalesce("inner", "element").alias("screen"), F.coalesce("inner_file", "source", "path").alias("source")).withColumn("key", route_key(F.col("pattern"), F.col("screen")))
    first = F.row_number().over(W.partitionBy("app", "key").orderBy("path", "line", "pattern", "screen"))
    routes = table(step.withColumn("nth", first).where("nth = 1").drop("nth"), "routes")
    live = routes.select("app").distinct()
    apps = live_apps = apps.join(live, "app", "left_semi")
    entry = owned(files.where(" or ".join(f"endswith(path, '{e}')" for e in ENTRIES)), live_apps).select("app", "path", F.posexplode(F.array(*[F.when(F.col("dir") == ".", F.lit(e)).otherwise(F.concat("dir", F.lit("/" + e))) for e in ENTRIES])).alias("at", "entry")).where("path = entry").groupBy("app").agg(F.min_by("path", "at").alias("entry"))
    apps = written(apps.join(entry, "app", "left").select("app", "dir", "title", F.coalesce("entry", F.concat("app", F.lit("/"))).alias("path"), "entry"), "apps", "ui_app")
    screens = routes.groupBy("app", "screen").agg(F.min_by(F.struct("key", "source"), F.struct("path", "line", "pattern")).alias("r")).select("app", "screen", F.col("r.key").alias("route"), F.col("r.source").alias("path"))
    screens = table(screens, "screens")
    parts = lambda kind: screens.join(of(kind), "path")
    led_on = written(led(screens), "imports", "ui_surface", "ui_frame", "ui_component", "ui_control")

    null = F.lit(None).cast("string")
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []

    def node(df: DataFrame, kind: str, id_: Column, name: Column, parent: Column | None, signature: Column | None = None, above: str = "ui_screen") -> None:
        rows = df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), "path", (null if parent is None else parent).alias("parent_id"), (null if signature is None else signature).alias("signature"))
        if not wanted(kind):
            return
        nodes.append(rows)
        if parent is not None and wanted(above):
            edges.append(rows.select(F.lit("contains").alias("type"), F.col("parent_id").alias("src"), F.col("id").alias("dst"), "path"))

    def edge(df: DataFrame, type_: str, src: Column, dst: Column, *ends: str) -> None:
        if all(map(wanted, ends)):
            edges.append(df.select(F.lit(type_).alias("type"), src.alias("src"), dst.alias("dst"), "path"))

    app_id = node_id("ui_app", "app")
    screen_id = node_id("ui_screen", "app", "screen")
    node(apps, "ui_app", app_id, F.col("title"), None)
    edge(apps, "binds_service", app_id, bound_service(F.col("app"), F.col("title"), F.coalesce("entry", "app")), "ui_app")
    inside = owned(files.where("contains(path, 'src/components/')"), live_apps).select("app", "dir", F.regexp_extract("path", r"(?:^|.*/)src/components/([^/]+)/", 1).alias("module"), F.regexp_extract("path", r"^(.*?src/components/[^/]+)/", 1).alias("path"))
    inside = inside.where(F.col("path") == F.concat(F.when(F.col("dir") == ".", F.lit("")).otherwise(F.concat("dir", F.lit("/"))), F.lit("src/components/"), F.col("module"))).where("module <> ''").distinct()
    node(inside, "ui_module", node_id("ui_module", "app", "module"), F.col("module"), app_id, above="ui_app")
    node(routes, "ui_route", node_id("ui_route", "app", "key"), F.col("pattern"), app_id, F.col("pattern"), "ui_app")
    node(screens, "ui_screen", screen_id, titled(F.col("screen")), node_id("ui_route", "app", "route"), F.col("screen"), "ui_route")

    at = existing(parts("ui_style").select(F.col("target").alias("hint")), files)
    styles = parts("ui_style").join(at.withColumnRenamed("hint", "h"), F.col("target") == F.col("h"), "left").withColumn("sheet", F.coalesce("file", "target"))
    style_key = F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("sheet", "^.*/", ""), r"(?i)\.module\.css$", "-module"), r"(?i)\.css$", ""), F.lit("."), F.lit("-"))
    styles = written(styles.select("app", "screen", "path", "sheet", style_key.alias("style"), attr("kind").alias("style_kind")), "styles", "ui_style")
    sheets = styles.groupBy("app", "style").agg(F.min(F.struct("sheet", "style_kind")).alias("s")).select("app", "style", F.col("s.sheet").alias("path"), F.col("s.style_kind").alias("style_kind"))
    node(sheets, "ui_style", node_id("ui_style", "app", "style"), F.col("style"), app_id, F.col("style_kind"), "ui_app")
    edge(styles, "uses_style", screen_id, node_id("ui_style", "app", "style"), "ui_screen", "ui_style")

    goes = parts("ui_navigation").select("app", "screen", "path", F.regexp_replace("name", r"\$\{[^}]+\}", ":param").alias("to"))
    slashed = F.concat(F.lit("/"), F.array_join(F.filter(F.split("to", "/"), lambda x: (x != "") & (x != ".")), "/"))
    goes = goes.withColumn("key", route_key(slashed, F.lit(""))).join(routes.select("app", "key"), ["app", "key"])
    edge(goes, "navigates_to", screen_id, node_id("ui_route", "app", "key"), "ui_screen", "ui_route")

    near = screens.select("app", "screen", "path", F.col("path").alias("file")).unionByName(screens.join(led_on.select("path", "file"), "path").select("app", "screen", "path", "file"))
    surfaces = near.join(of("ui_surface").select(F.col("path").alias("file"), F.col("name").alias("surface"), F.col("qualified_name").alias("surface_key"), F.col("target").alias("library"), attr("frame").alias("frame"), attr("title").alias("title")), "file").drop("file").distinct()
    surfaces = written(surfaces, "surfaces", "ui_surface", "ui_frame")
    node(surfaces, "ui_surface", node_id("ui_surface", "app", "screen", "surface_key"), F.col("surface"), screen_id, F.col("library"))
    main = screens.select("app", "screen", "path", F.lit("main").alias("frame"), F.lit("Main").alias("title"))
    frames = main.unionByName(surfaces.select("app", "screen", "path", "frame", "title"))
    node(frames, "ui_frame", node_id("ui_frame", "app", "screen", "frame"), F.col("title"), screen_id, F.col("frame"))

    forms = of("ui_form").select("path", F.lit("form").alias("hint")).distinct()
    controls = written(parts("ui_control").select("app", "screen", "path", F.col("name").alias("control"), F.col("target").alias("field"), attr("kind").alias("control_kind")), "controls", "ui_component", "ui_control")
    ui = controls.select("app", "screen", "path").distinct().join(forms, "path", "left")
    own_id = lambda what: node_id("ui_component", "app", "screen", F.concat("screen", F.lit(f"-{what}")))
    node(ui, "ui_component", own_id("ui"), F.concat(titled(F.col("screen")), F.lit(" UI")), screen_id, F.coalesce("hint", F.lit("other")))
    shown = F.when(F.startswith("control", F.concat("control_kind", F.lit("-"))), F.array_join(F.transform(F.split(F.substr("control", F.length("control_kind") + 2), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")).otherwise(F.col("control"))
    control_id = node_id("ui_control", "app", "screen", F.concat("screen", F.lit("-ui")), "control")
    node(controls, "ui_control", control_id, shown, own_id("ui"), F.col("control_kind"), "ui_component")
    fields = controls.where("field is not null")
    field_id = node_id("ui_control", "app", F.concat(F.lit("field:"), "field"))
    node(fields.groupBy("app", "field").agg(F.min("path").alias("path")), "ui_control", field_id, F.col("field"), None, F.lit("field"))
    edge(fields, "binds_field", control_id, field_id, "ui_control")

    # Calls: through imported helpers of api files, and the screen's own.
    helpers = of("ui_call").where("qualified_name is not null").select(F.col("path").alias("file"), F.col("qualified_name").alias("exported"), F.col("name").alias("method"), F.col("target").alias("template"))
    through = screens.join(led_on, "path").join(helpers, ["file", "exported"]).select("app", "screen", "path", "method", "template")
    direct = parts("ui_call").select("app", "screen", "path", F.col("name").alias("method"), F.col("target").alias("template"))
    calls = written(through.unionByName(direct).distinct(), "calls", "ui_component", "ui_control")
    node(calls.select("app", "screen", "path").distinct(), "ui_component", own_id("api"), F.concat(titled(F.col("screen")), F.lit(" API")), screen_id, F.lit("other"))
    slugged = F.coalesce(F.nullif(F.lower(F.regexp_replace(F.regexp_replace("template", "[^a-zA-Z0-9]+", "-"), "^-|-$", "")), F.lit("")), F.lit("path"))
    calls = calls.withColumn("key", F.concat_ws("-", F.lit("api"), "method", slugged, (F.row_number().over(W.partitionBy("app", "screen").orderBy("method", "template")) - 1).cast("string")))
    call_id = node_id("ui_control", "app", "screen", F.concat("screen", F.lit("-api")), "key")
    node(calls, "ui_control", call_id, F.concat_ws(" ", "method", "template"), own_id("api"), F.lit("other"), "ui_component")

    # Flows: confirmations, if an application has their files; they call what its analysis helpers do.
    told = [p for _, p in CONFIRMATIONS] + [r"AnalysisProvider\.(tsx|jsx)$"]
    steps = owned(files.where(F.col("path").rlike("|".join(told))), live_apps).select("app", "path", *[F.col("path").rlike(p).alias(f"s{i}") for i, (_, p) in enumerate(CONFIRMATIONS)], F.col("path").rlike(told[-1]).alias("provider"))
    flows = steps.groupBy("app").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(CONFIRMATIONS))], F.min(F.when(F.col("provider"), F.col("path"))).alias("p"), F.min(F.when(F.col("s0") | F.col("s1"), F.col("path"))).alias("q")).where("s0 or s1")
    flows = flows.select("app", F.coalesce("p", "q").alias("path"), F.array_join(F.array_compact(F.array(*[F.when(F.col(f"s{i}"), F.lit(s)) for i, (s, _) in enumerate(CONFIRMATIONS)], F.lit("progress"))), ",").alias("steps"))
    flow_id = node_id("ui_flow", "app", F.lit("analysis-confirm"))
    node(flows, "ui_flow", flow_id, F.lit("Analysis confirm"), app_id, F.col("steps"), "ui_app")
    runs = owned(files.where("path rlike '(?i)/api/analysis[.]'"), live_apps).select("app", F.col("path").alias("file")).join(helpers, "file").where("template rlike '(?i)analysis/runs'").select("app", "method", "template").distinct()
    asked = calls.select("path", "method", "template", call_id.alias("src")).unionByName(flows.join(runs, "app").select("path", "method", "template", flow_id.alias("src")))
    known = asked.join(endpoints.select("method", "template", "endpoint"), ["method", "template"], "left") if endpoints is not None else asked.withColumn("endpoint", null)
    hint = fit_id(F.concat(F.lit(f"{PARSER}:api_hint:"), F.concat_ws(":", "method", "template")))
    edge(known, "invokes_api", F.col("src"), F.coalesce("endpoint", hint), "ui_control")
    open_ = known.where("endpoint is null").groupBy("method", "template").agg(F.min("path").alias("path"))
    node(open_, "ui_control", hint, F.concat_ws(" ", "method", "template"), None, F.concat_ws(" ", "method", "template"))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    none = apps.select(*[null.alias(n) for n in ("type", "src", "dst", "path")]).limit(0)
    all_edges = union(edges or [none]).withColumn("id", fit_id(F.concat(F.lit(f"{PARSER}:"), "type", F.lit(":"), "src", F.lit("->"), "dst")))
    # an id names its kind or type: as a second key they let a filter by it pass, so that what it leaves out is not computed
    return union(nodes).dropDuplicates(["id", "kind"]), all_edges.dropDuplicates(["id", "type"])
