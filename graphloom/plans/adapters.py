"""Adapters: facts of one extractor -> (nodes, edges) of the graph, as frame-to-frame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, code_id, fit_id, language_of, posix, service_hint, system_edge_id, unscoped_key
from ..functions.text import grpc_name, http_path
from ..operators.calls import usage_edges
from ..operators.dedupe import stable_ids
from ..operators.joins import resolve_parents
from ..operators.routes import included_routes
from ..operators.states import state_urls
from .lineage import table

NODE = ["id", "parser_id", "kind", "name", "qualified_name", "language", "path", "parent_id", "layer", "http_method", "http_path"]
EDGE = ["id", "parser_id", "type", "src", "dst", "path", "layer", "protocol"]
COMPOSE = "docker-compose.yml"
Adapter = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
ADAPTERS: dict[str, Adapter] = {}
#: Parsers whose adapters write the facts themselves.
WRITTEN = {"python", "cpp", "java", "csharp", "typescript", "python-api-routes", "react-ui", "angular-ui", "angularjs-ui"}


def adapter(*parser_ids: str) -> Callable[[Adapter], Adapter]:
    def add(f: Adapter) -> Adapter:
        for p in parser_ids:
            ADAPTERS[p] = f
        return f

    return add


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def service_key(path: Column) -> Column:
    """Stable key of the service that a source path belongs to: its first telling folder, else one of its own."""
    hint = service_hint(path)
    return F.when(hint.isNotNull(), F.concat(F.lit(COMPOSE + "#"), hint)).otherwise(unscoped_key(path))


def service_id(path: Column) -> Column:
    return F.concat(F.lit("compose:service:"), service_key(path))


def nodes_of(df: DataFrame, id_: Column, kind: Column | str, name: Column, *, qualified: Column | None = None, language: Column | str = "system", parent: Column | None = None, layer: str = "system", method: Column | None = None, route: Column | None = None) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    null = F.lit(None).cast("string")
    return df.select(
        fit_id(id_).alias("id"), "parser_id", text(kind).alias("kind"), name.alias("name"), (name if qualified is None else qualified).alias("qualified_name"), text(language).alias("language"), posix(F.col("path")).alias("path"),
        (null if parent is None else parent).alias("parent_id"), F.lit(layer).alias("layer"), (null if method is None else method).alias("http_method"), (null if route is None else route).alias("http_path"),
    ).dropDuplicates(["id"])


def edges_of(df: DataFrame, type_: Column | str, src: Column, dst: Column, *, layer: str = "system", protocol: str | None = None, salt: Column | None = None) -> DataFrame:
    type_ = F.lit(type_) if isinstance(type_, str) else type_
    end = dst if salt is None else F.concat_ws("|", dst, salt)
    rows = df.select(system_edge_id(F.col("parser_id"), type_, src, end).alias("id"), "parser_id", type_.alias("type"), fit_id(src).alias("src"), fit_id(dst).alias("dst"), posix(F.col("path")).alias("path"), F.lit(layer).alias("layer"), F.lit(protocol).cast("string").alias("protocol"))
    return rows.where("src is not null and dst is not null").dropDuplicates(["id"])


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


CODE = ["module", "namespace", "class", "interface", "function", "method", "property", "field", "variable", "enum"]


def symbol_rows(facts: DataFrame) -> DataFrame:
    """Declarations with the stable ids of their nodes; the fact is their kind."""
    rows = facts.where(F.col("fact").isin(CODE)).withColumn("base", code_id(F.col("parser_id"), F.col("path"), F.col("fact"), F.col("qualified_name")))
    return stable_ids(rows, "base", ["line", "name"]).withColumnRenamed("fact", "kind")


@adapter("python", "cpp", "java", "csharp", "typescript")
def symbols(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code nodes with parents; edges for imports and exports, for bases whose names stand once, and for calls and injections between unique names."""
    facts = table(facts, "facts")  # files are read once
    rows = symbol_rows(facts)
    parents = resolve_parents(rows.select("id", "path", "kind", "qualified_name", F.col("parent").alias("parent_qualified_name")))
    rows = table(rows.join(parents, "id", "left"), "symbols")
    nodes = nodes_of(rows, F.col("id"), F.col("kind"), F.col("name"), qualified=F.col("qualified_name"), language=F.coalesce(language_of(F.col("path")), "parser_id"), parent=F.col("parent_id"), layer="code")
    modules = rows.where("kind = 'module'").select(F.col("path").alias("p"), F.col("id").alias("src"))
    named = rows.where(F.col("kind").isin("module", "namespace", "class", "interface")).select("kind", "qualified_name", "name", F.col("id").alias("dst"))
    target = named.where("kind in ('module', 'namespace')").groupBy(F.col("qualified_name").alias("t")).agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1")
    imported = facts.where("fact in ('imports', 'exports')").join(modules, F.col("path") == F.col("p"))
    imported = imported.select("*", F.explode(F.split(F.coalesce(attr("modules"), "target"), " ")).alias("candidate"))  # a TypeScript path can mean a file or a folder's index
    imports = edges_of(imported.join(target, F.col("candidate") == F.col("t")), F.col("fact"), F.col("src"), F.col("dst"), layer="code")
    types = named.where("kind in ('class', 'interface')").groupBy("name").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").withColumnRenamed("name", "t")
    owners = rows.where(F.col("kind").isin("class", "interface")).select(F.col("qualified_name").alias("q"), F.col("path").alias("p"), F.col("id").alias("src"))
    bases = facts.where(F.col("fact").isin("inherits", "implements")).join(owners, (F.col("qualified_name") == F.col("q")) & (F.col("path") == F.col("p"))).join(types, F.col("target") == F.col("t"))
    used = usage_edges(facts, rows.select("id", "qualified_name")).join(rows.select(F.col("id").alias("i"), "parser_id", "path"), F.col("src") == F.col("i"))
    calls = edges_of(used.select("parser_id", F.col("src").alias("a"), F.col("dst").alias("b"), "type", "path"), F.col("type"), F.col("a"), F.col("b"), layer="code")
    return nodes, imports.unionByName(edges_of(bases, F.col("fact"), F.col("src"), F.col("dst"), layer="code")).unionByName(calls)


@adapter("compose")
def compose(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    sid = lambda name: F.concat(F.lit("compose:service:"), F.col("path"), F.lit("#"), F.lower(name))
    services = facts.where("fact = 'service'")
    known = services.select(F.col("path").alias("p"), F.lower("name").alias("k")).distinct()
    infra = facts.where("fact = 'infrastructure'")
    iid = F.concat_ws(":", F.lit("compose"), attr("kind"), F.concat(F.col("path"), F.lit("#"), F.lower("name")))
    needs = facts.where("fact = 'depends_on'").join(known, (F.col("path") == F.col("p")) & (F.lower("target") == F.col("k")))
    backed = infra.select(F.col("path").alias("p2"), F.lower("name").alias("k2"), iid.alias("iid"))
    uses = needs.join(backed, (F.col("path") == F.col("p2")) & (F.col("k") == F.col("k2")))
    nodes = union(nodes_of(services, sid(F.col("name")), "service", F.col("name")), nodes_of(infra, iid, attr("kind"), F.col("name")))
    return nodes, union(edges_of(needs, "depends_on", sid(F.col("name")), sid(F.col("target"))), edges_of(uses, "connects_to", sid(F.col("name")), F.col("iid")))


@adapter("appsettings", "spring-config")
def settings(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores and buses that settings name, by kind, engine and host, tied to the service of the file."""
    rows = facts.where("fact = 'datasource' or (fact = 'binding' and attrs['type'] in ('database', 'cache', 'broker', 'search', 'storage'))")
    kind = F.coalesce(attr("type"), F.lit("database"))
    id_ = F.concat_ws(":", "parser_id", kind, attr("engine"), F.lower(F.coalesce("target", "name")))
    owners = nodes_of(facts.where("fact = 'port'"), service_id(F.col("path")), "service", F.coalesce(service_hint(F.col("path")), "path"))
    return union(nodes_of(rows, id_, kind, F.coalesce("target", "name")), owners), edges_of(rows, "connects_to", service_id(F.col("path")), id_)


def endpoint_id(parser: Column, key: Column, method: Column, path: Column) -> Column:
    return F.concat(parser, F.lit(":http_endpoint:"), F.concat_ws("|", key, method, path))


@adapter("openapi")
def openapi(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    api = F.concat_ws(":", F.lit("openapi:external_api"), F.col("path"))
    rows = facts.where("fact = 'endpoint'")
    id_ = endpoint_id(F.col("parser_id"), service_key(F.col("path")), attr("method"), http_path(F.col("target")))
    specs = nodes_of(facts.where("fact = 'spec'"), api, "external_api", F.col("name"))
    ends = nodes_of(rows, id_, "http_endpoint", F.col("name"), parent=service_id(F.col("path")), method=attr("method"), route=http_path(F.col("target")))
    return union(specs, ends), union(edges_of(rows, "documents", api, id_), edges_of(rows, "exposes", service_id(F.col("path")), id_))


@adapter("dotnet-project")
def dotnet_project(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    pid = lambda path: F.concat(F.lit("dotnet-project:dotnet_project:"), path)
    projects = facts.where("fact = 'project'")
    refs = facts.where("fact = 'project_reference'")
    by_name = projects.groupBy(F.col("name").alias("n")).agg(F.min("path").alias("by_name"), F.count("*").alias("c")).where("c = 1").drop("c")
    by_path = projects.select(F.col("path").alias("by_path"))
    found = refs.join(by_path, F.col("target") == F.col("by_path"), "left").join(by_name, F.col("name") == F.col("n"), "left")
    return nodes_of(projects, pid(F.col("path")), "dotnet_project", F.col("name"), language="csharp"), edges_of(found, "project_reference", pid(F.col("path")), pid(F.coalesce("by_path", "by_name")))


@adapter("maven-project", "gradle-project")
def build_modules(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runnable modules as services."""
    rows = facts.where("fact = 'module' and attrs['boot'] = 'true'")
    nodes = nodes_of(rows, F.concat(F.lit("compose:service:" + COMPOSE + "#"), F.lower("name")), "service", F.col("name"), language="java")
    return nodes, edges_of(rows.limit(0), "depends_on", F.col("name"), F.col("name"))


@adapter("bus-rabbit", "bus-kafka")
def bus(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = facts.where("fact = 'handler'")
    language = F.coalesce(language_of(F.col("path")), F.lit("csharp"))
    message = F.concat_ws(":", "parser_id", F.lit("message_type"), "name")
    topic = F.concat_ws(":", "parser_id", F.lit("message_topic"), "target")
    role = F.when(attr("role") == "producer", "publishes").otherwise("consumes")
    nodes = union(nodes_of(rows.where("name is not null"), message, "message_type", F.col("name"), language=language), nodes_of(rows.where("target is not null"), topic, "message_topic", F.col("target"), language=language))
    end = F.when(F.col("target").isNotNull(), topic).otherwise(message)
    handled = rows.where("attrs['method'] is not null and name is not null")
    return nodes, union(edges_of(rows, role, service_id(F.col("path")), end), edges_of(handled, "rpc_handles", service_id(F.col("path")), message))


@adapter("python-api-routes")
def python_api_routes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decorated handlers, and url patterns with the prefixes of all files that include theirs."""
    facts = table(facts, "facts")
    return api_routes(facts.where("fact = 'route'").unionByName(included_routes(facts)))


@adapter("ts-api-routes", "dotnet-api-routes", "java-api-routes")
def api_routes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = facts.where("fact = 'route'")
    id_ = endpoint_id(F.col("parser_id"), service_key(F.col("path")), attr("method"), F.col("target"))
    nodes = nodes_of(rows, id_, "http_endpoint", F.col("name"), language=F.coalesce(language_of(F.col("path")), F.lit("system")), parent=service_id(F.col("path")), method=attr("method"), route=F.col("target"))
    return nodes, edges_of(rows, "exposes", service_id(F.col("path")), id_)


@adapter("ts-http-calls", "dotnet-http-calls", "java-http-calls", "python-http-calls")
def http_calls(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with a callee go to that service's endpoint, those with a host to an external API; of others only
    client-side calls are kept, on the backend's endpoint. TypeScript and Java calls carry no protocol."""
    rows = facts.where("fact = 'http_call'")
    host = F.regexp_extract("target", r"^[a-z]+://([^/:?#{}]+)", 1)
    route = http_path(F.regexp_replace("target", r"^[a-z]+://[^/]*", ""))
    callee = F.coalesce(attr("callee"), F.when(F.col("parser_id") == "ts-http-calls", "backend"))
    inside = endpoint_id(F.lit("ts-api-routes"), F.concat(F.lit(COMPOSE + "#"), F.lower(callee)), attr("method"), route)
    outside = F.concat(F.col("parser_id"), F.lit(":external_api:"), host)
    dst = F.when(callee.isNotNull(), inside).when(host != "", outside)
    external = rows.where(callee.isNull() & (host != "") & (F.col("parser_id") != "java-http-calls"))
    kept = rows.where(callee.isNotNull() | (host != "") & (F.col("parser_id") != "java-http-calls"))
    plain = F.col("parser_id").isin("ts-http-calls", "java-http-calls")
    salt = F.concat_ws(":", "path", F.col("line").cast("string"))
    edges = edges_of(kept.where(plain), "http_calls", service_id(F.col("path")), dst, salt=salt).unionByName(edges_of(kept.where(~plain), "http_calls", service_id(F.col("path")), dst, protocol="http", salt=salt))
    return nodes_of(external, outside, "external_api", host), edges


@adapter("grpc-proto")
def grpc_proto(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    api = lambda c: F.concat(F.lit("grpc-proto:external_api:"), c)
    methods = facts.where("fact = 'grpc_method'")
    id_ = F.concat(F.lit("grpc-proto:grpc_method:"), F.col("qualified_name"))
    nodes = union(nodes_of(facts.where("fact = 'grpc_service'"), api(F.col("name")), "external_api", F.col("name")), nodes_of(methods, id_, "grpc_method", F.col("name"), qualified=F.col("qualified_name"), parent=api(F.col("parent"))))
    return nodes, union(edges_of(methods, "documents", api(F.col("parent")), id_), edges_of(methods, "exposes", service_id(F.col("path")), id_, protocol="grpc"))


@adapter("ts-grpc-calls", "java-grpc-calls", "dotnet-grpc-calls", "python-grpc-calls")
def grpc_calls(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = facts.where("fact = 'grpc_call'")
    dst = F.concat(F.lit("grpc-proto:grpc_method:"), grpc_name(attr("service")), F.lit("/"), F.regexp_replace(attr("method"), "Async$", ""))
    return nodes_of(rows.limit(0), F.col("name"), "grpc_method", F.col("name")), edges_of(rows, "http_calls", service_id(F.col("path")), dst, protocol="grpc", salt=F.col("path"))


@adapter("react-ui")
def react(facts: DataFrame, endpoints: DataFrame | None = None, kinds: list[str] | None = None, app: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The trees of all React applications, or of one; endpoints: (method, template, endpoint), known ends of their calls; kinds: nodes that are asked, all if not given."""
    from .react_tree import tree

    null = F.lit(None).cast("string")
    nodes, edges = tree(facts, endpoints, kinds, app)
    fixed = {"parser_id": F.lit("react-ui"), "qualified_name": F.coalesce("signature", "name"), "language": F.lit("ui"), "layer": F.lit("ui"), "http_method": null, "http_path": null}
    return nodes.withColumns(fixed).select(NODE), edges.withColumns({"parser_id": F.lit("react-ui"), "layer": F.lit("ui"), "protocol": null}).select(EDGE)


@adapter("angular-ui", "angularjs-ui")
def ui(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An app for each file's folder; what it declares hangs below it, controls below their file's screen or component."""
    folder = F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    app = F.concat(F.col("parser_id"), F.lit(":ui_app:"), folder)
    id_ = F.concat_ws(":", "parser_id", "fact", "path", F.coalesce("name", F.lit("")))
    facts = table(facts, "facts")
    named = state_urls(facts.where("fact = 'ui_route' and attrs['state'] is not null").select(folder.alias("app"), F.col("target").alias("state"), F.col("parent").alias("above"), attr("url").alias("url")))
    # A state is a route under its whole url; an abstract one is none.
    rows = facts.where(F.col("fact").startswith("ui_") & (F.coalesce(attr("abstract"), F.lit("")) != "true"))
    rows = rows.join(named.withColumnsRenamed({"app": "s_app", "state": "s_state"}), (folder == F.col("s_app")) & (attr("state") == F.col("s_state")), "left")
    rows = rows.withColumn("name", F.when(attr("url").isNotNull(), F.coalesce("full", "name")).otherwise(F.col("name"))).select(facts.columns)
    owners = rows.where(F.col("fact").isin("ui_screen", "ui_component")).groupBy(F.col("path").alias("p")).agg(F.min_by(id_, F.struct("line", "name")).alias("owner"))
    below = rows.join(owners, F.col("path") == F.col("p"), "left").withColumn("above", F.when(F.col("fact").isin("ui_control", "ui_style") & F.col("owner").isNotNull(), F.col("owner")).otherwise(app))
    nodes = union(nodes_of(rows, app, "ui_app", folder, language="ui", layer="ui"), nodes_of(below, id_, F.col("fact"), F.col("name"), language="ui", parent=F.col("above"), layer="ui"))
    screens = rows.where(F.col("fact").isin("ui_screen", "ui_component")).select(F.col("name").alias("s"), id_.alias("screen"))
    shown = rows.where("fact = 'ui_route'").join(screens, F.col("target") == F.col("s"))
    calls = facts.where("fact = 'invokes_api'").join(owners, F.col("path") == F.col("p"))
    target = endpoint_id(F.lit("ts-api-routes"), F.lit(COMPOSE + "#backend"), attr("method"), http_path(F.col("target")))
    moves = facts.where("fact = 'navigates_to'").join(owners, F.col("path") == F.col("p")).join(rows.where("fact = 'ui_route'").select(F.col("name").alias("r"), id_.alias("route")), F.col("target") == F.col("r"))
    edges = union(
        edges_of(below.where("fact <> 'ui_style'"), "contains", F.col("above"), id_, layer="ui"), edges_of(below.where("fact = 'ui_style'"), "uses_style", F.col("above"), id_, layer="ui"),
        edges_of(shown, "contains", id_, F.col("screen"), layer="ui"), edges_of(calls, "invokes_api", F.col("owner"), target, layer="ui"), edges_of(moves, "navigates_to", F.col("owner"), F.col("route"), layer="ui"),
        edges_of(rows, "binds_service", app, service_id(F.col("path")), layer="ui"),
    )
    return nodes, edges


def run(files: DataFrame, parser_id: str) -> tuple[DataFrame, DataFrame]:
    """Extract and adapt in one go: (path, text) -> (nodes, edges)."""
    from ..sources.extract import extract

    facts = extract(files, parser_id)
    return ADAPTERS[parser_id](facts if parser_id in WRITTEN else table(facts, "facts"))  # nodes and edges ask the facts several times; files are read once
