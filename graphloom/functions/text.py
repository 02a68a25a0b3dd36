"""Expressions on urls, configuration values and calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def http_path(path: Column) -> Column:
    """Decoded (as it stands if that fails), without query, fragment and trailing slash, with a leading slash."""
    bare = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), r"[?#].*$", "")
    cut = F.regexp_replace(bare, "/+$", "")
    return F.when(cut == "", "/").when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))


def join_paths(*parts: Column) -> Column:
    """Route pieces joined by single slashes, with a leading one and no trailing one."""
    joined = F.regexp_replace(F.concat_ws("/", F.lit(""), *parts), "/+", "/")
    return F.when(joined.isin("", "/"), "/").otherwise(F.regexp_replace(joined, "/$", ""))


def template_path(path: Column) -> Column:
    """``${x}`` and ``{x}`` become ``:x``."""
    return F.regexp_replace(path, r"\$?\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}", ":$1")


def braces_path(path: Column) -> Column:
    """``:x`` and ``${x}`` become ``{x}``."""
    return F.regexp_replace(F.regexp_replace(path, r"\$\{\s*([A-Za-z0-9_.]+)\s*\}", "{$1}"), r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")


def redact(value: Column) -> Column:
    """Passwords, users and tokens of settings are masked."""
    for key in ("password|pwd", "user id|username|user|uid", "token|secret|apikey|api_key"):
        value = F.regexp_replace(value, rf"(?i)\b({key})\s*=\s*[^;&\s]+", "$1=***")
    return F.regexp_replace(value, r"://[^/@\s:]+:[^/@\s]+@", "://***:***@")


def engine_of(key: Column, value: Column) -> Column:
    """Store or bus engine that a setting names; the first match counts."""
    both = F.lower(F.concat_ws(" ", key, value))
    out = F.lit(None).cast("string")
    for engine, pattern in reversed([("postgresql", "postgres|npgsql"), ("mysql", "mysql|mariadb"), ("mssql", "sqlserver|mssql|initial catalog"), ("mongodb", "mongo"), ("redis", "redis"), ("rabbitmq", "rabbit|amqp"), ("kafka", "kafka"), ("elasticsearch", "elastic"), ("minio", "minio|s3")]):
        out = F.when(both.rlike(pattern), engine).otherwise(out)
    return out


def binding_type(key: Column, value: Column) -> Column:
    engine = engine_of(key, value)
    return (
        F.when(engine.isin("postgresql", "mysql", "mssql", "mongodb"), "database").when(engine == "redis", "cache").when(engine.isin("rabbitmq", "kafka"), "broker")
        .when(engine == "elasticsearch", "search").when(engine == "minio", "storage").when(value.rlike(r"^https?://"), "http").otherwise("other")
    )


def target_host(value: Column) -> Column:
    """Host of a url, else of a Host/Server/Data Source setting; null if there is none."""
    url = F.regexp_extract(value, r"://(?:[^/@\s]*@)?([^/:?#\s,;]+)", 1)
    named = F.regexp_extract(value, r"(?i)(?:host|server|data source)\s*=\s*([^;,:\s]+)", 1)
    return F.when(url != "", url).when(named != "", named)


def jdbc_engine(url: Column) -> Column:
    """Null for placeholders and what is no JDBC url."""
    engine = F.lower(F.regexp_extract(url, r"^jdbc:([a-zA-Z0-9]+):", 1))
    return F.when((engine != "") & ~url.contains("${"), engine)


def grpc_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "(Grpc|Client|Stub|BlockingStub|FutureStub)+$", ""), "Async$", "")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def merge_metadata(old: Column, new: Column) -> Column:
    """Maps merged key by key, new values first."""
    old, new = F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


def package_language(manifest: Column) -> Column:
    """Language of a package.json: typescript if it depends on it, else javascript; null if it is no JSON object."""
    depends = F.coalesce(F.get_json_object(manifest, "$.devDependencies.typescript"), F.get_json_object(manifest, "$.dependencies.typescript"))
    return F.when(F.get_json_object(manifest, "$").isNull(), F.lit(None)).when(depends.isNotNull(), "typescript").otherwise("javascript")


def combine_routes(prefix: Column, suffix: Column) -> Column:
    """A suffix with a leading slash or ``~/`` stands for itself, others follow the prefix."""
    own = F.regexp_replace(suffix, "^~", "")
    return F.when(own.startswith("/"), join_paths(own)).otherwise(join_paths(prefix, suffix))


def endpoint_id(parser: Column, service: Column, method: Column, path: Column) -> Column:
    return F.concat(parser, F.lit(":http_endpoint:"), F.concat_ws("|", service, F.upper(method), http_path(path)))


def infra_key(kind: Column, engine: Column, host: Column, name: Column) -> Column:
    """Stable key of a store: kind, engine if known, and host, else the setting's name."""
    return F.concat_ws(":", kind, engine, F.lower(F.coalesce(host, name)))


def leaf_role(key: Column) -> Column:
    """What the last part of a setting's key names."""
    leaf = F.lower(F.element_at(F.split(key, "__|:|\\."), -1))
    return (
        F.when(leaf.rlike("^(host|hostname|server|endpoint|url|uri|address)$"), "target").when(leaf.rlike("^(password|pwd|secret|token|apikey)$"), "secret").when(leaf.rlike("^(user|username|uid|login)$"), "user")
        .when(leaf.rlike("^port$"), "port").when(leaf.rlike("^(database|db|schema|initialcatalog)$"), "database").otherwise("other")
    )


#: Resources whose routes catch all that follows, in the order in which they are tried (fixed values).
SPLAT_RESOURCES = "nodes files assets static media blobs objects content raw proxy".split()


def splat_path(path: Column) -> Column:
    """A client's path below a catch-all resource becomes the route's, ``../resource/*``; others stay, without trailing slashes."""
    bare = F.regexp_replace(path, "/+$", "")
    out = bare = F.when(bare == "", "/").otherwise(bare)
    for segment in reversed(SPLAT_RESOURCES):
        below = rf"(?i)^(.*)/{segment}/.+$"
        out = F.when(bare.rlike(below), F.concat(F.regexp_extract(bare, below, 1), F.lit(f"/{segment}/*"))).otherwise(out)
    return F.when(bare.endswith("/*"), bare).otherwise(out)


def compose_file(path: Column) -> Column:
    """The compose file that a source file's service stands in: a monorepo's own folders have the development one."""
    return F.when(F.replace(path, F.lit("\\"), F.lit("/")).rlike("^(backend|frontend|parsers)/"), "docker/docker-compose.dev.yml").otherwise("docker-compose.yml")


def api_template(raw: Column) -> Column:
    """A UI call's path as a template: expressions are ``{id}``, the query and the version prefix go; empty for the root."""
    bare = F.element_at(F.split(F.trim(raw), r"\?"), 1)
    bare = F.regexp_replace(bare, r"\$\{buildQuery\([^()]*(?:\([^()]*\)[^()]*)*\)\}", "")
    bare = F.regexp_replace(bare, r"\$\{(?:[^{}]|\{[^}]*\})*\}", "{id}")
    found = F.regexp_extract(bare, r"/[A-Za-z0-9_/{}.:-]+", 0)
    path = F.regexp_replace(F.when(found != "", found).otherwise(bare), "(?i)^(.*?)/api/v1", "$1")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    path = F.regexp_replace(F.regexp_replace(path, r"\{+id\}+", "{id}"), "[^A-Za-z0-9_/{}.:-]+$", "")
    return F.when(path == "/", "").otherwise(path)


def decode_id(raw: Column) -> Column:
    """An id out of an address, decoded once or, if it is still encoded, twice; what can't be decoded stays."""
    once = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    twice = F.when(once.contains("%"), F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)).otherwise(once)
    return F.coalesce(twice, raw)


#: Folders that name no service, and names of user interfaces (fixed values).
NO_SERVICE, UI_NAMES = "src app apps packages dist node_modules".split(), "ui web client".split()


def bound_service(key: Column, name: Column, path: Column) -> Column:
    """Id of the compose service that serves an application: a frontend first, then another interface's name, then the first candidate
    of its key and the folders of its path; null without any."""
    path = F.replace(F.coalesce(path, key), F.lit("\\"), F.lit("/"))
    folders = F.filter(F.transform(F.split(path, "/"), F.lower), lambda p: (p != "") & ~p.isin(NO_SERVICE) & ~p.contains("."))
    found = F.filter(F.array_distinct(F.concat(F.array(F.lower(key)), folders)), lambda p: p != "")
    front = F.array_contains(found, "frontend") | F.contains(F.lower(name), F.lit("frontend")) | F.contains(F.lower(key), F.lit("frontend"))
    service = F.when(F.coalesce(front, F.lit(False)), "frontend").otherwise(F.coalesce(F.get(F.filter(found, lambda p: p.isin(UI_NAMES)), 0), F.get(found, 0)))
    return F.concat(F.lit("compose:service:"), compose_file(F.when(path != "", path).otherwise(F.concat(service, F.lit("/")))), F.lit("#"), service)
