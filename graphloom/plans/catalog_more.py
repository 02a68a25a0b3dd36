"""Further registered queries: writes, settings, UI views, dispatch and run rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as fp
from ..functions.paths import SKIPPED_FOLDERS
from ..functions import text as ft
from ..operators import aggregates as agg
from ..operators import dedupe as ded
from ..operators import filters as flt
from ..operators import joins as jon
from ..operators import lifecycle as life
from ..operators import views
from ..schema import MAX_NODES, MOST_NODES
from ..sources import registry
from . import adapters
from .catalog import query
from .extraction import projects


@query("snk3_element_upsert", "SELECT id, status FROM elements WHERE type = 'directory' UNION ALL SELECT id, 'needed' FROM elements WHERE type = 'file'")
def _(c):
    new = c.elements.where("type = 'file'").withColumn("status", F.lit("needed"))
    return life.upsert(c.elements, new, ["id"]).select("id", "status")


@query("snk5_envelope_last", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id", canon=False)
def _(c):
    return ded.first_by(c.read("events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("snk6_snapshot", "SELECT path, mtime_ms, size FROM files")
def _(c):
    from .lineage import table

    return table(c.files.select("path", "mtime_ms", "size"), "snapshot")


@query("src3_inventory_reuse", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE path LIKE '%.html') AS pages")
def _(c):
    from .lineage import table

    once = table(c.files.select("path"), "inventory")
    return once.agg(F.count("*").alias("files"), F.count_if(F.col("path").endswith(".html")).alias("pages"))


@query("jon13_call_targets", "SELECT o_orderkey, 'ts:http_endpoint:svc|GET|/orders/' || o_custkey AS dst, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey", canon=False)
def _(c):
    """Orders call their customer's endpoint; two thirds of those exist."""
    path = lambda key: F.concat(F.lit("orders/"), F.col(key))
    calls = c.read("orders").select("o_orderkey", F.lit("svc").alias("service"), F.lit("get").alias("method"), F.concat(path("o_custkey"), F.lit("/?x=1")).alias("path"))
    ends = c.read("customer").where("c_custkey % 3 <> 0").select(ft.endpoint_id(F.lit("ts"), F.lit("svc"), F.lit("GET"), path("c_custkey")).alias("id"))
    return jon.call_targets(calls, ends, "ts").select("o_orderkey", "dst", "known")


@query("jon14_grpc_targets", "SELECT n_nationkey, 'grpc-proto:grpc_method:' || n_name || '/Get' AS dst FROM nation", canon=False)
def _(c):
    return c.read("nation").select("n_nationkey", F.concat(F.lit("grpc-proto:grpc_method:"), ft.grpc_name(F.concat("n_name", F.lit("Client"))), F.lit("/"), ft.grpc_name(F.lit("GetAsync"))).alias("dst"))


@query("agg8_merged_counts", "SELECT 'html' AS language, sum(n)::BIGINT AS file_count, (SELECT array_to_string(list_sort(list(DISTINCT path))[1:5], ',') FROM (SELECT path FROM (SELECT path FROM files WHERE ends_with(path, '.html') ORDER BY path LIMIT 5) UNION ALL SELECT path FROM (SELECT path FROM files WHERE ends_with(path, '.html') AND starts_with(path, 'm.') ORDER BY path LIMIT 5))) AS samples FROM (SELECT count(*) AS n FROM files WHERE ends_with(path, '.html') UNION ALL SELECT count(*) FROM files WHERE ends_with(path, '.html') AND starts_with(path, 'm.')) HAVING sum(n) > 0")
def _(c):
    reports = [agg.language_report(f) for f in (c.files, c.files.where("startswith(path, 'm.')"))]
    return agg.merged_counts(reports).select("language", "file_count", F.array_join("sample_paths", ",").alias("samples"))


@query("rnk3_external_order", "SELECT id, row_number() OVER (ORDER BY CASE WHEN kind IN ('service', 'broker', 'external_api') THEN 0 ELSE 1 END, id) AS place FROM system QUALIFY place <= 500")
def _(c):
    return ded.external_order(c.system, 500).select("id", "place")


@query("srt11_limits", f"SELECT o_orderkey, greatest(1, least(o_orderkey - 100, {MOST_NODES})) AS allowed FROM orders", canon=False)
def _(c):
    assert MAX_NODES <= MOST_NODES
    return c.read("orders").select("o_orderkey", ft.clamp(F.col("o_orderkey") - 100, F.lit(1), F.lit(MOST_NODES)).alias("allowed"))


@query("set2_known_ids", "SELECT id FROM nodes WHERE kind IN ('service', 'broker')")
def _(c):
    return c.services.select("id").union(c.brokers.select("id")).union(c.services.select("id")).distinct()


@query("str6_package_language", "SELECT p_partkey, ['typescript', 'javascript', NULL][(p_partkey % 3 + 1)::INT] AS language FROM part", canon=False)
def _(c):
    k = F.col("p_partkey").cast("string")
    docs = [F.concat(F.lit('{"devDependencies": {"typescript": "5.'), k, F.lit('"}}')), F.concat(F.lit('{"name": "x'), k, F.lit('"}')), F.concat(F.lit('{"name": '), k)]
    return c.read("part").select("p_partkey", ft.package_language(F.element_at(F.array(*docs), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("language"))


@query("str17_combined_routes", "SELECT p_partkey, ['/api/x' || p_partkey || '/{id}', '/own' || p_partkey, '/root' || p_partkey, '/api/x' || p_partkey][(p_partkey % 4 + 1)::INT] AS path FROM part", canon=False)
def _(c):
    k = F.col("p_partkey").cast("string")
    nth = (F.col("p_partkey") % 4 + 1).cast("int")
    prefix = F.element_at(F.array(*[F.concat(F.lit("api/x"), k)] * 3, F.concat(F.lit("/api/x"), k, F.lit("/"))), nth)
    own = F.element_at(F.array(F.lit("{id}"), F.concat(F.lit("/own"), k), F.concat(F.lit("~/root"), k, F.lit("/")), F.lit("")), nth)
    return c.read("part").select("p_partkey", prefix.alias("p"), own.alias("s")).select("p_partkey", ft.combine_routes(F.col("p"), F.col("s")).alias("path"))


@query("str24_leaf_roles", "SELECT p_partkey, ['secret', 'target', 'port', 'database', 'other', 'user'][(p_partkey % 6 + 1)::INT] AS role FROM part", canon=False)
def _(c):
    k = F.col("p_partkey").cast("string")
    keys = [F.concat(F.lit(a), k, F.lit(b)) for a, b in (("Db", "__Password"), ("Rabbit", ":Host"), ("server", ".port"), ("Main", "__Database"), ("Logging", "__Level"), ("Db", "__User"))]
    return c.read("part").select("p_partkey", F.element_at(F.array(*keys), (F.col("p_partkey") % 6 + 1).cast("int")).alias("k")).select("p_partkey", ft.leaf_role(F.col("k")).alias("role"))


@query("str29_infra_keys", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'database:postgresql:db' || s_suppkey ELSE 'cache:' || lower(s_name) END AS key FROM supplier", canon=False)
def _(c):
    even = F.col("s_suppkey") % 2 == 0
    key = ft.infra_key(F.when(even, "database").otherwise("cache"), F.when(even, "postgresql"), F.when(even, F.concat(F.lit("DB"), F.col("s_suppkey"))), F.col("s_name"))
    return c.read("supplier").select("s_suppkey", key.alias("key"))


@query("str27_env_lines", "SELECT s_suppkey, 'A' || s_suppkey AS key, s_name || ' y' AS value FROM supplier UNION ALL SELECT s_suppkey, 'B', s_suppkey::VARCHAR FROM supplier", canon=False)
def _(c):
    from ..sources.settings import parse_env

    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# note\nexport A"), k, F.lit('="'), "s_name", F.lit(' y"\nB = '), k, F.lit("\nbad line\n"))
    return parse_env(c.read("supplier").select("s_suppkey", text.alias("content")))


@query("arr1_samples", "SELECT p_brand, array_to_string(list_sort(list(p_name))[1:5], ',') AS samples FROM part GROUP BY p_brand", canon=False)
def _(c):
    from pyspark.sql import Window as W

    first = c.read("part").withColumn("n", F.row_number().over(W.partitionBy("p_brand").orderBy("p_name"))).where("n <= 5")
    return first.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("samples"))


@query("gra15_externals", "SELECT id FROM nodes WHERE layer = 'system' AND kind IN ('service', 'message_type') AND id IN (SELECT dst FROM edges WHERE type = 'consumes' UNION SELECT src FROM edges WHERE type = 'exposes')")
def _(c):
    return views.externals(c.endpoints, c.nodes, c.edges.where("type in ('consumes', 'exposes', 'contains')")).select("id")


@query(
    "gra16_dispatch",
    """SELECT 'service:6' AS start, 'service:6' AS id, 'exact' AS status UNION ALL SELECT id, parent_id, 'resolved_service' FROM system WHERE id = 'http_endpoint:1'
    UNION ALL SELECT id, id, 'exact_code' FROM classes WHERE id = (SELECT min(id) FROM classes) UNION ALL SELECT 'message_type:1', NULL, 'system_fallback' UNION ALL SELECT 'gone:0', NULL, 'system_fallback' UNION ALL SELECT 'focus', 'service:8', 'exact' UNION ALL SELECT 'nothing', NULL, 'none'""",
)
def _(c):
    """Every branch: peers, what belongs to a service, code, what belongs to none, an unknown id, a focus, and nothing asked for."""
    nodes, edges = c.nodes.where("kind <> 'method'"), c.edges.where("type in ('connects_to', 'exposes')")
    code = c.classes.agg(F.min("id")).first()[0]
    asked = [(i, {"resolve_from": i}) for i in ("service:6", "http_endpoint:1", code, "message_type:1", "gone:0")] + [("focus", {"focus_id": "service:8"}), ("nothing", {})]
    out = None
    for name, given in asked:
        shown, _e, status = views.view(nodes, edges, **given)
        rows = shown.where("role = 'focus'").agg(F.max("id").alias("id")).select(F.lit(name).alias("start"), "id", F.lit(status).alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("dml8_project_delete", "SELECT 'runs' AS part, count(*) AS n FROM events WHERE user_id <> 1 UNION ALL SELECT 'nodes', count(*) FROM orders WHERE o_custkey <> 1 UNION ALL SELECT 'ai_jobs', count(*) FROM customer", canon=False)
def _(c):
    own = lambda name, key: c.read(name).withColumn("project_id", F.col(key).cast("string"))
    jobs = own("events", "user_id").select("project_id", F.lit("sync").alias("kind"), F.lit("done").alias("status"))
    left = life.delete_project({"runs": own("events", "user_id"), "nodes": own("orders", "o_custkey"), "ai_jobs": own("customer", "c_custkey")}, jobs, "1")
    counts = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, f in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("run6_parser_scope", "SELECT path, 'spawn' AS role FROM files WHERE page_id % 4 = 1 AND ends_with(path, '.html')")
def _(c):
    changes = c.files.where("page_id % 4 = 1").select("path", F.lit("modified").alias("change"))
    return life.scoped_paths(changes, "html").where("role = 'spawn'")


@query("run9_finalize", "SELECT id, CASE WHEN deleted > 0 OR node_count = 0 THEN 'failed' ELSE 'success' END AS status FROM runs")
def _(c):
    return c.runs.select("id", life.finalize(F.col("node_count"), F.col("deleted")).alias("status"))


@query("run9_prune", "SELECT event_id FROM events WHERE (user_id % 3 <> 0) OR event_type = 'click'", canon=False)
def _(c):
    rows = c.read("events").select("event_id", F.col("user_id").alias("project_id"), F.col("event_type").alias("run_id"))
    done = rows.select("project_id").distinct().withColumns({"run_id": F.lit("click"), "status": life.finalize(F.lit(1), F.col("project_id") % 3)})
    return life.prune(rows, done).select("event_id")


_SCOPE = """, scope AS (SELECT f.path, p.html AS text, page_id FROM files f JOIN pages p USING (page_id) WHERE f.path IN (SELECT path FROM elements WHERE id NOT IN (SELECT up.id FROM up JOIN elements e ON e.path = up.a WHERE e.status NOT IN ('auto_found', 'needed', 'found')))
), named AS (SELECT path, text, CASE page_id % 3 WHEN 0 THEN path || '.ts' WHEN 1 THEN path || '.jsx' ELSE path END AS name_ FROM scope), spoken AS (SELECT name_, CASE WHEN ends_with(name_, '.ts') THEN 'typescript' WHEN ends_with(name_, '.jsx') THEN 'javascript' WHEN ends_with(name_, '.html') THEN 'html' END AS language FROM named
), front AS (SELECT 'm' AS d, * FROM spoken WHERE starts_with(name_, 'm.') UNION ALL SELECT 'w', * FROM spoken WHERE starts_with(name_, 'www.') UNION ALL SELECT 'e', * FROM spoken WHERE contains(name_, '/en/')
), head_ AS (SELECT * FROM front QUALIFY row_number() OVER (PARTITION BY d, language ORDER BY name_) <= 5)
"""
_FIVE = "array_to_string(list_sort(list(DISTINCT name_))[1:5], ',')"


@query(
    "run11_detection",
    _SCOPE + f"""SELECT 'language' AS part, language AS name, count(*) AS file_count, {_FIVE} AS samples FROM spoken WHERE language IS NOT NULL GROUP BY language
    UNION ALL SELECT 'artifact', rule, count(*), {_FIVE} FROM (SELECT name_, unnest(list_filter([CASE WHEN ends_with(name_, '.ts') THEN 'module' END, CASE WHEN contains(name_, '/en/') AND contains(text, 'the ') THEN 'english' END], lambda x: x IS NOT NULL)) AS rule FROM named) GROUP BY rule
    UNION ALL SELECT 'frontend', language, n, samples FROM (SELECT language, count(*) AS n FROM front WHERE language IS NOT NULL GROUP BY language) JOIN (SELECT language, {_FIVE} AS samples FROM head_ WHERE language IS NOT NULL GROUP BY language) USING (language)""",
)
def _(c):
    """Pages in scope as files of three endings."""
    from ..operators.filters import analysed

    scope = c.files.join(analysed(c.elements).select("path"), "path", "left_semi").join(c.read("pages").select("page_id", F.col("html").alias("text")), "page_id")
    ending = F.when(F.col("page_id") % 3 == 0, ".ts").when(F.col("page_id") % 3 == 1, ".jsx").otherwise("")
    files = scope.select(F.concat("path", ending).alias("path"), "text")
    fronts = [F.col("path").startswith("m."), F.col("path").startswith("www."), F.contains("path", F.lit("/en/"))]
    report = agg.post_sync_report(files, [("module", r"\.ts$", None), ("english", "/en/", "the ")], fronts)
    return report.select("part", "name", "file_count", F.array_join("sample_paths", ",").alias("samples"))


_HINT = f"list_filter(p[1:len(p) - 1], lambda x: NOT contains(x, '.') AND NOT list_contains({SKIPPED_FOLDERS}, x))[1]"


@query("str12_route_service", f"SELECT path, CASE WHEN {_HINT} IS NOT NULL THEN 'compose:service:docker-compose.yml#' || {_HINT} ELSE 'compose:service:unscoped:' || substr(sha1(path), 1, 12) END AS service FROM (SELECT path, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS p FROM files)")
def _(c):
    return c.files.select("path", adapters.service_id(F.col("path")).alias("service"))


@query("jon18_explicit_links", "SELECT id FROM classes WHERE parent_id IN (SELECT id FROM nodes WHERE parent_id = 'service:8') UNION ALL SELECT m.id FROM methods m JOIN classes c ON m.parent_id = c.id WHERE c.parent_id IN (SELECT id FROM nodes WHERE parent_id = 'service:8')")
def _(c):
    from ..operators import graph as gra

    return gra.code_of_service("service:8", "none", c.nodes, c.edges.where("type = 'connects_to'")).select("id")


@query("dat1_stamped", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT') || '07:08:09.120Z' AS ingested_at FROM orders", canon=False)
def _(c):
    return flt.stamped(c.read("orders"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 07:08:09.12"))).select("o_orderkey", "ingested_at")


@query("jon15_project_links", "SELECT 'dotnet-project:dotnet_project:bill' || p_partkey || '/Bill.csproj' AS src, 'dotnet-project:dotnet_project:core' || p_partkey || '/Core.csproj' AS dst FROM part", canon=False)
def _(c):
    return adapters.run(projects(c.spark, c.dir, "dotnet-project"), "dotnet-project")[1].select("src", "dst")


@query("jon16_compose_links", "SELECT unnest(['depends_on', 'connects_to']) AS type, 'compose:service:p' || p_partkey || '/docker-compose.yml#api' AS src FROM part", canon=False)
def _(c):
    return adapters.run(projects(c.spark, c.dir, "compose"), "compose")[1].select("type", "src")


@query("prj1_public_nodes", "SELECT id, parser_id, kind, name, qualified_name, language, path, parent_id, layer FROM system")
def _(c):
    return flt.public(flt.stamped(c.system))


@query("prj4_ui_nodes", "SELECT id, kind, name, qualified_name, path, NULL::VARCHAR AS signature, parent_id, NULL::VARCHAR AS metadata FROM nodes")
def _(c):
    return flt.ui_public(c.nodes, flt.UI_NODE)


@query("prj4_ui_edges", "SELECT id, src, dst, type, NULL::VARCHAR AS metadata FROM edges")
def _(c):
    return flt.ui_public(c.edges, flt.UI_EDGE)


@query("map2_layer", "SELECT id, 'system' AS layer, 2 AS entries FROM system")
def _(c):
    tagged = c.system.select("id", flt.with_layer(F.create_map(F.lit("kind"), F.col("kind"), F.lit("layer"), F.lit("code")), "system").alias("m"))
    return tagged.select("id", F.col("m")["layer"].alias("layer"), F.size("m").alias("entries"))


@query("srt10_copy_run", "SELECT event_id, event_type AS run_id FROM events UNION ALL SELECT event_id, 'copy' FROM events WHERE event_type = 'error'", canon=False)
def _(c):
    return life.copy_run(c.read("events").select("event_id", F.col("event_type").alias("run_id")), "error", "copy")


@query("str9_compose_file", "SELECT path, CASE WHEN page_id % 3 = 0 THEN 'docker/docker-compose.dev.yml' ELSE 'docker-compose.yml' END AS file FROM files")
def _(c):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "frontend/").otherwise("my/"), "path")
    return c.files.select("path", ft.compose_file(path).alias("file"))


_SPLAT = "CASE " + " ".join(f"WHEN regexp_matches(p, '(?i)/{s}/.+$') THEN regexp_replace(p, '(?i)^(.*)/({s})/.+$', '\\1/{s}/*')" for s in ft.SPLAT_RESOURCES) + " ELSE p END"


@query("str11_splat_paths", f"SELECT path, {_SPLAT} AS target FROM (SELECT path, rtrim('/v1/' || ['nodes', 'orders', 'Raw', 'files'][(page_id % 4 + 1)::INT] || '/' || path, '/') AS p FROM files)")
def _(c):
    kind = F.element_at(F.array(*map(F.lit, ("nodes", "orders", "Raw", "files"))), (F.col("page_id") % 4 + 1).cast("int"))
    return c.files.select("path", ft.splat_path(F.concat_ws("/", F.lit("/v1"), kind, "path")).alias("target"))


@query("str19_ui_templates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/orders/{id}/lines' ELSE '/orders/' || o_orderkey END AS path FROM orders", canon=False)
def _(c):
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/api/v1/orders/${order.id}/lines${buildQuery({a: "), key, F.lit("})}"))).otherwise(F.concat(F.lit(" /orders/"), key, F.lit("?x=1")))
    return c.read("orders").select("o_orderkey", ft.api_template(raw).alias("path"))


@query("str32_decoded_ids", "SELECT path AS id FROM files WHERE NOT contains(path, '%')")
def _(c):
    once = F.url_encode("path")
    return c.files.where(~F.contains("path", F.lit("%"))).select(ft.decode_id(F.when(F.col("page_id") % 2 == 0, once).otherwise(F.url_encode(once))).alias("id"))


@query("str33_bound_service", "SELECT page_id, 'compose:service:docker-compose.yml#' || CASE WHEN page_id % 5 = 0 THEN 'frontend' WHEN page_id % 5 = 1 THEN 'web' ELSE lower(split_part(path, '/', 2)) END AS service FROM files WHERE path LIKE '%/%' AND NOT contains(split_part(path, '/', 2), '.') AND split_part(path, '/', 2) <> ''")
def _(c):
    rows = c.files.where("path LIKE '%/%' AND NOT contains(split_part(path, '/', 2), '.') AND split_part(path, '/', 2) <> ''")
    kind = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("apps/"), "path", F.lit("/web/main.ts"))).otherwise(F.col("path"))
    name = F.when(F.col("page_id") % 5 == 0, "My Frontend").otherwise("shop")
    return rows.select("page_id", ft.bound_service(F.lit(""), name, kind).alias("service"))


@query("udf1_parser_registry", "SELECT language, max_by(id, id) AS parser_id FROM (SELECT n_name AS id, ['python', 'java', 'cpp'][(n_nationkey % 3 + 1)::INT] AS language FROM nation WHERE n_nationkey % 4 <> 0) GROUP BY language", canon=False)
def _(c):
    n = F.col("n_nationkey")
    manifests = c.read("nation").select(F.col("n_name").alias("directory"), F.when(n % 4 == 0, "other").otherwise(F.col("n_name")).alias("id"), F.array(F.element_at(F.array(*map(F.lit, ("python", "java", "cpp"))), (n % 3 + 1).cast("int"))).alias("languages"), F.lit("run").alias("command"), F.lit(1).alias("schema_version"), F.lit(1000).alias("timeout_ms"))
    return registry.by_language(manifests)


@query("udf6_detected", "SELECT rule, count(*) AS file_count FROM (SELECT unnest(list_filter([CASE WHEN ends_with(url, '.html') THEN 'page' END, CASE WHEN contains(url, '/en/') AND contains(html, 'the ') THEN 'english' END, CASE WHEN regexp_matches(url, '://m\\.') THEN 'mobile' END], lambda x: x IS NOT NULL)) AS rule FROM pages) GROUP BY rule", canon=False)
def _(c):
    files = c.read("pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return agg.detect(files, [("page", r"\.html$", None), ("english", "/en/", "the "), ("mobile", r"://m\.", None)]).select("rule", "file_count")


@query("agg17_walked", "SELECT count(*) AS walked FROM files")
def _(c):
    from .lineage import walked

    rows, seen = walked(c.files.select("path"))
    return rows.limit(1).select(F.lit(seen).cast("long").alias("walked"))


@query("str25_hosts", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages", canon=False)
def _(c):
    return c.read("pages").select("page_id", ft.target_host(F.col("url")).alias("host"))


_LOADED = """, found AS (
  (SELECT id FROM system WHERE kind IN ('service', 'broker', 'external_api') ORDER BY id LIMIT 500) UNION (SELECT id FROM system WHERE kind IN ('http_endpoint', 'message_type') ORDER BY id LIMIT 2000)
  UNION (SELECT id FROM system WHERE parent_id = 'service:9' ORDER BY id LIMIT 2000) UNION SELECT 'service:9'
), shown AS (SELECT * FROM edges WHERE src IN (SELECT id FROM found) OR dst IN (SELECT id FROM found) ORDER BY type, id LIMIT 2000)
"""


@query("gra7_view_load", _LOADED + "SELECT id FROM found UNION SELECT id FROM system WHERE id IN (SELECT src FROM shown UNION SELECT dst FROM shown)")
def _(c):
    return views.load(c.system, c.edges, "service:9")[0].select("id")


@query("jon21_screen_calls", "SELECT DISTINCT l_orderkey AS screen, 'GET /parts/' || p_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 2", canon=False)
def _(c):
    """Orders are screens that import one helper for each of their lines, of the module of the part's brand; the second line's is not used."""
    parts = c.read("part").select("p_partkey", F.concat(F.lit("api/"), "p_brand").alias("module"), F.concat(F.lit("load"), "p_partkey").alias("name"))
    imports = c.read("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("screen"), "module", "name", (F.col("l_linenumber") != 2).alias("used"))
    return jon.helper_calls(imports, parts.select("module", "name", F.concat(F.lit("GET /parts/"), "p_partkey").alias("target")))
