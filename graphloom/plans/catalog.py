"""Registered queries: each applies a library operator to the canon frames, with its oracle beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as fp
from ..functions import text as ft
from ..operators import aggregates as agg
from ..operators import dedupe as ded
from ..operators import filters as flt
from ..operators import graph as gra
from ..operators import joins as jon
from ..operators import lifecycle as life
from ..operators import views
from ..schema import PEER_KINDS
from .canon import Canon
from .oracle import CANON

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NODE = "id, parser_id, kind, name, qualified_name, language, path, parent_id, layer"
EDGE = "id, parser_id, type, src, dst, path, layer, protocol"


def query(name: str, sql: str | None = None, canon: bool = True) -> Callable:
    """Register f(canon frames) under a name."""

    def add(f: Callable[[Canon], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Canon(spark, sf_dir))
        if sql:
            ORACLES[name] = (CANON if canon else "") + sql
        return f

    return add


# -- scans and sinks ---------------------------------------------------------------------------------------------


@query("src1_tree_scan", "SELECT id, path, parent_path, type FROM elements")
def _(c):
    return c.elements.select("id", "path", "parent_path", "type")


@query("src2_inventory", "SELECT path, mtime_ms, size FROM files WHERE NOT list_has_any(string_split(path, '/'), ['de', 'node_modules'])")
def _(c):
    return c.files.where(~fp.denied(F.col("path"), ["de", "node_modules"])).select("path", "mtime_ms", "size")


@query("src4_path_listing", "SELECT path FROM files")
def _(c):
    return c.files.select("path")


@query("src5_text_probe", "SELECT doc_id, strlen(text) AS n_bytes, contains(left(text, 8192), chr(0)) AS is_binary FROM documents", canon=False)
def _(c):
    from ..sources.files import is_binary, valid_text

    raw = c.read("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return raw.where(valid_text(F.col("content"))).select("doc_id", F.length("content").cast("long").alias("n_bytes"), is_binary(F.col("content")).alias("is_binary"))


@query("src6_scoped_read", "SELECT page_id, length(html) AS n FROM pages WHERE strlen(html) <= 4000", canon=False)
def _(c):
    from ..sources.files import scoped

    pages = c.read("pages").select("page_id", "html", F.octet_length("html").cast("long").alias("size"), F.lit("found").alias("status"))
    return scoped(pages, 4000).select("page_id", F.length("html").cast("long").alias("n"))


@query("src7_envelopes", "SELECT event_id, 'p' || user_id AS parser_id, (props ->> 'k')::BIGINT AS model_k FROM events WHERE event_type = 'click'", canon=False)
def _(c):
    from ..sources.envelopes import parse_envelopes

    rows = c.read("events").where("event_type = 'click'").select("event_id", F.to_json(F.struct(F.concat(F.lit("p"), F.col("user_id")).alias("parser_id"), F.lit("1").alias("schema_version"), F.lit("x").alias("project_id"), F.lit("r").alias("analysis_run_id"), F.array().cast("array<string>").alias("files_analyzed"), F.col("props").alias("model"))).alias("raw"))
    got = parse_envelopes(rows, "raw", run_id="r")
    return got.select("event_id", "parser_id", F.get_json_object("model", "$.k").cast("long").alias("model_k"))


@query("src8_point_lookup", f"SELECT {NODE} FROM nodes WHERE id = 'service:7'")
def _(c):
    return c.nodes.where("id = 'service:7'").limit(1)


@query("src9_id_scan", "SELECT DISTINCT id FROM nodes")
def _(c):
    return c.nodes.select("id").distinct()


@query("src10_path_map", "SELECT id, path, status FROM elements WHERE is_active")
def _(c):
    return ded.one_element(c.elements.where("is_active")).select("id", "path", "status")


@query("src11_docs_tree", "SELECT path, type FROM elements WHERE type = 'directory' OR path LIKE '%.html'")
def _(c):
    return c.elements.where("type = 'directory' or endswith(path, '.html')").select("path", "type")


@query("src12_path_mapping", "SELECT path, CASE WHEN starts_with(path, 'blog.') THEN '/mnt/blog/' || substr(path, 6) WHEN starts_with(path, 'www.') THEN '/mnt/www/' || substr(path, 5) ELSE path END AS mapped FROM files")
def _(c):
    from ..sources.files import map_prefixes

    return c.files.select("path", map_prefixes(F.col("path"), {"blog.": "/mnt/blog/", "www.": "/mnt/www/"}).alias("mapped"))


@query("snk1_node_upsert", f"SELECT {NODE} FROM services_old UNION ALL SELECT {NODE} FROM services_new".replace("services_old", "nodes WHERE kind = 'service' AND id NOT IN (SELECT 'service:' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)").replace(" FROM services_new", ".x FROM x").split(" UNION ALL ")[0] + f" UNION ALL SELECT id, parser_id, kind, upper(name) || '!' AS name, qualified_name, language, path, parent_id, layer FROM nodes WHERE kind = 'service' AND id IN (SELECT 'service:' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)")
def _(c):
    new = c.services.where(F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 3 == 0).withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return life.upsert(c.services, new, ["id"])


@query("snk2_edge_upsert", "SELECT id, type, path FROM edges WHERE type = 'connects_to' UNION ALL SELECT id, type, 'new' FROM edges WHERE type = 'exposes' AND dst LIKE '%7' UNION ALL SELECT id, type, path FROM edges WHERE type = 'exposes' AND dst NOT LIKE '%7'")
def _(c):
    old = c.connects.unionByName(c.exposes).select("id", "type", "path")
    new = c.exposes.where(F.col("dst").endswith("7")).select("id", "type", F.lit("new").alias("path"))
    return life.upsert(old, new.unionByName(new), ["id"], [F.col("path")])


@query("snk4_export_slice", "SELECT kind AS part, count(*) AS n FROM nodes WHERE kind IN ('service', 'broker') GROUP BY kind")
def _(c):
    from ..sources.sinks import export_slice, read_slice

    where = export_slice({"service": c.services, "broker": c.brokers}, c.spark)
    return read_slice(c.spark, where, ["service", "broker"]).groupBy("part").agg(F.count("*").alias("n"))


# -- filters and projections -------------------------------------------------------------------------------------


@query("flt1_equality", f"SELECT {NODE} FROM nodes WHERE kind = 'class' AND language = 'python'")
def _(c):
    return c.nodes.where("kind = 'class' and language = 'python'")


@query("flt2_roots", "SELECT id, kind FROM nodes WHERE parent_id IS NULL OR parent_id = ''")
def _(c):
    return c.nodes.where(flt.is_root(F.col("parent_id"))).select("id", "kind")


@query("flt3_kinds", "SELECT id FROM nodes WHERE kind IN ('broker', 'external_api')")
def _(c):
    return flt.of_kinds(c.nodes, ["broker", "external_api"]).select("id")


@query("flt4_search_nodes", "SELECT id, name FROM nodes WHERE contains(lower(name), 'an') OR contains(lower(qualified_name), 'an') OR contains(lower(path), 'an') OR contains(lower(kind), 'an')")
def _(c):
    return flt.search_nodes(c.nodes, "AN").select("id", "name")


@query("flt5_search_edges", "SELECT id FROM edges WHERE contains(lower(type), 'r:1') OR contains(lower(src), 'r:1') OR contains(lower(dst), 'r:1') OR contains(lower(coalesce(path, '')), 'r:1')")
def _(c):
    return flt.search_edges(c.edges, "r:1").select("id")


@query("flt6_path_like", "SELECT id FROM nodes WHERE kind = 'http_endpoint' AND contains(lower(path), 'asia/ind')")
def _(c):
    return flt.path_like(c.nodes, "asia/ind*", ["http_endpoint"]).select("id")


@query("flt7_segment", "SELECT id FROM nodes WHERE list_contains(string_split(lower(path), '/'), 'china')")
def _(c):
    return c.nodes.where(fp.has_segment(F.col("path"), F.lit(" China "))).select("id")


@query("flt8_descendants", "SELECT id FROM elements WHERE is_active AND starts_with(path, (SELECT min(a) FROM steps) || '/')")
def _(c):
    least = c.elements.where("type = 'directory' and parent_path = ''").agg(F.min("path")).first()[0]
    return c.elements.where(F.col("is_active") & fp.is_below(F.col("path"), F.lit(least))).select("id")


@query("flt9_children", "SELECT id, type FROM elements WHERE is_active AND parent_path LIKE '%/en'")
def _(c):
    return c.elements.where("is_active and endswith(parent_path, '/en')").select("id", "type")


@query("flt10_status_scope", "SELECT id FROM elements WHERE id NOT IN (SELECT up.id FROM up JOIN elements e ON e.path = up.a WHERE e.status NOT IN ('auto_found', 'needed', 'found'))")
def _(c):
    return flt.analysed(c.elements).select("id")


@query("flt11_denylist", "SELECT path FROM files WHERE NOT list_has_any(string_split(path, '/'), ['en', 'es'])")
def _(c):
    return c.files.where(~fp.denied(F.col("path"), ["en", "es"])).select("path")


@query("flt12_layer", "SELECT 'code' AS layer, count(*) AS n FROM nodes WHERE layer = 'code' UNION ALL SELECT 'system', count(*) FROM system UNION ALL SELECT 'edges', count(*) FROM edges WHERE type IN ('connects_to', 'exposes', 'http_calls', 'consumes')")
def _(c):
    code, system = flt.in_layer(c.nodes, "code"), flt.in_layer(c.nodes, "system")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
    return count(code, "code").unionByName(count(system, "system")).unionByName(count(jon.within(c.edges, system), "edges"))


@query("flt13_family", "SELECT id, CASE WHEN type = 'http_calls' AND protocol = 'http' THEN 'http' WHEN type = 'consumes' THEN 'rpc_bus' WHEN type = 'connects_to' THEN 'infra' END AS family FROM edges WHERE (type = 'http_calls' AND protocol = 'http') OR type IN ('consumes', 'connects_to')")
def _(c):
    return c.edges.select("id", flt.family(F.col("type"), F.coalesce("protocol", F.lit(""))).alias("family")).where("family is not null")


@query("flt14_families", "SELECT DISTINCT CASE WHEN type = 'http_calls' AND protocol = 'http' THEN 'http' WHEN type = 'consumes' THEN 'rpc_bus' WHEN type = 'connects_to' THEN 'infra' END AS family FROM edges WHERE (type = 'http_calls' AND protocol = 'http') OR type IN ('consumes', 'connects_to')")
def _(c):
    return flt.families_present(c.edges)


@query("flt15_glob", "SELECT path FROM files WHERE regexp_full_match(path, '(.*/)?en/[^/]*7[^/]*')")
def _(c):
    return c.files.where(fp.matches_glob(F.col("path"), "**/en/*7*")).select("path")


@query("flt16_artifact_paths", "SELECT path, CASE WHEN ends_with(path, '.html') THEN 'page' WHEN starts_with(path, 'blog.') THEN 'blog' WHEN regexp_matches(path, '/fr/') THEN 'french' END AS rule FROM files WHERE ends_with(path, '.html') OR starts_with(path, 'blog.') OR regexp_matches(path, '/fr/')")
def _(c):
    p = F.col("path")
    return agg.first_rule(c.files, [("page", p.endswith(".html")), ("blog", p.startswith("blog.")), ("french", fp.matches_glob(p, "**/fr/**"))])


@query("flt17_content_hint", "SELECT doc_id FROM documents WHERE contains(left(text, 32000), 'License') OR contains(left(text, 32000), '%%%')", canon=False)
def _(c):
    return c.read("documents").where(flt.hinted(F.col("text"), ["License", "%%%"])).select("doc_id")


@query("flt18_ready_runs", "SELECT id FROM ready")
def _(c):
    return flt.ready(c.runs).select("id")


@query("flt19_kind_class", "SELECT kind, any_value(layer) AS layer, kind IN ('class', 'method') AS is_code, kind IN ('service', 'broker', 'external_api') AS is_peer, count(*) AS n FROM nodes GROUP BY kind")
def _(c):
    code = flt.is_code(F.col("kind"), F.col("layer"))
    return c.nodes.groupBy("kind").agg(F.first("layer").alias("layer"), F.bool_or(code).alias("is_code"), F.bool_or(F.col("kind").isin(PEER_KINDS)).alias("is_peer"), F.count("*").alias("n"))


@query("flt20_production", "SELECT path FROM files WHERE NOT regexp_matches(lower(path), '(^|/)(tests?|__tests__|mocks?|__mocks__|spec|generated|node_modules)/|\\.(test|spec|generated|g)\\.[a-z]+$')")
def _(c):
    return c.files.where(flt.production_code(F.col("path"))).select("path")


@query("flt21_layer_page", "SELECT id FROM nodes WHERE layer = 'code' ORDER BY path NULLS FIRST, name, id LIMIT 20 OFFSET 40")
def _(c):
    return ded.page(flt.in_layer(c.nodes, "code"), ["path", "name", "id"], 40, 20).select("id")


@query("prj2_view_projection", "SELECT id, kind, name, 'inside' AS role, false AS stub FROM nodes WHERE kind = 'service'")
def _(c):
    return flt.view_node(c.services, "inside", False).select("id", "kind", "name", "role", "stub")


@query("prj3_element_public", "SELECT id, nullif(parent_path, '') AS parent_path FROM elements")
def _(c):
    return c.elements.select("id", F.nullif("parent_path", F.lit("")).alias("parent_path"))


# -- joins -------------------------------------------------------------------------------------------------------


@query("jon1_incident", f"SELECT {EDGE} FROM edges WHERE src IN ('service:1', 'broker:2', 'http_endpoint:30') OR dst IN ('service:1', 'broker:2', 'http_endpoint:30')")
def _(c):
    return jon.incident(c.edges, c.nodes.where(F.col("id").isin("service:1", "broker:2", "http_endpoint:30")))


@query("jon2_within", "SELECT id FROM edges WHERE src IN (SELECT id FROM nodes WHERE path LIKE 'ASIA%') AND dst IN (SELECT id FROM nodes WHERE path LIKE 'ASIA%')")
def _(c):
    return jon.within(c.edges, c.nodes.where(F.col("path").startswith("ASIA"))).select("id")


@query("jon3_sound", "SELECT id FROM edges WHERE type IN ('http_calls', 'exposes', 'binds_service') OR (src IN (SELECT id FROM nodes WHERE path LIKE 'EUROPE%') AND dst IN (SELECT id FROM nodes WHERE path LIKE 'EUROPE%'))")
def _(c):
    return jon.sound(c.edges, c.nodes.where(F.col("path").startswith("EUROPE"))).select("id")


@query("jon4_missing_ends", f"SELECT {NODE} FROM nodes WHERE id IN (SELECT src FROM edges WHERE type = 'http_calls' UNION SELECT dst FROM edges WHERE type = 'http_calls') AND path NOT LIKE 'AFRICA%'")
def _(c):
    ids = jon.missing_ends(c.calls, c.nodes.where(F.col("path").startswith("AFRICA")))
    return c.nodes.join(ids, "id", "left_semi")


@query("jon5_stubs", "SELECT DISTINCT id, 'stub' AS parser_id, string_split(id, ':')[1] AS kind, string_split(id, ':')[2] AS name, string_split(id, ':')[2] AS qualified_name, 'system' AS language, '' AS path, 'system' AS layer, 'external' AS role, true AS stub FROM (SELECT src AS id FROM edges WHERE type = 'connects_to' UNION SELECT dst FROM edges WHERE type = 'connects_to') WHERE id NOT IN (SELECT id FROM nodes WHERE path LIKE 'ASIA%')")
def _(c):
    return jon.stubs(jon.missing_ends(c.connects, c.nodes.where(F.col("path").startswith("ASIA"))))


@query("jon6_has_children", "SELECT id, id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS has_children FROM system")
def _(c):
    return jon.with_children_flag(c.system, c.nodes).select("id", "has_children")


@query("jon7_element_link", "SELECT f.path, f.page_id, e.id AS element_id FROM files f LEFT JOIN elements e ON e.path = f.path AND e.is_active")
def _(c):
    return jon.linked_elements(c.files.select("path", "page_id"), ded.element_by_path(c.elements.where("is_active"))).select("path", "page_id", "element_id")


_SYMBOLS = """, symbols AS (
  SELECT 'm:' || p_brand || '/' || p_type AS id, p_brand AS path, 'module' AS kind, 'mod.' || p_type AS qualified_name, NULL::VARCHAR AS parent_qualified_name FROM part GROUP BY p_brand, p_type HAVING min(p_size) < 5
  UNION ALL SELECT 'c:' || p_partkey, p_brand, 'class', 'cls' || (p_partkey % 1500), 'mod.' || p_type FROM part)
"""


def _symbols(c):
    part = c.read("part")
    null = F.lit(None).cast("string")
    module = part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("s")).where("s < 5")
    module = module.select(F.concat(F.lit("m:"), F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("id"), F.col("p_brand").alias("path"), F.lit("module").alias("kind"), F.concat(F.lit("mod."), F.col("p_type")).alias("qualified_name"), null.alias("parent_qualified_name"))
    cls = part.select(F.concat(F.lit("c:"), F.col("p_partkey")).alias("id"), F.col("p_brand").alias("path"), F.lit("class").alias("kind"), F.concat(F.lit("cls"), (F.col("p_partkey") % 1500)).alias("qualified_name"), F.concat(F.lit("mod."), F.col("p_type")).alias("parent_qualified_name"))
    return module.unionByName(cls)


@query(
    "jon8_parents",
    _SYMBOLS
    + """SELECT s.id, nullif(coalesce(a.id, b.id, CASE WHEN s.kind <> 'module' THEN m.id END), s.id) AS parent_id FROM symbols s
LEFT JOIN (SELECT path, qualified_name AS q, min(id) AS id FROM symbols GROUP BY ALL) a ON a.path = s.path AND a.q = s.parent_qualified_name
LEFT JOIN (SELECT qualified_name AS q, min(id) AS id FROM symbols GROUP BY 1 HAVING count(*) = 1) b ON b.q = s.parent_qualified_name
LEFT JOIN (SELECT path, min(id) AS id FROM symbols WHERE kind = 'module' GROUP BY 1) m ON m.path = s.path""",
)
def _(c):
    return jon.resolve_parents(_symbols(c))


@query("jon9_usages", _SYMBOLS + "SELECT a.id AS src, b.id AS dst, 'calls' AS type FROM part p JOIN (SELECT qualified_name AS q, min(id) AS id FROM symbols GROUP BY 1 HAVING count(*) = 1) a ON a.q = 'cls' || (p.p_partkey % 1500) JOIN (SELECT qualified_name AS q, min(id) AS id FROM symbols GROUP BY 1 HAVING count(*) = 1) b ON b.q = 'cls' || (p.p_size + 700)")
def _(c):
    usages = c.read("part").select(F.concat(F.lit("cls"), F.col("p_partkey") % 1500).alias("from"), F.concat(F.lit("cls"), F.col("p_size") + 700).alias("to"), F.lit("calls").alias("type"))
    return jon.resolve_usages(usages, _symbols(c))


@query("jon10_ref_ids", "SELECT o_orderkey, 'ts:' || o_orderpriority || ':class:' || o_orderstatus AS dst FROM orders", canon=False)
def _(c):
    return c.read("orders").select("o_orderkey", fp.code_id(F.lit("ts"), F.col("o_orderpriority"), F.lit("class"), F.col("o_orderstatus")).alias("dst"))


@query("jon11_only_match", "SELECT s.s_suppkey, m.id AS match FROM supplier s LEFT JOIN (SELECT c_acctbal::INT % 1000 AS k, min(c_custkey) AS id FROM customer GROUP BY 1 HAVING count(*) = 1) m ON m.k = s.s_acctbal::INT % 1000", canon=False)
def _(c):
    k = lambda x: (F.round(F.col(x), 0).cast("int") % 1000).alias("k")
    left = c.read("supplier").select("s_suppkey", F.bround("s_acctbal", 0).cast("int").alias("k")).withColumn("k", F.col("k") % 1000)
    right = c.read("customer").select(F.col("c_custkey").alias("id"), F.bround("c_acctbal", 0).cast("int").alias("k")).withColumn("k", F.col("k") % 1000)
    return jon.only_match(left, right, ["k"]).select("s_suppkey", "match")


@query("jon12_service_by_name", "SELECT n_name, m.id AS match FROM nation LEFT JOIN (SELECT regexp_replace(lower(r_name), '-service$', '') AS k, min('broker:' || r_regionkey) AS id FROM region GROUP BY 1 HAVING count(*) = 1) m ON m.k = CASE WHEN n_nationkey < 5 THEN 'asia' ELSE lower(n_name) END", canon=False)
def _(c):
    right = c.read("region").select(F.concat(F.lit("broker:"), F.col("r_regionkey")).alias("id"), fp.spring_name(F.concat("r_name", F.lit("-service"))).alias("k"))
    left = c.read("nation").select("n_name", fp.spring_name(F.when(F.col("n_nationkey") < 5, "com-acme-asia-service").otherwise(F.col("n_name"))).alias("k"))
    return jon.only_match(left, right, ["k"]).select("n_name", "match")


@query("jon17_longest_prefix", "SELECT c.id, CASE WHEN c.path LIKE 'ASIA%' AND s.n_nationkey % 2 = 0 THEN 'broker:' || s.r_regionkey ELSE 'service:' || s.n_nationkey END AS owner FROM nodes c JOIN places s ON starts_with(c.path, s.place || '/') WHERE c.kind = 'http_endpoint'")
def _(c):
    services = c.services.where(~(F.col("path").startswith("ASIA") & (F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 2 == 0)))
    return jon.longest_prefix(c.endpoints, services.unionByName(c.brokers))


@query("jon20_vanished", "SELECT id FROM elements WHERE is_active AND path NOT IN (SELECT path FROM files WHERE page_id % 4 <> 0)")
def _(c):
    return jon.vanished(c.elements, c.files.where("page_id % 4 <> 0")).select("id")


@query("jon22_file_edges", "SELECT id FROM edges WHERE path = 'ASIA/INDIA/x' OR src IN (SELECT id FROM nodes WHERE path = 'ASIA/INDIA') OR dst IN (SELECT id FROM nodes WHERE path = 'ASIA/INDIA')")
def _(c):
    return jon.file_edges(c.nodes, c.edges, "ASIA/INDIA").select("id")


# -- aggregates --------------------------------------------------------------------------------------------------


@query("agg1_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _(c):
    return c.nodes.agg(F.count("*").alias("nodes")).crossJoin(c.edges.agg(F.count("*").alias("edges")))


@query("agg2_languages", "SELECT DISTINCT language FROM nodes WHERE language IS NOT NULL ORDER BY 1 LIMIT 50")
def _(c):
    return agg.languages(c.nodes)


@query("agg3_child_counts", "SELECT parent_id, count(*) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")
def _(c):
    return agg.child_counts(c.nodes)


@query("agg4_summary", "SELECT (SELECT count(*) FROM nodes) AS nodes, 'cpp,csharp,java,python,typescript' AS languages, (SELECT count(*) FROM edges) AS edges")
def _(c):
    return agg.graph_summary(c.nodes, c.edges)


@query("agg5_language_report", "SELECT language, count(*) AS file_count, array_to_string(list_sort(list(path))[1:5], ',') AS samples FROM (SELECT path, CASE WHEN ends_with(lower(path), '.html') THEN 'html' WHEN regexp_matches(path, '/en/[0-9]+$') THEN 'python' END AS language FROM files) WHERE language IS NOT NULL GROUP BY language")
def _(c):
    named = c.files.select(F.when(F.col("path").rlike("/en/[0-9]+$"), F.concat("path", F.lit(".py"))).otherwise(F.col("path")).alias("path"))
    return agg.language_report(named).select("language", "file_count", F.regexp_replace(F.array_join("sample_paths", ","), r"\.py(?=,|$)", "").alias("samples"))


@query("agg6_artifacts", "SELECT rule, count(*) AS n FROM (SELECT CASE WHEN ends_with(path, '.html') THEN 'page' WHEN starts_with(path, 'm.') THEN 'mobile' WHEN starts_with(path, 'www.') THEN 'www' END AS rule FROM files) WHERE rule IS NOT NULL GROUP BY rule")
def _(c):
    p = F.col("path")
    return agg.first_rule(c.files, [("page", p.endswith(".html")), ("mobile", p.startswith("m.")), ("www", p.startswith("www."))]).groupBy("rule").agg(F.count("*").alias("n"))


_BUS = "(url LIKE '%.html' AND contains(html, 'the ')) OR (url LIKE '%/' AND contains(html, 'of '))", "url LIKE '%.html' AND (contains(html, 'script') OR contains(html, 'and '))"


@query("agg7_bus_profile", f"SELECT count(*) FILTER ({_BUS[0]}) AS rabbit, count(*) FILTER ({_BUS[1]}) AS kafka, CASE WHEN count(*) FILTER ({_BUS[0]}) > 0 THEN 'bus-rabbit' WHEN count(*) FILTER ({_BUS[1]}) > 0 THEN 'bus-kafka' END AS parser_id FROM pages", canon=False)
def _(c):
    files = c.read("pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return agg.bus_profile(files, {"rabbit": {".html": ["the "], "/": ["of "]}, "kafka": {".html": ["script", "and "]}})


@query("agg9_degrees", "SELECT n.id, count(e.id) AS degree FROM system n LEFT JOIN (SELECT src AS n, id FROM edges UNION ALL SELECT dst, id FROM edges) e ON e.n = n.id GROUP BY n.id")
def _(c):
    return ded.degrees(c.system, c.edges)


@query("agg10_latest_status", "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 'p' || (user_id % 90) AS parser_id, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 5) SELECT parser_id, max_by(status, day) AS status FROM e WHERE day IN (SELECT day FROM d) GROUP BY 1", canon=False)
def _(c):
    rows = c.read("events").select(F.to_date("ts").cast("string").alias("day"), F.concat(F.lit("p"), F.col("user_id") % 90).alias("parser_id"), "event_type", "ts", "event_id")
    last = ded.first_by(rows, ["day", "parser_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    runs = last.groupBy(F.col("day").alias("started_at")).agg(F.collect_list(F.struct("parser_id", F.col("event_type").alias("status"))).alias("results")).withColumn("id", F.col("started_at"))
    return agg.latest_status(runs)


@query("agg11_run_status", "SELECT 'r' || (o_orderkey % 200) AS run_id, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'success' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'partial' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'failed' ELSE 'skipped' END AS status FROM orders GROUP BY 1", canon=False)
def _(c):
    rows = c.read("orders").select(F.concat(F.lit("r"), F.col("o_orderkey") % 200).alias("run_id"), F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failed").otherwise("skipped").alias("status"))
    return agg.fold_run_status(rows)


@query("agg12_ingest_status", "SELECT id, CASE WHEN deleted > 1 OR (node_count < 30 AND incremental) THEN 'partial' ELSE 'success' END AS status FROM runs")
def _(c):
    nodes = F.when(F.col("node_count") < 30, 0).otherwise(F.col("node_count"))
    return c.runs.select("id", agg.ingest_status(F.when(F.col("deleted") > 1, 1).otherwise(0), nodes, F.col("incremental").cast("int")).alias("status"))


@query("agg13_below", "SELECT count(*) AS n FROM elements WHERE is_active AND starts_with(path, (SELECT max(a) FROM steps WHERE a NOT LIKE '%/%') || '/')")
def _(c):
    top = c.elements.where("type = 'directory' and parent_path = ''").agg(F.max("path")).first()[0]
    return agg.below_count(c.elements, top)


@query("agg14_rollup_groups", "SELECT 'group:' || parent_id AS id, count(*) AS members FROM nodes WHERE kind = 'http_endpoint' AND id NOT IN (SELECT dst FROM edges WHERE type = 'http_calls' AND protocol = 'http') GROUP BY 1")
def _(c):
    return views.rollup_endpoints(c.system, c.edges.where("type <> 'contains'"), 100)[0]


@query("agg14_rollup_edges", "SELECT DISTINCT coalesce(a.g, e.src) AS src, coalesce(b.g, e.dst) AS dst, type FROM edges e LEFT JOIN folded a ON a.id = e.src LEFT JOIN folded b ON b.id = e.dst WHERE type <> 'contains' AND coalesce(a.g, e.src) <> coalesce(b.g, e.dst)".join([", folded AS (SELECT id, 'group:' || parent_id AS g FROM nodes WHERE kind = 'http_endpoint' AND id NOT IN (SELECT dst FROM edges WHERE type = 'http_calls' AND protocol = 'http')) ", ""]))
def _(c):
    return views.rollup_endpoints(c.system, c.edges.where("type <> 'contains'"), 100)[1]


@query("agg16_most_nodes", "SELECT max(node_count) AS most FROM ready")
def _(c):
    return flt.ready(c.runs).agg(F.max("node_count").alias("most"))


# -- ranking and dedupe ------------------------------------------------------------------------------------------

_COPIES = ", copies AS (SELECT id || '#' || k AS id, path, (hash_ % (k + 2)) = 0 AS is_active, (hash_ % (k + 3)) = 0 AS status_manually_set FROM (SELECT id, path, length(path) AS hash_, unnest([1, 2, 3]) AS k FROM elements)) "


def _copies(c):
    rows = c.elements.select("id", "path", F.length("path").alias("h"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    return rows.select(F.concat_ws("#", "id", F.col("k").cast("string")).alias("id"), "path", (F.col("h") % (F.col("k") + 2) == 0).alias("is_active"), (F.col("h") % (F.col("k") + 3) == 0).alias("status_manually_set"))


@query("ded1_one_element", _COPIES + "SELECT id, path FROM copies QUALIFY row_number() OVER (PARTITION BY path ORDER BY is_active DESC, status_manually_set DESC, id) = 1")
def _(c):
    return ded.one_element(_copies(c)).select("id", "path")


@query("ded2_by_path", _COPIES + "SELECT id, path FROM copies QUALIFY row_number() OVER (PARTITION BY path ORDER BY status_manually_set DESC, is_active DESC, id) = 1")
def _(c):
    return ded.element_by_path(_copies(c)).select("id", "path")


@query("ded3_superseded", _COPIES + "SELECT id FROM copies WHERE is_active QUALIFY row_number() OVER (PARTITION BY path ORDER BY status_manually_set DESC, id) > 1")
def _(c):
    return ded.superseded(_copies(c)).select("id")


@query("ded4_stable_ids", "SELECT id, parent_id FROM methods")
def _(c):
    return c.methods.select("id", "parent_id")


@query("ded5_distinct_callees", "SELECT src, dst, min(id) AS id FROM edges WHERE layer = 'system' GROUP BY src, dst")
def _(c):
    return ded.first_by(c.edges.where("layer = 'system'"), ["src", "dst"], [F.col("id").asc()]).select("src", "dst", "id")


@query("ded6_fact_dedupe", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem", canon=False)
def _(c):
    return c.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").dropDuplicates()


@query("rnk1_top_peers", ", p AS (SELECT * FROM nodes WHERE kind IN ('service', 'broker', 'external_api')), d AS (SELECT p.id, count(e.n) AS degree FROM p LEFT JOIN (SELECT src AS n FROM edges WHERE type = 'connects_to' UNION ALL SELECT dst FROM edges WHERE type = 'connects_to') e ON e.n = p.id GROUP BY 1) SELECT p.id, degree FROM p JOIN d USING (id) ORDER BY kind = 'service' DESC, CASE WHEN kind = 'service' THEN 0 ELSE degree END DESC, kind, name, id LIMIT 40")
def _(c):
    all_ = views.peers(c.system)
    return ded.top_peers(all_, jon.within(c.edges, all_), 40).select("id", "degree")


@query("rnk2_top_inside", "SELECT id FROM nodes WHERE kind IN ('http_endpoint', 'message_type') ORDER BY CASE kind WHEN 'message_type' THEN 2 ELSE 3 END, id LIMIT 2050")
def _(c):
    return ded.top_inside(c.endpoints.unionByName(c.message_types), 2050).select("id")


@query("rnk4_budget", "SELECT p_partkey, p_size * 25 AS max_nodes, least(40, greatest(8, p_size * 25 // 5)) AS reserve, greatest(0, p_size * 25 - 1 - least(40, greatest(8, p_size * 25 // 5))) AS inside FROM part", canon=False)
def _(c):
    most = F.col("p_size") * 25
    return c.read("part").select("p_partkey", most.alias("max_nodes"), *[b.alias(n) for b, n in zip(ded.budget(most), ("reserve", "inside"), strict=True)])


@query("rnk5_sample_paths", "SELECT path FROM files ORDER BY regexp_matches(path, '(index|main)[^/]*$') DESC, path LIMIT 5")
def _(c):
    entry = fp.basename(F.col("path")).rlike("^(index|main)")
    return c.files.orderBy(entry.desc(), "path").limit(5).select("path")


@query("srt1_nodes_page", f"SELECT {NODE} FROM nodes ORDER BY path NULLS FIRST, name, id LIMIT 50 OFFSET 100")
def _(c):
    return ded.page(c.nodes, ["path", "name", "id"], 100, 50)


@query("srt2_search_page", "SELECT id, name FROM nodes WHERE contains(lower(name), 'or') OR contains(lower(qualified_name), 'or') OR contains(lower(path), 'or') OR contains(lower(kind), 'or') ORDER BY name, id LIMIT 25 OFFSET 25")
def _(c):
    return ded.page(flt.search_nodes(c.nodes, "or"), ["name", "id"], 25, 25).select("id", "name")


@query("srt3_kinds_page", "SELECT id FROM nodes WHERE kind IN ('service', 'broker') ORDER BY kind, name, id LIMIT 12")
def _(c):
    return ded.page(flt.of_kinds(c.nodes, ["service", "broker"]), ["kind", "name", "id"], 0, 12).select("id")


@query("srt4_node_edges", "SELECT id FROM edges WHERE src = 'service:3' OR dst = 'service:3' ORDER BY type, id LIMIT 30")
def _(c):
    return gra.neighbours(c.edges, "service:3", "both", 30).select("id")


@query("srt5_children_page", "SELECT id FROM elements WHERE is_active AND parent_path LIKE '%.example.com' ORDER BY type, path LIMIT 40")
def _(c):
    return ded.page(c.elements.where("is_active and endswith(parent_path, '.example.com')"), ["type", "path"], 0, 40).select("id")


@query("srt6_projects", "SELECT c_custkey FROM customer ORDER BY CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey LIMIT 100", canon=False)
def _(c):
    return c.read("customer").orderBy(F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).desc_nulls_last(), "c_custkey").limit(100).select("c_custkey")


@query("srt7_newest_runs", "SELECT id FROM runs ORDER BY started_at DESC, id LIMIT 20")
def _(c):
    return c.runs.orderBy(F.col("started_at").desc(), "id").limit(20).select("id")


@query("srt8_latest_report", "SELECT user_id, max_by(value, (ts, event_id)) AS latest FROM events GROUP BY user_id", canon=False)
def _(c):
    return c.read("events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("srt9_current_job", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click' DESC, ts DESC, event_id) = 1", canon=False)
def _(c):
    jobs = c.read("events").select("user_id", F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("updated_at"))
    return ded.current_job(jobs, ["user_id"]).select("user_id", F.col("id").alias("event_id"))


_JOBS = ["angular-ui", "angularjs-ui", "appsettings", "bus-kafka", "bus-rabbit", "compose", "cpp", "csharp", "dotnet-api-routes", "dotnet-grpc-calls", "dotnet-http-calls", "dotnet-project", "gradle-project", "grpc-proto", "java", "java-api-routes", "java-grpc-calls", "java-http-calls", "maven-project", "openapi", "python", "python-api-routes", "python-grpc-calls", "python-http-calls", "react-ui", "spa-roots", "spring-config", "ts-api-routes", "ts-grpc-calls", "ts-http-calls", "typescript"]
_SPOKEN = ["cpp", "csharp", "java", "python", "typescript"]


@query(
    "srt12_job_order",
    f"""WITH j AS (SELECT {_JOBS}[(p_partkey % 31 + 1)::INT] AS parser_id, sum(p_size)::BIGINT AS n FROM part GROUP BY 1), k AS (SELECT *, list_contains({_SPOKEN}, parser_id) AS spoken FROM j), d AS (SELECT n AS dn FROM j WHERE parser_id = 'grpc-proto'),
    h AS (SELECT k.*, dn, ends_with(parser_id, 'grpc-calls') AND (n > dn OR n = dn AND parser_id < 'grpc-proto') AS held FROM k LEFT JOIN d ON true)
    SELECT parser_id, n AS file_count, row_number() OVER (ORDER BY NOT spoken, parser_id <> 'compose' AND NOT spoken, parser_id = 'openapi', CASE WHEN held THEN dn ELSE n END DESC, CASE WHEN held THEN 'grpc-proto' ELSE parser_id END, held, n DESC, parser_id)::INT AS place FROM h""",
    canon=False,
)
def _(c):
    """A job for each parser, with as many files as the parts that fall to it are large."""
    parser = F.element_at(F.array(*map(F.lit, _JOBS)), (F.col("p_partkey") % 31 + 1).cast("int"))
    jobs = c.read("part").groupBy(parser.alias("parser_id")).agg(F.sum("p_size").alias("file_count"))
    return agg.job_order(jobs.select("*", F.when(F.col("parser_id").isin(_SPOKEN), F.col("parser_id")).alias("language"), F.col("parser_id").alias("artifact_type"))).select("parser_id", "file_count", "place")


# -- set operations ----------------------------------------------------------------------------------------------


@query("set1_union_by_id", "SELECT DISTINCT id FROM (SELECT id FROM nodes WHERE kind = 'service' UNION ALL SELECT id FROM nodes WHERE path LIKE 'ASIA%')")
def _(c):
    return c.services.unionByName(c.nodes.where(F.col("path").startswith("ASIA"))).dropDuplicates(["id"]).select("id")


@query("set3_path_union", "SELECT path FROM files WHERE page_id % 3 = 0 UNION SELECT path FROM files WHERE page_id % 5 = 0")
def _(c):
    return c.files.where("page_id % 3 = 0").select("path").union(c.files.where("page_id % 5 = 0").select("path")).distinct()


@query("set4_scope_intersection", "SELECT path FROM files WHERE page_id % 2 = 0 AND path IN (SELECT path FROM elements WHERE status = 'found')")
def _(c):
    return c.files.where("page_id % 2 = 0").join(c.elements.where("status = 'found'").select("path"), "path", "left_semi").select("path")


@query("set5_change_set", "SELECT path, CASE WHEN page_id % 4 = 0 THEN 'deleted' WHEN page_id % 4 = 1 THEN 'added' ELSE 'modified' END AS change FROM files WHERE page_id % 4 < 3")
def _(c):
    before = c.files.where("page_id % 4 <> 1")
    after = c.files.where("page_id % 4 <> 0").withColumn("size", F.col("size") + F.when(F.col("page_id") % 4 == 2, 1).otherwise(0))
    return life.change_set(before, after)


@query("set6_fact_union", "SELECT 'a' AS client, s_name AS path, NULL AS url FROM supplier UNION ALL SELECT 'b', NULL, c_name FROM customer", canon=False)
def _(c):
    a = c.read("supplier").select(F.lit("a").alias("client"), F.col("s_name").alias("path"))
    b = c.read("customer").select(F.lit("b").alias("client"), F.col("c_name").alias("url"))
    return a.unionByName(b, allowMissingColumns=True)


# -- scalar functions --------------------------------------------------------------------------------------------


@query("str1_posix", "SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS path FROM pages", canon=False)
def _(c):
    return c.read("pages").select("page_id", fp.posix(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


@query("str2_ancestors", "SELECT path, a FROM steps")
def _(c):
    return c.files.select("path", F.explode(fp.ancestor_paths(F.col("path"))).alias("a"))


@query("str3_basename", "SELECT path, string_split(path, '/')[-1] AS base, lower(regexp_extract(string_split(path, '/')[-1], '\\.([^.]+)$', 1)) AS ext FROM files")
def _(c):
    return c.files.select("path", fp.basename(F.col("path")).alias("base"), fp.extension(F.col("path")).alias("ext"))


_ENDINGS = [("ts", "typescript"), ("TSX", "typescript"), ("js", "javascript"), ("jsx", "javascript"), ("mjs", "javascript"), ("cjs", "javascript"), ("py", "python"), ("pyw", "python"), ("cs", "csharp"), ("cpp", "cpp"), ("cc", "cpp"), ("cxx", "cpp"), ("h", "cpp"), ("hpp", "cpp"), ("go", "go"), ("java", "java"), ("rb", "ruby"), ("rs", "rust"), ("php", "php"), ("swift", "swift"), ("kt", "kotlin"), ("scala", "scala"), ("sh", "shell"), ("bash", "shell"), ("zsh", "shell"), ("txt", None)]


@query("str4_language", "SELECT page_id, [" + ", ".join(f"'{x}'" if x else "NULL" for _, x in _ENDINGS) + "][(page_id % 26 + 1)::INT] AS language FROM files")
def _(c):
    """Every file under each of the known endings in turn."""
    ending = F.element_at(F.array(*[F.lit(e) for e, _ in _ENDINGS]), (F.col("page_id") % 26 + 1).cast("int"))
    return c.files.select("page_id", fp.language_of(F.concat_ws(".", "path", ending)).alias("language"))


@query("str5_shebang", "SELECT p_partkey, ['python', 'javascript', NULL, NULL, 'shell', NULL][(p_partkey % 6 + 1)::INT] AS language FROM part", canon=False)
def _(c):
    k = F.col("p_partkey").cast("string")
    lines = [F.lit("#!/usr/bin/env python3"), F.concat(F.lit("#!/opt/v"), k, F.lit("/node")), F.concat(F.lit("#! /opt/v"), k, F.lit("/python2.7")), F.concat(F.lit("import x"), k), F.concat(F.lit("#!/opt/v"), k, F.lit("/bash")), F.concat(F.lit("#!/bin/tool"), k)]
    return c.read("part").select("p_partkey", fp.shebang_language(F.element_at(F.array(*lines), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("language"))


@query("str8_service_hint", "SELECT path, p[2] AS hint FROM (SELECT path, list_filter(string_split(lower(path), '/'), lambda x: x <> '' ) AS p FROM files) WHERE len(p) > 2")
def _(c):
    return c.files.where(F.size(F.split("path", "/")) > 2).select("path", fp.service_hint(F.col("path")).alias("hint"))


@query("str10_unscoped", "SELECT path, 'unscoped:' || substr(sha1(path), 1, 12) AS key FROM files")
def _(c):
    return c.files.select("path", fp.unscoped_key(F.col("path")).alias("key"))


@query("str13_fit_id", "SELECT doc_id, CASE WHEN strlen(t) <= 475 THEN t ELSE string_split(t, ':')[1] || ':h:' || substr(sha256(t), 1, 40) END AS id FROM (SELECT doc_id, 'ts:' || text AS t FROM documents)", canon=False)
def _(c):
    return c.read("documents").select("doc_id", fp.fit_id(F.concat(F.lit("ts:"), F.col("text"))).alias("id"))


@query("str14_spring_names", "SELECT p_partkey, [ 'orders' || p_partkey, 'order' || p_partkey, 'billing' || p_partkey || '-core', 'a' || p_partkey][(p_partkey % 4 + 1)::INT] AS name FROM part", canon=False)
def _(c):
    k = F.col("p_partkey").cast("string")
    names = [F.concat(F.lit("com-acme-orders"), k, F.lit("-service")), F.concat(F.lit("Order"), k, F.lit("-Service")), F.concat(F.lit("com-acme-billing"), k, F.lit("-core")), F.concat(F.lit(" a"), k, F.lit(" "))]
    return c.read("part").select("p_partkey", fp.spring_name(F.element_at(F.array(*names), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name"))


@query("str15_http_path", "SELECT page_id, CASE WHEN p = '' THEN '/' WHEN p LIKE '/%' THEN p ELSE '/' || p END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '://[^/]*(.*)$', 1), '[?#].*$', ''), '/+$', '') AS p FROM pages)", canon=False)
def _(c):
    return c.read("pages").select("page_id", ft.http_path(F.regexp_extract("url", "://[^/]*(.*)$", 1)).alias("path"))


@query("str16_join_paths", "SELECT n_nationkey, '/api/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey", canon=False)
def _(c):
    return c.read("nation").join(c.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", ft.join_paths(F.lit("api/"), F.concat(F.lit("/"), F.col("r_name")), F.concat("n_name", F.lit("/"))).alias("path"))


@query("str18_templates", "SELECT n_nationkey, '/n/:id/' || n_name || '/:x' AS colon, '/n/{id}/' || n_name || '/{x}' AS braces FROM nation", canon=False)
def _(c):
    path = F.concat(F.lit("/n/${id}/"), F.col("n_name"), F.lit("/{x}"))
    return c.read("nation").select("n_nationkey", ft.template_path(path).alias("colon"), ft.braces_path(ft.template_path(path)).alias("braces"))


@query("str20_short_label", "SELECT id, string_split(id, ':')[-1] AS label FROM nodes")
def _(c):
    return c.nodes.select("id", fp.short_label(F.col("id")).alias("label"))


@query("str21_stub_kind", "SELECT id, CASE WHEN kind IN ('class', 'method') THEN 'unknown' ELSE kind END AS guess FROM nodes")
def _(c):
    return c.nodes.select("id", jon.stub_kind(F.col("id")).alias("guess"))


@query("str22_redact", "SELECT s_suppkey, 'Host=db' || s_suppkey || ';Password=***;User Id=***' AS safe FROM supplier", canon=False)
def _(c):
    value = F.concat(F.lit("Host=db"), F.col("s_suppkey"), F.lit(";Password=p"), F.col("s_suppkey"), F.lit(";User Id=u"))
    return c.read("supplier").select("s_suppkey", ft.redact(value).alias("safe"))


_SETTINGS = [("ConnectionStrings__Main", "Host=db{};Database=x;Provider=Npgsql", "postgresql", "database", "db{}"), ("Bus", "amqp://u:p@mq{}:5672", "rabbitmq", "broker", "mq{}"), ("Redis", "redis://cache{}.local:6379", "redis", "cache", "cache{}.local"), ("Url", "https://api{}.x.org/v1", None, "http", "api{}.x.org"), ("Kafka__Servers", "server=k{}:9092", "kafka", "broker", "k{}")]
_said = lambda i, keyed: "[" + ", ".join("NULL" if s[i] is None else f"replace('{s[i]}', '{{}}', s_suppkey::VARCHAR)" if keyed else f"'{s[i]}'" for s in _SETTINGS) + "][(s_suppkey % 5 + 1)::INT]"


@query("str23_settings", f"SELECT s_suppkey, {_said(2, False)} AS engine, {_said(3, False)} AS type, {_said(4, True)} AS host FROM supplier", canon=False)
def _(c):
    """Settings of all suppliers, each with a host of its own."""
    nth = (F.col("s_suppkey") % 5 + 1).cast("int")
    k = F.element_at(F.array(*[F.lit(s[0]) for s in _SETTINGS]), nth)
    v = F.replace(F.element_at(F.array(*[F.lit(s[1]) for s in _SETTINGS]), nth), F.lit("{}"), F.col("s_suppkey").cast("string"))
    return c.read("supplier").select("s_suppkey", k.alias("k"), v.alias("v")).select("s_suppkey", ft.engine_of(F.col("k"), F.col("v")).alias("engine"), ft.binding_type(F.col("k"), F.col("v")).alias("type"), ft.target_host(F.col("v")).alias("host"))


@query("str26_flatten_json", "SELECT event_id, 'k' AS key, props ->> 'k' AS value FROM events", canon=False)
def _(c):
    from ..sources.settings import flatten_json

    return flatten_json(c.read("events").select("event_id", F.col("props").alias("content")))


@query("str28_jdbc", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'postgresql' WHEN 3 THEN 'mysql' END AS engine FROM supplier", canon=False)
def _(c):
    k = F.col("s_suppkey").cast("string")
    urls = [F.concat(F.lit("jdbc:postgresql://h"), k, F.lit("/db")), F.concat(F.lit("jdbc:mysql://${H"), k, F.lit("}/db")), F.concat(F.lit("http://x"), k), F.concat(F.lit("jdbc:mysql://h"), k, F.lit(":3306/db"))]
    return c.read("supplier").select("s_suppkey", ft.jdbc_engine(F.element_at(F.array(*urls), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("engine"))


@query("str30_grpc_names", "SELECT s_suppkey, ['Orders', 'GetOrder', 'Pay'][(s_suppkey % 3 + 1)::INT] || s_suppkey AS name FROM supplier", canon=False)
def _(c):
    k = F.col("s_suppkey").cast("string")
    names = [F.concat(F.lit(a), k, F.lit(b)) for a, b in (("Orders", "GrpcClient"), ("GetOrder", "Async"), ("Pay", "BlockingStub"))]
    return c.read("supplier").select("s_suppkey", ft.grpc_name(F.element_at(F.array(*names), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("name"))


@query("str31_url_parts", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages", canon=False)
def _(c):
    return c.read("pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))


@query("map1_metadata", "SELECT n_nationkey, n_name AS a, 'new' AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END AS c FROM nation", canon=False)
def _(c):
    old = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("old"))
    new = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("x"))).otherwise(F.create_map(F.lit("b"), F.lit("new")))
    m = ft.merge_metadata(old, new)
    return c.read("nation").select("n_nationkey", m["a"].alias("a"), m["b"].alias("b"), F.try_element_at(m, F.lit("c")).alias("c"))


@query("arr2_chunks", "SELECT path, least((row_number() OVER (ORDER BY path) - 1) // 60, CASE WHEN n > 60 AND n % 60 > 0 AND n % 60 < 6 THEN n // 60 - 1 ELSE (n + 59) // 60 - 1 END) AS chunk FROM (SELECT path, count(*) OVER () AS n FROM files)")
def _(c):
    return ded.chunk_numbers(c.files.select("path"), ["path"], 60, c.files.count())


@query("mth1_clamp", "SELECT o_orderkey, least(greatest(o_totalprice, 1000.0), 50000.0) AS price FROM orders", canon=False)
def _(c):
    return c.read("orders").select("o_orderkey", ft.clamp(F.col("o_totalprice"), F.lit(1000.0), F.lit(50000.0)).alias("price"))


@query("dat2_freshness", "SELECT id, started_at >= '2024-01-15' AS fresh FROM runs")
def _(c):
    return c.runs.select("id", (F.col("started_at") >= "2024-01-15").alias("fresh"))


@query("lay1_lanes", "SELECT id, CASE kind WHEN 'service' THEN 1 WHEN 'broker' THEN 2 ELSE 0 END AS lane, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS row FROM nodes WHERE kind IN ('service', 'broker', 'external_api')")
def _(c):
    return views.lanes(c.system.where(F.col("kind").isin("service", "broker", "external_api")))


# -- graph -------------------------------------------------------------------------------------------------------

_ANC = """, walk AS (
  SELECT id, parent_id AS ancestor, 1 AS depth FROM nodes WHERE kind = 'class' AND parent_id IS NOT NULL
  UNION ALL SELECT w.id, n.parent_id, w.depth + 1 FROM walk w JOIN nodes n ON n.id = w.ancestor WHERE n.parent_id IS NOT NULL)
"""


@query("gra1_ancestors", _ANC + "SELECT id, ancestor, depth FROM walk")
def _(c):
    return gra.ancestors(c.nodes, c.classes)


@query("gra2_subtree", "SELECT 'service:4' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM nodes WHERE parent_id = 'service:4' UNION ALL SELECT c.id, 2 FROM nodes c JOIN nodes p ON c.parent_id = p.id WHERE p.parent_id = 'service:4' UNION ALL SELECT m.id, 3 FROM methods m JOIN nodes c ON m.parent_id = c.id JOIN nodes p ON c.parent_id = p.id WHERE p.parent_id = 'service:4'")
def _(c):
    return gra.subtree(c.nodes, c.services.where("id = 'service:4'"))


@query("gra3_nearest_service", _ANC + "SELECT id, ancestor FROM walk WHERE ancestor LIKE 'service:%'")
def _(c):
    return gra.nearest_ancestor(c.nodes, c.classes, "service")


@query("gra4_neighbours", "SELECT id FROM edges WHERE dst = 'http_endpoint:10' ORDER BY type, id LIMIT 500")
def _(c):
    return gra.neighbours(c.edges, "http_endpoint:10", "in").select("id")


@query("gra5_file_dependencies", "SELECT id FROM edges WHERE path = 'EUROPE/FRANCE' OR src IN (SELECT id FROM nodes WHERE path = 'EUROPE/FRANCE') OR dst IN (SELECT id FROM nodes WHERE path = 'EUROPE/FRANCE')")
def _(c):
    return jon.file_edges(c.nodes, c.edges, "EUROPE/FRANCE").select("id")


@query("gra6_search", "SELECT id, 'node' AS part FROM nodes WHERE contains(lower(name), 'rus') OR contains(lower(qualified_name), 'rus') OR contains(lower(path), 'rus') OR contains(lower(kind), 'rus') UNION ALL SELECT id, 'edge' FROM edges WHERE contains(lower(type), 'rus') OR contains(src, 'rus') OR contains(dst, 'rus') OR contains(lower(coalesce(path, '')), 'rus')")
def _(c):
    return flt.search_nodes(c.nodes, "rus").select("id", F.lit("node").alias("part")).unionByName(flt.search_edges(c.edges, "rus").select("id", F.lit("edge").alias("part")))


_ROOT_NODES = "SELECT id, kind, name, 'inside' AS role, false AS stub FROM nodes WHERE kind IN ('service', 'broker', 'external_api') ORDER BY id LIMIT 100000"


_ROOT = """, peer AS (SELECT * FROM system WHERE kind IN ('service', 'broker', 'external_api')
), degree AS (SELECT p.id, count(e.id) AS degree FROM peer p LEFT JOIN (SELECT src AS n, id FROM edges WHERE type = 'connects_to' UNION ALL SELECT dst, id FROM edges WHERE type = 'connects_to') e ON e.n = p.id GROUP BY p.id
), kept AS (SELECT p.* FROM peer p JOIN degree USING (id) ORDER BY kind = 'service' DESC, CASE WHEN kind = 'service' THEN 0 ELSE degree END DESC, kind, name, id LIMIT {most}
), shown AS (SELECT * FROM edges WHERE type = 'connects_to' AND (src IN (SELECT id FROM kept) OR dst IN (SELECT id FROM kept)))
"""


@query("gra8_root_overview", _ROOT.format(most=27) + "SELECT id, kind, 'inside' AS role, false AS stub FROM kept UNION ALL SELECT DISTINCT dst, 'broker', 'external', true FROM shown WHERE dst NOT IN (SELECT id FROM kept)")
def _(c):
    """A budget of 27 leaves some brokers out, which edges of shown services bring back as stubs; exposes edges may not."""
    return views.root_overview(c.system, c.edges, 27)[0].select("id", "kind", "role", "stub")


@query("gra9_root_edges", _ROOT.format(most=200) + "SELECT id FROM shown ORDER BY type, id LIMIT 20")
def _(c):
    return views.root_overview(c.system, c.edges, 200, 20)[1].select("id")


@query("gra10_peers", "SELECT id FROM nodes WHERE kind IN ('service', 'message_type')")
def _(c):
    return views.peers(c.services.unionByName(c.message_types).unionByName(c.endpoints)).select("id")


@query("gra11_service_context", "SELECT id, regexp_replace(parent_id, '^x', '') AS owner FROM nodes WHERE kind = 'http_endpoint'")
def _(c):
    own = gra.nearest_ancestor(c.system, c.endpoints, "service").withColumnRenamed("ancestor", "a")
    by_path = jon.longest_prefix(c.endpoints, c.services)
    return by_path.join(own, "id", "left").select("id", F.coalesce("a", "owner").alias("owner"))


@query("gra12_inside", "SELECT id FROM nodes WHERE kind IN ('http_endpoint') AND (parent_id = 'service:5' OR id IN (SELECT dst FROM edges WHERE src = 'service:5') OR starts_with(path, (SELECT path || '/' FROM nodes WHERE id = 'service:5')))")
def _(c):
    path = c.services.where("id = 'service:5'").first()["path"]
    return views.inside_of_system({"id": "service:5", "kind": "service", "path": path}, c.system, c.edges.where("layer = 'system'")).select("id")


@query("gra13_inside_code", "SELECT id FROM classes WHERE parent_id = 'http_endpoint:50'")
def _(c):
    return views.inside_of_code({"id": "http_endpoint:50"}, c.nodes).select("id")


_FOCUS = """, inside AS (
  SELECT id FROM nodes WHERE kind = 'http_endpoint' AND parent_id = 'service:6' ORDER BY id LIMIT 21
), core AS (SELECT 'service:6' AS id UNION ALL SELECT id FROM inside
), touch AS (SELECT * FROM edges WHERE layer = 'system' AND (src IN (SELECT id FROM core) OR dst IN (SELECT id FROM core))
), ends AS (SELECT id FROM (SELECT src AS id FROM touch UNION SELECT dst FROM touch) WHERE id NOT IN (SELECT id FROM core)
), outer_ AS (SELECT e.id, row_number() OVER (ORDER BY CASE WHEN n.kind IN ('service', 'broker', 'external_api') THEN 0 ELSE 1 END, e.id) AS k FROM ends e JOIN nodes n ON n.id = e.id
), shown AS (SELECT 'service:6' AS id, 'focus' AS role UNION ALL SELECT id, 'inside' FROM inside UNION ALL SELECT id, 'external' FROM outer_ WHERE k <= 30 - (SELECT count(*) FROM core))
"""


def _focus(c):
    inside = c.endpoints.where("parent_id = 'service:6'")
    return views.focused("service:6", inside, c.system, c.edges.where("layer = 'system'"), 30, 200)


@query("gra14_focused_nodes", _FOCUS + "SELECT id, role FROM shown")
def _(c):
    return _focus(c)[0].select("id", "role")


@query("gra14_focused_edges", _FOCUS + "SELECT id FROM touch WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) ORDER BY type, id LIMIT 200")
def _(c):
    return _focus(c)[1].select("id")


@query("agg15_slice_counts", _FOCUS + "SELECT (SELECT count(*) FROM shown) AS nodes, (SELECT count(*) FROM shown WHERE role = 'focus') AS focus, (SELECT count(*) FROM shown WHERE role = 'inside') AS inside, (SELECT count(*) FROM shown WHERE role = 'external') AS external, (SELECT least(count(*), 200) FROM touch WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)) AS edges")
def _(c):
    return views.summary(*_focus(c))


@query("gra17_affiliation", "SELECT c.id, 'explicit' AS mode FROM classes c JOIN nodes e ON c.parent_id = e.id WHERE e.parent_id = 'service:8' UNION ALL SELECT m.id, 'explicit' FROM methods m JOIN nodes c ON m.parent_id = c.id JOIN nodes e ON c.parent_id = e.id WHERE e.parent_id = 'service:8'")
def _(c):
    return gra.code_of_service("service:8", "INDIA", c.nodes, c.edges.where("type = 'connects_to'"))


@query("gra17_affiliation_by_path", "SELECT id, 'path_match' AS mode FROM classes WHERE list_contains(string_split(lower(path), '/'), 'india')")
def _(c):
    return gra.code_of_service("service:none", "India", c.nodes, c.edges.where("type = 'connects_to'"))


@query("gra18_affiliated_roots", "SELECT id FROM nodes WHERE path LIKE 'ASIA/CHINA%' AND (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM nodes WHERE path LIKE 'ASIA/CHINA%'))")
def _(c):
    return gra.affiliated_roots(c.nodes, c.nodes.where(F.col("path").startswith("ASIA/CHINA"))).select("id")


@query("gra21_family_view", "SELECT id, kind, role FROM (SELECT n.id, n.kind, 'inside' AS role FROM nodes n WHERE kind IN ('service', 'broker') AND n.id IN (SELECT src FROM edges WHERE type = 'connects_to' UNION SELECT dst FROM edges WHERE type = 'connects_to'))")
def _(c):
    shown = flt.view_node(c.services.unionByName(c.brokers), "inside", False)
    return views.only_family(shown, c.edges.where("layer = 'system'"), "infra")[0].select("id", "kind", "role")


@query("gra22_lazy_tree", "SELECT id, name, id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS has_children FROM nodes WHERE parent_id = 'service:2' ORDER BY path, name, id LIMIT 50")
def _(c):
    return jon.with_children_flag(ded.page(c.nodes.where("parent_id = 'service:2'"), ["path", "name", "id"], 0, 50), c.nodes).select("id", "name", "has_children")


@query("gra23_by_path", "SELECT id FROM elements WHERE path = (SELECT max(path) FROM files)")
def _(c):
    top = c.files.agg(F.max("path")).first()[0]
    return c.elements.where(F.col("path") == top).select("id")


@query("gra24_tree_build", "SELECT DISTINCT path, type FROM elements")
def _(c):
    dirs = c.files.select(F.explode(fp.ancestor_paths(F.col("path"))).alias("path")).distinct().join(c.files.select("path"), "path", "left_anti").withColumn("type", F.lit("directory"))
    return dirs.unionByName(c.files.select("path", F.lit("file").alias("type")))


# -- lifecycle ---------------------------------------------------------------------------------------------------


@query("dml1_merge_nodes", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'N' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE 'a' END AS k, n_name AS keep FROM nation", canon=False)
def _(c):
    old = c.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.create_map(F.lit("k"), F.lit("a"), F.lit("keep"), F.col("n_name")).alias("metadata"))
    new = c.read("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("N"), F.col("n_name")).alias("name"), F.create_map(F.lit("k"), F.lit("b")).alias("metadata"))
    return life.merge_nodes(old, new).select("id", "name", F.col("metadata")["k"].alias("k"), F.col("metadata")["keep"].alias("keep"))


@query("dml2_delete_paths", "SELECT id FROM nodes WHERE kind <> 'http_endpoint' OR path NOT LIKE 'ASIA%'")
def _(c):
    gone = c.endpoints.where(F.col("path").startswith("ASIA")).select("parser_id", "path")
    return life.delete_paths(c.nodes, gone).select("id")


@query("dml3_copy_run", "SELECT 'r1' AS run_id, id FROM nodes WHERE kind = 'service' UNION ALL SELECT 'r2', id FROM nodes WHERE kind = 'service'")
def _(c):
    return life.copy_run(c.services.select(F.lit("r1").alias("run_id"), "id"), "r1", "r2")


@query("dml4_retention", "SELECT user_id AS project_id, max(event_id) AS run_id FROM events WHERE user_id = 1 GROUP BY 1 UNION ALL SELECT user_id, event_id FROM events WHERE user_id <> 1", canon=False)
def _(c):
    rows = c.read("events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"))
    last = rows.where("project_id = 1").agg(F.max("run_id")).first()[0]
    return life.keep_run(rows, 1, last if last is not None else -1)


@query("dml5_cascade", "SELECT path, CASE WHEN path = d OR (is_active AND starts_with(path, d || '/')) THEN 'needed' ELSE status END AS status FROM elements, (SELECT min(path) AS d FROM elements WHERE type = 'directory' AND parent_path = '' AND status <> 'not_needed')")
def _(c):
    top = c.elements.where("type = 'directory' and parent_path = '' and status <> 'not_needed'").agg(F.min("path")).first()[0]
    return life.cascade_status(c.elements, top, "needed", 10**9).select("path", "status")


@query("dml6_soft_delete", "SELECT id, is_active AND path IN (SELECT path FROM files WHERE page_id % 4 <> 0) AS is_active FROM elements")
def _(c):
    return life.soft_delete(c.elements, c.files.where("page_id % 4 <> 0")).select("id", "is_active")


@query(
    "dml7_sync_upserts",
    """, scanned AS (SELECT path, 'file' AS type FROM files UNION ALL SELECT path || '.new', 'file' FROM files WHERE page_id % 3 = 0),
  heir AS (SELECT DISTINCT s.path FROM scanned s JOIN elements e ON starts_with(s.path, e.path || '/') WHERE e.status = 'not_needed' AND e.status_manually_set AND e.is_active),
  j AS (SELECT s.path, s.type, e.status AS old, e.is_active AS was, e.id IS NOT NULL AS known, CASE WHEN e.id IS NOT NULL AND e.status_manually_set THEN e.status WHEN s.path IN (SELECT path FROM heir) THEN 'not_needed' WHEN e.id IS NOT NULL THEN e.status ELSE 'auto_found' END AS status FROM scanned s LEFT JOIN elements e ON e.path = s.path)
SELECT path, type, status, NOT known AS is_new FROM j WHERE NOT known OR NOT was OR status <> old""",
)
def _(c):
    scanned = c.files.select("path", F.lit("file").alias("type")).unionByName(c.files.where("page_id % 3 = 0").select(F.concat("path", F.lit(".new")).alias("path"), F.lit("file").alias("type")))
    return life.sync_upserts(c.elements, scanned)


@query("run1_latest", "SELECT id FROM (SELECT *, max(node_count) OVER () AS most FROM ready) WHERE NOT (node_count < most AND incremental AND deleted = 0) ORDER BY started_at DESC, id LIMIT 1")
def _(c):
    return life.latest_run(c.runs).select("id")


@query("run2_bootstrap", "SELECT id FROM ready ORDER BY node_count DESC, started_at DESC, id LIMIT 1")
def _(c):
    return life.bootstrap_source(c.runs, "none").select("id")


@query("run3_ui_run", "SELECT id FROM ready WHERE deleted = 2 ORDER BY started_at DESC, id LIMIT 1")
def _(c):
    return life.ui_run(c.runs, c.runs.where("deleted = 2").select(F.col("id").alias("run_id"))).select("id")


@query("run3_ui_run_fallback", "SELECT id FROM ready WHERE node_count > 0 AND (node_count = (SELECT max(node_count) FROM ready) OR NOT (incremental AND deleted = 0)) ORDER BY CASE WHEN incremental AND deleted = 0 AND node_count < (SELECT max(node_count) FROM ready) THEN 1 ELSE 0 END, started_at DESC, id LIMIT 1")
def _(c):
    return life.ui_run(c.runs, c.runs.limit(0).select(F.col("id").alias("run_id"))).select("id")


@query("run4_ingest", "SELECT n.id, e.id AS element_id FROM nodes n LEFT JOIN elements e ON e.path = n.path WHERE kind = 'broker' OR (kind = 'service' AND n.path NOT LIKE 'ASIA%')")
def _(c):
    old = c.brokers.unionByName(c.services)
    asia = c.services.where(F.col("path").startswith("ASIA")).select("path")
    return life.ingest(old.limit(0), c.connects.limit(0), old, c.connects, "canon", asia, c.elements)[0].select("id", "element_id")


@query("run5_scope", "SELECT path, CASE WHEN page_id % 4 = 0 THEN 'deleted' ELSE 'spawn' END AS role FROM files WHERE page_id % 4 < 2 AND ends_with(path, '.html')")
def _(c):
    changes = c.files.where("page_id % 4 < 2").select("path", F.when(F.col("page_id") % 4 == 0, "deleted").otherwise("added").alias("change"))
    return life.scoped_paths(changes, "html")


@query("run7_recover", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'failed' ELSE event_type END AS status FROM events", canon=False)
def _(c):
    rows = c.read("events").select("event_id", F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("status"))
    return life.recover(rows)


@query("run8_batch_check", "SELECT 'http_endpoint:' || c_custkey AS item, 'unknown kind' AS reason FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT id, 'unknown type' FROM edges WHERE type = 'connects_to'")
def _(c):
    nodes = c.endpoints.withColumn("kind", F.when(F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 100 == 0, "gadget").otherwise(F.col("kind")))
    return life.check_batch(nodes, c.connects.withColumn("type", F.lit("glues")))


@query("run10_single_job", "SELECT event_id::VARCHAR AS id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CASE WHEN user_id % 2 = 0 AND event_type = 'click' THEN 'cancelled' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events UNION ALL SELECT 'new', 'even', 'running'", canon=False)
def _(c):
    jobs = c.read("events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.lit("t").alias("updated_at"))
    return life.start_job(jobs, "even", "new", "t").drop("updated_at")


@query("run12_eligible", "SELECT id FROM ready WHERE EXISTS (SELECT 1 FROM runs WHERE graph_builder = 'parsers') ORDER BY started_at DESC, id LIMIT 1")
def _(c):
    return life.eligible_run(c.runs).select("id")


@query("run13_register", "SELECT DISTINCT p_brand AS source_type, p_type AS source_value FROM part", canon=False)
def _(c):
    rows = c.read("part").select(F.col("p_brand").alias("source_type"), F.col("p_type").alias("source_value"), "p_partkey")
    some = rows.where("p_partkey % 3 = 0").select("source_type", "source_value").distinct()
    return life.register(some, rows.select("source_type", "source_value"))
