"""Registered extraction queries over files made of all parts, adapter queries over the sample repository, and their expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.extract import REGISTRY, UNREADABLE, extract
from . import adapters
from .golden import EXPECTED
from .lineage import spread
from .samples import FILES

#: Parts whose files one task reads.
PARTS_A_TASK = 2000

#: Query name -> parser id.
EXTRACTORS = {
    "ext1_typescript": "typescript", "ext2_csharp": "csharp", "ext3_java": "java", "ext4_python": "python", "ext5_cpp": "cpp", "ext6_compose": "compose", "ext7_appsettings": "appsettings", "ext8_openapi": "openapi",
    "ext9_dotnet_project": "dotnet-project", "ext10_maven": "maven-project", "ext11_gradle": "gradle-project", "ext12_spring_config": "spring-config", "ext13_bus_rabbit": "bus-rabbit", "ext14_bus_kafka": "bus-kafka",
    "ext15_ts_api_routes": "ts-api-routes", "ext16_dotnet_api_routes": "dotnet-api-routes", "ext17_java_api_routes": "java-api-routes", "ext18_python_api_routes": "python-api-routes", "ext19_ts_http_calls": "ts-http-calls",
    "ext20_dotnet_http_calls": "dotnet-http-calls", "ext21_java_http_calls": "java-http-calls", "ext22_python_http_calls": "python-http-calls", "ext23_grpc_proto": "grpc-proto", "ext24_ts_grpc_calls": "ts-grpc-calls",
    "ext25_java_grpc_calls": "java-grpc-calls", "ext26_dotnet_grpc_calls": "dotnet-grpc-calls", "ext27_python_grpc_calls": "python-grpc-calls", "ext28_react_ui": "react-ui", "ext29_angular_ui": "angular-ui", "ext30_angularjs_ui": "angularjs-ui", "ext31_spa_roots": "spa-roots",
}
ADAPTED = {
    "adp1_symbols": "python", "adp2_compose": "compose", "adp3_appsettings": "appsettings", "adp4_openapi": "openapi", "adp5_dotnet_project": "dotnet-project", "adp6_maven": "maven-project", "adp6_gradle": "gradle-project", "adp7_spring_config": "spring-config",
    "adp8_bus_rabbit": "bus-rabbit", "adp9_bus_kafka": "bus-kafka", "adp10_ts_routes": "ts-api-routes", "adp10_java_routes": "java-api-routes", "adp11_ts_http_calls": "ts-http-calls", "adp12_python_http_calls": "python-http-calls", "adp12_java_http_calls": "java-http-calls",
    "adp12_dotnet_http_calls": "dotnet-http-calls", "adp13_grpc_proto": "grpc-proto", "adp14_java_grpc_calls": "java-grpc-calls", "adp16_angularjs_ui": "angularjs-ui",
}
FACT = ["path", "fact", "name", "parent", "line", "target", "attrs"]
GRAPH = ["part", "id", "kind", "src", "dst"]
#: For each extractor a piece of the sample files that gets the key of a part behind it ({}), and what facts show of it if that is not the same.
VARIED = {
    "ext1_typescript": ("Model",), "ext2_csharp": ("Document",), "ext3_java": ("Closeable",), "ext4_python": ("Loader",), "ext5_cpp": ("area",), "ext6_compose": ("acme/api",), "ext7_appsettings": ("db1",), "ext8_openapi": ("/carts",),
    "ext9_dotnet_project": ("Polly",), "ext10_maven": (">root", ">root{}", "root", "root{}"), "ext11_gradle": ('"g"', '"g{}"', "group=g", "group=g{}"), "ext12_spring_config": ("8081",), "ext13_bus_rabbit": ("mails",), "ext14_bus_kafka": ("acks",),
    "ext15_ts_api_routes": ("/carts",), "ext16_dotnet_api_routes": ('"api/', '"api{}/', "/api/", "/api{}/"), "ext17_java_api_routes": ("/carts",), "ext18_python_api_routes": ("/items",), "ext19_ts_http_calls": ("/orders",),
    "ext20_dotnet_http_calls": ("/rates",), "ext21_java_http_calls": ("/items",), "ext22_python_http_calls": ("/today",), "ext23_grpc_proto": ("Put",), "ext24_ts_grpc_calls": ("getOrder",),
    "ext25_java_grpc_calls": ("Orders",), "ext26_dotnet_grpc_calls": ("Orders",), "ext27_python_grpc_calls": ("Orders",), "ext28_react_ui": ("buy",), "ext29_angular_ui": ("home",), "ext30_angularjs_ui": ("/start",), "ext31_spa_roots": ("18.0.0",),
}


def _varied(name: str) -> tuple[str, str, str, str]:
    own = VARIED[name]
    return own if len(own) == 4 else (own[0], own[0] + "{}") * 2


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey) of all parts, dealt over tasks before their files are made."""
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), PARTS_A_TASK)


def files_of_parts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(path, text): the sample files of an extractor once for each part, with the part's key in them."""
    marks, _ = REGISTRY[EXTRACTORS[name]]
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in sorted(FILES.items()) if not marks or p.endswith(marks)])
    rows = _keys(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("key"), F.explode(files).alias("f"))
    piece, shown, _, _ = _varied(name)
    return rows.select("f.path", F.replace("f.text", F.lit(piece), F.replace(F.lit(shown), F.lit("{}"), F.col("key"))).alias("text"))


def facts_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
        return extract(files_of_parts(spark, sf_dir, name), EXTRACTORS[name]).where(F.col("fact") != UNREADABLE).withColumn("attrs", text).select(FACT)

    return run


def _facts_sql(name: str) -> str:
    _, _, piece, shown = _varied(name)
    varied = lambda c: f"replace({c}, '{piece}', replace('{shown}', '{{}}', p_partkey::VARCHAR)) AS {c}"
    columns = ", ".join(varied(c) if c in ("name", "parent", "target", "attrs") else c for c in FACT)
    return f"SELECT {columns} FROM part, ({_values(FACT, EXPECTED[name])})"


#: Folders that carry no key although files stand in them: their names are also services that others name.
FIXED_FOLDERS = {"ts-http-calls": {"backend"}}
#: Pieces of texts that name folders or modules, and what stands for them.
NAMED = {"dotnet-project": ("..\\core\\", "..\\core{}\\"), "angularjs-ui": ('"old"', '"old{}"'), "maven-project": (">shop<", ">shop{}<"), "python": ("Reader", "Reader{}")}
COMPOSE_FILE = "docker-compose.yml"


def _folders(parser_id: str) -> list[str]:
    """First folders of the sample files that an extractor reads."""
    marks, _ = REGISTRY[parser_id]
    found = {p.split("/")[0] for p in FILES if "/" in p and (not marks or p.endswith(marks))}
    return sorted(found - FIXED_FOLDERS.get(parser_id, set()))


def projects(spark: SparkSession, sf_dir: str, parser_id: str) -> DataFrame:
    """(path, text): for each part a project of its own, the sample files that an extractor reads under folders that carry the part's key."""
    marks, _ = REGISTRY[parser_id]
    files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in sorted(FILES.items()) if not marks or p.endswith(marks)])
    rows = _keys(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("key"), F.explode(files).alias("f"))
    piece, shown = NAMED.get(parser_id, ("\x00", ""))
    path = F.when(F.col("f.path") == COMPOSE_FILE, F.concat(F.lit("p"), "key", F.lit("/" + COMPOSE_FILE))).otherwise(F.regexp_replace("f.path", F.lit(f"^({'|'.join(_folders(parser_id)) or ' '})/"), F.concat(F.lit("$1"), "key", F.lit("/"))))
    return rows.select(path.alias("path"), F.replace("f.text", F.lit(piece), F.replace(F.lit(shown), F.lit("{}"), F.col("key"))).alias("text"))


def graph_query(parser_id: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges = adapters.run(projects(spark, sf_dir, parser_id), parser_id)
        null = F.lit(None).cast("string")
        n = nodes.select(F.lit("node").alias("part"), "id", "kind", F.col("parent_id").alias("src"), null.alias("dst"))
        return n.unionByName(edges.select(F.lit("edge").alias("part"), "id", F.col("type").alias("kind"), "src", "dst"))

    return run


def _graph_sql(name: str) -> str:
    """The recorded rows once for each part, their folders (and what is named after them) with its key; rows that name none stand once."""
    parser_id = ADAPTED[name]
    at = f"'(^|[:#>|])({'|'.join(_folders(parser_id)) or ' '})([/#|.:]|->|$)'"
    keyed = lambda c: f"regexp_replace({c}, {at}, '\\1\\2' || p_partkey || '\\3', 'g')"
    if parser_id == "compose":
        keyed = lambda c: f"replace({c}, '{COMPOSE_FILE}', 'p' || p_partkey || '/{COMPOSE_FILE}')"
    if parser_id == "python":  # bases are found by names that stand once
        plain = keyed
        keyed = lambda c: f"replace({plain(c)}, 'Reader', 'Reader' || p_partkey)"
    columns = ", ".join(f"{keyed(c)} AS {c}" if c in ("id", "src", "dst") else c for c in GRAPH)
    return f"SELECT DISTINCT {columns} FROM part, ({_values(GRAPH, EXPECTED[name])})"


def _values(columns: list[str], rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    cast = ", ".join(f"{c}::{'INT' if c == 'line' else 'VARCHAR'} AS {c}" for c in columns)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({', '.join(columns)})"


QUERIES = {**{n: facts_query(n) for n in EXTRACTORS}, **{n: graph_query(p) for n, p in ADAPTED.items()}}
ORACLES = {n: _facts_sql(n) if n in EXTRACTORS else _graph_sql(n) for n in EXPECTED}
