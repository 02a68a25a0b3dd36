"""Extractors called from SQL give what extract() gives."""

from graphloom.plans.samples import FILES
from graphloom.sources.extract import REGISTRY, extract
from graphloom.sources.table_functions import REFUSED, function_name, register, versions


def test_functions_equal_extractors(spark):
    files = spark.createDataFrame([*sorted(FILES.items()), ("a/null.py", None)], "path string, text string")
    assert register(spark) == [function_name(p) for p in sorted(REGISTRY)]
    rows = lambda df: sorted(repr((r["path"], r["fact"], r["name"], r["qualified_name"], r["parent"], r["line"], r["target"], sorted(r["attrs"].items()))) for r in df.collect())
    for parser_id in ("java", "python", "compose", "react-ui"):
        got = spark.sql(f"SELECT x.* FROM {{files}} f, LATERAL {function_name(parser_id)}(f.path, f.text, '{versions(parser_id)[-1]}') x", files=files)
        assert rows(got) == rows(extract(files, parser_id)) and got.count() > 0
    first = spark.sql("SELECT x.fact FROM {files} f, LATERAL extract_java(f.path, f.text, '1') x", files=files).distinct().collect()
    assert {r["fact"] for r in first} == {"module", "namespace", "class", "interface", "method", "imports", "inherits", "implements"}
    refused = spark.sql("SELECT x.fact, x.name, x.path FROM {files} f, LATERAL extract_compose(f.path, f.text, '3') x", files=files).collect()
    assert [tuple(r) for r in refused] == [(REFUSED, "3", "docker-compose.yml")]
