"""Extraction of many and of long files: tasks, batches, and work that grows with the files."""

import ast
import time

import pyarrow as pa

from graphloom.plans import adapters, extraction
from graphloom.plans.samples import FILES
from graphloom.sources.extract import FACTS_AT_ONCE, FILES_AT_ONCE, REGISTRY, extract, reading
from graphloom.sources.extract.pytree import nodes_of, source_of


def test_parts_are_dealt_over_tasks(spark, tmp_path):
    """A part table of one row group is read by one task; its files must not be."""
    parts = 2 * extraction.PARTS_A_TASK + 1
    spark.range(parts).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("ext1_typescript", "ext3_java", "ext13_bus_rabbit", "ext14_bus_kafka", "ext28_react_ui"):
        assert extraction.files_of_parts(spark, str(tmp_path), name).rdd.getNumPartitions() == 3
    assert extraction.projects(spark, str(tmp_path), "bus-kafka").rdd.getNumPartitions() == 3


def test_adapters_read_files_once(spark):
    """Nodes and edges ask the facts several times; each time was a run of the extractor."""
    files = spark.createDataFrame(sorted(FILES.items()), "path string, text string")
    for parser_id in ("bus-rabbit", "bus-kafka", "openapi", "compose", "spring-config"):
        for frame in adapters.run(files, parser_id):
            assert "MapIn" not in frame._jdf.queryExecution().executedPlan().toString()
            assert frame.count() > 0


def test_facts_leave_in_bounded_batches():
    """A batch of many files with many facts is not turned into one frame."""
    text = "".join(f"def f{i}(): pass\n" for i in range(50))
    given, taken = 20, 0

    def batches():
        nonlocal taken
        for _ in range(given):
            taken += 1
            yield pa.RecordBatch.from_pydict({"path": [f"m{i}.py" for i in range(4 * FILES_AT_ONCE)], "text": [text] * (4 * FILES_AT_ONCE)})

    _, run = REGISTRY["python"]
    sizes, early = [], None
    for batch in reading("python", run)(batches()):
        early = taken if early is None else early
        sizes.append(batch.num_rows)
    assert max(sizes) <= FACTS_AT_ONCE and early == 1
    assert sum(sizes) == given * 4 * FILES_AT_ONCE * len(list(run("m.py", text)))


def test_names_that_are_numbers(spark):
    text = "openapi: 3.0.0\ninfo: {title: 2024}\npaths:\n  /a:\n    get: {}\n"
    rows = extract(spark.createDataFrame([("x/openapi.yaml", text)], "path string, text string"), "openapi").collect()
    assert [(r["fact"], r["name"]) for r in rows] == [("spec", "2024"), ("endpoint", "GET /a")]


def test_java_addresses_take_time_by_length():
    """Eight times the calls took 64 times as long: names were collected and the file was searched anew at each call."""
    _, run = REGISTRY["java-http-calls"]

    def took(n):
        calls = "".join(f'    rest.getForObject("http://d{i}/x", X.class);\n    web.get().uri(located() + "/{i}").retrieve();\n    String v{i} = "a{i}";\n' for i in range(n))
        text = f'class C {{\n  RestTemplate rest; WebClient web;\n  void run() {{\n{calls}  }}\n  String located() {{ return d.getInstances("s").get(0).toString(); }}\n}}\n'
        start = time.perf_counter()
        assert len(list(run("C.java", text))) == 2 * n
        return time.perf_counter() - start

    took(20)
    assert took(320) < 24 * min(took(40) for _ in range(3))


def test_trees_of_python_files_are_walked_at_once():
    """The walk gives the nodes of ``ast.walk`` in its order, without operators and contexts, and dotted names are those of ``ast.unparse``."""
    text = "import a.b as c\nfrom . import d\nx: c.E = c.f(1, *y, k=[-z[0], (yield)])[1:2].g\nasync def h(p: int = 3, *q, r=None, **s) -> None:\n    async with t.u(v=f'{x!r:>{w}}') as i, j:\n        return not x and {k: 1 < 2 + l for k in m if n}\nmatch o:\n    case {'a': [1, *_]} | None:\n        pass\n"
    texts = [text, "", *(t for p, t in FILES.items() if p.endswith(".py") and not p.startswith("broken"))]
    uses = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
    for tree in map(ast.parse, texts):
        assert nodes_of(tree) == [n for n in ast.walk(tree) if not isinstance(n, uses)]
        assert all(source_of(n) == ast.unparse(n) for n in ast.walk(tree) if isinstance(n, ast.expr))
    assert source_of(ast.parse("a(1).b.c", mode="eval").body) == "a(1).b.c"
