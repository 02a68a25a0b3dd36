from pyspark.sql import functions as F

from graphloom.plans.samples import FILES
from graphloom.sources import envelopes, files, settings, sinks
from graphloom.sources.extract import REGISTRY, extract


def test_scan_of_a_working_copy(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / ".git/x").write_text("no")
    (tmp_path / "src/deep/a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1\2")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bad")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r["path"] for r in found.select("path").collect()) == ["b.bin", "c.txt", "src/deep/a.py"]
    assert [tuple(r) for r in files.texts(found).collect()] == [("src/deep/a.py", "x = 1\n")]
    assert {tuple(r) for r in files.tree(found).where("type = 'directory'").collect()} == {("src", "directory"), ("src/deep", "directory")}
    plan = files.inventory(found)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_envelopes(spark):
    good = '{"parser_id": "p", "schema_version": "1", "analysis_run_id": "r", "model": {"a": 1}}'
    rows = spark.createDataFrame([(1, good), (2, "{"), (3, '{"parser_id": "p"}'), (4, good.replace('"r"', '"other"'))], "n int, raw string")
    assert [r["n"] for r in envelopes.parse_envelopes(rows, "raw", "r").collect()] == [1]
    assert sorted(r["n"] for r in envelopes.invalid_envelopes(rows, "raw").collect()) == [2, 3]


def test_settings(spark):
    df = spark.createDataFrame([("j", '{"A": {"B": 1, "C": null, "D": [1], "E": true}}'), ("bad", "{")], "path string, content string")
    assert {tuple(r) for r in settings.flatten_json(df).collect()} == {("j", "A__B", "1"), ("j", "A__E", "true")}
    env = spark.createDataFrame([("e", "# c\nexport A='x'\nB = 2\n\nnope\n")], "path string, content string")
    assert {tuple(r) for r in settings.parse_env(env).collect()} == {("e", "A", "x"), ("e", "B", "2")}
    props = spark.createDataFrame([("e", "! c\na.b=1\nc: 2\n")], "path string, content string")
    assert {tuple(r) for r in settings.parse_properties(props).collect()} == {("e", "a.b", "1"), ("e", "c", "2")}


def test_run_partitions_are_overwritten_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("p", "r1", 1), ("p", "r2", 2)], "project_id string, run_id string, x int")
    sinks.save_run(rows, path)
    sinks.save_run(rows.where("run_id = 'r2'").withColumn("x", F.lit(9)), path)
    assert {(r["run_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("r1", 1), ("r2", 9)}


def test_unreadable_files_stop_nothing(spark):
    for parser in REGISTRY:
        extract(spark.createDataFrame(sorted(FILES.items()), "path string, text string").limit(0), parser)
    assert [r.fact for r in extract(spark.createDataFrame(sorted(FILES.items()), "path string, text string").where("path = 'broken/bad.py'"), "python").collect()] == ["unreadable"]
    assert extract(spark.createDataFrame(sorted(FILES.items()), "path string, text string").where("path in ('broken/bad.py', 'tools/base.py')"), "python").count() == 4
