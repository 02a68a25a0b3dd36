"""Operators on small inline graphs: cycles, ties, missing ends, empty frames."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths as fp
from graphloom.functions import text as ft
from graphloom.operators import aggregates as agg
from graphloom.operators import dedupe as ded
from graphloom.operators import filters as flt
from graphloom.operators import graph as gra
from graphloom.operators import joins as jon
from graphloom.operators import lifecycle as life
from graphloom.operators import views

NODE = "id string, parser_id string, kind string, name string, qualified_name string, language string, path string, parent_id string, layer string"
EDGE = "id string, parser_id string, type string, src string, dst string, path string, layer string, protocol string"


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, "p", k, i, i, None, path, parent, layer) for i, k, path, parent, layer in rows], NODE)


def edges_of(spark, rows):
    return spark.createDataFrame([(f"{t}:{a}->{b}", "p", t, a, b, None, "system", proto) for t, a, b, proto in rows], EDGE)


@pytest.fixture
def small(spark):
    nodes = nodes_of(spark, [
        ("s1", "service", "s1", None, "system"), ("s2", "service", "s2", None, "system"), ("b", "broker", "b", None, "system"), ("e1", "http_endpoint", "s1/e1", "s1", "system"),
        ("t", "message_topic", "b/t", "b", "system"), ("c1", "class", "s1/src/C", "m", "code"), ("m", "module", "s1/src", None, "code"), ("scr", "ui_screen", "ui", None, "ui"),
    ])
    edges = edges_of(spark, [("http_calls", "s2", "e1", "http"), ("connects_to", "s1", "b", None), ("exposes", "s1", "e1", None), ("publishes", "s1", "t", None), ("http_calls", "s1", "ghost:external_api:x", "http"), ("contains", "m", "c1", None), ("binds_service", "scr", "s1", None)])
    return nodes, edges


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_cycle_is_walked_once(spark):
    nodes = nodes_of(spark, [("a", "class", "", "b", "code"), ("b", "class", "", "a", "code"), ("c", "class", "", "gone", "code")])
    assert {tuple(r) for r in gra.ancestors(nodes, nodes.where("id in ('a', 'c')")).collect()} == {("a", "b", 1)}
    assert {tuple(r) for r in gra.subtree(nodes, nodes.where("id = 'a'")).collect()} == {("a", 0), ("b", 1)}


def test_incidence_counts_each_edge_once(small):
    nodes, edges = small
    assert ids(jon.incident(edges, nodes.where("id in ('s1', 'e1')"))) == ["binds_service:scr->s1", "connects_to:s1->b", "exposes:s1->e1", "http_calls:s1->ghost:external_api:x", "http_calls:s2->e1", "publishes:s1->t"]
    assert jon.incident(edges, nodes.limit(0)).count() == 0


def test_no_nested_loop_joins(small):
    nodes, edges = small
    for df in (jon.incident(edges, nodes), jon.longest_prefix(nodes, nodes), jon.within(edges, nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unsound_edges(spark, small):
    nodes, edges = small
    kept = ids(jon.sound(edges, nodes.where("id <> 't'")))
    assert "http_calls:s1->ghost:external_api:x" in kept and "publishes:s1->t" not in kept


def test_stub_kinds(spark):
    df = spark.createDataFrame([("x:class:y",), ("broker:b",), ("x:ui_thing:y",), ("plain",), ("",)], "id string")
    assert [r[0] for r in df.select(jon.stub_kind(F.col("id"))).collect()] == ["class", "broker", "ui_thing", "unknown", "unknown"]


def test_root_overview_shows_peers_and_stubs(small):
    shown, edges = views.root_overview(*small)
    rows = {r["id"]: (r["role"], r["stub"]) for r in shown.collect()}
    assert rows["s1"] == ("inside", False) and rows["ghost:external_api:x"] == ("external", True)
    assert "e1" not in rows and "c1" not in rows
    assert ids(edges) == ["connects_to:s1->b", "http_calls:s1->ghost:external_api:x"]


def test_topics_are_peers_without_a_broker(small):
    nodes, _ = small
    assert "t" not in ids(views.peers(nodes)) and "t" in ids(views.peers(nodes.where("id <> 'b'")))


def test_focused_view_hides_code(small):
    nodes, edges = small
    inside = views.inside_of_system({"id": "s1", "kind": "service", "path": "s1"}, nodes, edges)
    shown, kept = views.focused("s1", inside, nodes, edges, 50)
    roles = {r["id"]: r["role"] for r in shown.collect()}
    assert roles["s1"] == "focus" and roles["e1"] == "inside" and roles["s2"] == "external" and "scr" not in roles
    assert "binds_service:scr->s1" not in ids(kept)


def test_budget():
    assert ded.budget(200) == (40, 159) and ded.budget(10) == (8, 1) and ded.budget(1) == (8, 0)


def test_self_loop_counts_twice(spark):
    nodes = nodes_of(spark, [("a", "service", "", None, "system"), ("z", "service", "", None, "system")])
    assert {tuple(r) for r in ded.degrees(nodes, edges_of(spark, [("calls", "a", "a", None)])).collect()} == {("a", 2), ("z", 0)}


def test_status_scope(spark):
    rows = [("a", "needed"), ("a/b", "not_needed"), ("a/b/c", "found"), ("d/e", "found")]
    df = spark.createDataFrame(rows, "path string, status string")
    assert sorted(r["path"] for r in flt.analysed(df).collect()) == ["a", "d/e"]


@pytest.mark.parametrize(("pattern", "path", "fits"), [("**/x.py", "x.py", True), ("**/x.py", "a/b/x.py", True), ("*.py", "a/x.py", False), ("a/**", "a/b/c", True), ("a?c", "abc", True), ("a.c", "abc", False)])
def test_glob(spark, pattern, path, fits):
    assert spark.range(1).select(fp.matches_glob(F.lit(path), pattern)).first()[0] is fits


def test_long_ids_are_hashed(spark):
    long_ = "ts:" + "é" * 300
    got = spark.createDataFrame([("ts:short",), (long_,)], "i string").select(fp.fit_id(F.col("i"))).collect()
    assert got[0][0] == "ts:short" and got[1][0].startswith("ts:h:") and len(got[1][0]) == 45


def test_http_path_keeps_plus_and_bad_escapes(spark):
    df = spark.createDataFrame([("/a%20b/?q=1",), ("/a+b",), ("/%zz/",), ("",)], "p string")
    assert [r[0] for r in df.select(ft.http_path(F.col("p"))).collect()] == ["/a b", "/a+b", "/%zz", "/"]


def test_choice_of_run(spark):
    cols = "id string, started_at string, status string, ingest_status string, node_count long, incremental boolean, deleted long"
    rows = [("r3", "3", "success", "success", 5, True, 0), ("r2", "2", "success", "partial", 9, False, 0), ("r1", "1", "failed", "success", 99, False, 0)]
    runs = spark.createDataFrame(rows, cols)
    assert life.latest_run(runs).first()["id"] == "r2" and life.bootstrap_source(runs, "r2").first()["id"] == "r3"
    deleted = spark.createDataFrame([("r3", "3", "success", "success", 5, True, 2), rows[1]], cols)
    assert life.latest_run(deleted).first()["id"] == "r3" and life.latest_run(runs.limit(0)).count() == 0


def test_cascade(spark):
    cols = "id string, path string, status string, is_active boolean, status_manually_set boolean"
    df = spark.createDataFrame([("1", "a", "needed", True, False), ("2", "a/b", "found", True, False), ("3", "a/c", "found", False, False), ("4", "ab", "found", True, False)], cols)
    assert {r["path"]: r["status"] for r in life.cascade_status(df, "a", "not_needed").collect()} == {"a": "not_needed", "a/b": "not_needed", "a/c": "found", "ab": "found"}
    lifted = life.cascade_status(df.withColumn("status", F.lit("not_needed")), "a", "needed")
    assert {r["path"] for r in lifted.where("status = 'needed'").collect()} == {"a"}
    with pytest.raises(ValueError):
        life.cascade_status(df, "a", "not_needed", limit=0)


def test_change_set(spark):
    cols = "path string, mtime_ms long, size long"
    a, b = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], cols), spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("n", 1, 1)], cols)
    assert {tuple(r) for r in life.change_set(a, b).collect()} == {("y", "modified"), ("z", "deleted"), ("n", "added")}


def test_merge_keeps_old_fields(spark):
    cols = "id long, name string, metadata map<string,string>"
    old = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "b", None)], cols)
    new = spark.createDataFrame([(1, None, {"y": "3"}), (3, "c", {"z": "4"})], cols)
    got = {r["id"]: (r["name"], r["metadata"]) for r in life.merge_nodes(old, new).collect()}
    assert got == {1: ("a", {"x": "1", "y": "3"}), 2: ("b", {}), 3: ("c", {"z": "4"})}


def test_bad_batches_are_told(spark, small):
    nodes, edges = small
    assert life.check_batch(nodes, edges).count() == 0
    assert life.check_batch(nodes.withColumn("kind", F.lit("x")), edges).count() == nodes.count()


def test_chunks(spark):
    df = spark.range(0, 103).select(F.format_string("%03d", "id").alias("path"))
    assert dict(ded.chunk_numbers(df, ["path"], 50, 103).groupBy("chunk").count().collect()) == {0: 50, 1: 53}
    assert dict(ded.chunk_numbers(df, ["path"], 0, 103).groupBy("chunk").count().collect()) == {0: 103}


def test_run_folds(spark):
    df = spark.createDataFrame([("a", "success"), ("a", "failed"), ("b", "success"), ("c", "failed"), ("d", "skipped")], "run_id string, status string")
    assert dict(agg.fold_run_status(df).collect()) == {"a": "partial", "b": "success", "c": "failed", "d": "skipped"}


def test_affiliation_prefers_explicit_links(small):
    nodes, edges = small
    got = {tuple(r) for r in gra.code_of_service("s1", "s1", nodes, edges).collect()}
    assert got == {("c1", "path_match"), ("m", "path_match")}
    linked = edges.unionByName(edges.limit(1).withColumns({"id": F.lit("x"), "src": F.lit("c1"), "dst": F.lit("s1")}))
    assert {tuple(r) for r in gra.code_of_service("s1", "s1", nodes, linked).collect()} == {("c1", "explicit")}


def test_job_order_is_topological(spark):
    """Always the job of the most files among those whose predecessors have run."""
    import random

    from graphloom.operators import aggregates as agg

    r = random.Random(4)
    ids = ["compose", "openapi", "grpc-proto", "java-grpc-calls", "ts-grpc-calls", "ts-api-routes", "appsettings", "python", "typescript", "bus-kafka"]
    for _ in range(12):
        jobs = [(i, i if i in ("python", "typescript") else None, i, r.randrange(1, 6)) for i in r.sample(ids, r.randrange(1, len(ids) + 1))]
        have = {j[0] for j in jobs}

        def before(a, b):
            spoken = ("python", "typescript")
            return (a in spoken) > (b in spoken) or (a not in spoken and b not in spoken and (a == "compose" or b == "openapi" or (a == "grpc-proto" and b.endswith("grpc-calls"))) and a != b and a != "openapi" and b != "compose")

        want, left = [], list(jobs)
        while left:
            free = [j for j in left if not any(before(o[0], j[0]) for o in left)]
            pick = min(free, key=lambda j: (-j[3], j[2]))
            want.append(pick[0])
            left.remove(pick)
        got = agg.job_order(spark.createDataFrame(jobs, "parser_id string, language string, artifact_type string, file_count long")).orderBy("place").collect()
        assert [x["parser_id"] for x in got] == want and len(have) == len(got)


def test_all_externals_whatever_a_view_has_room_for(spark):
    """A view stops at its budget; the candidates don't."""
    nodes = nodes_of(spark, [(f"http_endpoint:{i}", "http_endpoint", f"s/{i}", "s", "system") for i in range(30)] + [(f"message_type:{i}", "message_type", "m", None, "system") for i in range(60)] + [("class:1", "class", "s/1/C", "http_endpoint:1", "code")])
    edges = edges_of(spark, [("consumes", f"http_endpoint:{i % 30}", f"message_type:{i}", None) for i in range(60)] + [("contains", "http_endpoint:1", "class:1", None), ("http_calls", "http_endpoint:2", "ghost:external_api:x", None)])
    inside = nodes.where("kind = 'http_endpoint'")
    assert ids(views.externals(inside, nodes, edges)) == sorted([f"message_type:{i}" for i in range(60)] + ["ghost:external_api:x"])
    shown, _ = views.focused("none", inside, nodes, edges, 60, 60)
    assert shown.count() == 60 and shown.where("role = 'external'").count() < 61


def test_small_sets_of_ids_move_no_edges(spark, tmp_path):
    """The size of a filtered table is not known before it is run; it is known of the ids once written."""
    kinds = ["service:", "class:", "plain"]
    nodes = nodes_of(spark, [(f"{k}{i}", "x", f"p{i}", None, "system") for k in kinds for i in range(20)])
    edges = edges_of(spark, [("t", f"{a}{i}", f"{b}{(i * 7) % 25}", None) for a in kinds for b in kinds for i in range(25)])
    chosen = nodes.where("path in ('p1', 'p3', 'p7')")
    own = set(ids(chosen))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = edges.collect()
    for most in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            assert ids(jon.within(edges, chosen)) == sorted(r["id"] for r in rows if r["src"] in own and r["dst"] in own)
            assert ids(jon.incident(edges, chosen)) == sorted(r["id"] for r in rows if r["src"] in own or r["dst"] in own)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wide, ends = str(tmp_path / "nodes"), str(tmp_path / "edges")
    spark.range(200_000).selectExpr("concat('class:', id) as id", "sha2(cast(id as string), 512) as path").write.parquet(wide)
    spark.range(200_000).selectExpr("concat('e', id) as id", "concat('class:', id) as src", "concat('class:', sha2(cast(id as string), 256)) as dst").write.parquet(ends)
    few = spark.read.parquet(wide).where("path like 'ffff%'")
    assert "SortMergeJoin" not in jon.within(spark.read.parquet(ends), few)._jdf.queryExecution().executedPlan().toString()
