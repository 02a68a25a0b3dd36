"""Lifecycle, lookup and naming rules on small inline tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as ft
from graphloom.operators import aggregates as agg
from graphloom.operators import dedupe as ded
from graphloom.operators import filters as flt
from graphloom.operators import joins as jon
from graphloom.operators import lifecycle as life
from graphloom.sources import extract as ex
from graphloom.sources import registry
from graphloom.sources.extract.lex import Source


def test_a_batch_folds_its_duplicates(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, kind string")
    new = spark.createDataFrame([(1, 1, None, "z"), (1, 2, "c", None), (3, 1, "d", "w")], "id long, at int, name string, kind string")
    got = sorted(map(tuple, life.merge_nodes(old, new, order=F.col("at")).collect()))
    assert got == [(1, "c", "z"), (2, "b", "y"), (3, "d", "w")]
    assert life.upsert(old, new.drop("at"), ["id"]).count() == 3


def test_a_node_has_one_element(spark):
    nodes = spark.createDataFrame([("n", "p"), ("m", None)], "id string, path string")
    elements = spark.createDataFrame([("e1", "p", False, False), ("e2", "p", True, False)], "id string, path string, is_active boolean, status_manually_set boolean")
    assert sorted(map(tuple, jon.linked_elements(nodes, elements).select("id", "element_id").collect())) == [("m", None), ("n", "e2")]


def test_project_delete(spark):
    rows = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "project_id string, n int")
    jobs = lambda status: spark.createDataFrame([("p", "sync", status)], "project_id string, kind string, status string")
    left = life.delete_project({"runs": rows, "ai_jobs": rows}, jobs("done"), "p")
    assert sorted(r.n for r in left["runs"].collect()) == [2, 3] and left["ai_jobs"].count() == 3
    with pytest.raises(ValueError, match="running"):
        life.delete_project({"runs": rows}, jobs("running"), "p")


def test_prune_and_finalize(spark):
    rows = spark.createDataFrame([("p", "r1"), ("p", "r2"), ("q", "r1")], "project_id string, run_id string")
    runs = spark.createDataFrame([("p", "r2", 5, 0), ("q", "r2", 0, 0)], "project_id string, run_id string, nodes int, errors int").withColumn("status", life.finalize(F.col("nodes"), F.col("errors")))
    assert sorted(map(tuple, life.prune(rows, runs).collect())) == [("p", "r2"), ("q", "r1")]


def test_latest_status_of_equal_times(spark):
    runs = spark.createDataFrame([(str(i), "t", [("x", f"s{i}")]) for i in range(8)], "id string, started_at string, results array<struct<parser_id:string,status:string>>")
    assert agg.latest_status(runs).collect() == [("x", "s7")]


def test_places_across_ranges(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1009).repartition(7)
    got = ded.places(rows, ["k"]).orderBy("k").select("_place").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_helper_calls(spark):
    imports = spark.createDataFrame([("s", "m", "f", True), ("s", "m", "g", False), ("t", "o", "f", True)], "screen string, module string, name string, used boolean")
    exports = spark.createDataFrame([("m", "f", "GET /a"), ("m", "f", "GET /b"), ("m", "g", "GET /c")], "module string, name string, target string")
    assert sorted(map(tuple, jon.helper_calls(imports, exports).collect())) == [("s", "GET /a"), ("s", "GET /b")]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (ft.splat_path, {"/v1/Nodes/a/b/": "/v1/nodes/*", "/files/*": "/files/*", "/graph/summary": "/graph/summary", "//": "/", "/files/x/nodes/y": "/files/x/nodes/*"}),
        (ft.compose_file, {"backend/a.ts": "docker/docker-compose.dev.yml", "my/backend/a.ts": "docker-compose.yml", "parsers\\x": "docker/docker-compose.dev.yml"}),
        (ft.api_template, {"/api/v1/orders/${encode(id)}?x": "/orders/{id}", "items": "/items", "${base}/api/v1/x": "/x", "/": "", "/a/${f({b: 1})}/c": "/a/{id}/c"}),
        (ft.decode_id, {"a%3Ab": "a:b", "a%253Ab": "a:b", "a%ZZ": "a%ZZ", "a+b": "a+b"}),
    ],
)
def test_names(spark, function, cases):
    got = spark.createDataFrame(list(cases.items()), "given string, wanted string").select("given", function(F.col("given")).alias("got"), "wanted").collect()
    assert [(r.given, r.got) for r in got] == [(r.given, r.wanted) for r in got]


def test_bound_services(spark):
    rows = [("x", "Shop Frontend", "a/b", "frontend"), ("shop", "s", "apps/web/src/main.ts", "web"), ("", "s", "src/shop/app.ts", "shop"), ("", "s", "src/app.ts", None)]
    got = spark.createDataFrame(rows, "key string, name string, path string, wanted string").select(F.element_at(F.split(ft.bound_service(F.col("key"), F.col("name"), F.col("path")), "#"), -1).alias("got"), "wanted").collect()
    assert [r.got for r in got] == [r.wanted for r in got]


def test_registry(spark):
    rows = [("a", "a", ["java"], "run", 1, 9), ("b", "b", ["java", "cpp"], "run", 1, 9), ("c", "x", ["cpp"], "run", 1, 9), ("d", "d", ["cpp"], None, 1, 9)]
    df = spark.createDataFrame(rows, "directory string, id string, languages array<string>, command string, schema_version int, timeout_ms int")
    assert sorted(map(tuple, registry.by_language(df).collect())) == [("cpp", "b"), ("java", "b")]


def test_layers_and_public_fields(spark):
    df = spark.createDataFrame([("n", {"a": "b", "layer": "old"}), ("m", None)], "id string, metadata map<string,string>")
    got = {r.id: r.m for r in df.select("id", flt.with_layer(F.col("metadata"), "ui").alias("m")).collect()}
    assert got == {"n": {"a": "b", "layer": "ui"}, "m": {"layer": "ui"}}
    assert flt.ui_public(df, flt.UI_NODE).columns == list(flt.UI_NODE) and flt.public(flt.stamped(df)).columns == df.columns


def test_unreadable_files_leave_a_fact(spark):
    files = spark.createDataFrame([("a.py", "def (:"), ("b.py", "class A:\n    pass\n")], "path string, text string")
    got = {(r.path, r.fact, r.name) for r in ex.extract(files, "python").collect()}
    assert ("a.py", ex.UNREADABLE, "SyntaxError") in got and any(p == "b.py" and n == "A" for p, _, n in got)


def facts(parser, path, text):
    return [(f["fact"], f["name"], f["target"], f["attrs"]) for f in ex.REGISTRY[parser][1](path, text)]


def test_tokens():
    src = Source('a("x, y", [1, 2], f(b)) // c("z")\n/* d( */ e')
    assert [t.text for t in src.tokens if t.kind == "name"] == ["a", "f", "b", "e"] and len(src.parts(1)) == 3 and src.tokens[-1].line == 2


def test_listeners_and_senders():
    java = 'class A {\n  // @RabbitListener(queues = "no")\n  @RabbitListener(id = "i", queues = {"q1", "q2"}) @Transactional\n  public Map<String, List<X>> on(final com.acme.OrderEvent e, int n) { amqpTemplate.convertAndSend("out", f(g(1))); }\n}\nclass B { @RabbitListener(queues = "b")\n void on(BillEvent e) {} }'
    got = [(f["name"], f["target"], f["parent"], f["attrs"].get("method")) for f in ex.REGISTRY["bus-rabbit"][1]("A.java", java)]
    assert got == [("OrderEvent", "q1", "A", "on"), ("BillEvent", "b", "B", "on"), ("A", "out", "A", None)]
    cs = "class C : IConsumer<Acme.OrderPlaced> { public async Task Handle(Acme.PayCommand c) { return Run(x); } }"
    assert [(f["name"], f["attrs"].get("method")) for f in ex.REGISTRY["bus-rabbit"][1]("C.cs", cs)] == [("OrderPlaced", "Consume"), ("PayCommand", "Handle")]


def test_projects():
    pom = '<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>a</artifactId><packaging>war</packaging><build><plugins><plugin><artifactId>spring-boot-maven-plugin</artifactId></plugin></plugins></build></project>'
    assert facts("maven-project", "m/pom.xml", pom) == [("module", "a", "m", {"packaging": "war", "boot": "true"})]
    assert facts("maven-project", "m/pom.xml", pom.replace("</artifactId></plugin>", "</artifactId><configuration><skip>true</skip></configuration></plugin>"))[0][3]["boot"] == "false"
    kts = 'plugins {\n  id("org.springframework.boot") version "3"\n}\n// group = "no"\ngroup = "g"\nrootProject.name = "n"\ntasks.named("bootJar") { enabled = false }\n'
    assert facts("gradle-project", "x/build.gradle.kts", kts) == [("module", "n", "x", {"group": "g", "packaging": "jar", "boot": "false"})]


def test_stubs():
    java = "class G { OrdersBlockingStub s; void f() { this.s = com.acme.OrdersGrpc.newBlockingStub(c); s.get(r); other.get(r); } }"
    assert [f[1] for f in facts("java-grpc-calls", "G.java", java)] == ["Orders/get"]
    ts = "const c = new pb.BillServiceClient(url);\nc.pay(x);\norderClient.list(y);\nlist(z);"
    assert [f[1] for f in facts("ts-grpc-calls", "g.ts", ts)] == ["BillService/pay", "OrderService/list"]
    assert [f[1] for f in facts("python-grpc-calls", "g.py", "class A:\n    def f(self):\n        self.s = pb.OrdersStub(c)\n        self.s.Get(1)\n")] == ["Orders/Get"]


def test_angularjs_states():
    js = "$stateProvider.state('app', {abstract: true, resolve: {a: function () { return {url: 'no'}; }}, url: '/app'}).state('app.home', {url: '/home'});\n$routeProvider.when('/x', {controller: 'XCtrl'});\n$http({method: 'put', url: '/api/x'});"
    got = facts("angularjs-ui", "a.js", js)
    assert got == [("ui_route", "/app", "app", {"abstract": "true", "state": "app", "url": "/app"}), ("ui_route", "/home", "app.home", {"state": "app.home", "url": "/home"}), ("ui_route", "/x", "XCtrl", {}), ("invokes_api", "PUT /api/x", "/api/x", {"method": "PUT"})]


def test_stamps_are_utc_in_every_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = flt.stamped(spark.range(1), "2024-05-06 07:08:09.12").first()
            assert row["ingested_at"] == "2024-05-06T07:08:09.120Z"
            import datetime

            now = datetime.datetime.fromisoformat(flt.stamped(spark.range(1)).first()["ingested_at"])
            assert abs((datetime.datetime.now(datetime.UTC) - now).total_seconds()) < 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
