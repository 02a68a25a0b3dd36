"""Overlays and sections of settings."""

from graphloom.operators.sections import effective, section_bindings


def test_overlays(spark):
    rows = [("a", None, "K", "base"), ("a", "Dev", "K", "dev"), ("a", "Prod", "K", "prod"), ("a", "Prod", "Only", "p"), ("b", None, "K", "b"), ("b", "Dev", "K", None), ("b", None, "Twice", "x"), ("b", None, "Twice", "y")]
    df = spark.createDataFrame(rows, "scope string, environment string, key string, value string")
    read = lambda *e: {(r["scope"], r["key"]): r["value"] for r in effective(df, e).collect()}
    assert read() == {("a", "K"): "base", ("b", "K"): "b", ("b", "Twice"): "y"}
    assert read("Dev", "Prod") == {("a", "K"): "prod", ("a", "Only"): "p", ("b", "K"): "b", ("b", "Twice"): "y"}
    assert read("Prod", "Dev")[("a", "K")] == "dev"


def test_sections(spark):
    rows = [
        ("a", "EventBus__Server", "mq"), ("a", "EventBus__Port", "5671"), ("a", "EventBus__UserName", "joe"), ("a", "EventBus__Password", "secret"), ("a", "EventBus__PrefetchCount", "9"), ("a", "EventBus__DefaultDatabase", "d"),
        ("a", "Kafka__BootstrapServers", "k1:9092"), ("a", "MyCache__Ttl", "5"), ("a", "ConnectionStrings__Db", "Server=h;Pwd=x;Initial Catalog=c"), ("a", "ConnectionStrings__Redis", "redis://r:1"), ("a", "Logging__Level", "Debug"),
        ("a", "BaseUrl", "https://u:p@api.example/x"), ("b", "Kafka__BootstrapServers", "k2:9092"), ("b", "Plain", "text"),
    ]
    df = spark.createDataFrame([(s, None, k, v) for s, k, v in rows], "scope string, environment string, key string, value string")
    got = {(r["scope"], r["key"]): (r["type"], r["engine"], r["target"], r["value"]) for r in section_bindings(df).collect()}
    assert got == {
        ("a", "EventBus"): ("broker", "rabbitmq", "mq:5671", "mq:5671|DefaultDatabase=d|PrefetchCount=9"), ("a", "Kafka"): ("broker", "kafka", "k1:9092", "k1:9092"), ("a", "MyCache"): ("cache", "redis", None, "Ttl=5"),
        ("a", "ConnectionStrings__Db"): ("database", "mssql", "h", "Server=h;Pwd=***;Initial Catalog=c"), ("a", "ConnectionStrings__Redis"): ("cache", "redis", "r", "redis://r:1"), ("a", "BaseUrl"): ("http", None, "api.example", "https://***:***@api.example/x"),
        ("b", "Kafka"): ("broker", "kafka", "k2:9092", "k2:9092"),
    }
    assert section_bindings(df.limit(0)).count() == 0
