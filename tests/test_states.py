"""Full urls of nested router states."""

from graphloom.operators.states import state_urls


def test_full_urls(spark):
    rows = [
        ("a", "root", None, "/r"), ("a", "root.x", "root", "/x?q"), ("a", "root.x.y", "root.x", None), ("a", "root.x.y.z", "root.x.y", "/z/:id"), ("a", "alone", "root.x", "^/alone?p"), ("a", "alone.one", "alone", "/one"), ("a", "lost", "nowhere", "/lost"),
        ("a", "c1", "c2", "/1"), ("a", "c2", "c3", "/2"), ("a", "c3", "c1", "/3"), ("a", "c4", "c1", "/4"), ("b", "root", None, "/b"), ("b", "root.x", "root", "/x"), ("b", "root.x", "root", "/w"),
    ] + [("d", f"s{i}", f"s{i - 1}" if i else None, f"/{i}") for i in range(40)]
    got = {(r["app"], r["state"]): r["full"] for r in state_urls(spark.createDataFrame(rows, "app string, state string, above string, url string")).collect()}
    assert got == {
        ("a", "root"): "/r", ("a", "root.x"): "/r/x", ("a", "root.x.y"): "/r/x", ("a", "root.x.y.z"): "/r/x/z/:id", ("a", "alone"): "/alone", ("a", "alone.one"): "/alone/one", ("a", "lost"): "/lost",
        **{("a", f"c{i}"): None for i in range(1, 5)}, ("b", "root"): "/b", ("b", "root.x"): "/b/w", **{("d", f"s{i}"): "".join(f"/{k}" for k in range(i + 1)) for i in range(40)},
    }
    assert state_urls(spark.createDataFrame([], "app string, state string, above string, url string")).count() == 0
