"""Folded addresses of Java clients, and url patterns over files that include each other."""

import pytest

from graphloom.operators.routes import included_routes
from graphloom.plans import adapters
from graphloom.sources.extract import REGISTRY, extract


def java(body, fields=""):
    text = f"class A {{ RestTemplate rest; WebClient web;\n{fields}\nvoid f() {{ {body} }} }}"
    return [(f["attrs"]["client"], f["attrs"]["method"], f["target"], f["attrs"].get("callee")) for f in REGISTRY["java-http-calls"][1]("a/A.java", text)]


@pytest.mark.parametrize(
    "expression, path, callee",
    [
        ('"/a/b/"', "/a/b", None), ('"a?x=1#y"', "/a", None), ('"/a" + id + "/b"', "/a{id}/b", None), ("BASE", "/v1", "stock"), ('BASE + "/x/" + this.id', "/v1/x/{id}", "stock"), ('(BASE + "/x")', "/v1/x", "stock"),
        ('URI.create(BASE)', "/v1", "stock"), ('new URI("http://User@Host.Example:80/p%20q?z")', "/p q", "host.example"), ('UriComponentsBuilder.fromHttpUrl(BASE).path("/a").pathSegment("b", id).queryParam("q", 1).build().toUri()', "/v1/a/b/{id}", "stock"),
        ('String.format("%s/%d/%s", BASE, 5, id)', "/v1/{arg}/{id}", "stock"), ('BASE.concat("/c").trim()', "/v1/c", "stock"), ('Other.PATH + "/x"', "/{PATH}/x", None), ('found() + "/pets"', "/pets", "pets-service"), ('"http://" + host + "/x"', "/x", "x"),
    ],
)
def test_folding(expression, path, callee):
    fields = 'static final String HOST = "http://" + "stock:8080"; static final String BASE = HOST + "/v1"; String loop = loop + "x"; String found() { return dc.getInstances("pets-service").get(0); }'
    assert java(f"rest.exchange({expression}, HttpMethod.PATCH, null, X.class);", fields) == [("rest_template", "PATCH", path, callee)]


def test_clients_and_what_is_no_address():
    assert java('web.get().uri("/a"); web.method(HttpMethod.PUT).uri("/b"); rest.delete("/c"); rest.postForLocation("/d", x);') == [("web_client", "GET", "/a", None), ("web_client", "PUT", "/b", None), ("rest_template", "DELETE", "/c", None), ("rest_template", "POST", "/d", None)]
    assert java('rest.getForObject(compute(1), X.class); rest.exchange("/a", verb, X.class); map.put(); list.get(0); rest.getForObject(cond ? "/a" : "/b", X.class); web.get().uri(b -> b.path("/x").build());') == []
    assert len(java("rest.getForObject(loop, X.class);", 'String loop = loop + "x";')) == 1  # it ends
    text = 'class B { void f() { URLConnection c = (HttpURLConnection) new URL("http://h/x").openConnection(); c.setRequestMethod("POST"); } }'
    assert [(f["attrs"]["method"], f["target"], f["attrs"]["callee"]) for f in REGISTRY["java-http-calls"][1]("B.java", text)] == [("POST", "/x", "h")]


def plain_routes(files, patterns, led):
    """patterns: file -> [(kind, path, include or None, handler)]."""
    includes = {led.get(m) for p in patterns.values() for _, _, m, _ in p if m}
    out = set()

    def walk(file, prefix, seen):
        for kind, given, module, handler in patterns.get(file, ()):
            value = given.removeprefix("^").removesuffix("$") if kind == "re_path" else given
            whole = prefix.rstrip("/") + "/" + value.lstrip("/")
            whole = whole if whole.startswith("/") else "/" + whole
            if module is None:
                out.add((file, whole, handler))
            elif led.get(module) and led[module] not in seen:
                walk(led[module], whole, seen | {led[module]})

    for file in files:
        if file not in includes:
            walk(file, "", {file})
    return out


def test_includes(spark):
    patterns = {
        "site/urls.py": [("path", "", None, "home"), ("path", "shop/", "shop.urls", None), ("re_path", "^v(\\d)/$", "shop.urls", None), ("path", "none/", "missing.urls", None), ("path", "cycle/", "loop.a", None)],
        "shop/urls/__init__.py": [("path", "cart/", None, "Cart"), ("path", "deep/", "shop.deep", None)],
        "shop/deep.py": [("path", "/abs", None, "abs"), ("re_path", "^x$", None, "X"), ("path", "again/", "shop.urls", None), ("path", "deeper/", "shop.deeper", None)],
        "shop/deeper.py": [("path", "end", None, "end")],
        "loop/a.py": [("path", "a/", None, "a"), ("path", "b/", "loop.b", None)], "loop/b.py": [("path", "b/", None, "b"), ("path", "a/", "loop.a", None)],
        "only/a.py": [("path", "x/", "only.b", None)], "only/b.py": [("path", "y/", "only.a", None), ("path", "never", None, "never")],
        "single/urls.py": [("path", "s", None, "s")],
    }
    led = {"shop.urls": "shop/urls/__init__.py", "shop.deep": "shop/deep.py", "shop.deeper": "shop/deeper.py", "loop.a": "loop/a.py", "loop.b": "loop/b.py", "only.a": "only/a.py", "only.b": "only/b.py"}
    line = lambda kind, given, module, handler: f"    {kind}(r'{given}', " + (f"include('{module}')" if module else f"{handler}.as_view()" if handler[0].isupper() else f"views.{handler}") + "),"
    files = {f: "urlpatterns = [\n" + "\n".join(line(*x) for x in p) + "\n]\n" for f, p in patterns.items()}
    files |= {"bad.py": "def (", "app.py": "@app.get('/direct')\ndef direct(): pass\n", "odd.py": "urlpatterns = [path(x, y), other('a', b), path('only')]\nurlpatterns += [path('added', v)]\n"}
    df = spark.createDataFrame(sorted(files.items()), "path string, text string").repartition(3)
    got = {(r["path"], r["target"], r["parent"]) for r in included_routes(extract(df, "python-api-routes")).collect()}
    assert got == plain_routes(list(patterns), patterns, led)
    nodes, _ = adapters.run(df, "python-api-routes")
    names = {r["name"] for r in nodes.collect()}
    assert {"GET /direct", "GET /shop/deep/deeper/end", "GET /v(\\d)/cart/"} <= names and not any("never" in n for n in names)
    assert included_routes(extract(df.limit(0), "python-api-routes")).count() == 0
