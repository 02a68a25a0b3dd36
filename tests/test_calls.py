"""Members, call sites and their resolution: hand-made code bases, and random ones whose calls are known by construction."""

import random

import pytest

from graphloom.operators.calls import usages
from graphloom.plans import adapters
from graphloom.sources.extract import REGISTRY, extract


def found(spark, files, language):
    df = spark.createDataFrame(sorted(files.items()), "path string, text string").repartition(3)
    return {(r["from"], r["to"], r["type"]) for r in usages(extract(df, language)).collect()}


def declared(language, path, text):
    kinds = {"class", "interface", "enum", "namespace", "method", "function", "field", "property", "variable"}
    return [(f["fact"], f["qualified_name"], f["parent"], f["line"]) for f in REGISTRY[language][1](path, text) if f["fact"] in kinds]


def test_java_members():
    text = """package p.q;
@Deprecated
public abstract class Box<T extends Comparable<T>> extends Base<T> implements A, b.B {
  private static final Map<String, List<int[]>> MAP = new HashMap<>(), other = null;
  int[] sizes = {1, 2}; String s = "class X { void no() {} }"; // class Y {}
  static { init(); }
  { init(); }
  public Box(int n) { }
  @Override public <R> List<R> map(final Function<T, R> f, int... rest) throws E { return null; }
  abstract void none();
  enum Kind { ONE(1) { void inner() { } }, TWO; int size() { return 1; } }
  record Pair(int a, Box b) { Pair { } int sum() { return a; } }
  @interface Mark { }
}
"""
    assert declared("java", "src/p/q/Box.java", text) == [
        ("namespace", "p.q", "src.p.q.Box", 1), ("class", "p.q.Box", "p.q", 3), ("field", "p.q.Box.MAP", "p.q.Box", 4), ("field", "p.q.Box.other", "p.q.Box", 4), ("field", "p.q.Box.sizes", "p.q.Box", 5),
        ("field", "p.q.Box.s", "p.q.Box", 5), ("method", "p.q.Box.map(Function,int[])", "p.q.Box", 9), ("method", "p.q.Box.none()", "p.q.Box", 10), ("enum", "p.q.Box.Kind", "p.q.Box", 11), ("method", "p.q.Box.Kind.size()", "p.q.Box.Kind", 11),
        ("class", "p.q.Box.Pair", "p.q.Box", 12), ("method", "p.q.Box.Pair.sum()", "p.q.Box.Pair", 12),
    ]


def test_csharp_members():
    text = """using System;
namespace A.B
{
    [Serializable]
    public sealed partial class Store<T> : Base, IStore where T : class
    {
        private readonly List<T> _items = new(), _more;
        public string Name { get; set; } = "x";
        public int Count => _items.Count;
        public Store(int n) : base(n) { }
        public async Task<T> Get(int id) { return null; }
        void Short(int a) => Get(a);
        public T this[int i] { get { return null; } }
        public static bool operator ==(Store<T> a, Store<T> b) => true;
        private class Inner { public int X; }
        struct Hidden { public int Y; }
        public enum Kind { One = 1, Two }
    }
    public record Point(int X, int Y);
}
"""
    assert declared("csharp", "a/Store.cs", text) == [
        ("namespace", "A.B", "a.Store", 2), ("class", "A.B.Store", "A.B", 5), ("field", "A.B.Store._items", "A.B.Store", 7), ("field", "A.B.Store._more", "A.B.Store", 7), ("property", "A.B.Store.Name", "A.B.Store", 8), ("property", "A.B.Store.Count", "A.B.Store", 9),
        ("method", "A.B.Store.Store", "A.B.Store", 10), ("method", "A.B.Store.Get", "A.B.Store", 11), ("method", "A.B.Store.Short", "A.B.Store", 12), ("class", "A.B.Store.Inner", "A.B.Store", 15), ("field", "A.B.Store.Inner.X", "A.B.Store.Inner", 15), ("enum", "A.B.Store.Kind", "A.B.Store", 17),
        ("class", "A.B.Point", "A.B", 19),
    ]


def test_typescript_members():
    text = """import x, { a as b } from './x';
export abstract class Cart<T> extends Base<T> implements I {
  private items: T[] = [];
  static count = 0
  @Input() name!: string
  handler = async (n: number) => { b(n); }
  constructor(private readonly svc: Svc, n: number) { super(); }
  async *walk(n?: number): Promise<void> { }
  get total(): number { return 1; }
  abstract none(): void;
}
export interface I { a: string; b(): void }
export const enum Kind { A, B }
export function run<T>(a: T): T { const inner = () => 1; return a; }
const one = 1, two = () => run(2);
export default function main() {}
declare namespace N.M { function hidden(): void }
"""
    assert declared("typescript", "src/cart.ts", text) == [
        ("class", "src.cart.Cart", "src.cart", 2), ("property", "src.cart.Cart.items", "src.cart.Cart", 3), ("property", "src.cart.Cart.count", "src.cart.Cart", 4), ("property", "src.cart.Cart.name", "src.cart.Cart", 5), ("property", "src.cart.Cart.handler", "src.cart.Cart", 6),
        ("method", "src.cart.Cart.walk", "src.cart.Cart", 8), ("method", "src.cart.Cart.total", "src.cart.Cart", 9), ("method", "src.cart.Cart.none", "src.cart.Cart", 10), ("interface", "src.cart.I", "src.cart", 12), ("enum", "src.cart.Kind", "src.cart", 13),
        ("function", "src.cart.run", "src.cart", 14), ("variable", "src.cart.one", "src.cart", 15), ("variable", "src.cart.two", "src.cart", 15), ("function", "src.cart.main", "src.cart", 16), ("namespace", "src.cart.N.M", "src.cart", 17),
    ]


def test_java_calls(spark):
    files = {
        "a/Repo.java": "package a; public class Repo { public Row find(int k) { return null; } public Row find(int k, int l) { return find(k); } void pair(int a) {} void pair(String a) {} static Repo make() { return new Repo(); } }",
        "a/Row.java": "package a; public class Row { public void save() { this.save(); } }",
        "b/Service.java": """package b; import a.Repo; import a.*; import c.Unknown;
class Service extends Parent {
  private final Repo repo; Repo[] many; Unknown odd;
  void run(Row given) {
    repo.find(1).save(); this.repo.find(1, 2); given.save();
    var row = Repo.make().find(3); row.save();
    for (Row r : rows()) { r.save(); }
    inherited(); super.inherited(); run(given); repo.pair(x); odd.call(); many.find(1);
    list.forEach(repo -> repo.find(9, 9, 9)); new Inner().go(); new Row().save();
    String repoText = "repo.pair(1)"; // repo.pair(1, 2)
  }
  Row rows() { return null; }
  class Inner { Service other; void go() { inherited(); helper(); other.rows().save(); } }
  void helper() {}
}
class Parent extends GrandParent { }
class GrandParent extends Parent { void inherited() { } }""",
    }
    run = "b.Service.run(Row)"
    assert found(spark, files, "java") == {
        ("a.Repo.find(int,int)", "a.Repo.find(int)", "calls"), (run, "a.Repo.find(int)", "calls"), (run, "a.Row.save()", "calls"), (run, "a.Repo.find(int,int)", "calls"), (run, "a.Repo.make()", "calls"), (run, "b.Service.rows()", "calls"),
        (run, "b.GrandParent.inherited()", "calls"), (run, "b.Service.Inner.go()", "calls"), ("b.Service.Inner.go()", "b.GrandParent.inherited()", "calls"), ("b.Service.Inner.go()", "b.Service.helper()", "calls"), ("b.Service.Inner.go()", "b.Service.rows()", "calls"),
        ("b.Service.Inner.go()", "a.Row.save()", "calls"),
    }


def test_csharp_calls_and_injections(spark):
    files = {
        "a/IRepo.cs": "namespace Data; public interface IRepo { Task<Row> FindAsync(int k); } public class Row { public void Save() { } } public class Logger<T> { public void Info(string s) { } }",
        "b/Service.cs": """using Data; using Al = Data.Row;
namespace App.Services;
public class Service : Base
{
    private readonly IRepo _repo; public Logger<Service> Log { get; }
    public Service(IRepo repo, Logger<Service> log, int n, string s, Missing m) : base(repo) { _repo = repo; Log.Info("x"); }
    public async Task Run(Al given)
    {
        var row = await _repo.FindAsync(1); row.Save(); (await _repo.FindAsync(2)).Save(); given?.Save(); base.Shared(); Shared(); Run(given); Helper.Do(1);
        if (row is Row other) other.Save();
        void Local() { Shared(); }
    }
    private class Nested { public Nested(Service s) { s.Run(null); } }
}
public abstract class Base { protected void Shared() { } protected Base(IRepo r) { } }
public static class Helper { public static void Do(int n) => Twice(n); static void Twice(int n) { } }""",
    }
    service = "App.Services.Service"
    assert found(spark, files, "csharp") == {
        (service, "Data.IRepo", "injects"), (service, "Data.Logger", "injects"), (f"{service}.Service", "Data.Logger.Info", "calls"), (f"{service}.Run", "Data.IRepo.FindAsync", "calls"), (f"{service}.Run", "Data.Row.Save", "calls"),
        (f"{service}.Run", "App.Services.Base.Shared", "calls"), (f"{service}.Run", "App.Services.Helper.Do", "calls"), ("App.Services.Helper.Do", "App.Services.Helper.Twice", "calls"), (f"{service}.Nested", service, "injects"), (f"{service}.Nested.Nested", f"{service}.Run", "calls"),
        ("App.Services.Base", "Data.IRepo", "injects"),
    }


def test_typescript_calls(spark):
    files = {
        "lib/base.ts": "export class Base { shared(): void {} }\nexport default class Main extends Base { go(n: number): Base { return this; } }\nexport function util(n: number) { return other(n); }\nconst other = (n: number): Main => { util(n); return new Main(); };\nexport { other as renamed };",
        "lib/index.ts": "export * from './base';\nexport { default as Main } from './base';\nexport * from './loop';",
        "lib/loop.ts": "export * from './index';",
        "app/use.tsx": """import Main, { util as u, renamed } from '../lib/base';
import { Main as Again, Base } from '../lib';
import * as lib from '../lib/loop';
import React from 'react';
export const shared = new Again();
class Page extends Again {
  private one: Main;
  constructor(private readonly two: Again, three: Base) { super(); }
  render = () => { u(1); this.one.go(2).shared(); this.two.shared(); lib.util(3); renamed(4).go(5); this.shared(); React.use(); return <div onClick={() => u(1)}>it's</div>; }
  again(u: Missing) { u.call(1); const m = new Main(); m.go(1); const f = (m: Base) => m.shared(); shared.go(1); unknown(2); this.again(u); }
}""",
    }
    page = "app.use.Page"
    assert found(spark, files, "typescript") == {
        ("lib.base.util", "lib.base.other", "calls"), ("lib.base.other", "lib.base.util", "calls"), (f"{page}.render", "lib.base.util", "calls"), (f"{page}.render", "lib.base.Main.go", "calls"), (f"{page}.render", "lib.base.Base.shared", "calls"),
        (f"{page}.render", "lib.base.other", "calls"), (f"{page}.again", "lib.base.Main.go", "calls"), (f"{page}.again", "lib.base.Base.shared", "calls"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_random_code_bases(spark, seed):
    """Random classes over packages with fields, inheritance and chains; the generator knows every call."""
    r = random.Random(seed)
    n = 14
    parent = {i: r.choice([None, *range(i)]) if i else None for i in range(n)}
    package = {i: f"p{r.randrange(3)}" for i in range(n)}
    own = {i: [f"m{k}" for k in range(r.randrange(1, 4))] for i in range(n)}
    gives = {(i, m): r.randrange(n) for i in range(n) for m in own[i]}
    fields = {i: {f"f{i}_{k}": r.randrange(n) for k in range(r.randrange(3))} for i in range(n)}

    def holder(i, table, name):
        while i is not None:
            if name in table[i]:
                return i
            i = parent[i]
        return None

    def lookup(i):
        names = set()
        while i is not None:
            names |= set(own[i])
            i = parent[i]
        return sorted(names)

    def all_fields(i):
        names = []
        while i is not None:
            names += sorted(fields[i])
            i = parent[i]
        return names

    want, files = set(), {}
    name = lambda i, m: f"{package[i]}.C{i}.{m}()"
    for i in range(n):
        methods = []
        for m in own[i]:
            lines = []
            for _ in range(r.randrange(3)):
                at, text = i, ""
                if all_fields(i) and r.random() < 0.6:
                    f = r.choice(all_fields(i))
                    text, at = ("this." if r.random() < 0.5 else "") + f + ".", fields[holder(i, fields, f)][f]
                for step in range(r.randrange(1, 4)):
                    called = r.choice(lookup(at))
                    of = holder(at, own, called)
                    text += ("" if text == "" or text.endswith(".") else ".") + f"{called}()"
                    want.add((name(i, m), name(of, called), "calls"))
                    at = gives[of, called]
                lines.append(f"    {text};")
            methods.append(f"  public C{gives[i, m]} {m}() {{\n" + "\n".join(lines) + "\n    return null;\n  }")
        seen = sorted({t for t in fields[i].values()} | {gives[i, m] for m in own[i]} | ({parent[i]} - {None}))
        imports = "".join(f"import {package[t]}.C{t};\n" for t in seen if package[t] != package[i])
        extends = f" extends C{parent[i]}" if parent[i] is not None else ""
        body = "\n".join([*(f"  protected C{t} {f};" for f, t in fields[i].items()), *methods])
        files[f"{package[i]}/C{i}.java"] = f"package {package[i]};\n{imports}public class C{i}{extends} {{\n{body}\n}}\n"
    assert found(spark, files, "java") == {w for w in want if w[0] != w[1]}


def test_edges_and_odd_files(spark):
    files = {"a/A.java": "package a; class A { void f() { new B().g(); } }", "a/B.java": "package a; class B { void g() {} }", "a/B2.java": "package a; class B { void h() {} }", "a/C.java": None, "a/D.java": "class {{{ ((( <", "a/E.java": ""}
    nodes, edges = adapters.run(spark.createDataFrame(sorted(files.items()), "path string, text string"), "java")
    ids = {r["qualified_name"]: r["id"] for r in nodes.collect()}
    got = {(r["type"], r["src"], r["dst"]) for r in edges.collect()}
    assert got == {("calls", ids["a.A.f()"], ids["a.B.g()"])}
    assert found(spark, {}, "java") == set()


def test_calls_broadcast_no_table_that_grows(spark):
    """Compressed files of these tables are small; their rows are not, and a broadcast brings them to the driver."""
    files = {f"shop/S{i}.cs": f"using Desks;\nnamespace Shop;\npublic class S{i} {{\n  private readonly Desk _d;\n  public void Buy() {{ _d.Offer(1).Accept(); }}\n}}\n" for i in range(3)}
    files["desk/Desk.cs"] = "namespace Desks;\npublic class Desk {\n  public Quote Offer(int k) { return new Quote(); }\n}\npublic class Quote {\n  public void Accept() { }\n}\n"
    found = usages(extract(spark.createDataFrame(sorted(files.items()), "path string, text string"), "csharp"))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["from"], r["to"]) for r in found.collect()} == {(f"Shop.S{i}.Buy", f"Desks.{t}") for i in range(3) for t in ("Desk.Offer", "Quote.Accept")}
