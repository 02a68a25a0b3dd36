"""React applications: the JSX parser, and trees of small repositories with wrappers, nested routes, helpers and flows."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans import codebase, react_tree
from graphloom.plans.canon import Canon
from graphloom.plans.react_tree import tree
from graphloom.sources.extract import REGISTRY, extract
from graphloom.sources.extract.jsx import Jsx
from graphloom.sources.extract.react import Screen, api_path


def test_elements_nest():
    text = """const a = b < c && d > e; const f = <T,>(x: T) => x; // <no/>
const s = "<no/>" + `<no/> ${cond ? <Inner a="1" /> : null}`; const r = /<no>/;
return (
  <Page title="it's" icon={<Icon big />} {...rest} on={(e) => e > 1}>
    Don't <b>break</b> {list.map((x) => <Row key={x}>{x && <Cell />}</Row>)}
    <>
      <UI.Button />
    </>
  </Page>
);"""
    jsx = Jsx(text)
    names = [(e.name, None if e.parent is None else jsx.elements[e.parent].name) for e in jsx.elements]
    assert names == [("Inner", None), ("Page", None), ("Icon", "Page"), ("b", "Page"), ("Row", "Page"), ("Cell", "Row"), ("", "Page"), ("UI.Button", "")]
    page = jsx.elements[1]
    assert page.string("title") == "it's" and page.code("on") == "(e) => e > 1" and jsx.elements[2].attrs == {"big": None}
    assert "Don't" not in jsx.code and len(jsx.code) == len(text) and "list.map" in jsx.code


def test_broken_files_end():
    for text in ("<", "<a", "<a href=", "<a>{", "<a>text", "x = `${", "/*", "return <A><B></A>", "'"):
        assert len(Jsx(text).code) == len(text)
        list(Screen("a/b.tsx", text).routes())


def test_routes():
    text = """export const r = [
  { path: '/', element: <Shell />, children: [
    { index: true, element: <Home /> },
    { path: 'a/', element: <A x={{ path: 'no' }} />, children: [{ path: ':id', Component: Item }, { path: '/abs', element: <Abs /> }] },
    { element: <Guard />, children: [{ path: 'deep', element: <Deep /> }] },
  ] },
];
const other = <Route path="/x" element={<X />}><Route path="y" component={Y} /><Route path={'z'} /></Route>;
const options = { method: 'GET', path2: 'no' };"""
    found = [(pattern, element) for _, pattern, element in Screen("src/router.tsx", text).routes()]
    assert found == [("/", "Shell"), ("/", "Home"), ("/a", "A"), ("/a/:id", "Item"), ("/abs", "Abs"), ("/deep", "Deep"), ("/x", "X"), ("/x/y", "Y"), ("/x/z", None)]


@pytest.mark.parametrize(
    "raw, path",
    [("/api/v1/projects/${id}/runs?x=${y}", "/projects/{id}/runs"), ("${BASE}/items", "{id}/items"), ("/a/${buildQuery({ a: f(1) })}", "/a/"), ("/", ""), ("plain", "/plain"), ("/v/${f({ a: 1 })}/w", "/v/{id}/w")],
)
def test_api_paths(raw, path):
    got = api_path(raw)
    assert got == path or (raw.startswith("${BASE}") and got in ("/items", "/{id}/items"))


def test_tree(spark):
    files = {
        "fe/package.json": '{"name": "shop-frontend", "devDependencies": {"react": "18"}}',
        "fe/src/main.tsx": "import './base.css';",
        "fe/src/routes.tsx": "import { CartRoute } from './shell'; import Home from './pages'; import { Gone } from './nowhere';\nconst r = [{ path: '/', element: <Home /> }, { path: '/cart', element: <CartRoute /> }, { path: '/lost', element: <Gone /> }, { path: '/cart2', element: <CartRoute /> }];",
        "fe/src/shell.tsx": "import { CartPage } from './pages/CartPage'; import { Provider } from './provider';\nexport function CartRoute() { if (x) { return <Provider />; } return (<CartPage />); }\nexport function Else() { return null; }",
        "fe/src/pages/index.tsx": "export default function Home() { return <a>it's</a>; }",
        "fe/src/pages/CartPage.tsx": "import { load as get, unused } from '../api/cart.js'; import { Viewer } from '../components/view/Viewer';\nexport function CartPage() { fetch('/api/v1/ping'); navigate('/cart'); return <form><input name=\"a\" /><input name=\"a\" /><button title={messages.actionSaveAll}>x</button></form>; }",
        "fe/src/api/cart.ts": "export async function load(id) { const a = await apiFetch<Cart>(`/api/v1/carts/${id}`, { method: 'post' }); fetch('/api/v1/more'); }\nexport const other = async () => { fetch('/other'); };\nexport const unused = 1;",
        "fe/src/api/analysis.ts": "export const start = async (p: string) => { await apiFetch(`/api/v1/projects/${p}/analysis/runs`, { method: 'POST' }); };",
        "fe/src/components/view/Viewer.tsx": "import { EditorView } from '@codemirror/view'; export const Viewer = () => <div />;",
        "fe/src/LanguagesConfirmModal.tsx": "export const x = 1;",
        "fe/src/AnalysisProvider.tsx": "export const y = 1;",
        "lib/package.json": '{"name": "lib", "dependencies": {"react": "18"}}',
        "lib/src/Widget.tsx": "export const W = () => <b />;",
        "bad/package.json": "{",
    }
    facts = extract(spark.createDataFrame(sorted(files.items()), "path string, text string"), "react-ui")
    nodes, edges = tree(facts)
    n = {r["id"].removeprefix("react-ui:"): (r["name"], (r["parent_id"] or "").removeprefix("react-ui:"), r["path"]) for r in nodes.collect()}
    e = {(r["type"], r["src"].removeprefix("react-ui:"), r["dst"].removeprefix("react-ui:")) for r in edges.collect() if r["type"] != "contains"}
    assert {k for k in n if k.startswith("ui_app")} == {"ui_app:fe"} and n["ui_app:fe"] == ("shop-frontend", "", "fe/src/main.tsx")
    assert {k: v for k, v in n.items() if k.startswith("ui_route")} == {
        "ui_route:fe/root": ("/", "ui_app:fe", "fe/src/routes.tsx"), "ui_route:fe/cart": ("/cart", "ui_app:fe", "fe/src/routes.tsx"), "ui_route:fe/gone": ("/lost", "ui_app:fe", "fe/src/routes.tsx"),
    }
    assert n["ui_screen:fe/Home"] == ("Home", "ui_route:fe/root", "fe/src/pages/index.tsx") and n["ui_screen:fe/CartPage"] == ("Cart", "ui_route:fe/cart", "fe/src/pages/CartPage.tsx") and n["ui_screen:fe/Gone"][2] == "fe/src/routes.tsx"
    assert {k for k in n if k.startswith(("ui_frame", "ui_surface"))} == {"ui_frame:fe/Home/main", "ui_frame:fe/CartPage/main", "ui_frame:fe/Gone/main", "ui_frame:fe/CartPage/viewer", "ui_surface:fe/CartPage/codemirror-viewer"}
    cart = "ui_control:fe/CartPage/CartPage"
    assert {k for k in n if k.startswith("ui_control:fe/CartPage")} == {
        f"{cart}-ui/a", f"{cart}-ui/a-1", f"{cart}-ui/button-save-all", f"{cart}-api/api-GET-more-0", f"{cart}-api/api-GET-ping-1", f"{cart}-api/api-POST-carts-id-2",
    }
    assert n["ui_module:fe/view"] == ("view", "ui_app:fe", "fe/src/components/view") and n["ui_flow:fe/analysis-confirm"][2] == "fe/src/AnalysisProvider.tsx"
    assert e == {
        ("binds_service", "ui_app:fe", "compose:service:docker-compose.yml#frontend"), ("navigates_to", "ui_screen:fe/CartPage", "ui_route:fe/cart"), ("binds_field", f"{cart}-ui/a", "ui_control:fe/field:a"), ("binds_field", f"{cart}-ui/a-1", "ui_control:fe/field:a"),
        ("invokes_api", f"{cart}-api/api-GET-more-0", "api_hint:GET:/more"), ("invokes_api", f"{cart}-api/api-GET-ping-1", "api_hint:GET:/ping"), ("invokes_api", f"{cart}-api/api-POST-carts-id-2", "api_hint:POST:/carts/{id}"),
        ("invokes_api", "ui_flow:fe/analysis-confirm", "api_hint:POST:/projects/{id}/analysis/runs"),
    }
    known = spark.createDataFrame([("GET", "/ping", "endpoint:1")], "method string, template string, endpoint string")
    ends = {r["dst"] for r in tree(facts, known)[1].where("type = 'invokes_api'").collect()}
    assert "endpoint:1" in ends and "react-ui:api_hint:GET:/ping" not in ends
    nothing = tree(extract(spark.createDataFrame([], "path string, text string"), "react-ui"))
    assert nothing[0].count() == nothing[1].count() == 0


def test_facts_are_read_by_kind(spark):
    """Each step asks for one kind of facts; it read them all, once for each step."""
    files = {"fe/package.json": '{"name": "a", "dependencies": {"react": "18"}}', "fe/src/router.tsx": "import { P } from './P';\nconst r = [{ path: '/', element: <P /> }];\n", "fe/src/P.tsx": "export const P = () => <form><input name='q' /></form>;\n"}
    nodes, _ = tree(extract(spark.createDataFrame(sorted(files.items()), "path string, text string"), "react-ui"))
    assert "PartitionFilters: [isnotnull(fact" in nodes._jdf.queryExecution().executedPlan().toString()
    assert {"react-ui:ui_screen:fe/P", "react-ui:ui_control:fe/field:q"} <= {r["id"] for r in nodes.collect()}


def test_work_of_a_file():
    """Calls of functions, which any machine counts alike: 3,561 for such a page when each character and each token was a step of its own."""
    import cProfile
    import pstats

    page = next(text for path, text in codebase._PAGE if path.endswith(".tsx"))
    _, run = REGISTRY["react-ui"]
    list(run("s1/src/pages/DeskPage.tsx", page))
    with cProfile.Profile() as made:
        list(run("s1/src/pages/DeskPage.tsx", page))
    assert pstats.Stats(made).total_calls < 1900


@pytest.mark.parametrize("text, names", [("f<A>(b)", []), ("return<A />", ["A"]), ("x=<A />", ["A"]), ("/* a */<A />", ["A"]), ("// f<B\n<A />", ["A"]), ("a<b>c</b>", []), ("<></>", [""]), ("typeof<A />", [])])
def test_what_opens_an_element(text, names):
    assert [e.name for e in Jsx(text).elements] == names


APPS = {
    "fe/package.json": '{"name": "a", "dependencies": {"react": "18"}}',
    "fe/src/router.tsx": "import { P } from '../../be/src/P';\nimport { Q } from './Q';\nconst r = [{ path: '/', element: <P /> }, { path: '/q', element: <Q /> }];\n",
    "fe/src/Q.tsx": "import { load } from './api/q';\nimport './q.css';\nexport const Q = () => <form><input name='q' /><Link to='/' /><b onClick={load} /></form>;\n",
    "fe/src/api/q.ts": "export const load = () => { fetch('/q'); };\n",
    "fe/src/components/x/X.tsx": "export const X = 1;\n",
    "be/package.json": '{"name": "b", "dependencies": {"react": "18"}}',
    "be/src/router.tsx": "import { P } from './P';\nconst r = [{ path: '/', element: <P /> }];\n",
    "be/src/P.tsx": "import { load } from '../../fe/src/api/q';\nexport const P = () => { fetch('/p'); return <ReactFlow><button name='go' /></ReactFlow>; };\n",
    "be/src/ChangesConfirm.tsx": "export const c = 1;\n",
}


def test_only_facts_that_are_asked():
    """The extractor found all facts of a file whatever was asked of it."""
    _, run = REGISTRY["react-ui"]
    for asked in (react_tree.ROUTE_FACTS, react_tree.PART_FACTS, ["ui_style", "ui_navigation"]):
        for path, text in APPS.items():
            assert list(run(path, text, asked=frozenset(asked))) == [f for f in run(path, text) if f["fact"] in asked]


def test_only_nodes_that_are_asked(spark):
    """Some kinds, or one application, are what the whole trees hold of them."""
    facts = extract(spark.createDataFrame(sorted(APPS.items()), "path string, text string"), "react-ui")
    rows = lambda pair: [sorted(map(repr, df.collect())) for df in pair]
    whole = [df.localCheckpoint() for df in tree(facts)]
    kinds = ["ui_route", "ui_screen"]
    nodes = whole[0].where(F.col("kind").isin(kinds))
    ids = [r["id"] for r in nodes.select("id").collect()]
    assert len(ids) == 6
    edges = whole[1].where(F.col("src").isin(ids) & F.col("dst").isin(ids))
    assert rows(tree(facts, kinds=kinds)) == rows((nodes, edges))
    assert rows(tree(extract(spark.createDataFrame(sorted(APPS.items()), "path string, text string"), "react-ui", react_tree.ROUTE_FACTS), kinds=kinds))[0] == rows((nodes,))[0]
    below = lambda column, app: F.col(column).rlike(f"^react-ui:ui_[a-z]+:{app}(/|$)")
    for app in ("fe", "be"):
        one, its_edges = tree(facts, app=app)
        assert rows((one.where(below("id", app)), its_edges)) == rows((whole[0].where(below("id", app)), whole[1].where(below("src", app))))
        assert one.where(~below("id", app)).where("not startswith(id, 'react-ui:api_hint:')").isEmpty()


def test_texts_are_made_where_they_are_read(spark):
    """The plan joined suppliers and their desks again for each of seven kinds of files, and the files' texts shuffled."""
    made = codebase.app_files(Canon(spark, "/root/testdata/sf0.001"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Union" not in plan and plan.count("FileScan parquet") == plan.count("FileScan parquet [s#") == 1
    assert made.count() == made.select("path").distinct().count() > 0
