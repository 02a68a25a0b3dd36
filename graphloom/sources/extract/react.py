"""What one file of a React application tells: routes, what its components return, screens' parts, controls and calls of the API.

Which file is a screen, and what it calls through helpers of other files, is a question to all files of an application:
:mod:`graphloom.plans.react_tree` answers it.
"""

from __future__ import annotations

import json
import posixpath
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cached_property

from . import Fact, extractor, fact, line_of
from .jsx import Element, Jsx
from .lex import NAMES, Source

#: Names of handlers, setters and values that give a control its role.
HANDLER_ROLES = {
    "goUp": "up", "onUp": "up", "onEnter": "enter", "onConfirm": "confirm", "onCancel": "cancel", "enterCode": "enter-code", "clearToast": "dismiss", "runSearch": "search", "refetch": "retry",
    "clearDeleteError": "dismiss-error", "handleSubmit": "submit", "triggerSync": "sync", "confirmAndDelete": "delete", "setLocale": "language", "setLayerFilter": "layer", "setSourceType": "source-type",
}
HANDLERS = re.compile(rf"\b(?:{'|'.join(HANDLER_ROLES)})\b")
VALUE_ROLES = {"locale": "language", "layerFilter": "layer", "sourceType": "source-type"}
MESSAGE_PREFIXES = ("GRAPH_UI_", "GRAPH_VIEW_", "GRAPH_")
CONVERSIONS = {"encodeURIComponent", "Boolean", "String"}
#: Marks of libraries that draw a surface of their own: kind, key, library, frame's key and name.
SURFACES = [
    (r"@xyflow/react|\bReactFlow\b", "canvas", "react-flow-canvas", "@xyflow/react", "canvas", "React Flow canvas"),
    (r"codemirror|@codemirror/|\bEditorView\b|\bEditorState\b", "code_viewer", "codemirror-viewer", "codemirror", "viewer", "CodeMirror viewer"),
]
#: The words of each of those patterns: without any of them it need not be tried.
SURFACE_WORDS = {p: re.findall(r"[@\w/]+", p.replace(r"\b", "")) for p, *_ in SURFACES}
CONTROLS = {"button": "button", "input": "input", "select": "select"}
API_FILE = re.compile(r"/api/[^/]+\.(ts|js)$", re.I)
NO_API_FILE = re.compile(r"\.test\.|(^|/)(types|models|graph-types|analysis-types)\.ts$", re.I)
SCRIPT = re.compile(r"\.(js|jsx|mjs|cjs)$", re.I)
ROUTER_FILE = re.compile(r"(^|/)(router|routes)\.tsx?$", re.I)
ROUTER_MARKS = {"createBrowserRouter", "createHashRouter", "createRoutesFromElements"}


def slug(text: str) -> str:
    return re.sub(r"^-|-$", "", re.sub(r"[^a-zA-Z0-9]+", "-", text)).lower() or "path"


def kebab(text: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", text).replace("_", "-").lower()


def absolute(parent: str, segment: str) -> str:
    """A route's path below its parent's; one that begins with a slash stands alone."""
    whole = segment if segment.startswith("/") else f"{parent}/{segment}"
    return "/" + "/".join(p for p in whole.split("/") if p and p != ".")


def api_path(raw: str) -> str:
    """The path of an address template: no query, expressions as {id}, without the API's prefix; empty if none is left."""
    path = re.sub(r"\$\{buildQuery\((?:[^()]|\([^)]*\))*\)\}", "", raw.strip().split("?")[0])
    path = re.sub(r"\$\{(?:[^{}]|\{[^}]*\})*\}", "{id}", path)
    found = re.search(r"/api/v1/[A-Za-z0-9_/{}.:-]*|/[A-Za-z0-9_/{}.:-]+", path)
    path = re.sub(r"/api/v1", "", found[0] if found else path, count=1, flags=re.I)
    path = re.sub(r"\{+id\}+", "{id}", path if path.startswith("/") else f"/{path}")
    path = re.sub(r"[^A-Za-z0-9_/{}.:-]+$", "", path)
    return "" if path == "/" else path


class Screen:
    """One source file: its elements, tokens and imports."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.jsx = Jsx(text)
        self.src = Source(self.jsx.code)
        self.folder = posixpath.dirname(path)
        self.imports = dict(self.imported())

    def hint(self, spec: str) -> str:
        """The path, without extension, of a relative import; packages stand for themselves."""
        if not spec.startswith("."):
            return spec
        return SCRIPT.sub("", posixpath.normpath(posixpath.join(self.folder, spec)))

    def imported(self) -> Iterator[tuple[str, tuple[str, str]]]:
        """local name -> (path hint, exported name)."""
        text, strings = self.src.text, self.src.strings
        for i in self.src.places("import"):
            k = i + 1 + (text(i + 1) == "type" and text(i + 2) != "from")
            nth = bisect_left(strings, k)
            if nth == len(strings) or strings[nth] >= k + 400 or text(strings[nth] - 1) != "from":
                continue
            hint = self.hint(self.src.string(strings[nth]))
            if text(k)[:1] in NAMES:
                yield text(k), (hint, "default")
                k += 1 + (text(k + 1) == ",")
            if text(k) == "{":
                for part in self.src.parts(k):
                    names = [t for x in part if (t := text(x))[:1] in NAMES and t not in ("type", "as")]
                    if names:
                        yield names[-1], (hint, names[0])

    # -- routes ---------------------------------------------------------------------------------------------------

    def looks_like_router(self) -> bool:
        return any(e.name in ("Routes", "Route") for e in self.jsx.elements) or not ROUTER_MARKS.isdisjoint(self.src.codes) or bool(ROUTER_FILE.search(self.path))

    def routes(self) -> Iterator[tuple[int, str, str | None]]:
        """(line, path pattern, element) of route objects and Route elements; children's paths are joined to their parents'."""
        done = -1
        for i in self.src.places("{"):
            if i > done and self.route_at(i) is not None:
                yield from self.objects(i, "")
                done = self.src.close.get(i, i)
        paths: dict[int, str] = {}
        for n, e in enumerate(self.jsx.elements):
            if e.name == "Route":
                above = e.parent
                while above is not None and above not in paths:
                    above = self.jsx.elements[above].parent
                given = e.string("path")
                paths[n] = absolute(paths.get(above, ""), given) if given else paths.get(above, "")
                if given:
                    shown = re.match(r"\{\s*<\s*([A-Za-z_$][\w$]*)", e.attrs.get("element") or "") or re.match(r"\{\s*([A-Za-z_$][\w$]*)", e.attrs.get("component") or e.attrs.get("Component") or "")
                    yield line_of(self.text, e.at), paths[n], shown[1] if shown else None

    def route_at(self, i: int) -> tuple[str | None, str | None, int | None] | None:
        """(segment, element, place of the children) of the object at i, if it is a route: it has a path, is an index, or has children."""
        member = self.src.members(i).get
        at, index, children = member("path"), member("index"), member("children")
        if children is not None and self.src.text(children) != "[":
            children = None
        segment = "" if index is not None and self.src.text(index) == "true" else self.src.string(at) if at is not None else None
        if segment is None and children is None:
            return None
        shown = next((k for key in ("element", "Component", "component") if (k := member(key)) is not None), None)
        element = None if shown is None else self.src.text(shown + 1) if self.src.text(shown) == "<" else self.src.text(shown)
        return segment, element or None, children

    def objects(self, i: int, parent: str) -> Iterator[tuple[int, str, str | None]]:
        segment, element, children = self.route_at(i)
        own = parent if segment is None else absolute(parent, segment) if segment else parent or "/"
        if segment is not None:
            yield self.src.line(i), own, element
        if children is not None:
            for part in self.src.parts(children):
                if self.src.text(part[0]) == "{" and self.route_at(part[0]) is not None:
                    yield from self.objects(part[0], own)

    @cached_property
    def functions(self) -> list[tuple[str, bool, int, int]]:
        """(name, exported, first token, last token) of functions and of constants that hold arrow functions."""
        return list(self.declared())

    def declared(self) -> Iterator[tuple[str, bool, int, int]]:
        for i in sorted([*self.src.places("function"), *self.src.places("const")]):
            word = self.src.text(i)
            if i >= len(self.src) - 2 or self.src.kind(i + 1) != "name":
                continue
            exported = "export" in (self.src.text(i - 1), self.src.text(i - 2))
            k = i + 2
            if word == "const":
                while k < len(self.src) and self.src.text(k) not in ("=", ";"):
                    k += 1
                if self.src.text(k) != "=":
                    continue
                k += 1 + (self.src.text(k + 1) == "async")
            bracket = k if self.src.text(k) == "(" else next((x for x in self.src.places("(", k) if x < k + 40), None) if word == "function" else None
            if bracket is None:
                continue
            k = self.src.close.get(bracket, bracket) + 1
            while k < len(self.src) and self.src.text(k) not in ("{", ";") and not (word == "const" and self.src.reads(k, "=", ">")):
                k += 1
            if word == "const":
                k += 2
            if self.src.text(k) == "{":
                yield self.src.text(i + 1), exported, k, self.src.close.get(k, len(self.src))
            elif word == "const" and self.src.reads(k - 2, "=", ">"):
                yield self.src.text(i + 1), exported, k, next((x for x in range(k, len(self.src)) if self.src.text(x) == ";"), len(self.src))

    def returned_page(self, first: int, last: int) -> str | None:
        """The first imported ...Page that is returned between two tokens."""
        if not self.pages:
            return None
        for i in self.returns[bisect_left(self.returns, first) : bisect_left(self.returns, last)]:
            k = i + 1 + (self.src.text(i + 1) == "(")
            name = self.src.text(k + 1) if self.src.text(k) == "<" else ""
            if name in self.pages:
                return name
        return None

    @cached_property
    def pages(self) -> set[str]:
        return {name for name in self.imports if name.endswith("Page")}

    @cached_property
    def returns(self) -> list[int]:
        return list(self.src.places("return"))

    # -- parts of screens -----------------------------------------------------------------------------------------

    def navigations(self) -> Iterator[tuple[str, str]]:
        for e in self.jsx.elements:
            if e.name in ("Link", "NavLink") and (to := e.string("to")):
                yield "link", to
        for i in self.src.named("navigate", "("):
            if (to := self.src.string(i + 2)) is not None:
                yield "navigate", to

    def calls(self) -> Iterator[tuple[str | None, str, str, int]]:
        """(exported function, method, path template, line) of requests."""
        spans = [(name, a, b) for name, exported, a, b in self.functions if exported]
        for i in sorted([*self.src.places("fetch"), *self.src.places("apiFetch")]):
            if self.src.text(i - 1) == ".":
                continue
            k = i + 1
            if self.src.text(k) == "<":
                depth = 0
                while k < len(self.src):
                    depth += (self.src.text(k) == "<") - (self.src.text(k) == ">")
                    k = self.src.close.get(k, k) + 1
                    if not depth:
                        break
            parts = self.src.parts(k) if self.src.text(k) == "(" else []
            given = self.src.string(parts[0][0]) if parts else None
            path = api_path(given) if given is not None else ""
            if path:
                method = self.src.member(parts[1][0], "method") if len(parts) > 1 and self.src.text(parts[1][0]) == "{" else None
                verb = (self.src.string(method) if method is not None else None) or "GET"
                owner = next((name for name, a, b in reversed(spans) if a <= i <= b), None)
                yield owner, verb.upper(), path, self.src.line(i)

    def controls(self) -> Iterator[tuple[Element, str, str, str | None]]:
        """(element, kind, stable key, field) of buttons, inputs and selects."""
        used: set[str] = set()
        for n, e in enumerate(x for x in self.jsx.elements if x.name.lower() in CONTROLS):
            kind = CONTROLS[e.name.lower()]
            if kind == "input":
                kind = {"checkbox": "checkbox", "submit": "button"}.get((e.string("type") or "").lower(), kind)
            key = e.string("name") or e.string("id") or self.role(e, kind) or f"{kind}-{n}"
            key = f"{key}-{n}" if key in used else key
            used.add(key)
            yield e, kind, key, e.string("name")

    def role(self, e: Element, kind: str) -> str | None:
        """A key that tells what a control is for, from its label, title, value, handler or text."""
        if label := e.string("aria-label"):
            return f"{kind}-{slug(label)}"
        for name in ("aria-label", "title"):
            if m := re.search(r"\.([A-Za-z]\w*)\b", e.code(name) or ""):
                return f"{kind}-{self.message(m[1])}"
        if m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*", e.code("value") or ""):
            return f"{kind}-{VALUE_ROLES.get(m[1]) or kebab(m[1])}"
        handler = e.code("onClick") or e.code("onChange")
        if handler and (told := self.handled(handler)):
            return f"{kind}-{told}"
        if m := re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9 _-]{0,40})\s*", e.inner):
            return f"{kind}-{slug(m[1])}"
        if m := re.search(r"\{(?:messages\.)?([A-Za-z]\w*)\}", e.inner):
            return f"{kind}-{self.message(m[1])}"
        return None

    @staticmethod
    def message(name: str) -> str:
        for prefix in MESSAGE_PREFIXES:
            name = name.removeprefix(prefix)
        return name.lower().replace("_", "-") if re.fullmatch("[A-Z0-9_]+", name) else kebab(name.removeprefix("action") or name)

    @staticmethod
    def handled(code: str) -> str | None:
        if known := set(HANDLERS.findall(code)):
            return next(role for name, role in HANDLER_ROLES.items() if name in known)
        plain = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*", code) or re.search(r"\b([a-z][a-zA-Z0-9]*)\s*\(", code)
        if plain and plain[1] not in CONVERSIONS:
            return kebab(re.sub(r"^(on|set)(?=.)", "", plain[1]))
        return None


@extractor("react-ui", "package.json", ".tsx", ".jsx", ".ts", ".js", ".css")
def react(path: str, text: str, asked: frozenset[str] | None = None) -> Iterable[Fact]:
    """The file itself, and by its kind: an application's root, routes, returned pages, imports, navigation, styles, surfaces, controls and calls.

    asked: only facts of these kinds are looked for.
    """
    wanted = lambda kind: asked is None or kind in asked
    if wanted("ui_file"):
        yield fact("ui_file", path, None, None, 1)
    if path.endswith("package.json"):
        doc = json.loads(text)
        if wanted("ui_package") and "react" in {**(doc.get("dependencies") or {}), **(doc.get("devDependencies") or {})}:
            yield fact("ui_package", doc.get("name"), None, None, 1, posixpath.dirname(path) or ".")
        return
    if path.endswith(".css"):
        return
    file = Screen(path, text)
    if file.looks_like_router() and path.endswith((".tsx", ".jsx", ".ts")):
        if wanted("ui_router"):
            yield fact("ui_router", path, None, None, 1, None, named=bool(ROUTER_FILE.search(path)))
        if wanted("ui_route"):
            for line, pattern, element in file.routes():
                yield fact("ui_route", pattern, None, None, line, element)
    if wanted("ui_import"):
        for local, (hint, name) in file.imports.items():
            yield fact("ui_import", local, None, None, 1, hint, exported=name)
    if wanted("ui_function"):
        for name, _, a, b in file.functions:
            yield fact("ui_function", name, None, None, file.src.line(a) if a < len(file.src) else 1, file.returned_page(a, b))
        yield fact("ui_function", None, None, None, 1, file.returned_page(0, len(file.src)))
    if wanted("ui_style"):
        for i in file.src.named("import"):
            spec = file.src.string(i + 1) or (file.src.string(i + 3) if file.src.text(i + 2) == "from" else None)
            if spec and re.sub(r"\?.*$", "", spec).endswith(".css"):
                yield fact("ui_style", spec, None, None, file.src.line(i), file.hint(re.sub(r"\?.*$", "", spec)), kind="css_module" if spec.endswith(".module.css") else "global_css")
    if wanted("ui_navigation"):
        for via, to in file.navigations():
            yield fact("ui_navigation", to, None, None, 1, None, via=via)
    if wanted("ui_surface"):
        for pattern, kind, key, library, frame, title in SURFACES:
            if any(w in text for w in SURFACE_WORDS[pattern]) and re.search(pattern, text):
                yield fact("ui_surface", kind, key, None, 1, library, frame=frame, title=title)
    if wanted("ui_control"):
        for e, kind, key, given in file.controls():
            yield fact("ui_control", key, None, None, line_of(text, e.at), given, kind=kind)
    if wanted("ui_form") and any(e.name.lower() == "form" for e in file.jsx.elements):
        yield fact("ui_form", None, None, None, 1)
    if wanted("ui_call"):
        helpers = bool(API_FILE.search(path)) and not NO_API_FILE.search(path)
        for owner, method, template, line in file.calls():
            yield fact("ui_call", method, owner if helpers else None, None, line, template)
    if wanted("ui_query"):
        for i in file.src.named("searchParams", ".", "get", "("):
            if (name := file.src.string(i + 4)) is not None:
                yield fact("ui_query", name, None, None, file.src.line(i))
