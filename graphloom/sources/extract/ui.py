"""User-interface structure of single-page applications: routes, screens, controls, calls."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from . import Fact, extractor, fact, line_of
from .calls import VERBS
from .lex import Source

#: Packages that mark an application root (fixed values).
FRAMEWORKS = {"react": "react", "@angular/core": "angular", "angular": "angularjs"}


@extractor("spa-roots", "package.json")
def roots(path: str, text: str) -> Iterable[Fact]:
    """One fact for each framework that a package depends on."""
    doc = json.loads(text)
    needed = {**(doc.get("dependencies") or {}), **(doc.get("devDependencies") or {})}
    for package, framework in FRAMEWORKS.items():
        if package in needed:
            yield fact("spa", doc.get("name"), None, None, 1, re.sub(r"/?package\.json$", "", path) or ".", framework=framework)


def _controls(text: str) -> Iterable[Fact]:
    for m in re.finditer(r"<(button|input|select|textarea|form|a|Link)\b([^>]*)>", text):
        label = re.search(r"""(?:name|id|aria-label|to|href)\s*=\s*\{?["'`]([^"'`]+)""", m[2])
        yield fact("ui_control", label[1] if label else m[1], None, None, line_of(text, m.start()), None, element=m[1])


@extractor("angular-ui", ".ts", ".html")
def angular(path: str, text: str) -> Iterable[Fact]:
    """Route tables, component declarations and template controls."""
    if path.endswith(".html"):
        yield from _controls(text)
        return
    for m in re.finditer(r"""\{\s*path\s*:\s*["']([^"']*)["'][^{}]*?\b(?:component\s*:\s*(\w+)|loadChildren\s*:[^{}]*?["']([^"']+)["'])""", text):
        yield fact("ui_route", m[1], None, None, line_of(text, m.start()), m[2] or m[3])
    for m in re.finditer(r"@Component\s*\(\s*\{([\s\S]*?)\}\s*\)\s*export\s+class\s+(\w+)", text):
        selector = re.search(r"""selector\s*:\s*["']([^"']+)""", m[1])
        yield fact("ui_component", m[2], None, None, line_of(text, m.start()), selector[1] if selector else None)


@extractor("angularjs-ui", ".js")
def angularjs(path: str, text: str) -> Iterable[Fact]:
    """Modules (with what they require), states and routes with their settings, and $http calls in both forms."""
    src = Source(text)
    for variable, method, at in src.calls():
        parts = src.parts(at)
        name = src.string(parts[0][0]) if parts else None
        line = src.tokens[at - 1].line
        if variable == "angular" and method == "module" and name is not None and len(parts) > 1:
            yield fact("ui_module", name, None, None, line)
        elif variable == "$http" and method in VERBS and name is not None:
            yield fact("invokes_api", f"{method.upper()} {name}", None, None, line, name, method=method.upper())
    for i in range(len(src) - 2):
        if src.text(i) != "." or src.text(i + 2) != "(" or src.text(i + 1) not in ("state", "when"):
            continue
        parts, line = src.parts(i + 2), src.tokens[i + 1].line
        name = src.string(parts[0][0]) if len(parts) > 1 else None
        if name is None or src.text(parts[1][0]) != "{":
            continue
        said = lambda key, block=parts[1][0]: src.member(block, key)
        if src.text(i + 1) == "when":
            yield fact("ui_route", name, None, None, line, src.string(said("controller") or -1))
        else:
            abstract = src.text(said("abstract") or -1) == "true"
            url = src.string(said("url") or -1)
            above = src.string(said("parent") or -1) or name.rpartition(".")[0] or None
            yield fact("ui_route", url or name, None, above, line, name, abstract=True if abstract else None, state=name, url=url)
    for i in src.named("$http", "(", "{"):
        url, verb = (src.string(src.member(i + 2, key) or -1) for key in ("url", "method"))
        if url is not None:
            verb = (verb or "GET").upper()
            yield fact("invokes_api", f"{verb} {url}", None, None, src.tokens[i].line, url, method=verb)
