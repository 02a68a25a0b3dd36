"""Code symbols of Python, read with its own parser, and of C++, by patterns."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable

from . import Fact, extractor, fact, line_of
from .pytree import source_of


def module_name(path: str) -> str:
    return re.sub(r"(/__init__)?\.[^./]+$", "", path).replace("/", ".")


@extractor("python", ".py")
def python(path: str, text: str) -> Iterable[Fact]:
    """module, class, function, variable; imports as facts with a target."""
    tree = ast.parse(text)
    module = module_name(path)
    yield fact("module", module.rpartition(".")[2], module, None, 1)

    def walk(body: list[ast.stmt], outer: str) -> Iterable[Fact]:
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = f"{outer}.{node.name}"
                bases = [source_of(b) for b in node.bases]
                yield fact("class", node.name, name, outer, node.lineno, end_line=node.end_lineno)
                for base in bases:
                    yield fact("inherits", base, name, None, node.lineno, base)
                yield from walk(node.body, name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{outer}.{node.name}"
                yield fact("function", node.name, name, outer, node.lineno, end_line=node.end_lineno)
                yield from walk([x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], name)
            elif isinstance(node, ast.Import):
                for alias in node.names:
                    yield fact("imports", alias.name, module, None, node.lineno, alias.name)
            elif isinstance(node, ast.ImportFrom):
                up = module.split(".")[: -node.level] if node.level else []
                yield fact("imports", node.module, module, None, node.lineno, ".".join([*up, *([node.module] if node.module else [])]))
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and outer == module:
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        yield fact("variable", target.id, f"{module}.{target.id}", module, node.lineno)

    yield from walk(tree.body, module)


@extractor("cpp", ".cpp", ".cc", ".cxx", ".h", ".hpp")
def cpp(path: str, text: str) -> Iterable[Fact]:
    module = module_name(path)
    yield fact("module", module.rpartition(".")[2], module, None, 1)
    for m in re.finditer(r'^[ \t]*#include[ \t]*([<"])([^>"]+)[>"]', text, re.M):
        yield fact("imports", m[2], module, None, line_of(text, m.start()), m[2], system=m[1] == "<")
    for m in re.finditer(r"^[ \t]*(?:class|struct)\s+(\w+)[^;{=]*\{", text, re.M):
        yield fact("class", m[1], f"{module}.{m[1]}", module, line_of(text, m.start()))
    for m in re.finditer(r"^(?!\s*(?:if|for|while|switch|return|else|class|struct)\b)[\w:<>*&~ \t]+?[ \t*&]((?:\w+::)*~?\w+)\s*\([^;{}()]*\)\s*(?:const\s*)?\{", text, re.M):
        yield fact("function", m[1].rpartition("::")[2], f"{module}.{m[1].replace('::', '.')}", module, line_of(text, m.start()))
