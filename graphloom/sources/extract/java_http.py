"""HTTP calls of Java files: five kinds of clients, with addresses that are folded from constants, concatenations and builders."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from ...schema import HTTP_VERBS as VERBS
from . import Fact, extractor, fact
from .lex import Source

#: Methods of the REST template and their verbs (fixed values of its interface).
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH"}
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
#: Wrappers and builders: those that pass their argument on, those that add a path, those that add what is no part of it, and those that end.
PASSED = {"create", "valueOf", "fromHttpUrl", "fromUriString", "fromPath", "of"}
APPENDED, LEFT_OUT = {"path", "concat", "append"}, {"queryParam", "queryParams", "query", "fragment", "encode", "scheme", "port"}
ENDED = {"toUriString", "toUri", "build", "buildAndExpand", "toString", "trim", "strip"}
DEEPEST = 8


class Folder:
    """String expressions of one file."""

    def __init__(self, text: str):
        self.src = Source(text)
        self.values: dict[str, range] = {}
        self.services: dict[str, str | None] = {}
        for i in range(1, len(self.src) - 2):
            if self.src.text(i - 1) == "String" and self.src.tokens[i].kind == "name" and self.src.text(i + 1) == "=":
                end = next(self.src.places(";", i + 2), len(self.src))
                self.values.setdefault(self.src.text(i), range(i + 2, end))

    def pluses(self, span: range) -> Iterator[range]:
        """The parts between additions outside brackets."""
        start = i = span.start
        while i < span.stop:
            if self.src.text(i) == "+":
                yield range(start, i)
                start = i + 1
            i = self.src.close.get(i, i) + 1
        yield range(start, span.stop)

    def fold(self, span: range, depth: int = 0) -> tuple[str, str | None] | None:
        """(text, service) of an expression: what is not known stands in braces; None if the expression tells no address."""
        if depth > DEEPEST:
            return None
        out, service = "", None
        for part in self.pluses(span):
            found = self.part(part, depth)
            if found is None:
                return None
            out, service = out + found[0], found[1] or service
        return out, service

    def part(self, span: range, depth: int) -> tuple[str, str | None] | None:
        if not len(span):
            return None
        first, text = span.start, self.src.text(span.start)
        if self.src.string(first) is not None:
            found: tuple[str, str | None] | None = (self.src.string(first), None)
            at = first + 1
        elif text == "(":
            found, at = self.fold(range(first + 1, self.src.close.get(first, first)), depth + 1), self.src.close.get(first, first) + 1
        elif text == "new":
            at = self.src.type_ends(first + 1)
            found = self.first_argument(at, depth) or ("", None)
            at = self.src.close.get(at, at) + 1
        elif self.src.tokens[first].kind == "name":
            last = self.src.last_of(first)
            name = self.src.text(last)
            at = last + 1
            if self.src.text(at) == "(":
                bracket, at = at, self.src.close.get(at, at) + 1
                if name == "format":
                    found = self.formatted(bracket, depth)
                elif name in PASSED:
                    found = self.first_argument(bracket, depth)
                elif last == first and not self.src.parts(bracket):
                    service = self.discovered(name)
                    found = ("", service) if service else None
                elif last > first:  # a method of a value
                    return self.chained(self.named(first, depth), first + 1, span, depth) if last == first + 2 else None
                else:
                    found = None
            else:
                found = self.named(last, depth)
        else:
            return None
        return self.chained(found, at, span, depth)

    def named(self, i: int, depth: int) -> tuple[str, str | None]:
        name = self.src.text(i)
        held = self.values.get(name)
        return (self.fold(held, depth + 1) if held is not None else None) or (f"{{{name}}}", None)

    def chained(self, found: tuple[str, str | None] | None, at: int, span: range, depth: int) -> tuple[str, str | None] | None:
        """The value after the calls that follow on it."""
        while found is not None and at < span.stop:
            if self.src.text(at) != "." or self.src.text(at + 2) != "(":
                return None
            name, bracket = self.src.text(at + 1), at + 2
            if name in APPENDED:
                more = self.first_argument(bracket, depth)
                found = (found[0] + more[0], found[1]) if more else None
            elif name == "pathSegment":
                more = [self.fold(p, depth + 1) for p in self.src.parts(bracket)]
                found = (found[0].rstrip("/") + "".join(f"/{m[0]}" for m in more), found[1]) if all(more) else None
            elif name == "host":
                more = self.first_argument(bracket, depth)
                found = (f"http://{more[0]}", found[1]) if more else None
            elif name not in LEFT_OUT | ENDED:
                return None
            at = self.src.close.get(bracket, bracket) + 1
        return found

    def first_argument(self, bracket: int, depth: int) -> tuple[str, str | None] | None:
        parts = self.src.parts(bracket)
        return self.fold(parts[0], depth + 1) if parts else None

    def formatted(self, bracket: int, depth: int) -> tuple[str, str | None] | None:
        parts = self.src.parts(bracket)
        pattern = self.fold(parts[0], depth + 1) if parts else None
        if pattern is None:
            return None
        given = iter([self.fold(p, depth + 1) for p in parts[1:]])
        return re.sub(r"%[-\d.]*[sdx]", lambda m: (next(given, None) or ("{arg}", None))[0], pattern[0]), pattern[1]

    def discovered(self, method: str) -> str | None:
        """The service whose instances a method of this file asks for, looked up once."""
        if method not in self.services:
            self.services[method] = self.asked(method)
        return self.services[method]

    def asked(self, method: str) -> str | None:
        for i in self.src.named(method, "("):
            body = self.src.close.get(i + 1, i + 1) + 1
            if self.src.text(body) == "{":
                for k in self.src.named("getInstances", "("):
                    if body < k < self.src.close.get(body, body):
                        return self.src.string(k + 2)
        return None


def target(found: tuple[str, str | None]) -> tuple[str, str | None] | None:
    """(path, service) of a folded address: the host is the service if none was discovered; queries and a last slash go."""
    raw, service = found
    m = re.match(r"(?i)https?://([^/?#]*)([^?#]*)", raw)
    if m:
        host = re.sub(r"\{[^}]*\}", "x", m[1]).rpartition("@")[2].partition(":")[0].lower()
        raw, service = m[2], service or host
    elif not raw and not service:
        return None
    path = unquote(re.split(r"[?#]", raw, maxsplit=1)[0]).rstrip("/") or "/"
    return (path if path.startswith("/") else f"/{path}"), service


def _call(method: str, found: tuple[str, str | None] | None, line: int, client: str) -> Iterator[Fact]:
    told = target(found) if found is not None else None
    if told:
        yield fact("http_call", f"{method} {told[0]}", None, None, line, told[0], method=method, client=client, callee=told[1])


@extractor("java-http-calls", ".java")
def java_calls(path: str, text: str) -> Iterable[Fact]:
    """RestTemplate (with exchange), WebClient, RestClient, HttpURLConnection, java.net.http requests and Feign methods."""
    if not any(w in text for w in ("uri", "exchange", "openConnection", "FeignClient", "estTemplate")):
        return  # without these words no rule holds
    folder = Folder(text)
    src = folder.src
    names = {t.text for t in src.tokens if t.kind == "name"}
    fluent = [kind for kind, gate in (("web_client", {"WebClient", "webClient", "webClientBuilder"}), ("rest_client", {"RestClient", "restClient"})) if gate & names]
    rest = "RestTemplate" in names | {n[:1].upper() + n[1:] for n in names if n.lower().endswith("resttemplate")}
    for i in src.places("."):
        if src.text(i + 2) != "(":
            continue
        word, bracket, line = src.text(i + 1), i + 2, src.tokens[i + 1].line
        after = src.close.get(bracket, bracket) + 1
        if word in VERBS and after == bracket + 2 and src.reads(after, ".", "uri", "("):
            for kind in fluent:
                yield from _call(word.upper(), folder.first_argument(after + 2, 0), line, kind)
        elif word == "method" and src.reads(bracket + 1, "HttpMethod", ".") and src.reads(after, ".", "uri", "("):
            for kind in fluent:
                yield from _call(src.text(bracket + 3), folder.first_argument(after + 2, 0), line, kind)
        elif word in REST_TEMPLATE and rest and src.parts(bracket):
            yield from _call(REST_TEMPLATE[word], folder.first_argument(bracket, 0), line, "rest_template")
        elif word == "exchange" and len(parts := src.parts(bracket)) > 1 and src.reads(parts[1].start, "HttpMethod", "."):
            yield from _call(src.text(parts[1].start + 2).upper(), folder.fold(parts[0]), line, "rest_template")
        elif word == "openConnection":
            start = next((k for k in range(i - 1, -1, -1) if src.reads(k, "new", "URL", "(") and src.close.get(k + 2) == i - 1), None)
            if start is not None:
                verb = next((src.string(k + 2) for k in itertools.takewhile(lambda k: k < i + 80, src.places("setRequestMethod", i + 1)) if src.text(k + 1) == "("), None)
                yield from _call((verb or "GET").upper(), folder.first_argument(start + 2, 0), line, "url_connection")
        elif word == "uri" and src.reads(bracket + 1, "URI", ".", "create", "("):
            verb = next((src.text(k + 1) for k in range(after, min(after + 40, len(src))) if src.text(k) == "." and src.text(k + 1) in ("GET", "POST", "PUT", "DELETE")), None)
            if verb:
                yield from _call(verb, folder.first_argument(bracket + 4, 0), line, "http_client")
    for i in src.named("@", "FeignClient", "("):
        callee = src.given(i + 2, "name", "value")
        base = src.member_string(i + 2, "path") or ""
        for k in src.named("@"):
            verb = MAPPINGS.get(src.text(k + 1))
            if src.text(k + 1) == "RequestMapping" and src.text(k + 2) == "(":
                verb = next((src.text(x + 2) for p in src.parts(k + 2) for x in p if src.reads(x, "RequestMethod", ".")), None)
            if verb and src.text(k + 2) == "(":
                given = "/" + "/".join(p.strip("/") for p in (base, src.given(k + 2, "value", "path") or "") if p.strip("/"))
                yield fact("http_call", f"{verb} {given}", None, None, src.tokens[k].line, given, method=verb, client="feign", callee=callee)
