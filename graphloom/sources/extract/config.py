"""Deployment and configuration: compose, settings, OpenAPI, Spring."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from ...schema import HTTP_VERBS, INFRASTRUCTURE
from . import Fact, extractor, fact

ENGINES = (("postgresql", "postgres|npgsql"), ("mysql", "mysql|mariadb"), ("mssql", "sqlserver|mssql|initial catalog"), ("mongodb", "mongo"), ("redis", "redis"), ("rabbitmq", "rabbit|amqp"), ("kafka", "kafka"), ("elasticsearch", "elastic"), ("minio", "minio|s3"))
BINDINGS = {"postgresql": "database", "mysql": "database", "mssql": "database", "mongodb": "database", "redis": "cache", "rabbitmq": "broker", "kafka": "broker", "elasticsearch": "search", "minio": "storage"}


def load_yaml(text: str):
    import yaml

    return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))  # the same loader, in C where it is built


@extractor("compose", "compose.yml", "compose.yaml")
def compose(path: str, text: str) -> Iterable[Fact]:
    services = (load_yaml(text) or {}).get("services") or {}
    for name, body in services.items():
        if not isinstance(body, dict):
            continue
        image = str(body.get("image") or "")
        kind = next((k for k, p in INFRASTRUCTURE if re.search(p, image, re.I)), None)
        yield fact("service", name, f"{path}#{name.lower()}", None, None, None, image=image or None)
        needed = body.get("depends_on") or []
        for other in needed:
            condition = needed[other].get("condition") if isinstance(needed, dict) and isinstance(needed[other], dict) else None
            yield fact("depends_on", name, None, None, None, str(other), condition=condition)
        if kind:
            yield fact("infrastructure", name, None, None, None, None, kind=kind, image=image)


def redact(value: str) -> str:
    value = re.sub(r"(?i)\b(password|pwd|user id|username|user|uid|token|secret|apikey)\s*=\s*[^;&\s]+", r"\1=***", value)
    return re.sub(r"://[^/@\s:]+:[^/@\s]+@", "://***:***@", value)


def host(value: str) -> str | None:
    m = re.search(r"://(?:[^/@\s]*@)?([^/:?#\s,;]+)", value) or re.search(r"(?i)(?:host|server|data source)\s*=\s*([^;,:\s]+)", value)
    return m[1] if m else None


def binding(key: str, value: str) -> Fact | None:
    engine = next((e for e, p in ENGINES if re.search(p, f"{key} {value}", re.I)), None)
    if engine is None and not re.match(r"https?://", value):
        return None
    if value.startswith(("${", "<", "#{")):
        return None
    return fact("binding", key, None, None, None, host(value), type=BINDINGS.get(engine, "http"), engine=engine, value=redact(value))


@extractor("appsettings", "appsettings.json", ".env", ".Development.json", ".Production.json")
def appsettings(path: str, text: str) -> Iterable[Fact]:
    from ..settings import flatten

    if path.endswith(".json"):
        rows = flatten(json.loads(re.sub(r"^\s*//.*$", "", text, flags=re.M)))
    else:
        rows = re.findall(r"""(?m)^\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*=\s*["']?([^"'\r\n]*)["']?\s*$""", text)
    for key, value in rows:
        found = binding(key, value)
        if found:
            yield found


@extractor("openapi", "openapi.yml", "openapi.yaml", "openapi.json", "swagger.json")
def openapi(path: str, text: str) -> Iterable[Fact]:
    doc = json.loads(text) if path.endswith(".json") else load_yaml(text)
    if not isinstance(doc, dict) or not (doc.get("openapi") or doc.get("swagger")):
        return
    title = (doc.get("info") or {}).get("title") or path
    yield fact("spec", title, None, None, None, None)
    for route, verbs in (doc.get("paths") or {}).items():
        for verb, op in (verbs or {}).items():
            if verb.lower() in HTTP_VERBS:
                op = op if isinstance(op, dict) else {}
                yield fact("endpoint", f"{verb.upper()} {route}", None, title, None, route, method=verb.upper(), operation_id=op.get("operationId"), summary=op.get("summary"))


@extractor("spring-config", "application.yml", "application.yaml", "application.properties")
def spring_config(path: str, text: str) -> Iterable[Fact]:
    from ..settings import flatten

    if path.endswith(".properties"):
        values = {k.strip(): v.strip() for k, v in re.findall(r"(?m)^\s*([^#!=:\s][^=:]*)[=:](.*)$", text)}
    else:
        values = {k.replace("__", "."): v for k, v in flatten(load_yaml(text) or {})}
    if values.get("server.port", "").isdigit():
        yield fact("port", values["server.port"], None, None, None, None)
    for key, value in sorted(values.items()):
        m = re.match(r"jdbc:([a-zA-Z0-9]+):", value)
        if m and "${" not in value and key.startswith("spring.") and key.endswith(".url"):
            name = key.split(".")[-2]
            yield fact("datasource", name, None, None, None, host(value), engine=m[1].lower())
