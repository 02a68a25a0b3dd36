"""Build files and message handlers."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from . import Fact, extractor, fact, line_of
from .lex import Source


def _child(node: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        node = next((x for x in node if x.tag.rpartition("}")[2] == name), None) if node is not None else None
    return node


def _said(node: ET.Element | None, *names: str) -> str | None:
    found = _child(node, *names)
    return (found.text or "").strip() or None if found is not None else None


@extractor("maven-project", "pom.xml")
def maven(path: str, text: str) -> Iterable[Fact]:
    """The project's coordinates; what it leaves out comes from its parent. Spring Boot: a starter, or the plugin unless it is skipped."""
    project = ET.fromstring(text)
    artifact = _said(project, "artifactId")
    if artifact is None:
        return
    packaging = _said(project, "packaging") or "jar"
    boot = False
    for node in project.iter():
        name = _said(node, "artifactId") or ""
        boot |= name.startswith("spring-boot-starter") and node.tag.endswith("dependency")
        boot |= name == "spring-boot-maven-plugin" and node.tag.endswith("plugin")
    skipped = any(n.tag.endswith("skip") and (n.text or "").strip() == "true" for n in project.iter())
    group = _said(project, "groupId") or _said(project, "parent", "groupId")
    yield fact("module", artifact, None, _said(project, "parent", "artifactId"), 1, posixpath.dirname(path) or path, group=group, packaging=packaging, boot=boot and not skipped and packaging != "pom")


@extractor("gradle-project", "build.gradle", "build.gradle.kts")
def gradle(path: str, text: str) -> Iterable[Fact]:
    """Top-level settings of a build script, in Groovy or Kotlin; the folder names a project without a name."""
    src = Source(text)
    settings: dict[str, str] = {}
    plugins, off, i = set(), False, 0
    for at, token in enumerate(src.tokens):
        if src.text(at) == "id":
            plugins.add(src.string(at + 1) or src.string(at + 2))
        if token.text == "bootJar":
            block = next((k for k in range(at, min(at + 4, len(src))) if src.text(k) == "{"), None)
            off |= block is not None and any(src.reads(k, "enabled", "=", "false") for k in range(block, src.close[block]))
    while i < len(src):
        value = src.string(i + 2) if src.text(i + 1) in ("=", "(") else src.string(i + 1)
        if src.tokens[i].kind == "name" and value is not None:
            settings.setdefault(src.text(i), value)
        i = src.close.get(i, i) + 1 if src.text(i) == "{" else i + 1
    starter = any(t.kind == "string" and t.text.startswith("org.springframework.boot:spring-boot-starter") for t in src.tokens)
    folder = posixpath.dirname(path)
    name = next((settings[k] for k in ("name", "archivesBaseName", "archivesName") if k in settings), None) or posixpath.basename(folder) or "root"
    yield fact("module", name, None, None, 1, folder or path, group=settings.get("group"), packaging="jar", boot=("org.springframework.boot" in plugins or starter) and not off)


#: Project types by the first mark in a project file (fixed values).
PROJECT_TYPES = (("web", "Microsoft.NET.Sdk.Web"), ("worker", "Microsoft.NET.Sdk.Worker"), ("worker", "OutputType>Exe<"), ("web", "Microsoft.NET.Sdk.BlazorWebAssembly"), ("test", "Microsoft.NET.Test.Sdk"), ("classlib", "Microsoft.NET.Sdk"))


@extractor("dotnet-project", ".csproj", ".sln")
def dotnet_project(path: str, text: str) -> Iterable[Fact]:
    name = posixpath.basename(path)
    if path.endswith(".sln"):
        yield fact("solution", name[:-4], None, None, 1)
        return
    kind = next((k for k, mark in PROJECT_TYPES if mark.lower() in text.lower()), "unknown")
    yield fact("project", name, None, None, 1, path, type=kind)
    for m in re.finditer(r'<(Project|Package)Reference\s+Include="([^"]+)"', text, re.I):
        if m[1].lower() == "package":
            yield fact("package", m[2], None, name, line_of(text, m.start()))
        else:
            other = m[2].replace("\\", "/")
            yield fact("project_reference", posixpath.basename(other), None, name, line_of(text, m.start()), posixpath.normpath(posixpath.join(posixpath.dirname(path), other)))


def _handler(src: Source, at: int, role: str, message: str | None, channel: str | None, method: str | None = None) -> Fact:
    return fact("handler", message, None, src.owner(at), src.tokens[at].line, channel, role=role, method=method)


def _listeners(src: Source, annotation: str) -> Iterable[Fact]:
    """Java methods under an annotation, which names the queue or topic; the first parameter is the message."""
    for i in src.named("@", annotation):
        listed = i + 2 if src.text(i + 2) == "(" else None
        channel = src.given(listed, "queues", "queue", "topics", "topic") if listed else None
        method, message, _ = next(src.methods(src.close[listed] if listed else i + 2), (None, None, 0))
        if method:
            yield _handler(src, i, "consumer", message, channel, method)


def _sends(src: Source, senders: tuple[str, ...], method: str) -> Iterable[Fact]:
    for variable, name, at in src.calls():
        if name == method and variable.lower() in senders and src.parts(at) and src.string(src.parts(at)[0][0]) is not None:
            yield _handler(src, at, "producer", src.owner(at), src.string(src.parts(at)[0][0]))


def _consumers(src: Source, attribute: str, method: str | None) -> Iterable[Fact]:
    """C# classes that implement a consumer of a message type, and attributes that name a queue or topic."""
    for i in src.named("IConsumer", "<"):
        last = src.type_ends(i) - 2
        yield _handler(src, i, "consumer", src.text(last), None, method)
    for i in src.named(attribute, "("):
        if src.string(i + 2) is not None:
            yield _handler(src, i, "consumer", src.owner(i) or "UnknownMessage", src.string(i + 2))


#: Endings of the names of message types (fixed values).
MESSAGES = ("message", "event", "command")


@extractor("bus-rabbit", ".cs", ".java")
def rabbit(path: str, text: str) -> Iterable[Fact]:
    """Spring AMQP listeners and templates; in C# consumers, and methods that take a message where the client library is used or the type says so."""
    if not any(w in text for w in ("RabbitListener", "convertAndSend", "IConsumer", "RabbitMQ")) and (path.endswith(".java") or not any(w in text.lower() for w in MESSAGES)):
        return  # without these words no rule holds
    src = Source(text)
    if path.endswith(".java"):
        yield from _listeners(src, "RabbitListener")
        yield from _sends(src, ("rabbittemplate", "amqptemplate"), "convertAndSend")
        return
    yield from _consumers(src, "RabbitListener", "Consume")
    client = any(t.text == "RabbitMQ" for t in src.tokens)
    for name, message, at in src.methods():
        if message and src.text(at - 1) in ("void", "Task", ">") and (client or message.lower().endswith(MESSAGES)):
            yield _handler(src, at, "consumer", message, None, name)


@extractor("bus-kafka", ".cs", ".java")
def kafka(path: str, text: str) -> Iterable[Fact]:
    """Spring Kafka listeners and templates; in C# consumers and topic attributes."""
    if not any(w in text for w in ("KafkaListener", "IConsumer", "Topic")) and "kafkatemplate" not in text.lower():
        return  # without these words no rule holds
    src = Source(text)
    if path.endswith(".java"):
        yield from _listeners(src, "KafkaListener")
        yield from _sends(src, ("kafkatemplate",), "send")
    else:
        yield from _consumers(src, "Topic", None)
