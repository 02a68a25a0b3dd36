"""Declarations, members and call sites of Java, C# and TypeScript files: a scope tree with declared types over tokens.

What one file can tell is told here: types with their members, the names that its imports bring in, and for each
call the chain that leads to the called name ("a field of this, then a method's result, then m").  Where a chain ends
is a question to all files: :mod:`graphloom.operators.calls` answers it with joins.

A type that a file mentions becomes a list of candidates: the qualified names that it could have, best first, by the
language's rules for enclosing scopes, imports, package and namespace.  Facts of these kinds are added to the others:

* ``call``: name of the called method, qualified_name of the caller, attrs steps, starts (candidates or ``self``), args
* ``inject``: a constructor's parameter, qualified_name of its class, attrs starts
* ``alias``: qualified_name stands for target (default exports, re-exports; ``*`` for all names of a module)
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

from . import Fact, extractor, fact
from .lex import Source

#: Words that stand before members (fixed values of the languages).
MODIFIERS = {
    "java": set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split()),
    "csharp": set("public protected private internal static readonly const abstract virtual override sealed async extern unsafe partial new volatile required event file ref".split()),
    "typescript": set("public protected private static readonly abstract override async declare accessor export default".split()),
}
TYPE_WORDS = {"java": {"class", "interface", "enum", "record"}, "csharp": {"class", "interface", "enum", "record", "struct"}, "typescript": {"class", "interface", "enum", "namespace", "module"}}
KINDS = {"record": "class", "module": "namespace"}
#: Words before a bracket that are no calls.
NO_CALLS = set("if for foreach while switch catch return throw new typeof sizeof nameof lock using await else do super this base function synchronized assert yield delete void in of instanceof case default constructor when and or not checked unchecked fixed async".split())
DECLARE = {"const", "let", "var"}
PRIMITIVE = set("int long short byte char float double boolean bool void string decimal object number any unknown never undefined null var dynamic uint ulong ushort sbyte".split())
#: Types whose argument is what is waited for.
PROMISES = {"Task", "ValueTask", "Promise"}
SEPARATOR = " "


def module_of(path: str) -> str:
    return re.sub(r"\.[^./]+$", "", path).replace("/", ".")


class Scope:
    """A type, function or module: its qualified name, what it encloses, and the names declared in it with what leads to them."""

    def __init__(self, qualified: str, kind: str, outer: Scope | None):
        self.qualified, self.kind, self.outer = qualified, kind, outer
        self.fields: dict[str, str | None] = {}

    def types(self) -> list[str]:
        """The enclosing types, own first."""
        found, at = [], self
        while at is not None:
            if at.kind in ("class", "interface", "enum"):
                found.append(at.qualified)
            at = at.outer
        return found


class Reader:
    """One file's walk: facts in ``facts``."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.language, self.src = path, language, Source(text)
        self.module, self.space = module_of(path), ""
        self.facts: list[Fact] = []
        self.opened = {c: o for o, c in self.src.close.items()}
        self.imports: dict[str, list[str]] = {}
        self.spaces: list[str] = []
        self.facts.append(fact("module", self.module.rpartition(".")[2], self.module, None, 1))

    # -- reading --------------------------------------------------------------------------------------------------

    def line(self, i: int) -> int:
        return self.src.tokens[min(i, len(self.src) - 1)].line

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.src) and self.src.tokens[i].kind == "name"

    def skip(self, i: int) -> int:
        """The place after the token or bracket at i."""
        return self.src.close.get(i, i) + 1

    def angle(self, i: int) -> int:
        """The place after the type arguments at i; i if there are none that close."""
        if self.src.text(i) != "<":
            return i
        depth, at = 0, i
        while at < len(self.src):
            text = self.src.text(at)
            depth += (text == "<") - (text == ">" and self.src.text(at - 1) != "=")
            at = self.skip(at)
            if not depth:
                return at
            if text in (";", "{") or at - i > 200:
                return i
        return i

    def dotted(self, i: int) -> tuple[str, int]:
        """A dotted name and the place after it."""
        found = self.src.text(i)
        i += 1
        while self.src.text(i) == "." and self.named(i + 1):
            found, i = f"{found}.{self.src.text(i + 1)}", i + 2
        return found, i

    def typed(self, i: int) -> tuple[str | None, int]:
        """The name of the type at i (without arguments; with [] if it is an array) and the place after it."""
        if not self.named(i):
            return None, self.skip(i) if self.src.text(i) in ("(", "{", "[") else i + 1
        name, i = self.dotted(i)
        inner, i = i + 1, self.angle(i)
        if name in PROMISES:
            name = self.typed(inner)[0] if inner < i else None
        array = ""
        while True:
            if self.src.text(i) == "[" and self.src.close.get(i) == i + 1:
                array, i = array + "[]", i + 2
            elif self.src.text(i) == "?" and self.language == "csharp":
                i += 1
            elif self.src.reads(i, ".", ".", "."):
                array, i = array + "[]", i + 3
            elif self.language == "typescript" and self.src.text(i) in ("|", "&"):
                other, i = self.typed(i + 1)
                name = name if other in ("null", "undefined") else None
            else:
                return (name + array if name else None), i

    # -- names ----------------------------------------------------------------------------------------------------

    def candidates(self, name: str | None, scope: Scope) -> str | None:
        """Qualified names that a mentioned type can have, best first; null for none that could be a type of these files."""
        if not name or name.endswith("[]") or name in PRIMITIVE:
            return None
        first, _, rest = name.partition(".")
        found: list[str] = []
        if self.language == "typescript":
            found += self.imports.get(first, [f"{self.module}.{first}"])
        else:
            found += [f"{t}.{first}" for t in scope.types()]
            found += self.imports.get(first, [])
            spaces = [self.space] if self.language == "java" else [self.space.rsplit(".", n)[0] for n in range(self.space.count(".") + 1)]
            root = "" if self.space or self.language == "csharp" else f"{self.module}."
            found += [f"{s}.{first}" if s else f"{root}{first}" for s in spaces]
            if self.language == "csharp":
                found += [f"{self.module}.{first}"]
            found += [f"{s}.{first}" for s in self.spaces]
            if rest:
                found.append(first)
        return SEPARATOR.join(dict.fromkeys(f"{c}.{rest}" if rest else c for c in found))

    # -- declarations ---------------------------------------------------------------------------------------------

    def file(self) -> list[Fact]:
        at, scope = 0, Scope(self.module, "module", None)
        if self.language == "typescript":
            self.module_facts(scope)
        self.declarations(at, len(self.src), scope)
        return self.facts

    def declarations(self, at: int, end: int, scope: Scope) -> None:
        """Members of a file, namespace or type between two places."""
        pending: list[tuple] = []
        while at < end:
            at = self.declaration(at, end, scope, pending)
        for body in pending:  # after all members are known
            self.body(*body)

    def declaration(self, at: int, end: int, scope: Scope, pending: list) -> int:
        text, language = self.src.text(at), self.language
        if self.src.reads(at, "@", "interface"):
            return self.statement(at, end)
        if text == "@":
            _, at = self.dotted(at + 1)
            return self.skip(at) if self.src.text(at) == "(" else at
        if text == "[" and language == "csharp" and scope.kind != "method":
            return self.skip(at)
        if language == "java" and text in ("package", "import") and scope.kind == "module":
            return self.java_header(at)
        if language == "csharp" and text in ("using", "namespace") and scope.kind in ("module", "namespace"):
            return self.csharp_header(at, end, scope, pending)
        if text in MODIFIERS[language] and not (language == "typescript" and self.src.text(at + 1) in ("(", ":", "=", "?", "!", ";")):
            return at + 1
        if text in TYPE_WORDS[language] and self.named(at + 1) and not (language == "csharp" and text == "record" and self.src.text(at + 1) in TYPE_WORDS["csharp"]):
            return self.type(at, scope)
        if language == "csharp" and text == "record":
            return at + 1
        if language == "typescript":
            return self.typescript_member(at, end, scope, pending)
        return self.member(at, end, scope, pending)

    def type(self, at: int, scope: Scope) -> int:
        word, name, line = self.src.text(at), self.src.text(at + 1), self.line(at)
        kind = KINDS.get(word, word)
        # The order of the walk is that of the text: headers, then body.
        i = self.angle(at + 2)
        if word == "namespace" or word == "module":
            name, i = self.dotted(at + 1)
        parts = i if self.src.text(i) == "(" else None
        i = self.skip(i) if parts is not None else i
        outer = f"{self.space}" if scope.kind == "module" and self.space else scope.qualified
        own = Scope(f"{outer}.{name}", kind, scope)
        bases: list[tuple[str, str]] = []
        relation = None
        while i < len(self.src) and self.src.text(i) not in ("{", ";"):
            text = self.src.text(i)
            if text in ("extends", "implements", "permits", "where") or (text == ":" and self.language == "csharp"):
                relation = {"extends": "inherits", "implements": "implements", ":": "inherits"}.get(text)
                i += 1
            elif relation and self.named(i):
                base, i = self.typed(i)
                if base:
                    bases.append((relation if not (relation == "inherits" and bases and self.language == "csharp") else "implements", base))
                i = self.skip(i) if self.src.text(i) == "(" else i
            else:
                i = self.skip(i)
        if word == "struct":
            return self.skip(i)
        self.facts.append(fact(kind, name.rpartition(".")[2], own.qualified, outer, line, end_line=self.line(self.src.close.get(i, i)), signature=None))
        for relation, base in bases:
            self.facts.append(fact(relation, base, own.qualified, None, line, base, starts=self.candidates(base, scope if scope.kind != "module" else own)))
        if parts is not None:
            for part, given in self.parameters(parts, own):  # components of a record: they lead on, but are no symbols
                own.fields[part] = given
                self.facts.append(fact("parameter_property", part, f"{own.qualified}.{part}", own.qualified, line, type=given))
        if kind == "namespace" or self.src.text(i) != "{":
            return self.skip(i)
        start, end = i + 1, self.src.close.get(i, len(self.src))
        if word == "enum":
            while start < end and self.src.text(start) != ";":
                start = self.skip(start)
            start = start if self.language == "java" else end
        self.declarations(start, end, own)
        return self.skip(i)

    def parameters(self, at: int, scope: Scope) -> list[tuple[str, str | None]]:
        """(name, type candidates) of the parameters in the bracket at a place."""
        return [(name, self.candidates(given, scope)) for name, given in self.simple(at)]

    def simple(self, at: int) -> list[tuple[str, str | None]]:
        """(name, type as written) of the parameters in the bracket at a place."""
        found, arrow = [], self.src.parts(at)
        merged: list[range] = []
        depth = 0
        for part in arrow:  # commas between type arguments part no parameters
            if depth and merged:
                merged[-1] = range(merged[-1].start, part.stop)
            else:
                merged.append(part)
            depth = max(0, sum((self.src.text(k) == "<") - (self.src.text(k) == ">" and self.src.text(k - 1) != "=") for k in merged[-1]))
        for part in merged:
            i = part.start
            while i < part.stop and (self.src.text(i) in ("@", "[") or self.src.text(i) in MODIFIERS[self.language] or self.src.text(i) in ("this", "in", "out", "params", "...")):
                if self.src.text(i) == "@":
                    _, i = self.dotted(i + 1)
                    i = self.skip(i) if self.src.text(i) == "(" else i
                else:
                    i = self.skip(i)
            if self.language == "typescript":
                while self.src.text(i) == ".":
                    i += 1
                if self.named(i):
                    k = i + 1 + (self.src.text(i + 1) == "?")
                    found.append((self.src.text(i), self.typed(k + 1)[0] if self.src.text(k) == ":" else None))
            elif self.named(i):
                given, k = self.typed(i)
                if k < part.stop and self.named(k):
                    found.append((self.src.text(k), given))
        return found

    def java_header(self, at: int) -> int:
        word, i = self.src.text(at), at + 1
        static = self.src.text(i) == "static"
        name, i = self.dotted(i + static)
        if word == "package":
            self.space = name
            self.facts.append(fact("namespace", name.rpartition(".")[2], name, self.module, self.line(at)))
        elif self.src.reads(i, ".", "*"):
            self.facts.append(fact("imports", f"{name}.*", self.module, None, self.line(at), f"{name}.*"))
            self.spaces += [] if static else [name]
            i += 2
        else:
            self.facts.append(fact("imports", name, self.module, None, self.line(at), name))
            self.imports.setdefault(name.rpartition(".")[2], [] if static else [name])
        return i

    def csharp_header(self, at: int, end: int, scope: Scope, pending: list) -> int:
        word, i = self.src.text(at), at + 1
        static = self.src.text(i) == "static"
        name, i = self.dotted(i + static)
        if word == "using":
            if self.src.text(i) == "=":
                target, i = self.dotted(i + 1)
                self.imports[name] = [target]
                name = target
            elif not static:
                self.spaces.append(name)
            if name:
                self.facts.append(fact("imports", name.rpartition(".")[2], self.module, None, self.line(at), name))
            return i
        outer = self.space
        self.space = f"{outer}.{name}" if outer else name
        self.facts.append(fact("namespace", name.rpartition(".")[2], self.space, outer or self.module, self.line(at)))
        if self.src.text(i) == "{":
            self.declarations(i + 1, self.src.close.get(i, end), Scope(self.space, "module", None))
            self.space = outer
            return self.skip(i)
        return i + 1

    def member(self, at: int, end: int, scope: Scope, pending: list) -> int:
        """A method, constructor, field or property of a Java or C# type, or a statement beside them."""
        if scope.kind == "module" or self.src.text(at) in (";", ",", "}"):
            return self.skip(at)
        if self.src.text(at) == "{":
            return self.skip(at)  # an initialiser: no method encloses its calls
        i = self.angle(at)  # type parameters of a Java method
        given, k = self.typed(i)
        if self.src.text(k) == "(" and given == scope.qualified.rpartition(".")[2]:
            return self.callable(i, k, scope, pending, None, given, constructor=True)
        if not self.named(k):
            return max(self.skip(at), k) if given is None else self.statement(k, end)
        if self.src.text(k) == "operator" or self.src.reads(k, "this", "["):
            return self.statement(k, end)
        name, k = self.dotted(k)  # explicit implementations of interfaces have dots
        name = name.rpartition(".")[2]
        after = self.angle(k)
        if self.src.text(after) == "(":
            return self.callable(k - 1, after, scope, pending, given, name)
        what = "property" if self.language == "csharp" and (self.src.text(after) == "{" or self.src.reads(after, "=", ">")) else "field"
        while True:
            scope.fields[name] = self.candidates(given, scope)
            if what == "property" or self.language == "csharp" or self.language == "java":
                self.facts.append(fact(what, name, f"{scope.qualified}.{name}", scope.qualified, self.line(k - 1), type=scope.fields[name]))
            if what == "property":
                after = self.skip(after) if self.src.text(after) == "{" else self.statement(after, end)
                return self.statement(after, end) if self.src.text(after) == "=" else after
            while after < end and self.src.text(after) not in (",", ";"):
                after = self.skip(after)
            if self.src.text(after) != "," or not self.named(after + 1):
                return after + 1
            name, k = self.src.text(after + 1), after + 2
            after = k

    def statement(self, at: int, end: int) -> int:
        """The place after the next semicolon, or after a body that comes first."""
        while at < end and self.src.text(at) not in (";", "{"):
            at = self.skip(at)
        return self.skip(at)

    def callable(self, at: int, bracket: int, scope: Scope, pending: list, given: str | None, name: str, constructor: bool = False) -> int:
        """A method or constructor whose parameters stand in the bracket."""
        parameters = self.simple(bracket)
        shown = "(" + ",".join(re.sub(r".*\.", "", t or "") for _, t in parameters) + ")"
        qualified = f"{scope.qualified}.{name}" + (shown if self.language == "java" else "")
        if not (constructor and self.language == "java"):
            self.facts.append(fact("method", name, qualified, scope.qualified, self.line(at), type=self.candidates(given, scope), params=len(parameters), signature=shown))
        if constructor and self.language == "csharp":
            for part, kind in parameters:
                if starts := self.candidates(kind, scope):
                    self.facts.append(fact("inject", part, scope.qualified, None, self.line(bracket), starts=starts))
        i = self.src.close.get(bracket, bracket) + 1
        while i < len(self.src) and self.src.text(i) not in ("{", ";", "}") and not self.src.reads(i, "=", ">"):
            i = self.skip(i)
        start = i + 1 if self.src.text(i) == "{" else i + 2
        stop = self.src.close.get(i, i) if self.src.text(i) == "{" else self.statement(i, len(self.src)) if self.src.text(i) == "=" else i
        if not (constructor and self.language == "java") and stop > start:
            pending.append((start, stop, scope, qualified, [(n, self.candidates(t, scope)) for n, t in parameters]))
        return max(stop, i) + (self.src.text(i) != "=")

    # -- TypeScript -----------------------------------------------------------------------------------------------

    def module_path(self, given: str) -> list[str]:
        """Modules that an import's path can mean; none for packages."""
        if not given.startswith("."):
            return []
        parts = list(PurePosixPath(self.path).parent.parts)
        for step in given.split("/"):
            if step == "..":
                parts = parts[:-1]
            elif step not in (".", ""):
                parts.append(step)
        whole = ".".join(parts)
        plain = re.sub(r"\.(tsx?|jsx?|mjs|cjs)$", "", whole)
        return list(dict.fromkeys([plain, f"{plain}.index"]))

    def module_facts(self, scope: Scope) -> None:
        """Imports with the names that they bring in, and what the module exports under other names."""
        for i in range(len(self.src)):
            word = self.src.text(i)
            if word not in ("import", "export") or self.src.text(i - 1) == ".":
                continue
            end = next((k for k in range(i + 1, min(i + 400, len(self.src))) if self.src.string(k) is not None or self.src.text(k) in (";", "=", "(", "class", "function", "const")), None)
            given = self.src.string(end) if end is not None else None
            at = i + 1 + (self.src.text(i + 1) == "type" and self.src.text(i + 2) != "from")
            if given is not None and (word == "import" or self.src.text(end - 1) == "from"):
                modules = self.module_path(given)
                self.facts.append(fact("imports" if word == "import" else "exports", given, self.module, None, self.line(i), given, modules=SEPARATOR.join(modules) or None))
                if self.named(at) and self.src.text(at) != "from" and word == "import":
                    self.imports[self.src.text(at)] = [f"{m}.default" for m in modules]
                    at += 1 + (self.src.text(at + 1) == ",")
                if self.src.text(at) == "*":
                    if word == "import":
                        self.imports[self.src.text(at + 2)] = [f"{m}" for m in modules]
                    elif self.src.text(at + 1) != "as":
                        for m in modules:
                            self.facts.append(fact("alias", "*", self.module, None, self.line(i), m))
            else:
                modules = None
            if self.src.text(at) == "{" and (modules is not None or word == "export"):
                for part in self.src.parts(at):
                    names = [self.src.text(k) for k in part if self.named(k) and self.src.text(k) not in ("type", "as")]
                    if names and word == "import":
                        self.imports[names[-1]] = [f"{m}.{names[0]}" for m in modules or []]
                    elif names:
                        for target in [f"{m}.{names[0]}" for m in modules] if modules is not None else [f"{self.module}.{names[0]}"] if names[-1] != names[0] else []:
                            self.facts.append(fact("alias", names[-1], f"{self.module}.{names[-1]}", None, self.line(i), target))
            if word == "export" and self.src.text(i + 1) == "default":
                k = i + 2 + (self.src.text(i + 2) in ("async", "abstract"))
                k += self.src.text(k) in ("class", "function")
                if self.named(k):
                    self.facts.append(fact("alias", "default", f"{self.module}.default", None, self.line(i), f"{self.module}.{self.src.text(k)}"))

    def value_type(self, at: int, scope: Scope) -> str | None:
        """Type candidates of an initial value that is a new object."""
        if self.src.text(at) == "await":
            at += 1
        return self.candidates(self.typed(at + 1)[0], scope) if self.src.text(at) == "new" else None

    def typescript_member(self, at: int, end: int, scope: Scope, pending: list) -> int:
        text = self.src.text(at)
        if scope.kind == "interface":
            if self.named(at) and self.src.text(at + 1 + (self.src.text(at + 1) == "?")) in (":", "("):
                k = at + 1 + (self.src.text(at + 1) == "?")
                if self.src.text(k) == ":":
                    scope.fields[text] = self.candidates(self.typed(k + 1)[0], scope)
            return self.skip(at)
        if scope.kind == "module":
            if text in ("import", "export"):
                return at + 1
            if text == "function":
                k = at + 1 + (self.src.text(at + 1) == "*")
                return self.function("function", k, self.angle(k + 1), scope, pending) if self.named(k) else self.skip(at)
            if text in DECLARE and self.named(at + 1):
                return at + 1 if self.src.text(at + 1) == "enum" else self.variable("variable", at + 1, end, scope, pending)
            return self.skip(at)
        if text in ("get", "set") and (self.named(at + 1) or self.src.string(at + 1) is not None):
            return at + 1
        if not self.named(at):
            return self.skip(at)
        k = at + 1 + (self.src.text(at + 1) in ("?", "!"))
        k = self.angle(k)
        if self.src.text(k) == "(":
            if text == "constructor":
                for part in self.src.parts(k):
                    if any(self.src.text(x) in ("public", "private", "protected", "readonly") for x in part):
                        for name, given in self.parameters(k, scope):
                            if any(self.src.text(x) == name for x in part):
                                scope.fields[name] = given
                                self.facts.append(fact("parameter_property", name, f"{scope.qualified}.{name}", scope.qualified, self.line(k), type=given))
                i = self.src.close.get(k, k) + 1
                return self.skip(i) if self.src.text(i) == "{" else i
            return self.function("method", at, k, scope, pending)
        return self.variable("property", at, end, scope, pending)

    def function(self, kind: str, at: int, bracket: int, scope: Scope, pending: list) -> int:
        name = self.src.text(at)
        qualified = f"{scope.qualified}.{name}"
        i, given = self.src.close.get(bracket, bracket) + 1, None
        if self.src.text(i) == ":":
            given, i = self.typed(i + 1)
            if self.src.text(i) not in ("{", ";"):
                while i < len(self.src) and self.src.text(i) not in ("{", ";", "}"):
                    i = self.skip(i)
        parameters = self.simple(bracket)
        self.facts.append(fact(kind, name, qualified, scope.qualified, self.line(at), type=self.candidates(given, scope), params=len(parameters)))
        if self.src.text(i) == "{":
            pending.append((i + 1, self.src.close.get(i, len(self.src)), scope, qualified, [(n, self.candidates(t, scope)) for n, t in parameters]))
            return self.skip(i)
        return i

    def variable(self, kind: str, at: int, end: int, scope: Scope, pending: list) -> int:
        """A top-level variable or a property, with the function that it may hold."""
        name, k, given = self.src.text(at), at + 1 + (self.src.text(at + 1) in ("?", "!")), None
        qualified = f"{scope.qualified}.{name}"
        if self.src.text(k) == ":":
            given, k = self.typed(k + 1)
            while k < end and self.src.text(k) not in ("=", ";", "}", ",") and self.line(k) == self.line(k - 1):
                k = self.skip(k)
        kind_of = self.candidates(given, scope)
        value = k + 1 if self.src.text(k) == "=" and self.src.text(k + 1) != ">" else None
        if value is not None:
            kind_of = kind_of or self.value_type(value, scope)
            if kind_of is None and self.src.text(value + (self.src.text(value) == "async")) == "(":
                closed = self.src.close.get(value + (self.src.text(value) == "async"), value)
                if self.src.text(closed + 1) == ":":  # what a call of the arrow function gives
                    kind_of = self.candidates(self.typed(closed + 2)[0], scope)
        scope.fields[name] = kind_of
        self.facts.append(fact(kind, name, qualified, scope.qualified, self.line(at), type=kind_of))
        if value is None:
            return k if k > at else at + 1
        stop = value
        while stop < end and self.src.text(stop) != ";":
            ahead = self.skip(stop)
            if ahead < end and self.line(ahead) > self.line(ahead - 1) and (self.named(ahead) or self.src.text(ahead) in ("@", "#")) and self.src.text(ahead - 1) not in ("=", ">", ",", "+", "?", ":", "&", "|", "(") and self.src.text(ahead) not in ("in", "of", "instanceof", "as"):
                stop = ahead
                break
            if self.src.text(ahead) == "," and kind == "variable":
                stop = ahead
                break
            stop = ahead
        parameters: list = []
        first = value + (self.src.text(value) == "async")
        first += 2 if self.src.text(first) == "function" and self.named(first + 1) else self.src.text(first) == "function"
        if self.src.text(self.angle(first)) == "(" and any(self.src.reads(x, "=", ">") or self.src.text(x) == "{" for x in range(self.src.close.get(self.angle(first), first), min(stop, len(self.src)))):
            parameters = self.parameters(self.angle(first), scope)
        pending.append((value, min(stop, end), scope, qualified, parameters))
        if self.src.text(stop) == "," and kind == "variable" and self.named(stop + 1):
            return self.variable(kind, stop + 1, end, scope, pending)
        return stop + (self.src.text(stop) == ";")

    # -- bodies ---------------------------------------------------------------------------------------------------

    def body(self, start: int, stop: int, scope: Scope, caller: str, parameters: list) -> None:
        """Local variables and call sites between two places."""
        local: list[tuple[int, int, str, tuple | None]] = [(start, stop, name, (given, ()) if given else None) for name, given in parameters]
        blocks = [stop]
        for i in range(start, stop):
            while len(blocks) > 1 and i >= blocks[-1]:
                blocks.pop()
            text = self.src.text(i)
            if text in ("{", "("):
                blocks.append(min(self.src.close.get(i, stop), stop))
            for name, leads in self.locals(i, start, scope, local):
                ends = blocks[-1] if text != "(" else stop
                local.append((i, ends, name, leads))
            self.call(i, start, scope, caller, local)

    def locals(self, i: int, start: int, scope: Scope, local: list) -> Iterator[tuple[str, tuple | None]]:
        """Variables declared at a place: name and what leads to its type, if anything does."""
        text, before = self.src.text(i), self.src.text(i - 1)
        if self.src.reads(i, "=", ">"):  # a lambda's parameters hide others
            if self.named(i - 1):
                yield self.src.text(i - 1), None
            elif before == ")" and i - 1 in self.opened:
                for name, given in self.parameters(self.opened[i - 1], scope):
                    yield name, (given, ()) if given else None
        elif self.src.reads(i, "-", ">") and self.named(i - 1):
            yield self.src.text(i - 1), None
        elif self.language == "typescript":
            if text in DECLARE and self.named(i + 1):
                name, k = self.src.text(i + 1), i + 2
                if self.src.text(k) == ":":
                    given = self.candidates(self.typed(k + 1)[0], scope)
                    yield name, (given, ()) if given else None
                elif self.src.text(k) == "=":
                    yield name, self.leads(k + 1, start, scope, local)
                else:
                    yield name, None
            elif text == "function" and self.named(i + 1):
                yield self.src.text(i + 1), None
        elif self.named(i) and (before in (";", "{", "}", "(", "") or i == start or before in ("final", "using", "await", "out", "is", "case", ">", ")")) and text not in NO_CALLS:
            given, k = self.typed(i)
            if k > i and self.named(k) and self.src.text(k) not in ("in", "is", "as", "instanceof", "switch") and self.src.text(k + 1) in ("=", ";", ":", "in", ")", ",") and not self.src.reads(k + 1, "=", "="):
                if given == "var":
                    yield self.src.text(k), self.leads(k + 2, start, scope, local) if self.src.text(k + 1) == "=" else None
                else:
                    found = self.candidates(given, scope)
                    yield self.src.text(k), (found, ()) if found else None

    def leads(self, at: int, start: int, scope: Scope, local: list) -> tuple | None:
        """What leads to the value of the expression at a place: a new object, or a chain of members up to the statement's end."""
        at += self.src.text(at) == "await"
        if self.src.text(at) == "new":
            name, k = self.typed(at + 1)
            if self.src.text(k) == "(":
                k = self.src.close.get(k, k) + 1
            if self.src.text(k) != ".":
                found = self.candidates(name, scope)
                return (found, ()) if found else None
        end = at
        while end < len(self.src) and (self.named(end) or self.src.text(end) in (".", "(", "?", "!", "<")):
            nxt = self.angle(end) if self.src.text(end) == "<" else self.skip(end)
            if nxt == end or (self.named(end) and self.named(nxt)):
                break
            end = nxt
        return self.chain(end - 1, start, scope, local) if self.src.text(end) in (";", ")", ",", "}", "") or self.line(end) > self.line(end - 1) else None

    def chain(self, last: int, start: int, scope: Scope, local: list) -> tuple | None:
        """(starts, steps) of the expression that ends at a place: names of members, with () for calls."""
        steps: list[str] = []
        i = last
        while True:
            called = ""
            if self.src.text(i) == "!":
                i -= 1
            if self.src.text(i) == ")":
                bracket = self.opened.get(i)
                if bracket is None:
                    return None
                i, called = bracket - 1, f"({len(self.src.parts(bracket))})"
                if self.src.text(i) == ">":
                    depth = 0
                    while i > start:
                        depth += (self.src.text(i) == ">") - (self.src.text(i) == "<")
                        i -= 1
                        if not depth:
                            break
            if not self.named(i) or self.src.text(i) in NO_CALLS - {"this", "super", "base"}:
                return None
            name, before = self.src.text(i), self.src.text(i - 1)
            first = i
            if before == ">" and self.language == "java" and self.src.text(i - 2) != "-":  # x.<T>m()
                while i > start and self.src.text(i - 1) != ".":
                    i -= 1
                before = self.src.text(i - 1)
            if called and before == "new" or (called and self.made(i, start)):
                found = self.candidates(self.made(i, start) or name, scope)
                return (found, tuple(reversed(steps))) if found else None
            if before == ".":
                steps.append(name + called)
                i -= 2
                if self.src.text(i) == "?":
                    i -= 1
                continue
            break
        return self.begin(name, called, first, scope, local, tuple(reversed(steps)))

    def made(self, i: int, start: int) -> str | None:
        """The dotted name that ends at i if ``new`` stands before it."""
        parts = [self.src.text(i)]
        while self.src.text(i - 1) == "." and self.named(i - 2):
            i -= 2
            parts.insert(0, self.src.text(i))
        return ".".join(parts) if self.src.text(i - 1) == "new" else None

    def begin(self, name: str, called: str, at: int, scope: Scope, local: list, steps: tuple) -> tuple | None:
        """What a chain's first name stands for."""
        if name in ("super", "base"):
            return ("super", steps) if self.language == "csharp" and steps else None
        own = scope.types()
        if name == "this":
            return ("self", steps) if own and not called else None
        for declared, ends, known, leads in reversed(local):
            if known == name and declared <= at < ends:
                return None if leads is None or called else (leads[0], (*leads[1], *steps))
        if self.language == "typescript":
            return SEPARATOR.join(self.imports.get(name, [f"{self.module}.{name}"])) or None, ((f"{called}",) if called else ()) + steps
        if called or self.holds(scope, name):
            return ("self", (name + called, *steps)) if own else None
        found = self.candidates(name, scope) if name[:1].isupper() else None
        return (found, steps) if found else ("self", (name, *steps)) if own else None

    def holds(self, scope: Scope | None, name: str) -> bool:
        while scope is not None:
            if name in scope.fields:
                return True
            scope = scope.outer
        return False

    def call(self, i: int, start: int, scope: Scope, caller: str, local: list) -> None:
        if not self.named(i) or self.src.text(i) in NO_CALLS:
            return
        bracket = self.angle(i + 1)
        if self.src.text(bracket) != "(" or self.src.text(i - 1) in ("new", "function") or self.made(i, start):
            return
        if self.src.text(i - 1) != "." and self.named(i - 1) and self.src.text(i - 1) not in NO_CALLS and self.language != "typescript":
            return  # a local function's declaration
        found = self.chain(self.src.close.get(bracket, bracket), start, scope, local)
        if found and found[0] and found[1]:
            starts, steps = found
            self.facts.append(fact("call", self.src.text(i), caller, None, self.line(i), starts=starts, steps=SEPARATOR.join(steps), types=SEPARATOR.join(scope.types()) or None))


def _read(path: str, text: str, language: str) -> Iterable[Fact]:
    return Reader(path, text, language).file()


@extractor("typescript", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
def typescript(path: str, text: str) -> Iterable[Fact]:
    """module, class, interface, enum, namespace, function, method, property, variable; imports, exports, bases; call sites."""
    return _read(path, text, "typescript")


@extractor("java", ".java")
def java(path: str, text: str) -> Iterable[Fact]:
    """module, namespace, class, interface, enum (nested too), method (named with its parameter types), field; imports, bases; call sites."""
    return _read(path, text, "java")


@extractor("csharp", ".cs")
def csharp(path: str, text: str) -> Iterable[Fact]:
    """module, namespace, class (records too), interface, enum, method and constructor, property, field; usings, bases; call sites and injections."""
    return _read(path, text, "csharp")
