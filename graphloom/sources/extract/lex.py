"""Tokens of brace languages (Java, C#, TypeScript, JavaScript, Gradle): names, strings, numbers and marks, without comments."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

#: What is skipped before a token, and the token; at the end of a text an empty one.
TOKEN = re.compile(
    r"""((?:\s+|//[^\n]*|/\*.*?\*/)*+)
      ([A-Za-z_$][\w$]*
      |[^\w$"'`]
      |"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`
      |\d[\w.]*
      |.|\Z)""",
    re.X | re.S,
)
NAMES = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")
QUOTES = frozenset("\"'`")
BRACKETS = frozenset("()[]{}")
CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
#: Words before a bracket that make no declaration.
STATEMENTS = {"return", "new", "await", "throw", "else", "if", "for", "while", "switch", "catch", "using", "lock"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int


class _Code(dict):
    """Texts by place; nothing elsewhere."""

    def __missing__(self, i: int) -> str:
        return ""


class Source:
    """The tokens of a text and, for each opening bracket, the place of the one that closes it.

    ``text(i)`` is the text of the token at a place: nothing outside the file, and for strings, which are no code; ``string(i)`` is that of a
    string, else None.  Both are asked for millions of times, so they are lookups of dictionaries, and marks are found by lists.
    """

    def __init__(self, text: str):
        self.pairs: list[tuple[str, str]] = TOKEN.findall(text)
        while self.pairs and not self.pairs[-1][1]:
            self.pairs.pop()
        self.codes: list[str] = [t for _, t in self.pairs]
        strings = {i: t[1:-1] for i, t in enumerate(self.codes) if t[0] in QUOTES and len(t) > 1}
        for i in strings:
            self.codes[i] = ""
        self.close: dict[int, int] = {}
        opened: list[tuple[str, int]] = []
        for i, mark in [(i, t) for i, t in enumerate(self.codes) if t in BRACKETS]:
            if mark in CLOSED_BY:
                opened.append((CLOSED_BY[mark], i))
            elif opened and mark == opened[-1][0]:
                self.close[opened.pop()[1]] = i
        for _, at in opened:
            self.close[at] = len(self.codes)
        self.text = _Code(enumerate(self.codes)).__getitem__
        self.string = strings.get
        self.strings = list(strings)

    @cached_property
    def breaks(self) -> list[int]:
        """For each line end the place of the first token behind it."""
        out = [i for i, (skipped, _) in enumerate(self.pairs) if "\n" in skipped for _ in range(skipped.count("\n"))]
        inside = [i + 1 for i, c in enumerate(self.codes) if not c for _ in range(self.pairs[i][1].count("\n"))]
        return sorted(out + inside) if inside else out

    def line(self, i: int) -> int:
        return 1 + bisect_right(self.breaks, i)

    @cached_property
    def tokens(self) -> list[Token]:
        kinds = map(self.kind, range(len(self)))
        texts = [c or t[1:-1] for c, (_, t) in zip(self.codes, self.pairs, strict=True)]
        return list(map(Token._make, zip(kinds, texts, map(self.line, range(len(self))), strict=True)))

    def kind(self, i: int) -> str:
        c = self.codes[i][:1]
        return "name" if c in NAMES else "string" if not c else "number" if c.isdecimal() else "mark"

    def __len__(self) -> int:
        return len(self.codes)

    def reads(self, i: int, *words: str) -> bool:
        return i >= 0 and self.codes[i : i + len(words)] == [*words]

    def places(self, word: str, start: int = 0) -> Iterator[int]:
        """Places of a word from one on."""
        at = max(start, 0) - 1
        try:
            while True:
                at = self.codes.index(word, at + 1)
                yield at
        except ValueError:
            return

    def named(self, *words: str) -> Iterator[int]:
        """Places where the words stand in a row."""
        return (i for i in self.places(words[0]) if len(words) == 1 or self.reads(i, *words))

    def parts(self, i: int) -> list[range]:
        """The parts between commas of the bracket at i, without those of brackets in it."""
        out, start, at, end = [], i + 1, i + 1, self.close.get(i, i + 1)
        while at < end:
            if self.text(at) == ",":
                out.append(range(start, at))
                start = at + 1
            at = self.close.get(at, at) + 1
        return [*out, range(start, end)] if end > start else out

    def members(self, i: int) -> dict[str, int]:
        """In the braces at i, the place of each key's value; of a repeated key the first."""
        out: dict[str, int] = {}
        for part in self.parts(i):
            if len(part) > 2 and self.text(part[1]) in (":", "="):
                key = self.string(part[0])
                out.setdefault(self.text(part[0]) if key is None else key, part[2])
        return out

    def member(self, i: int, key: str) -> int | None:
        """In the braces at i, the place of the value of ``key``."""
        for part in self.parts(i):
            if len(part) > 2 and key in (self.text(part[0]), self.string(part[0])) and self.text(part[1]) in (":", "="):
                return part[2]
        return None

    def member_string(self, i: int, key: str) -> str | None:
        """The string given for ``key`` in the bracket at i."""
        at = self.member(i, key)
        return self.string(at) if at is not None else None

    def owner(self, i: int) -> str | None:
        """The class in whose body a place is; if in none, the first of the file."""
        found = [(c, o) for c, o in self._classes() if o < i < self.close.get(o, 0)] or list(self._classes())[:1]
        return self.text(found[-1][0]) if found else None

    def _classes(self) -> Iterator[tuple[int, int]]:
        for i in self.named("class"):
            body = next(self.places("{", i + 1), None)
            if body is not None and self.tokens[i + 1].kind == "name":
                yield i + 1, body

    def type_ends(self, i: int) -> int:
        """The place after the type (dotted, with type arguments and brackets) that begins at i."""
        while self.text(i + 1) == ".":
            i += 2
        i += 1
        if self.text(i) == "<":
            depth = 0
            while i < len(self):
                depth += (self.text(i) == "<") - (self.text(i) == ">")
                i += 1
                if not depth:
                    break
        while self.reads(i, "[", "]"):
            i += 2
        return i

    def methods(self, start: int = 0) -> Iterator[tuple[str, str | None, int]]:
        """(name, simple type of the first parameter, place) of declarations from a place on."""
        for i in (k - 1 for k in self.places("(", max(start, 1) + 1)):
            before = self.tokens[i - 1]
            if self.tokens[i].kind == "name" and (before.kind == "name" or before.text in (">", "]")) and before.text not in STATEMENTS:
                at = i + 2
                while self.text(at) in ("final", "this", "in", "ref", "@"):
                    at += 2 if self.text(at) == "@" else 1
                end = self.type_ends(at) if at < len(self) and self.tokens[at].kind == "name" else at
                typed = end > at and end < len(self) and self.tokens[end].kind == "name"
                simple = next((self.text(k) for k in range(self.last_of(at), at - 1, -1) if self.text(k) not in (".", "")), None) if typed else None
                yield self.text(i), simple, i

    def last_of(self, i: int) -> int:
        """The place of the last name of the dotted name at i."""
        while self.text(i + 1) == ".":
            i += 2
        return i

    def calls(self) -> Iterator[tuple[str, str, int]]:
        """(variable, method, place of the bracket) of calls on a variable or field."""
        for i in self.places(".", 1):
            if self.text(i + 2) == "(" and self.tokens[i - 1].kind == self.tokens[i + 1].kind == "name":
                yield self.text(i - 1), self.text(i + 1), i + 2

    def given(self, i: int, *keys: str) -> str | None:
        """First string of an argument list: that of one of the keys, else one without a key."""
        plain = None
        for part in self.parts(i):
            key = self.text(part[0]) if len(part) > 1 and self.text(part[1]) in ("=", ":") else None
            found = next((s for k in part if (s := self.string(k)) is not None), None)
            if found is not None and key in keys:
                return found
            if found is not None and key is None and plain is None:
                plain = found
        return plain
