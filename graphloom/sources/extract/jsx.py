"""JSX in TypeScript and JavaScript: the elements of a file as a tree, with the code around them.

A scanner walks code and elements in turns: code holds elements where an expression may stand, elements hold code in
braces, in attributes and between their children.  Text between tags is blanked out of the code, so that its quotes and
brackets can't mislead the tokenizer that reads the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: What stands before an expression: only there ``<`` can open an element.
BEFORE = set("(,=?:&|{[;>!}")
WORDS = {"return", "default", "case", "yield", "await", "else", "do", "in", "of"}
NAME = re.compile(r"[A-Za-z_$][\w$]*")
TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:-]*")
SPACE = re.compile(r"\s*")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: Code in which nothing stays open: no marks, whole strings, and brackets around such; the rest of a string in quotes; text between tags.
BARE = r"""[^"'`/<()\[\]{}]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
PLAIN = re.compile(rf"(?:{BARE}|\((?:{BARE})*+\)|\[(?:{BARE})*+\]|\{{(?:{BARE})*+\}})++", re.S)
#: Attributes whose value is a string, or braces around plain code.
SIMPLE = re.compile(rf"""([A-Za-z_$][\w$:-]*+)\s*=\s*("[^"]*"|'[^']*'|\{{(?:{BARE}|\((?:{BARE})*+\))*+\}})\s*""", re.S)
QUOTED = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*\\?", re.S) for q in "\"'"}
STRING = re.compile(r"""\{?\s*(["'`])((?:(?!\1).)*)\1\s*\}?""", re.S)
SHOWN = re.compile(r".[^<{]*", re.S)
CLOSED_BY = {"(": ")", "[": "]", "{": "}"}
#: ``<`` that may open an element: before a name, and behind anything but a name that is no word before an expression.
OPENS = re.compile(rf"<(?=[A-Za-z_$>])(?:(?<![\w$]<)|{'|'.join(f'(?<={w}<)' for w in sorted(WORDS))})")


def last_word(run: str) -> str:
    """The last name or mark of code without brackets and strings; empty if there is none."""
    run = run.rstrip()
    k = len(run)
    while k and (run[k - 1].isalnum() or run[k - 1] in "_$"):
        k -= 1
    m = NAME.search(run, k)
    return m[0] if m else run[-1:]


@dataclass
class Element:
    """A tag with its attributes' values (None for those without; expressions with their braces) and where it stands."""

    name: str
    at: int
    parent: int | None
    attrs: dict[str, str | None] = field(default_factory=dict)
    open_end: int = 0
    inner: str = ""

    def string(self, name: str) -> str | None:
        """A plain string value, also one in braces."""
        value = self.attrs.get(name)
        m = STRING.fullmatch(value) if value else None
        return m[2] if m else None

    def code(self, name: str) -> str | None:
        value = self.attrs.get(name)
        return value[1:-1] if value and value.startswith("{") else None


class Jsx:
    """``elements`` in the order of their tags (parents first) and ``code``: the text with what stands between tags blanked."""

    def __init__(self, text: str):
        self.text, self.elements = text, []
        self.blank: list[tuple[int, int]] = []
        if OPENS.search(text):
            self.scan(0, None, None)
        parts, done = [], 0
        for a, b in sorted(self.blank):
            if a >= done:
                parts += [text[done:a], "\n".join(" " * len(x) for x in text[a:b].split("\n"))]
                done = b
        self.code = "".join([*parts, text[done:]])

    def children(self, parent: int | None) -> list[int]:
        return [i for i, e in enumerate(self.elements) if e.parent == parent]

    def scan(self, i: int, closing: str | None, parent: int | None) -> int:
        """Walks code from a place to behind the closing bracket (or the end)."""
        text, size, before = self.text, len(self.text), ""
        while i < size:
            c = text[i]
            if c == closing:
                return i + 1
            if (m := PLAIN.match(text, i)) is not None:
                i = m.end()
                if i < size and text[i] in "</":  # all else that can follow is asked for nothing before it
                    before = last_word(m[0]) or before
            elif c in "([{":
                i, before = self.scan(i + 1, CLOSED_BY[c], parent), ")" if c != "{" else "}"
            elif c in "\"'":
                i, before = self.quoted(i), '"'
            elif c == "`":
                i, before = self.template(i, parent), '"'
            elif c == "/":
                if text.startswith("//", i):
                    i = size if (end := text.find("\n", i)) < 0 else end
                elif text.startswith("/*", i):
                    i = size if (end := text.find("*/", i)) < 0 else end + 2
                elif (before == "" or before in BEFORE or before in WORDS) and (m := REGEX.match(text, i)):
                    i, before = m.end(), '"'
                else:
                    i, before = i + 1, c
            elif c == "<":
                if (before == "" or before in BEFORE or before in WORDS) and (end := self.element(i, parent)) is not None:
                    i, before = end, ")"
                else:
                    i, before = i + 1, c
            else:  # a bracket that closes nothing
                i, before = i + 1, c
        return i

    def quoted(self, i: int) -> int:
        return QUOTED[self.text[i]].match(self.text, i + 1).end() + 1

    def template(self, i: int, parent: int | None) -> int:
        k = i + 1
        while k < len(self.text) and self.text[k] != "`":
            if self.text.startswith("${", k):
                k = self.scan(k + 2, "}", parent)
            else:
                k += 2 if self.text[k] == "\\" else 1
        return k + 1

    def skip(self, i: int) -> int:
        return SPACE.match(self.text, i).end()

    def element(self, i: int, parent: int | None) -> int | None:
        """The place after the element at i; None if none stands there."""
        text = self.text
        m = TAG.match(text, i + 1)
        if not m and not text.startswith("<>", i):
            return None
        marks = len(self.elements), len(self.blank)
        own = Element(m[0] if m else "", i, parent)
        number = len(self.elements)
        self.elements.append(own)
        k = self.skip(m.end() if m else i + 1)
        while not text.startswith((">", "/>"), k):
            if a := SIMPLE.match(text, k):
                own.attrs[a[1]] = a[2]
                k = a.end()
                continue
            if text.startswith("{", k):
                k = self.scan(k + 1, "}", number)
            elif a := ATTRIBUTE.match(text, k):
                k = self.skip(a.end())
                value = None
                if text.startswith("=", k):
                    start = k = self.skip(k + 1)
                    if text[k : k + 1] in ("'", '"') and text[k : k + 1]:
                        end = text.find(text[k], k + 1)
                        k = len(text) if end < 0 else end + 1
                    elif text.startswith("{", k):
                        k = self.scan(k + 1, "}", number)
                    else:
                        inner = self.element(k, number) if text.startswith("<", k) else None
                        if inner is None:
                            break
                        k = inner
                    value = text[start:k]
                own.attrs[a[0]] = value
            else:
                break
            k = self.skip(k)
        if text.startswith("/>", k):
            own.open_end = k + 2
            return k + 2
        if not text.startswith(">", k):
            del self.elements[marks[0] :], self.blank[marks[1] :]
            return None
        own.open_end = k = k + 1
        while k < len(text):
            if text.startswith("</", k):
                own.inner = text[own.open_end : k]
                end = text.find(">", k)
                return len(text) if end < 0 else end + 1
            if text[k] == "{":
                k = self.scan(k + 1, "}", number)
            elif text[k] == "<" and (end := self.element(k, number)) is not None:
                k = end
            else:
                stop = SHOWN.match(text, k).end()
                self.blank.append((k, stop))
                k = stop
        del self.elements[marks[0] :], self.blank[marks[1] :]
        return None
