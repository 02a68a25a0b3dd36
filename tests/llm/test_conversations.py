"""Conversation repair against a plain search, with segments of few rows so that conversations reach over them."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import types as T

from graphloom.llm import conversation_repair
from graphloom.llm.conversation_repair import damage, repair, repaired_rows

ROW = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("role", "text", "conv", "part", "seg", "copies", "first", "said")]])


@pytest.fixture
def talks_of(spark):
    return lambda rows: spark.createDataFrame([(*r, *["z"] * 6) for r in rows], ROW)


def plain_edits(rows):
    """rows: (role, text, fault) -> (cost, audit, lines): all edit sequences, shortest first by cost and then by letters."""

    @cache
    def best(i, given):
        """given: the last initial so far, '' at the start."""
        found = [(0, "", ())] if i == len(rows) and given in ("", "a") else []
        for role in ("user", "assistant"):
            if role[0] == {"": "u", "s": "u", "u": "a", "a": "u"}[given]:
                found.append(step(2, "I", f"{role}:", added(i, role[0], 0)))
        if i < len(rows):
            role, text, fault = rows[i]
            found.append(step(3, "D", None, best(i + 1, given)))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                after = {"": "su", "s": "u", "u": "a", "a": "u"}[given]
                if role[:1] and role[0] in after:
                    found.append(step(cut, "K", f"{role}:{text}", best(i + 1, role[0])))
                for other in ("user", "assistant"):
                    if other[0] in after:
                        found.append(step(2 + cut, "R", f"{other}:{text}", best(i + 1, other[0])))
        found = [f for f in found if f is not None]
        return min(found) if found else None

    @cache
    def added(i, given, n):
        """After an added row: no cheapest path has more than two of them in a row but the last."""
        found = [(0, "", ())] if i == len(rows) and given == "a" else []
        if n < 2:
            role = "assistant" if given == "u" else "user"
            found.append(step(2, "I", f"{role}:", added(i, role[0], n + 1)))
        if i < len(rows):
            role, text, fault = rows[i]
            found.append(step(3, "D", None, best(i + 1, given)))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                after = {"u": "a", "a": "u"}[given]
                if role[:1] == after:
                    found.append(step(cut, "K", f"{role}:{text}", best(i + 1, after)))
                other = "user" if after == "u" else "assistant"
                found.append(step(2 + cut, "R", f"{other}:{text}", best(i + 1, after)))
        found = [f for f in found if f is not None]
        return min(found) if found else None

    def step(cost, letter, line, rest):
        return rest and (rest[0] + cost, letter + rest[1], ((line,) if line is not None else ()) + rest[2])

    return best(0, "")


def plain_repair(rows):
    """rows of one conversation (turn, role, text) -> the digest."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, marked = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, lines = plain_edits(tuple(marked))
    turns = {t for has, t, *_ in rows if has}
    count = lambda f: sum(m[2] == f for m in marked)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def talks(seed, n, most=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "open", " ", "", None, "Why?  ", "cut off\n", "été ."]
    out = []
    for c in range(n):
        turn = 0
        for _ in range(r.randrange(1, most)):
            out.append((c if c else None, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), r.choice(texts) if r.random() < 0.6 else f"t{r.randrange(99)}."))
            turn += r.choice([0, 1, 1, 1, 2])
    return out


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair(spark, talks_of, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment)
    r = random.Random(5)
    rows = talks(7, 120)
    rows += [(500, i, r.choice(["user", "assistant", "system", "bot"]), r.choice(["Same.", "no end", f"{i}!", f"{i}"])) for i in range(150)]  # over many segments and partitions
    rows += [(501, 3, "user", "Hello.")] * 20 + [(501, None, "assistant", "Hello.")] * 3 + [(502, 1, "user", "long " * 5000 + ".")] * 2
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    want = {c: plain_repair(v) for c, v in by.items()}
    df = talks_of(rows).repartition(3)
    got = {x[0]: tuple(x[1:]) for x in repair(df).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    lines = {}
    for x in sorted(repaired_rows(df).collect(), key=lambda x: (x["part"], x["seg"], x["place"])):
        lines.setdefault(x["conv"], []).append(f"{x['role']}:{x['text']}")
    assert lines == {c: list(w[1]) for c, w in want.items() if w[1]}


def test_empty(talks_of):
    assert repair(talks_of([])).count() == 0 and repaired_rows(talks_of([])).count() == 0


def test_short_conversations_by_all_edits():
    """The automaton against every edit sequence of up to three rows over all kinds of rows."""
    machine = conversation_repair.Automaton()
    kinds = [("system", ""), ("user", ""), ("assistant", ""), ("tool", ""), ("user", "truncated"), ("system", "truncated"), ("user", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            syms = [conversation_repair.DELETE if f == "blank" else conversation_repair.symbol(role, f == "truncated") for role, f in rows]
            states, costs = machine.scan(syms, [1] * n, conversation_repair.END)
            letters, at = machine.trace(syms, [1] * n, states, 0)
            want = plain_edits(tuple((role, "x", f) for role, f in rows))
            assert (costs[0], "".join(letters) + conversation_repair.tail(at)) == want[:2]
    assert len(machine.vectors) < 40  # few states, however many rows


def test_damage(talks_of):
    rows = [(c, t, ["user", "assistant", None][t % 3] if t else "system", "One. Two! Three? four" if c % 2 else None) for c in range(40) for t in range(6)] + [(None, None, "assistant", "x")]
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            want += [(c, t, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (2 if how == 3 else 1)
    assert sorted(map(repr, (tuple(r) for r in damage(talks_of(rows)).collect()))) == sorted(map(repr, want))
