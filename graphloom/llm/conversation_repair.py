"""Conversation structure repair: the cheapest edits that turn a conversation's roles into (s?(ua)+)?.

Rows may be kept (0), given the role user or assistant (2) or deleted (3); empty user or assistant rows may be
inserted (2); a truncated row that stays costs 1; blank and repeated rows must go.  Places in the pattern are four
states (start, after s, after u, after a).  From the last row to the first, the cost to reach the end from each
state is a vector; minus its least entry it is one of few, and each is a state of a deterministic automaton,
made when it is first met and cached with its transitions: one table look-up a row gives the costs.  The trace
then runs back over that scan, first row to last, along tight arcs only (those that lie on a cheapest path), of several the one with
the least letter, which gives the least of all cheapest audits; its steps are cached in a table too.

Scale: rows are sorted over the cluster by conversation and turn and cut into bounded segments.  A conversation inside one
partition is repaired where it stands.  One that reaches over partitions or segments (a conversation may hold a third of all
rows) is repaired by segment: four scans give a segment's costs as a function of those at its end, small tables put these functions
together, and the segments are traced in parallel.  Only its hash, and the strings themselves, take one stream in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import table

#: Rows and characters of a segment at most, or one longer row.
SEGMENT_ROWS, SEGMENT_CHARS = 1 << 12, 1 << 20
NEVER = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
#: States: 0 start, 1 after s, 2 after u, 3 after a. What an added or renamed row leads to, and what keeping a row of an initial does.
NEXT = (2, 2, 3, 2)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
ROLE = {2: "user", 3: "assistant"}
DELETE = 0
LEGAL = {"su", "ua", "au"}


def symbol(role: str, truncated: bool) -> int:
    """A row that may stay, as a letter of the automaton: its role's initial (s, u, a or another) and whether it is truncated."""
    return 1 + 2 * ("sua".find(role[0]) if role[:1] in ("s", "u", "a") else 3) + truncated


def arcs(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, by letter."""
    found = [("D", 3, state)]
    if sym != DELETE:
        initial, truncated = divmod(sym - 1, 2)
        if (state, initial) in KEPT:
            found.append(("K", truncated, KEPT[state, initial]))
        found.append(("R", 2 + truncated, NEXT[state]))
    return found


class Automaton:
    """Cost vectors as states, with transitions and trace steps made when first needed."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, vector) -> tuple[int, int]:
        """The number of a vector's state, and its least entry."""
        least = min(vector)
        shape = tuple(v - least if v < NEVER else NEVER for v in vector)
        if shape not in self.number:
            self.number[shape] = len(self.vectors)
            self.vectors.append(shape)
        return self.number[shape], least

    @staticmethod
    def before(sym: int, after: tuple[int, ...]) -> list[int]:
        """Costs to the end before a row, from those after it: rows may be added before it, at 2 each."""
        bare = [min(cost + after[to] for _, cost, to in arcs(sym, s)) for s in range(4)]
        u, a = min(bare[2], 2 + bare[3]), min(bare[3], 2 + bare[2])
        return [min(v, NEVER) for v in (min(bare[0], 2 + u), min(bare[1], 2 + u), u, a)]

    def scan(self, syms, times, end) -> tuple[list[int], tuple[int, ...]]:
        """States after each row and at last before all, from the last row back, and the costs before all."""
        state, cost = self.state(end)
        states = [state]
        for i in range(len(syms) - 1, -1, -1):
            key = (state, syms[i])
            if key not in self.moves:
                self.moves[key] = self.state(self.before(syms[i], self.vectors[state]))
            state, more = self.moves[key]
            cost += more * times[i]  # only rows that must go are counted more than once: they change no state
            states.append(state)
        return states, tuple(v + cost if v < NEVER else NEVER for v in self.vectors[state])

    def step(self, after: int, sym: int, state: int) -> tuple[str, int]:
        """The least letters from a state before a row to one after it along tight arcs."""
        key = (after, sym, state)
        if key not in self.steps:
            costs, ahead = self.before(sym, self.vectors[after]), self.vectors[after]
            letters, at = "", state
            while True:
                tight = [(edit, to) for edit, cost, to in arcs(sym, at) if cost + ahead[to] == costs[at]]
                if 2 + costs[NEXT[at]] == costs[at]:
                    tight.append(("I", NEXT[at]))
                edit, to = min(tight)
                letters, at = letters + edit, to
                if edit != "I":
                    break
            self.steps[key] = (letters, at)
        return self.steps[key]

    def trace(self, syms, times, states: list[int], entry: int) -> tuple[list[str], int]:
        """Letters of each row (with those of rows added before it), and the state after the last."""
        found, at, last = [], entry, len(syms) - 1
        for i, sym in enumerate(syms):
            letters, at = self.step(states[last - i], sym, at)
            found.append(letters if times[i] == 1 else letters * times[i])
        return found, at


#: Costs to the end where no row is left.
END = (0, 4, 2, 0)


def tail(state: int) -> str:
    """Letters of the rows added at the end."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def repaired(letters: list[str], rows: list, entry: int, last: bool) -> tuple[str, list[dict], list[str]]:
    """The audit, the rows that the edits leave, and their lines. rows: (role, text), or None for copies that go."""
    at, out = entry, []

    def add(edits: str) -> None:
        nonlocal at
        for _ in edits:
            at = NEXT[at]
            out.append({"role": ROLE[at], "text": ""})

    for edits, row in zip(letters, rows, strict=True):
        edit = edits[-1]
        if edit != "D":
            add(edits[:-1])
            role, text = row
            at = NEXT[at] if edit == "R" else KEPT[at, "sua".find(role[0])]
            out.append({"role": ROLE[at] if edit == "R" else role, "text": text})
        else:
            add("I" * edits.count("I"))
    more = tail(at) if last else ""
    add(more)
    return "".join(letters) + more, out, [f"{r['role']}:{r['text']}" for r in out]


class Segment:
    """Consecutive rows of one conversation, with their letters and faults."""

    def __init__(self):
        self.syms, self.times, self.rows, self.chars = [], [], [], 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.first, self.last = 0, None, None
        self.turns: list = [None, None, 0]

    def add(self, has_turn: int, turn: int, role: str, text: str, copies: int, first: bool) -> None:
        bare = text.rstrip(SPACES)
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a copy beside its like
        self.last = initial
        if has_turn:
            if self.turns[1] != turn:
                self.turns[2] += 1
            self.turns[:2] = [turn if self.turns[0] is None else self.turns[0], turn]
        kept = first and bool(bare)
        if not bare:
            self.faults["blank"] += copies
        else:
            self.faults["duplicate"] += copies - kept
        if kept:
            cut = bare[-1] not in ".!?"
            self.faults["truncated"] += cut
            self._push(symbol(role, cut), 1, (role, text))
            self.chars += len(role) + len(text)
        if copies > kept:
            self._push(DELETE, copies - kept, None)

    def _push(self, sym: int, times: int, row) -> None:
        self.syms.append(sym)
        self.times.append(times)
        self.rows.append(row)

    def facts(self) -> dict:
        return {**self.faults, "illegal": self.illegal, "first_initial": self.first, "last_initial": self.last, "first_turn": self.turns[0], "last_turn": self.turns[1], "n_turns": self.turns[2]}


_ROW = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_LONG = ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "n_turns", "cost")


def _schema(conv: T.StructField, *more: T.StructField) -> T.StructType:
    base = [conv, T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("edge", T.BooleanType())]
    base += [T.StructField(c, T.LongType()) for c in _LONG] + [T.StructField(c, T.StringType()) for c in ("first_initial", "last_initial", "audit", "hash")]
    return T.StructType([*base, T.StructField("kept", T.ArrayType(_ROW)), *more])


_LONGS, _TEXTS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_RAW = [T.StructField("syms", T.BinaryType()), T.StructField("times", _LONGS), T.StructField("roles", _TEXTS), T.StructField("texts", _TEXTS), T.StructField("costs", _LONGS)]


def _batches(rows: Iterator[dict], schema: T.StructType, most: int = 256) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append({f.name: row.get(f.name) for f in arrow})
        if len(held) == most or row.get("roles"):
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _segments(rows: DataFrame, keep_rows: bool) -> DataFrame:
    """Sorted rows -> segments; those of a conversation that is whole in this partition are repaired at once."""
    schema = _schema(rows.schema["conv"], *_RAW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, machine, count = TaskContext.get().partitionId(), Automaton(), 0
        conv, now, cut, opening = None, None, False, True

        def close(edge: bool) -> dict:
            nonlocal count
            row = {"conv": conv, "part": part, "seg": count, "edge": edge, **now.facts()}
            count += 1
            if edge:
                units = [machine.scan(now.syms, now.times, [0 if i == j else NEVER for i in range(4)])[1] for j in range(4)]
                return row | {"syms": bytes(now.syms), "times": now.times, "roles": [r and r[0] for r in now.rows], "texts": [r and r[1] for r in now.rows], "costs": [v for u in units for v in u]}
            states, costs = machine.scan(now.syms, now.times, END)
            letters, _ = machine.trace(now.syms, now.times, states, 0)
            audit, out, lines = repaired(letters, now.rows, 0, True)
            return row | {"cost": costs[0], "audit": audit, "hash": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "kept": out if keep_rows else None}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "t_has", "t_val", "role", "text", "copies", "first")]
            for c, *row in zip(*columns, strict=True):
                if now is None or c != conv:
                    if now is not None:
                        yield close(opening or cut)
                        opening = False
                    conv, now, cut = c, Segment(), False
                elif len(now.syms) >= SEGMENT_ROWS or now.chars >= SEGMENT_CHARS:
                    cut = True
                    yield close(True)
                    now = Segment()
                now.add(*row)
        if now is not None:
            yield close(True)

    return rows.mapInArrow(lambda batches: _batches(work(batches), schema), schema)


def _ends(edges: DataFrame) -> DataFrame:
    """(part, seg, ends, last, total): for each segment the costs at its end, whether it is its conversation's last, and the conversation's cost."""
    listed = edges.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "costs"))).alias("segs")).select("segs")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("ends", _LONGS), T.StructField("last", T.BooleanType()), T.StructField("total", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for segs in batch.column("segs").to_pylist():
                end, found = list(END), []
                for k in range(len(segs) - 1, -1, -1):
                    found.append({"part": segs[k]["part"], "seg": segs[k]["seg"], "ends": end, "last": k == len(segs) - 1})
                    unit = segs[k]["costs"]
                    end = [min(min(end[j] + unit[4 * j + s] for j in range(4)), NEVER) for s in range(4)]
                for row in found:
                    yield row | {"total": end[0]}

    return listed.mapInArrow(lambda batches: _batches(work(batches), schema), schema)


def _entries(edges: DataFrame) -> DataFrame:
    """(part, seg, entry): the state in which each segment is entered."""
    exits = T.StructType([edges.schema["conv"], T.StructField("part", T.IntegerType()), T.StructField("seg", T.IntegerType()), T.StructField("exits", _LONGS)])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        machine = Automaton()
        for batch in batches:
            for r in batch.to_pylist():
                states, costs = machine.scan(r["syms"], r["times"], r["ends"])
                yield {"conv": r["conv"], "part": r["part"], "seg": r["seg"], "exits": [machine.trace(r["syms"], r["times"], states, s)[1] for s in range(4)]}

    left = edges.select("conv", "part", "seg", "syms", "times", "ends").mapInArrow(lambda batches: _batches(leave(batches), exits), exits)
    listed = left.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seg", "exits"))).alias("segs"))
    follow = lambda past, x: F.array_append(past, F.element_at(x["exits"], (F.element_at(past, -1) + 1).cast("int")))
    states = F.aggregate("segs", F.array(F.lit(0).cast("long")), follow)
    return listed.select(F.explode(F.arrays_zip(F.col("segs.part").alias("part"), F.col("segs.seg").alias("seg"), F.slice(states, 1, F.size("segs")).alias("entry"))).alias("x")).select("x.part", "x.seg", F.col("x.entry").cast("int").alias("entry"))


def _traced(edges: DataFrame, keep_rows: bool) -> DataFrame:
    schema = _schema(edges.schema["conv"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        machine = Automaton()
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                states, _ = machine.scan(r["syms"], r["times"], r["ends"])
                letters, _ = machine.trace(r["syms"], r["times"], states, r["entry"])
                rows = [x if x[0] is not None else None for x in zip(r["roles"], r["texts"], strict=True)]
                audit, out, lines = repaired(letters, rows, r["entry"], r["last"])
                yield r | {"cost": r["total"], "audit": audit, "hash": "\n".join(lines), "kept": out if keep_rows else None}

    return edges.mapInArrow(lambda batches: _batches(work(batches), schema, 1), schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of several segments: a stream in order, of which a task holds the audit alone."""
    schema = _schema(pieces.schema["conv"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, audits, digest, written = None, [], None, False

        def close() -> dict:
            return now | {"audit": "".join(audits), "hash": digest.hexdigest()}

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                lines = r.pop("hash")
                if now is None or r["conv"] != now["conv"]:
                    if now is not None:
                        yield close()
                    now, audits, digest, written = r, [], hashlib.sha256(), False
                else:
                    for c in ("blank", "duplicate", "truncated", "illegal"):
                        now[c] += r[c]
                    now["illegal"] += now["last_initial"] + r["first_initial"] not in LEGAL
                    now["last_initial"] = r["last_initial"]
                    if r["n_turns"]:
                        now["n_turns"] += r["n_turns"] - (now["last_turn"] == r["first_turn"])
                        now["first_turn"] = r["first_turn"] if now["first_turn"] is None else now["first_turn"]
                        now["last_turn"] = r["last_turn"]
                audits.append(r["audit"])
                if lines:
                    digest.update(("\n" * written + lines).encode())
                    written = True
        if now is not None:
            yield close()

    sorted_ = pieces.drop("kept").repartition("conv").sortWithinPartitions("conv", "part", "seg")
    return sorted_.mapInArrow(lambda batches: _batches(work(batches), schema), schema)


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Different rows with their number of copies, whether role and text are met first, in order of conversation, turn, role and text."""
    text = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    rows = df.select(df[conv_col].alias("conv"), df[turn_col].isNotNull().cast("int").alias("t_has"), F.coalesce(df[turn_col].cast("long"), F.lit(0)).alias("t_val"), text(role_col).alias("role"), text(text_col).alias("text"))
    said = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    rows = rows.withColumn("said", said).groupBy("conv", "t_has", "t_val", "said").agg(F.count("*").alias("copies"), F.min("role").alias("role"), F.min("text").alias("text"))
    rows = table(rows, "turns")
    firsts = rows.groupBy("conv", "said").agg(F.min(F.struct("t_has", "t_val")).alias("f")).select(F.col("conv").alias("c"), F.col("said").alias("s"), "f.t_has", "f.t_val")
    # The first occurrence is one row, so that a saying of a third of all rows is no hot key.
    same = rows["conv"].eqNullSafe(firsts["c"]) & (rows["said"] == firsts["s"]) & (rows["t_has"] == firsts["t_has"]) & (rows["t_val"] == firsts["t_val"])
    marked = rows.join(firsts, same, "left").select("conv", rows["t_has"], rows["t_val"], "role", "text", "copies", F.col("s").isNotNull().alias("first"))
    order = ["conv", "t_has", "t_val", "role", "text"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order)


def _pieces(df: DataFrame, names: tuple[str, str, str, str], keep_rows: bool) -> tuple[DataFrame, DataFrame]:
    """Segments of conversations whole in one partition, with results; traced segments of the others."""
    segments = table(_segments(_ordered(df, *names), keep_rows), "segments")
    whole, edges = segments.where("not edge").drop(*[f.name for f in _RAW]), segments.where("edge")
    edges = table(edges.drop("cost", "audit", "hash", "kept").join(_ends(edges), ["part", "seg"]), "edges")
    return whole, _traced(edges.join(_entries(edges), ["part", "seg"]), keep_rows)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    A row's first fault counts: blank (no character but spaces), duplicate (role and text met earlier in the conversation), truncated (the last
    character that is no space is none of .!?).  illegal counts neighbours whose initials are not su, ua or au; gaps is
    the number of turns missing between the least and the greatest.  audit is the cheapest edits' letters (K, R, D, I), of several the
    least by ASCII; repaired_sha256 hashes the repaired ``role:text`` lines.

    Null roles and texts are one space; null turns come first and count for no gap; rows of one turn are ordered by role and text, so
    that the result doesn't depend on the input's order; a null conversation is a conversation.  Repeated rows are duplicates of the first.  A
    role whose initial is none of s, u, a, or that is empty, can't be kept.  Texts of any length are taken whole (a segment
    holds at least one row).  Other columns are not read, so their names can't clash.  An empty table gives an empty
    result.  One conversation's audit is one string, and its hash one stream in order: both are the result itself.
    """
    whole, traced = _pieces(df, (conv_col, turn_col, role_col, text_col), False)
    rows = whole.unionByName(_joined(table(traced, "traced")))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return rows.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("hash").alias("repaired_sha256"))


def repaired_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations' rows: conv, part, seg and place (in this order), role, text. Odd rows as in :func:`repair`."""
    whole, traced = _pieces(df, (conv_col, turn_col, role_col, text_col), True)
    rows = whole.unionByName(traced).select("conv", "part", "seg", F.posexplode("kept").alias("place", "row"))
    return rows.select("conv", "part", "seg", "place", "row.role", "row.text")


def damage(df: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) as crc32 of ``conv_id:turn`` modulo 20 damages them: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls in the key, roles and texts are one space."""
    key: Column = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), key.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
