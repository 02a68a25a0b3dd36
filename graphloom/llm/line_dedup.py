"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Two line texts are linked if their edit distance (code points) is at most TAU.  Each line of
length L is cut into TAU + 1 segments; two linked lines share a segment up to a bounded shift, so a
line probes the index of segments for its own length and those up to TAU shorter, at the
multi-match-aware positions alone.  Keys that only one text holds go first; what is left is joined
under a character-histogram bound (an edit changes it by 2 at most) and verified with banded
bit-parallel edit distance.  Of each class of linked texts the first line (least id, then line
number) stays; all other occurrences go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import forget, table

TAU, LEAST_CHARS = 2, 20
#: Character groups of the histogram; other characters make no lane.
LANES = ["ab", "cd", "e", "fg", "h", "i", "jkl", "mn", "o", "pq", "r", "s", "t", "uv", "wxyz", " .,;:!?"]


def _cuts(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line: the last length % (tau + 1) segments are longer by one."""
    m = tau + 1
    base, short = F.floor(length / m).cast("int"), m - length % m
    return 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - short), base + F.when(F.lit(i) > short, 1).otherwise(0)


def keys(line: Column, n: Column, tau: int = TAU) -> Column:
    """Distinct keys of the line's own segments and probes; n is its length.

    A key is a segment's number and text, so that the index tells segments by their length.
    """
    out = []
    for delta in range(tau + 1):
        for i in range(1, tau + 2):
            start, size = _cuts(n - delta, i, tau)
            for o in range(max(1 - i, delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i)) + 1):
                out.append(F.xxhash64(F.lit(i), F.substring(line, start + o, size)))
    return F.array_distinct(F.array(*out))


def lanes(line: Column) -> list[Column]:
    """Counts of each character group."""
    low = F.lower(line)
    return [F.regexp_count(low, F.lit("[" + g + "]")).cast("int") for g in LANES]


def edit_distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """Edit distance of two strings if it is at most tau, else some larger number.

    One column of the matrix at a time: the band's 2 * tau + 1 vertical steps are bits of two
    words, moved on together; the distance is followed down the band's lowest diagonal, then along the last row.
    """
    width = 2 * tau + 1
    full = F.lit((1 << width) - 1).cast("long")
    one = lambda x: x.cast("long")

    def run(xs: Column) -> Column:
        x, y = xs["x"], xs["y"]
        m = F.size(x)

        def step(s: Column, j: Column) -> Column:
            match = None
            for k in range(width):
                i = j + (k - tau)
                bit = F.when((i >= 1) & (i <= m) & (F.get(x, i - 1) == F.get(y, j - 1)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
                match = bit if match is None else match.bitwiseOR(bit)
            return F.element_at(F.transform(F.array(match), lambda pm: after(s, j, pm)), 1)

        def after(s: Column, j: Column, pm: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full)
            return F.element_at(F.transform(F.array(F.struct(d0.alias("d0"), vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full).alias("hp"), d0.bitwiseAND(vp).alias("hn"))), lambda h: moved(s, j, h)), 1)

        def moved(s: Column, j: Column, h: Column) -> Column:
            d0, hp, hn = h["d0"], h["hp"], h["hn"]
            bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("long")).cast("int")
            down = 1 - bit(d0, F.lit(2 * tau))
            along = bit(hp, m - j + tau) - bit(hn, m - j + tau)
            half = F.shiftright(d0, 1)
            vp = hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(full)
            return F.struct(vp.alias("vp"), half.bitwiseAND(hp).alias("vn"), (s["d"] + F.when(j + tau <= m, down).otherwise(along)).alias("d"))

        first = F.struct(one(F.lit(((1 << width) - 1) & ~((1 << tau) - 1))).alias("vp"), one(F.lit(0)).alias("vn"), F.least(F.lit(tau), m).alias("d"))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), first, step, lambda s: s["d"])

    chars = F.transform(F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))), run)
    close = F.abs(F.char_length(a) - F.char_length(b)) <= tau
    return F.when(close & (F.char_length(b) > 0) & (F.char_length(a) > 0), F.element_at(chars, 1)).when(close, F.greatest(F.char_length(a), F.char_length(b))).otherwise(tau + 1)


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, no, line, n): judged lines, trimmed, and their length."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("no", "raw"))
    rows = rows.select("id", "no", F.trim(F.col("raw"), F.lit(" \t\r\x0b\x0c")).alias("line"))
    return rows.withColumn("n", F.char_length("line")).where(F.col("n") >= least)


def edit_links(docs: DataFrame, occurrences: DataFrame, spread: DataFrame, id_col: str, text_col: str, tau: int = TAU) -> DataFrame:
    """(u, v): hashes (struct of a and b) of all pairs of different line texts within edit distance tau, u < v.

    occurrences: (id, no, a, b); spread: (a, keys), forgotten once used.  A key that one text alone holds leads nowhere;
    the texts of the others are read again from ``docs`` where they stand first.
    """
    segments = spread.select("a", F.explode("keys").alias("key"))
    shared = segments.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").select("key")
    live = segments.join(shared, "key", "left_semi").select("a").distinct()
    live = table(live, "live")
    forget(spread)
    firsts = occurrences.join(live, "a", "left_semi").groupBy("a", "b").agg(F.min(F.struct("id", "no")).alias("at"))
    wanted = firsts.groupBy("at.id").agg(F.collect_set("at.no").alias("nos")).withColumnRenamed("id", "_id")
    held = docs.where(F.col(text_col).isNotNull()).join(wanted, F.col(id_col) == F.col("_id"))
    lines = held.select(F.explode(F.element_at(F.transform(F.array(F.split(text_col, "\n")), lambda ls: F.transform("nos", lambda k: F.get(ls, k))), 1)).alias("raw")).select(F.trim(F.col("raw"), F.lit(" \t\r\x0b\x0c")).alias("line")).distinct()
    kept = table(lines.select(F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("h"), "line", F.char_length("line").alias("n"), F.array(*lanes(F.col("line"))).alias("c")), "lines")
    slim = kept.select("h", "n", "c", F.explode(keys(F.col("line"), F.col("n"), tau)).alias("key"))
    left, right = (slim.select("key", F.col("h").alias(x), F.col("n").alias(f"n{x}"), *[F.get("c", i).alias(f"{x}{i}") for i in range(len(LANES))]) for x in "uv")
    apart = sum((F.abs(F.col(f"u{i}") - F.col(f"v{i}")) for i in range(1, len(LANES))), F.abs(F.col("u0") - F.col("v0")))
    met = left.join(right, (left.key == right.key) & (F.col("u") < F.col("v")) & (F.abs(F.col("nu") - F.col("nv")) <= tau) & (apart <= 2 * tau))
    pairs = table(met.select("u", "v").distinct(), "pairs")
    both = pairs.join(kept.select(F.col("h").alias("u"), F.col("line").alias("x")), "u").join(kept.select(F.col("h").alias("v"), F.col("line").alias("y")), "v")
    return table(both.where(edit_distance(F.col("x"), F.col("y"), tau) <= tau).select("u", "v"), "links")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST_CHARS) -> DataFrame:
    """(id, n_lines, n_links, dropped array<int>): by id, its judged lines, their links to different texts, and the 0-based numbers of the lines that go.

    Judged are lines of at least ``least`` characters once trimmed of ASCII white space; shorter ones stay.
    Null texts and null ids have no judged lines; rows that share an id share decisions by line number.  Ties between
    lines of one class go to the least id and line number; a line of any length is compared whole.
    """
    hashed = _lines(docs, id_col, text_col, least).select("id", "no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), keys(F.col("line"), F.col("n"), tau).alias("keys"))
    both = table(hashed, "occurrences")
    lines = table(both.drop("keys"), "occurrences")
    links = edit_links(docs.select(id_col, text_col), lines, both.select("a", "keys"), id_col, text_col, tau)
    seen = table(lines.groupBy("a", "b").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("n")), "texts")
    ends = links.select(F.explode(F.array("u", "v")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    classes = connected_components(links).select(F.col("node").alias("h"), "component")
    near = seen.select(F.struct("a", "b").alias("h"), "first").join(classes, "h")
    least_of = near.groupBy("component").agg(F.min("first").alias("class_first"))
    near = near.join(least_of, "component").join(ends, "h").select("h.a", "h.b", "class_first", "links")
    verdicts = seen.join(near, ["a", "b"], "left").where("n > 1 or links is not null").select("a", "b", F.coalesce("class_first", "first").alias("stay"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    told = lines.select("id", "no", "a", "b").join(verdicts, ["a", "b"], "left")
    gone = F.col("stay").isNotNull() & (F.struct("id", "no") != F.col("stay"))
    return told.groupBy("id").agg(F.count("*").alias("n_lines"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"), F.array_sort(F.collect_set(F.when(gone, F.col("no")))).alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines of these sorted 0-based numbers."""
    lines = F.split(text, "\n")

    def piece(k: Column, ls: Column) -> Column:
        low = F.coalesce(F.get(dropped, k - 1) + 1, F.lit(0))
        high = F.coalesce(F.get(dropped, k), F.size(ls))
        return F.slice(ls, low + 1, F.greatest(high - low, F.lit(0)))

    parts = F.element_at(F.transform(F.array(lines), lambda ls: F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda k: piece(k, ls)))), 1)
    return F.when(F.size(dropped) > 0, F.array_join(parts, "\n")).otherwise(text)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, plus _n_lines, _n_links, _n_dropped. All rows stay.

    Of a class of linked lines the one of the least id, and in it the first, stays; repeated rows (of one id) share the decisions of
    that id, so that equal rows stay equal.  Texts and lines of any length are read whole.  Rows of null id or text stay as
    they are; an empty table gives an empty result.  Columns of the three names above are replaced; any others pass through.
    """
    docs = docs.drop("_n_lines", "_n_links", "_n_dropped")
    mark = uuid.uuid4().hex
    own = {c: f"{c}_{mark}" for c in ("id", "n_lines", "n_links", "dropped")}
    found = decide(docs, id_col, text_col, **limits).withColumnsRenamed(own)
    rows = docs.join(found, docs[id_col] == F.col(own["id"]), "left")
    rows = rows.withColumn(text_col, F.when(F.size(own["dropped"]) > 0, without(F.col(text_col), F.col(own["dropped"]))).otherwise(F.col(text_col)))
    zero = F.lit(0).cast("long")
    return rows.withColumns({"_n_lines": F.coalesce(own["n_lines"], zero), "_n_links": F.coalesce(own["n_links"], zero), "_n_dropped": F.coalesce(F.size(own["dropped"]).cast("long"), zero)}).drop(*own.values())
