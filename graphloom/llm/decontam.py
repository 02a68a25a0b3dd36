"""Benchmark decontamination: one Aho-Corasick automaton over all normalised test questions and answers.

Words are runs of ASCII letters and digits (A-Z lower-cased) and all other-than-ASCII characters,
joined by single spaces.  Each window of ``width`` consecutive item words (a shorter item whole)
is a pattern with a space on both sides, so matches fall on word edges.  One scan of a text finds
every occurrence of every pattern; hits map back to character offsets of the original text.

An automaton takes up to 40 bytes of memory for each byte of its patterns, which overlap tenfold.  The patterns are a
distributed table; only a part of PATTERN_BYTES at most is ever gathered, sent out and built at once.  Most benchmarks
are one such part and the texts are scanned once; a larger one is scanned a part at a time, each giving the hits of texts
that have some, merged by text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import table

#: Bytes of patterns in one automaton, about 240 MB of memory; one longer pattern is an automaton of its own.
PATTERN_BYTES = 6_000_000
#: Item ids that one row of a window holds at most, and bytes that each counts.
ITEMS_A_ROW, ITEM_BYTES = 1 << 12, 64
BREAKS = bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122))
TO_SPACE = bytes.maketrans(BREAKS, b" " * len(BREAKS))
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORDS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode().lower().translate(TO_SPACE).split()


def patterns(benchmark: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """(window, item): every window of every item, once."""
    words = F.regexp_extract_all(F.translate(item_text, UPPER, LOWER), F.lit(WORDS), 0)
    items = benchmark.select(F.col(item_id).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return items.select("item", "words", F.explode(starts).alias("at")).select(F.array_join(F.slice("words", F.col("at"), width), " ").alias("window"), "item").distinct()


_built: dict[str, object] = {}


def automaton(rows: list[tuple[str, list]], key: str):
    """Built once for each Python worker and part; one is kept at a time."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        out = ahocorasick.Automaton()
        together: dict[str, list] = {}
        for window, items in rows:  # a window of many items has several rows
            together.setdefault(window, []).extend(items)
        for window, items in together.items():
            out.add_word(f" {window} ", (window.count(" ") + 1, items))
        out.make_automaton()
        _built[key] = out
    return _built[key]


def scan(words: list[bytes], machine) -> tuple[list[tuple[int, int]], set]:
    """Runs of words hit, as disjoint [from, to) in order, and the items that hold them."""
    joined = f" {b' '.join(words).decode()} "
    found, items = [], set()
    for end, (n, held) in machine.iter(joined):
        found.append((end, n))
        items.update(held)
    if not found:
        return [], items
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    last = np.searchsorted(np.flatnonzero(letters == 32), [end for end, _ in found])  # a pattern's last space closes word last - 1
    return merged(zip((last - np.array([n for _, n in found])).tolist(), last.tolist(), strict=True)), items


def merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def _hits(text: str | None, n_words: int, runs: list[tuple[int, int]], items) -> dict:
    spans = []
    if runs:
        places = [m.span() for m in WORD.finditer(text.translate(TO_LOWER))]
        spans = [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in runs]
    known = sorted(i for i in items if i is not None)
    return {"n_words": n_words, "n_hit": sum(b - a for a, b in runs), "item_ids": known + [None] * (len(known) < len(items)), "spans": spans}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, name: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, item_ids (sorted, a null id last), spans (merged, characters of the original).

    Null or wordless texts have no words and no hits; null or wordless items are no patterns; items without id
    count as one item of null id; an empty benchmark hits nothing; repeated items and rows count as they stand; texts of any
    length are scanned whole; other columns pass through, but one of the name ``name`` is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(name)
    kind = benchmark.schema[item_id].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    hits = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(kind)), T.StructField("spans", T.ArrayType(span))])
    arrow, schema = to_arrow_type(hits), T.StructType([*docs.schema.fields, T.StructField(name, hits, False)])
    held_by = table(patterns(benchmark, item_id, item_text, width).select("window", "item").distinct(), "patterns")
    many = held_by.groupBy("window").agg(F.ceil(F.count("*") / ITEMS_A_ROW).alias("rows"))
    chunk = F.pmod(F.xxhash64("item"), "rows").alias("chunk")
    windows = table(held_by.join(many, "window").groupBy("window", chunk).agg(F.collect_list(F.struct("item")).alias("items")), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + 2 + F.size("items") * ITEM_BYTES)).first()[0] or 0
    parts = max(1, math.ceil(size / PATTERN_BYTES))

    def sent(part: int):
        rows = windows.where(F.pmod(F.xxhash64("window", "chunk"), F.lit(parts)) == part).select("window", F.col("items.item").alias("items")).toArrow()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, list(zip(rows.column("window").to_pylist(), rows.column("items").to_pylist(), strict=True))))

    if parts == 1:
        only = sent(0)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = only.value
            for batch in batches:
                rows = []
                for text in batch.column(text_col).to_pylist():
                    words = normal_words(text)
                    rows.append(_hits(text, len(words), *(scan(words, automaton(held, key)) if held and words else ([], ()))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, name])

        return docs.mapInArrow(whole, schema)

    found = None
    for part in range(parts):
        now = sent(part)

        def some(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            key, held = now.value
            for batch in batches:
                signs, runs, items = [], [], []
                for sign, text in zip(batch.column("sign").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    a, b = scan(normal_words(text), automaton(held, key)) if held else ([], ())
                    if a:
                        signs.append(sign)
                        runs.append([{"start": x, "stop": y} for x, y in a])
                        items.append(list(b))
                yield pa.RecordBatch.from_arrays([pa.array(signs, pa.string()), pa.array(runs, to_arrow_type(T.ArrayType(span))), pa.array(items, to_arrow_type(T.ArrayType(kind)))], names=["sign", "runs", "items"])

        rows = docs.where(F.col(text_col).isNotNull()).select(_sign(F.col(text_col)).alias("sign"), F.col(text_col).alias("text"))
        one = table(rows.mapInArrow(some, T.StructType([T.StructField("sign", T.StringType()), T.StructField("runs", T.ArrayType(span)), T.StructField("items", T.ArrayType(kind))])).dropDuplicates(["sign"]), "leaks")
        now.unpersist()
        found = one if found is None else found.unionByName(one)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs, items in zip(batch.column(text_col).to_pylist(), batch.column(own[1]).to_pylist(), batch.column(own[2]).to_pylist(), strict=True):
                runs = merged((r["start"], r["stop"]) for part in runs or [] for r in part)
                rows.append(_hits(text, len(normal_words(text)), runs, {i for part in items or [] for i in part}))
            kept = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, arrow)], names=schema.names)

    own = [f"{c}_{uuid.uuid4().hex}" for c in ("sign", "runs", "items")]
    found = found.groupBy("sign").agg(F.collect_list("runs"), F.collect_list("items")).toDF(*own)
    return docs.join(found, _sign(F.col(text_col)) == F.col(own[0]), "left").mapInArrow(put_together, schema)


def _sign(text: Column) -> Column:
    return F.sha2(text, 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    name = f"leaks_{uuid.uuid4().hex}"
    return find_leaks(docs, benchmark, name=name, **names).where(f"{name}.n_hit = 0").drop(name)
