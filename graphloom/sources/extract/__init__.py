"""Extractors: functions (path, text) -> facts, run over file frames.

A fact is (fact, name, qualified_name, parent, line, target, attrs); absent fields are null.  A file
that an extractor can't read gives one fact, UNREADABLE with the error, and never fails the run.  Functions that
run in Python workers are pickled by value, so executors need no copy of the package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import sys
from functools import partial
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Fact = dict
UNREADABLE = "unreadable"
Extractor = Callable[[str, str], Iterable[Fact]]
FIELDS = ["fact", "name", "qualified_name", "parent", "line", "target"]
COLUMNS = ["parser_id", "path", *FIELDS, "attrs"]
SCHEMA = "parser_id string, path string, fact string, name string, qualified_name string, parent string, line int, target string, attrs map<string,string>"
_TEXTS = {str, type(None)}
#: A task holds the texts of so many files and so many facts at once, however many its batches hold.
FILES_AT_ONCE, FACTS_AT_ONCE = 64, 8192
#: parser id -> (languages or file marks, extractor)
REGISTRY: dict[str, tuple[tuple[str, ...], Extractor]] = {}


def extractor(parser_id: str, *marks: str) -> Callable[[Extractor], Extractor]:
    """Register under an id, for paths that end with one of the marks; a later one takes an id over."""

    def add(f: Extractor) -> Extractor:
        REGISTRY[parser_id] = (marks, f)
        return f

    return add


def fact(what: str, name: str | None = None, qualified_name: str | None = None, parent: str | None = None, line: int | None = None, target: str | None = None, **attrs) -> Fact:
    return {"fact": what, "name": name, "qualified_name": qualified_name, "parent": parent, "line": line, "target": target, "attrs": {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in attrs.items() if v is not None} if attrs else attrs}


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Facts as one batch; names that a file gives as numbers are texts."""
    *columns, attrs = zip(*rows, strict=True)
    arrays = []
    for name, column in zip(COLUMNS, columns, strict=False):
        if name != "line" and not _TEXTS.issuperset(map(type, column)):
            column = [v if v is None or isinstance(v, str) else str(v) for v in column]
        arrays.append(pa.array(column, pa.int32() if name == "line" else pa.string()))
    ends = [0, *accumulate(map(len, attrs))]
    keys, values = ([pair[at] for own in attrs for pair in own] for at in (0, 1))
    arrays.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())))
    return pa.RecordBatch.from_arrays(arrays, names=COLUMNS)


def reading(parser_id: str, run: Extractor) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (path, text) -> batches of facts, of bounded size whatever the batches hold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        fields = itemgetter(*FIELDS)
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                paths, texts = (c.slice(at, FILES_AT_ONCE).to_pylist() for c in batch.columns)
                for path, text in zip(paths, texts, strict=True):
                    try:
                        found = list(run(path, text or ""))
                    except Exception as e:  # noqa: BLE001  an unreadable file must not stop the others
                        found = [fact(UNREADABLE, type(e).__name__, message=e)]
                    for f in found:
                        out.append((parser_id, path, *fields(f), f["attrs"].items()))
                        if len(out) == FACTS_AT_ONCE:
                            yield _batch(out)
                            out = []
        if out:
            yield _batch(out)

    return each


def extract(files: DataFrame, parser_id: str, kinds: list[str] | None = None) -> DataFrame:
    """(path, text) -> facts of one extractor over the files that it reads; kinds: only those facts, for extractors that can be asked for some."""
    marks, run = REGISTRY[parser_id]
    if kinds is not None:
        run = partial(run, asked=frozenset(kinds))
    condition = None
    for mark in marks:
        test = files.path.endswith(mark)
        condition = test if condition is None else condition | test
    chosen = files.select("path", "text") if condition is None else files.where(condition).select("path", "text")
    return chosen.mapInArrow(reading(parser_id, run), SCHEMA)


from . import build, calls, config, java_http, members, react, routes, symbols, ui  # noqa: E402, F401  they register themselves
