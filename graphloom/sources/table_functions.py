"""Extractors and adapters' contract in SQL: a table function for each extractor, called by LATERAL, with negotiated schema versions.

    SELECT f.path, x.fact, x.name FROM files f, LATERAL extract_java(f.path, f.text, '2') x

A caller states the version of the facts' schema that it reads; a version that the extractor doesn't write is refused by a row, so that
one caller's request stops no query.  Functions run in Python workers and are pickled by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .extract import FIELDS, REGISTRY, SCHEMA, UNREADABLE, fact

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REFUSED = "refused"
#: Schema versions that extractors write: symbols have a second one, with usages.
SYMBOLS = ("python", "cpp", "java", "csharp", "typescript")


def versions(parser_id: str) -> tuple[str, ...]:
    return ("1", "2") if parser_id in SYMBOLS else ("1",)


def function_name(parser_id: str) -> str:
    return "extract_" + parser_id.replace("-", "_")


def table_function(parser_id: str):
    """The table function of one extractor: (path, text, version) -> facts; files that it doesn't read give none, null texts are empty."""
    marks, run = REGISTRY[parser_id]
    known, name = versions(parser_id), parser_id

    class Extract:
        def eval(self, path: str, text: str, version: str) -> Iterator[tuple]:
            if path is None or (marks and not path.endswith(marks)):
                return
            if version not in known:
                found = [fact(REFUSED, version, message=f"{name} writes {', '.join(known)}")]
            else:
                try:
                    found = list(run(path, text or ""))
                except Exception as e:  # noqa: BLE001  an unreadable file must not stop the others
                    found = [fact(UNREADABLE, type(e).__name__, message=e)]
                if version == "1":
                    found = [f for f in found if f["fact"] not in ("call", "inject", "alias", "parameter_property")]
            for f in found:
                yield (name, path, *(f[k] for k in FIELDS), f["attrs"])

    return udtf(Extract, returnType=SCHEMA)


def register(spark: SparkSession, *parser_ids: str) -> list[str]:
    """Register the functions of some extractors, or of all; gives their names."""
    names = []
    for parser_id in parser_ids or sorted(REGISTRY):
        names.append(function_name(parser_id))
        spark.udtf.register(names[-1], table_function(parser_id))
    return names
