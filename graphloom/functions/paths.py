"""Path and id expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTENSION_LANGUAGES, ID_BYTES, SHEBANG_LANGUAGES

#: Folders that name no service (fixed values).
SKIPPED_FOLDERS = "src lib app apps packages routes handlers controllers config configs settings contracts tests test dist node_modules bin obj wwwroot".split()


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def ancestor_paths(path: Column) -> Column:
    """Ancestors nearest first, without the path itself and the empty root."""
    parts = F.split(path, "/")
    steps = F.filter(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: i > 0)
    return F.when(F.size(parts) > 1, F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGES.items() for x in kv])
    return F.element_at(table, extension(path))


def shebang_language(first_line: Column) -> Column:
    """Language of a ``#!`` line's interpreter, the basename of its last token; null if it is none of the known ones."""
    tool = F.lower(F.regexp_extract(F.element_at(F.split(F.trim(F.regexp_extract(first_line, r"^#!\s*([^\r\n]+)", 1)), r"\s+"), -1), r"([^/]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in SHEBANG_LANGUAGES.items() for x in kv])
    return F.try_element_at(table, tool)


def is_below(path: Column, folder: Column) -> Column:
    return path.startswith(F.concat(folder, F.lit("/")))


def denied(path: Column, names: list[str]) -> Column:
    """Whether any segment is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def has_segment(path: Column, name: Column) -> Column:
    """Whole-segment equality, backslashes and case aside."""
    return F.array_contains(F.split(F.lower(posix(path)), "/"), F.lower(F.trim(name)))


def glob_regex(pattern: str) -> str:
    """Java regex of a glob: ``**/`` any folders or none, ``**`` anything, ``*`` within a segment, ``?`` one character of a segment."""
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([.\\+^$(){}|\[\]])", r"\\\1", part)
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def service_hint(path: Column) -> Column:
    """First folder, lower-cased, that is not a common layout folder and holds no dot; null if there is none."""
    parts = F.filter(F.split(F.lower(posix(path)), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.get(F.filter(folders, lambda p: ~p.isin(SKIPPED_FOLDERS) & ~p.contains(".")), 0)


def unscoped_key(path: Column) -> Column:
    return F.concat(F.lit("unscoped:"), F.substring(F.sha1(path), 1, 12))


def fit_id(id_: Column, most: int = ID_BYTES) -> Column:
    """Ids over ``most`` UTF-8 bytes become their first part and a hash."""
    return F.when(F.octet_length(id_) <= most, id_).otherwise(F.concat(F.split_part(id_, F.lit(":"), F.lit(1)), F.lit(":h:"), F.substring(F.sha2(id_, 256), 1, 40)))


def code_id(parser: Column, path: Column, kind: Column, qualified_name: Column) -> Column:
    return fit_id(F.concat_ws(":", parser, path, kind, qualified_name))


def system_edge_id(parser: Column, type_: Column, src: Column, dst: Column) -> Column:
    return fit_id(F.concat_ws(":", parser, type_, F.concat(src, F.lit("->"), dst)))


def short_label(id_: Column) -> Column:
    """Last part of an id; the id itself if that is empty."""
    tail = F.element_at(F.split(id_, ":"), -1)
    return F.when(tail != "", tail).otherwise(id_)


def spring_name(name: Column) -> Column:
    """Lower-cased; four hyphened parts or more lose the first two; a trailing -service goes."""
    parts = F.split(F.lower(F.trim(name)), "-")
    short = F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 3, F.size(parts)), "-")).otherwise(F.lower(F.trim(name)))
    return F.regexp_replace(short, "-service$", "")
