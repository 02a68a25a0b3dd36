"""Working-copy scans and file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths, denied
from ..schema import ANALYSED_STATUSES


def scan(spark: SparkSession, root: str, denylist: list[str] | None = None) -> DataFrame:
    """(path relative to root, mtime_ms, size, content) of all files below root; content is read only if it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + root.rstrip("/").split(":")[-1].lstrip("/").replace(".", r"\.") + "/", "")
    rows = df.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")
    return rows.where(~denied(F.col("path"), [".git", *(denylist or [])]))


def inventory(files: DataFrame) -> DataFrame:
    return files.select("path", "mtime_ms", "size")


def tree(files: DataFrame) -> DataFrame:
    """(path, type): the files and all folders above them."""
    folders = files.select(F.explode(ancestor_paths(F.col("path"))).alias("path")).distinct().withColumn("type", F.lit("directory"))
    return files.select("path", F.lit("file").alias("type")).unionByName(folders)


def is_binary(content: Column, probe: int = 8192) -> Column:
    """A NUL in the first bytes."""
    return F.instr(F.decode(F.substring(content, 1, probe), "ISO-8859-1"), "\x00") > 0


def valid_text(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of the files that are text."""
    good = files.where(~is_binary(F.col("content")) & valid_text(F.col("content")))
    return good.select("path", F.decode("content", "UTF-8").alias("text"))


def scoped(files: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Files within a size and an analysed status."""
    return files.where((F.col("size") <= most) & F.col("status").isin(ANALYSED_STATUSES))


def map_prefixes(path: Column, prefixes: dict[str, str]) -> Column:
    """The longest prefix that fits is exchanged."""
    out = path
    for old in sorted(prefixes, key=len):
        out = F.when(path.startswith(old), F.concat(F.lit(prefixes[old]), F.substring(path, len(old) + 1, 1 << 30))).otherwise(out)
    return out
