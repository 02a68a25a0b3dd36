"""Tables that cut lineage, written where the driver and all executors can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset (local runs, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark removes the shuffle files of a query once it has ended; a lost one is made again by Spark's own stage retries.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def walked(files: DataFrame) -> tuple[DataFrame, int]:
    """The files, read once, and how many a walk met: a metric of that one read."""
    seen = Observation()
    rows = table(files.observe(seen, F.count(F.lit(1)).alias("files")), "walk")
    return rows, seen.get["files"]


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it again: lost executors cost no recomputation.

    ``by``: a column of few values, whose filters then read the files of those alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def spread(df: DataFrame, rows: int, least: int = 1) -> DataFrame:
    """The rows dealt over tasks of about ``rows`` each: a small file is read by one task, however much work each of its rows is.

    The number of tasks grows with the table; counting a plain Parquet scan reads its footers alone.
    """
    return df.repartition(max(least, -(-df.count() // rows)))


#: What :func:`stored` has written: application, inputs with their sizes and times, name -> path.
_stored: dict[tuple, str] = {}


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files under the paths."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf).listStatus(path)
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return tuple(out)


def stored(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table built once for each state of its input files and kept for the application: the graph that queries ask, as ingested."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, _state(spark, paths))
    if key not in _stored:
        df = build()
        path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
        with tidy(spark):
            df.write.option("compression", "zstd").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
