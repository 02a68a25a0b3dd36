"""Tables that cut lineage, written where the driver and all executors can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.lineage import shared_dir, table, tidy

__all__ = ["forget", "shared_dir", "table", "tidy"]


def forget(written: DataFrame) -> None:
    """Delete a table of :func:`table` that nothing unwritten depends on any more."""
    jvm = written.sparkSession.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in written.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(written.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
