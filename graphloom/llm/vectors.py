"""Vectors of embedding tables as exact integers: component x becomes floor(256 * x), x as double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Sums up to this size are exact in doubles, which matrix products are much faster for.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor a non-finite component; an empty vector is usable."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vector: Column) -> Column:
    """Components as longs; those beyond 64 bits are clamped to the ends of that range."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))


def largest(rows: DataFrame, column: str) -> tuple[int, int]:
    """The largest absolute component of a column of integer vectors and the largest number of components: one row of sums."""
    size = F.array_max(F.transform(column, lambda x: F.abs(x.cast("decimal(20,0)"))))
    found = rows.agg(F.max(size), F.max(F.size(column))).first()
    return int(found[0] or 0), int(found[1] or 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's integer vectors, all of ``dims`` components, as rows of a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)
