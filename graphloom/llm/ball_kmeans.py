"""Centroid clustering: exact k-means on integer vectors with balls.

Each cluster is a ball: its centroid and a radius that covers its members.  A centroid can only take
members of another ball if the two centroids are at most twice that ball's radius apart, so each ball
has a short list of neighbours.  Within a ball, the members nearer to their centroid than half the way
to the nearest neighbour form the stable core and are compared with nothing; the others lie in annuli,
and a member of the a-th annulus is compared exactly with the a nearest neighbours alone.  The result is
that of plain k-means, ties included: d(x, c') <= d(x, c) implies d(c, c') <= 2 d(x, c).

Vectors stay in a table with their cluster and distance; a round reads it twice (sums and radii by
task, then the assignment) and writes it once.  Only the k centroids, k sums and k radii reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import forget, table
from .vectors import EXACT, integers, matrix, usable


def exact(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the fastest type in which all squared distances are exact: doubles, 64-bit integers or Python's own."""
    reach = max([0, *(abs(int(end)) for a in (vectors, centroids) if a.size for end in (a.min(), a.max()))])
    most = max(1, vectors.shape[1]) * 16 * reach * reach  # four times a squared distance
    kind = np.float64 if most < EXACT else np.int64 if most < 1 << 63 else object
    return vectors.astype(kind), centroids.astype(kind)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return (apart * apart).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector by comparing it with all centroids; ties go to the smaller number."""
    x, c = exact(vectors, centroids)
    best, at = squared(x, c[0]), np.zeros(len(x), np.int32)
    for j in range(1, len(c)):
        now = squared(x, c[j])
        nearer = now < best
        best, at = np.where(nearer, now, best), np.where(nearer, np.int32(j), at)
    return at, best


def neighbours(centroids: np.ndarray, radii: list[int | None]) -> list[list[tuple[int, int]]]:
    """For each ball the (squared distance, number) of the centroids within twice its radius, nearest first. radii: squared, None for no members."""
    c = centroids.astype(object)
    found = []
    for i, radius in enumerate(radii):
        apart = [(int(((c[i] - c[j]) ** 2).sum()), j) for j in range(len(c)) if j != i] if radius is not None else []
        found.append(sorted(x for x in apart if x[0] <= 4 * radius))
    return found


def reassign(vectors: np.ndarray, clusters: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest`, for vectors whose cluster is known and whose ball's neighbours are."""
    x, c = exact(vectors, centroids)
    at, best = clusters.copy(), np.zeros(len(x), x.dtype)
    for i in np.unique(clusters):
        members = np.flatnonzero(clusters == i)
        own = squared(x[members], c[i])
        order = np.argsort(own, kind="stable")
        members, own = members[order], own[order]
        least, to = own.copy(), np.full(len(members), i, np.int32)
        reach = own * 4
        for apart, j in near[i]:
            outer = int(np.searchsorted(reach, apart))  # nearer members are in the core, or in an annulus further in
            if outer == len(members):
                break
            now = squared(x[members[outer:]], c[j])
            nearer = (now < least[outer:]) | ((now == least[outer:]) & (j < to[outer:]))
            least[outer:] = np.where(nearer, now, least[outer:])
            to[outer:] = np.where(nearer, np.int32(j), to[outer:])
        at[members], best[members] = to, least
    return at, best


def _moved(radius: int, step: int) -> int:
    """Square of a bound on the distance to a centroid that has moved; both given squared."""
    return (math.isqrt(radius) + 1 + math.isqrt(step) + 1) ** 2


def _assigned(rows: DataFrame, dims: int, centroids: np.ndarray, near: list | None) -> DataFrame:
    schema = T.StructType([rows.schema["id"], rows.schema["x"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("x"), dims)
            if near is None:
                at, best = nearest(vectors, centroids)
            else:
                at, best = reassign(vectors, batch.column("cluster").to_numpy(), centroids, near)
            if best.dtype == object and len(best) and max(best) >= 1 << 63:
                raise OverflowError("a squared distance does not fit in 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(at, pa.int32()), pa.array(best.astype(np.int64))], ["id", "x", "cluster", "distance"])

    return rows.mapInArrow(assign, schema)


def _sums(rows: DataFrame, dims: int, k: int) -> list:
    """For each cluster with members: number, squared radius, sums of its components. Each task sums its own rows first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            at, distance, vectors = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy(), matrix(batch.column("x"), dims)
            for i in np.unique(at):
                own = at == i
                n[i] += own.sum()
                far[i] = max(far[i], distance[own].max())
                of = vectors[own]
                wide = len(of) * max(abs(int(of.min(initial=0))), abs(int(of.max(initial=0)))) >= 1 << 63
                sums[i] += of.astype(object).sum(axis=0) if wide else of.sum(axis=0).astype(object)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": held.astype(np.int32), "n": n[held], "far": far[held], "sums": [[str(v) for v in sums[i]] for i in held]}, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("far", pa.int64()), ("sums", pa.list_(pa.string()))]))

    parts = rows.select("x", "cluster", "distance").mapInArrow(add, "cluster int, n long, far long, sums array<string>")
    totals = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[t for t in totals]).alias("sums") if dims else F.array().alias("sums")).collect()  # at most k rows


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2:") -> tuple[DataFrame, DataFrame]:
    """Clusters the vectors of exactly ``dims`` components, none null or non-finite, as integers floor(256 * x).

    First centroids: the k vectors with the smallest sha256 of ``seed`` and the id, in that order.  A round assigns every vector
    to the nearest centroid (ties: the smaller number), then moves each centroid with members to the componentwise floor of
    their mean; the others stay.  After the rounds all vectors are assigned once more.

    Returns (members, centroids): members has id, cluster, distance (squared), a row for each kept input row;
    centroids has cluster, n, cluster_inertia, centroid (array of longs), centroid_sha256.

    Other vectors are left out.  Repeated ids are rows like others (a repeated first centroid leaves its second copy without
    members); rows without an id are clustered, and are first centroids after all others; among equal ids the smaller vector comes first.
    With fewer than k vectors there are fewer centroids; an empty table gives empty results.  Other columns of the
    input are not read, so their names can't clash.  Squared distances must fit in 64 bits, else an error is raised.
    """
    rows = df.select(df[id_col].alias("id"), df[vector_col].alias("v")).where((F.size("v") == dims) & usable(F.col("v"))).select("id", integers(F.col("v")).alias("x"))
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    if not first:
        none = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return none, none.select("cluster", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cluster_inertia"), F.array(F.lit(0).cast("long")).alias("centroid"), F.lit("").alias("centroid_sha256"))
    now = table(_assigned(rows, dims, centroids, None), "balls")
    for _ in range(rounds):
        radii: list[int | None] = [None] * len(centroids)
        after = centroids.copy()
        for r in _sums(now, dims, len(centroids)):
            after[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
            step = int(((after[r["cluster"]].astype(object) - centroids[r["cluster"]].astype(object)) ** 2).sum())
            radii[r["cluster"]] = _moved(r["far"], step)
        centroids = after
        before, now = now, table(_assigned(now, dims, centroids, neighbours(centroids, radii)), "balls")
        forget(before)
    shown = [(i, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    shown = df.sparkSession.createDataFrame(shown, "cluster int, centroid array<long>, centroid_sha256 string")
    held = now.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("cluster_inertia"))
    centers = shown.join(held, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cluster_inertia", F.lit(0)).alias("cluster_inertia"), "centroid", "centroid_sha256")
    return now.select("id", "cluster", "distance"), centers
