"""Ball k-means and exact top-k search against plain NumPy, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from graphloom.llm import ball_kmeans, top_k

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.StringType()) for c in ("id", "x", "v", "cluster", "distance", "block", "g", "query_id")]])
NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors_of(spark):
    return lambda rows: spark.createDataFrame([(i, v, *["z"] * 8) for i, v in rows], ROW)


def cloud(seed, n, dims, spread=0.3):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(7, dims))
    return [(i, (centers[r.integers(7)] + spread * r.normal(size=dims)).tolist()) for i in range(n)]


def whole(rows, dims=None):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and dims in (None, len(v))]
    return [(i, [math.floor(256 * x) for x in v]) for i, v in ok]


def plain_kmeans(rows, k, rounds, dims):
    kept = whole(rows, dims)
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]
    at = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        found = [at(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f == j]
            if own:
                centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((repr(i), *at(v)[::-1]) for i, v in kept), centers


ODD_VECTORS = [(900, None), (901, [None] * 6), (902, [NAN] + [0.0] * 5), (903, [INF] + [0.0] * 5), (904, []), (905, [1.0] * 5), (906, [0.0] * 6), (906, [0.0] * 6), (None, [0.1] * 6), (907, [-0.001] * 6)]


@pytest.mark.parametrize("k, rounds", [(9, 5), (3, 1), (40, 2), (2, 0)])
def test_ball_kmeans(vectors_of, k, rounds):
    rows = cloud(1, 300, 6) + [(1000 + i, [0.5] * 6) for i in range(150)] + ODD_VECTORS
    members, centroids = ball_kmeans.cluster(vectors_of(rows).repartition(5), k=k, rounds=rounds, dims=6)
    want, centers = plain_kmeans(rows, k, rounds, 6)
    assert sorted((repr(r["id"]), r["cluster"], r["distance"]) for r in members.collect()) == want
    got = sorted(centroids.collect(), key=lambda r: r["cluster"])
    assert [r["centroid"] for r in got] == centers
    assert [r["centroid_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    assert [r["n"] for r in got] == [sum(w[1] == j for w in want) for j in range(len(centers))]
    assert [r["cluster_inertia"] for r in got] == [sum(w[2] for w in want if w[1] == j) for j in range(len(centers))]


def test_ball_kmeans_few_and_none(vectors_of):
    members, centroids = ball_kmeans.cluster(vectors_of([(1, [1.0, 2.0]), (2, [1.5, 2.0])]), dims=2)
    assert sorted((r["id"], r["distance"]) for r in members.collect()) == [(1, 0), (2, 0)] and centroids.count() == 2
    members, centroids = ball_kmeans.cluster(vectors_of([(1, None)]), dims=2)
    assert members.columns == ["id", "cluster", "distance"] and members.count() == centroids.count() == 0


def test_distances_are_exact_at_any_size():
    r = np.random.default_rng(3)
    for reach in (1 << 10, 1 << 27, 1 << 31):  # doubles, 64 bits, Python's own integers
        x, c = r.integers(-reach, reach, (40, 5)), r.integers(-reach, reach, (6, 5))
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for v in x]
        at, best = ball_kmeans.nearest(x, c)
        assert [(int(d), int(j)) for d, j in zip(best, at, strict=True)] == want
        start = r.integers(0, 6, 40).astype(np.int32)
        radii = [max([int(((x[i].astype(object) - c[j].astype(object)) ** 2).sum()) for i in np.flatnonzero(start == j)], default=None) for j in range(6)]
        at, best = ball_kmeans.reassign(x, start, c, ball_kmeans.neighbours(c, radii))
        assert [(int(d), int(j)) for d, j in zip(best, at, strict=True)] == want


def test_neighbours_are_few():
    """Balls that are far apart are not compared."""
    c = np.array([[0, 0], [3, 0], [1000, 0], [1003, 0]])
    assert [[j for _, j in n] for n in ball_kmeans.neighbours(c, [4, 4, 4, None])] == [[1], [0], [3], []]


def plain_top(queries, rows, k):
    found = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i is not None and i != q)
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(found)


@pytest.mark.parametrize("block, held, bits", [(1024, 4, 10), (7, 1, 3)])
def test_top_k(vectors_of, monkeypatch, block, held, bits):
    for name, value in (("BLOCK_ROWS", block), ("HELD", held), ("BITS", bits)):
        monkeypatch.setattr(top_k, name, value)
    copy = cloud(2, 1, 6)[0][1]
    rows = cloud(1, 200, 6) + [(1000 + i, copy) for i in range(120)] + ODD_VECTORS + [(2000, copy), (2000, copy)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = sorted(tuple(r) for r in top_k.search(vectors_of(queries).repartition(3), vectors_of(rows).repartition(5), k=4).collect())
    assert got == plain_top(whole(queries), whole(rows), 4)


def test_top_k_few_and_none(vectors_of):
    rows = [(0, [1.0, -2.0]), (1, [0.5, 0.5]), (2, [-3.0, 1.0])]
    got = sorted(tuple(r) for r in top_k.search(vectors_of(rows[:1]), vectors_of(rows)).collect())
    assert got == plain_top(whole(rows[:1]), whole(rows), 5) and len(got) == 2
    assert top_k.search(vectors_of(rows[:1]), vectors_of(rows[:1])).count() == 0
    assert top_k.search(vectors_of([]), vectors_of(rows)).count() == 0 and top_k.search(vectors_of(rows), vectors_of([])).count() == 0
    with pytest.raises(OverflowError):
        top_k.search(vectors_of([(1, [1e12])]), vectors_of([(2, [1e12])]))


def test_scores_beyond_doubles(vectors_of):
    rows = [(i, [float((1 << 21) + i), float(i * i), -1.0]) for i in range(60)]
    got = sorted(tuple(r) for r in top_k.search(vectors_of(rows[:3]), vectors_of(rows)).collect())
    assert got == plain_top(whole(rows[:3]), whole(rows), 5)
