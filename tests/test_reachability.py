"""Ancestors and subtrees of deep chains, wide trees and cycles against a plain walk."""

import random

import pytest

from graphloom.operators.graph import ancestors, nearest_ancestor, subtree


def plain_up(parents, start):
    found, at, depth = {}, start, 0
    while (at := parents.get(at)) is not None and at in parents and at not in found and at != start:
        depth += 1
        found[at] = depth
    return found


@pytest.fixture(scope="module")
def forest():
    r = random.Random(3)
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(150)}  # a chain of 150
    parents |= {f"t{i}": f"t{r.randrange(max(1, i))}" if i else "" for i in range(120)}
    parents |= {f"y{i}": f"y{(i + 1) % 20}" for i in range(20)}  # a cycle
    parents |= {f"z{i}": f"z{i - 1}" if i else "y5" for i in range(40)}  # a chain into it
    parents |= {"self": "self", "lost": "nowhere", "deep": "c149"}
    return parents


def frame(spark, parents):
    return spark.createDataFrame([(i, p, "big" if i in ("c3", "t0") else "small") for i, p in parents.items()], "id string, parent_id string, kind string")


def test_ancestors(spark, forest):
    nodes = frame(spark, forest)
    starts = ["c149", "deep", "c5", "t119", "y3", "z39", "self", "lost", "c0"]
    got = {}
    for r in ancestors(nodes, nodes.where(nodes.id.isin(starts))).collect():
        assert r["ancestor"] not in got.setdefault(r["id"], {})
        got[r["id"]][r["ancestor"]] = r["depth"]
    assert got == {s: up for s in starts if (up := plain_up(forest, s))}
    assert dict(nearest_ancestor(nodes, nodes.where("id in ('deep', 't119', 'y3')"), "big").collect()) == {"deep": "c3", "t119": "t0"}


def test_subtrees(spark, forest):
    nodes = frame(spark, forest)
    down = {}
    for i, p in forest.items():
        down.setdefault(p, []).append(i)
    for roots in (["c0"], ["t0"], ["y5"], ["c10", "c140", "z0"], ["self"], ["deep"]):
        want, level = {r: 0 for r in roots}, roots
        while level:
            level = [c for p in level for c in down.get(p, ()) if c not in want and not want.update({c: want[p] + 1})]
        got = subtree(nodes, nodes.where(nodes.id.isin(roots))).collect()
        assert len(got) == len(want) and {r["id"]: r["depth"] for r in got} == want
