import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import compact_windows as cw
from graphloom.llm import suffix_dedup as sd
from graphloom.llm import suffix_tree_lm
from graphloom.llm import text as tx


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1f", max_size=30)), max_size=6))
def test_words_are_those_of_the_contract(texts):
    words = tx.Words(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    got = [[bytes(words.data[s:e]) for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)] for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
    assert got == want
    hashes = words.hashes()
    flat = [w for t in want for w in t]
    assert len({(w, int(h)) for w, h in zip(flat, hashes, strict=True)}) == len(set(flat))


def test_sliced_and_null_columns():
    column = pa.array(["aa", None, "bb cc", "dd"]).slice(1, 2)
    data, offsets = tx.raw(column)
    assert bytes(data) == b"bb cc" and offsets.tolist() == [0, 0, 5]


def test_blocks_hold_long_texts_whole():
    batch = pa.record_batch({"text": ["x" * 100, "y", "z" * 5]})
    assert [b.num_rows for b in tx.blocks(iter([batch]), "text", 10)] == [1, 2]


@settings(deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(1, 9))
def test_cartesian_spans(values, least):
    h = np.array(values, np.uint64) << np.uint64(32)
    got = list(zip(*(x.tolist() for x in cw.cartesian_spans(h, least)), strict=True))
    want = []
    for c, v in enumerate(values):
        left = next((i for i in range(c - 1, -1, -1) if values[i] <= v), -1) + 1
        right = next((i for i in range(c + 1, len(values)) if values[i] < v), len(values)) - 1
        if right - left + 1 >= least:
            want.append((c, left, right))
    assert sorted(got) == want


def test_spans_of_many_texts_at_once():
    """Each text was read by calls of its own, once for each hash function: 330 calls or so a text."""
    import cProfile
    import pstats

    r = random.Random(4)
    hashes = [np.array([r.choice([0, 3, 2**32 - 1, r.randrange(2**32)]) << 32 for _ in range(r.choice([2, 5, 6, 40]))], np.uint64) for _ in range(60)]
    apart = np.concatenate([[len(h) < 5] * len(h) + [True] * 4 for h in hashes])
    joined = np.concatenate([np.append(h, np.full(4, 2**63, np.uint64)) for h in hashes])
    starts = np.cumsum([0, *(len(h) + 4 for h in hashes)])
    want = [(c + at, l + at, x + at) for h, at in zip(hashes, starts, strict=False) for c, l, x in zip(*(v.tolist() for v in cw.cartesian_spans(h, 5)), strict=True)]
    assert list(zip(*(v.tolist() for v in cw.cartesian_spans(joined, 5, apart)), strict=True)) == want and len(want) > 100

    texts = [" ".join(str(r.randrange(99)) for _ in range(r.choice([0, 1, 49, 50, 120]))) for _ in range(200)]
    batch = pa.record_batch({"id": pa.array(range(200), pa.int64()), "text": texts})
    with cProfile.Profile() as made:
        found = pa.Table.from_batches(cw._windows(iter([batch])))
    assert pstats.Stats(made).total_calls < 20 * len(texts)
    alone = [pa.Table.from_batches(cw._windows(iter([batch.slice(i, 1)]))) for i, t in enumerate(texts) if len(t.split()) >= 50]
    rows = lambda t: sorted(zip(*(t.column(n).to_pylist() for n in ("content", "id", "c", "before", "behind", "told")), strict=True))
    held = lambda t: [x for x in rows(t) if x[-1] != 1]
    assert {x[:-1] for x in held(found)} == {x[:-1] for t in alone for x in held(t)}


def test_shared_labels_of_two_passages():
    """Sums over rectangles give what sets give, with labels that repeat or stand in one side alone."""
    r = np.random.default_rng(5)
    a, b = r.integers(-20, 400, (24, cw.WIDE)).astype(np.int32), r.integers(-20, 400, (24, cw.WIDE)).astype(np.int32)
    for x in range(0, 24, 2):  # half of the pairs without repeats, some aligned, some shifted
        a[x] = r.permutation(cw.WIDE * 2)[: cw.WIDE] - 20
        b[x] = np.roll(a[x], x) if x % 4 else r.permutation(a[x])
    repeats = np.array([any(len(set(own)) < len(own) for own in (p[p > 0].tolist(), q[q > 0].tolist())) for p, q in zip(a, b, strict=True)])
    assert 8 <= repeats.sum() <= 12
    both, least = cw._both(a, b, repeats), cw.LEAST
    for x in range(24):
        p, q = ([{v for v in side[x][i : i + least].tolist() if v > 0} for i in range(least)] for side in (a, b))
        assert both[:, :, x].tolist() == [[len(s & t) for t in q] for s in p]
    counted = a > 0
    assert cw._distinct(cw._before(a), counted).tolist() == [[len({v for v in row[i : i + least] if v > 0}) for i in range(least)] for row in a.tolist()]


def brute(texts):
    seen, out = set(), {}
    for i, t in texts:
        data, cover = (t or "").encode(), bytearray(len((t or "").encode()))
        for j in range(len(data) - 99):
            if data[j : j + 100] in seen:
                cover[j : j + 100] = b"\1" * 100
            else:
                seen.add(data[j : j + 100])
        out[i] = (sum(cover), hashlib.sha256(bytes(b for b, c in zip(data, cover, strict=True) if not c)).hexdigest())
    return out


def random_texts(n=60):
    r = random.Random(3)
    base = ["".join(r.choice("ab é") for _ in range(400)) for _ in range(5)] + ["xy " * 150, "q" * 300]
    out = []
    for i in range(n):
        a, b, k = r.choice(base), r.choice(base), r.randrange(250)
        out.append((i, a[k : k + r.randint(50, 180)] + "é" * r.randrange(3) + b[: r.randrange(300)]))
    return out


def test_suffix_dedup_against_brute_force(spark):
    texts = [*random_texts(), (100, None), (101, ""), (102, "short"), (103, "short"), (104, random_texts()[7][1])]
    df = spark.createDataFrame([*texts, (100, None), (None, "q" * 300)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS key", "3 AS spans")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in sd.remove_repeats(df).where("doc_id is not null").collect()}
    assert got == brute(texts)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_large_buckets_in_parts(monkeypatch):
    rows = random_texts(80)
    monkeypatch.setattr(sd, "BATCH_BYTES", 600)
    table = pa.table({"id": pa.array([i for i, _ in rows]), "text": [t for _, t in rows]})
    parts = []
    for b in sd._anchors(iter(table.to_batches())):
        parts.append(b.to_pandas())
    import pandas as pd

    places = pd.concat(parts).query("told != 1").groupby("id").place.apply(list).reset_index().rename(columns={"place": "places"})
    cut = pa.Table.from_batches(list(sd._cut(iter(pa.Table.from_pandas(table.to_pandas().merge(places, on="id"), preserve_index=False).to_batches(max_chunksize=9)))))
    ordered = cut.sort_by("key").to_batches(max_chunksize=17)
    cover = {i: set() for i, _ in rows}
    for b in sd._sorted_buckets(iter(ordered)):
        for i, a, z in zip(*(b.column(c).to_pylist() for c in ("id", "start", "stop")), strict=True):
            cover[i] |= set(range(a, z))
    assert {i: len(c) for i, c in cover.items()} == {i: n for i, (n, _) in brute(rows).items()}


def test_difference_cover():
    for v in (3, 7, 32, 64):
        d = sd.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 3 * v**0.5 + 2


@pytest.mark.parametrize("shift", [0, 3])
def test_alike_spans(shift):
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 32, 200, dtype=np.uint32)
    b = a.copy()
    b[[80, 120]] += 1
    spans = cw.alike_spans(a, np.roll(b, shift) if shift else b)
    assert spans and spans[0][1] - spans[0][0] >= 46
    assert cw.alike_spans(a, r.integers(0, 1 << 32, 200, dtype=np.uint32)) == []


def test_bytes_are_classed_as_told():
    every = np.arange(256, dtype=np.uint8)
    assert tx.lowered(every).tobytes() == bytes(range(256)).lower()
    assert np.flatnonzero(tx.spaces(every)).tolist() == [9, 10, 11, 12, 13, 32]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_suffix_tree_lookups(n):
    """Keys found by shelves are those found by a search of all, also where many keys or none share a shelf; groups are those of a stable sort."""
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 64, n, np.uint64), np.arange(n, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(n, dtype=np.uint64))))
    wanted = np.concatenate((keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 50, np.uint64)))
    at = suffix_tree_lm.find(keys, suffix_tree_lm.shelves(keys), wanted)
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert at.tolist() == [place.get(k, -1) for k in wanted.tolist()]
    rows = wanted[rng.integers(0, len(wanted), 2 * n)]
    first, times = suffix_tree_lm.grouped(rows)
    uniq, count = np.unique(rows, return_counts=True)
    assert rows[first].tolist() == uniq.tolist() and times.tolist() == count.tolist()
