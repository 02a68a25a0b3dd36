"""MinHash near-dedup with tensored banding, every link confirmed on the full shingle sets.

Each document gets two small collections of SIDE keys, each key a run of ROWS minhashes; table
(i, j) is keyed by the pair (key i of the first collection, key j of the second).  SIDE * SIDE
tables so cost 2 * SIDE * ROWS minhashes, about the square root of what separate bands would.
A pair of similarity s meets unless all keys of one side differ: (1 - s**ROWS)**SIDE twice; for
0.85, 14 and 4 that is 6e-5.

Equal sets are one class from the start.  Classes that meet in any bucket form clusters; within a
cluster all pairs are confirmed, block against block in matrix products, so that neither a group's
pairs become rows nor a large cluster meets in one task.  Each pair of blocks gives a spanning
forest of its links, and components of these are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import uuid
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import connected_components
from .scratch import table

SIDE, ROWS, SHINGLE, PERCENT = 14, 4, 5, 85
#: A block holds about so many classes and shingles.
BLOCK_CLASSES, BLOCK_SHINGLES, COLUMNS = 512, 300_000, 4096
SEEDS = np.array([(0xA0761D6478BD642F * (2 * i + 3) ** 3) % (1 << 64) | 1 for i in range(2 * SIDE * ROWS)], np.uint64)


def side_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * SIDE keys for each non-empty set."""
    joined = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * SIDE), np.uint64)
    for i in range(2 * SIDE):
        key = np.full(len(sets), i + 1, np.uint64)
        for r in range(ROWS):
            seed = SEEDS[i * ROWS + r]
            least = np.minimum.reduceat((joined ^ (joined >> np.uint64(32)) ^ seed) * seed, starts)
            key = tx.mix(key * np.uint64(0xD6E8FEB86659FD93) + least)
        out[:, i] = key
    return out


def _signatures(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, text_col):
            sets = tx.shingle_sets(tx.Words(block.column(text_col)), SHINGLE)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = side_keys([sets[i] for i in full]) if full else np.zeros((0, 2 * SIDE), np.uint64)
            bands: list[list[int] | None] = [None] * len(sets)
            for i, row in zip(full, keys.view(np.int64).tolist(), strict=True):
                bands[i] = row
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([block.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "print", "bands"])

    return run


def _sets(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, text_col):
            sets = tx.shingle_sets(tx.Words(block.column(text_col)), SHINGLE)
            yield pa.RecordBatch.from_arrays([block.column(id_col), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the graph of alike pairs between the sets numbered ``left`` and ``right`` (the same: within)."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    number = np.cumsum(held > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int((held > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        sides = []
        for side, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, COLUMNS), np.float32)
            p = place[side, rows[a:b]]
            m[p[p >= 0], column[a:b][p >= 0] - at] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    both = both.astype(np.int64)
    alike = 100 * both >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - both)
    out, open_ = [], np.ones(len(sets), bool)
    for seed in left:
        if not open_[seed]:
            continue
        open_[seed], reached, edge = False, [seed], np.array([seed])
        while len(edge):
            l, r = place[0, edge], place[1, edge]
            near = np.zeros(len(sets), bool)
            near[right[alike[l[l >= 0]].any(0)]] = True
            near[left[alike[:, r[r >= 0]].any(1)]] = True
            edge = np.flatnonzero(near & open_)
            open_[edge] = False
            reached.extend(edge.tolist())
        out += [(int(ids[seed]), int(ids[x])) for x in reached[1:]]
    return out


def _forest(group: pa.Table) -> pa.Table:
    ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
    low, high = own.min(), own.max()
    links = forest(ids, sets, np.flatnonzero(own == low), np.flatnonzero(own == high)) if low == group.column("i")[0].as_py() and high == group.column("j")[0].as_py() else []
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def _met(classes: DataFrame) -> DataFrame:
    """(u, v): each class with the least class of every bucket that it shares.

    A side's keys that nobody shares can't be half of a shared pair, so pairs are formed of shared keys only.
    """
    sides = classes.select("id", F.posexplode("bands").alias("i", "key"))
    shared = sides.groupBy("key").count().where("count > 1").select("key")
    sides = sides.join(shared, "key", "left_semi").groupBy("id").agg(*[F.collect_list(F.when(half, F.col("key"))).alias(x) for x, half in (("a", F.col("i") < SIDE), ("b", F.col("i") >= SIDE))])
    keys = sides.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "id")
    keys = table(keys, "bands")
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return keys.join(hubs, "key").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``docs``.

    Rows without words (null, empty) have no shingles and stay alone; a null id stays alone with a
    null component; rows that share an id are taken as one node; equal ids and equal texts (repeated rows) hang together; texts of any
    length are read whole; an empty table gives an empty result.  Other columns are not read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signs = table(rows.mapInArrow(_signatures("id", "text"), "id long, n long, print binary, bands array<long>"), "signatures")
    known = signs.where("id is not null and n > 0")
    classes = known.groupBy("print").agg(F.min(F.struct("id", "n", "bands")).alias("c")).select("print", "c.*")
    clusters = table(connected_components(_met(classes)).join(classes.select(F.col("id").alias("node"), "n"), "node").select(F.col("node").alias("id"), "n", F.col("component").alias("cluster")), "clusters")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = clusters.join(blocks, "cluster").select("id", "cluster", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("own")).distinct()
    sets = rows.join(clusters.select("id"), "id", "left_semi").mapInArrow(_sets("id", "text"), "id long, shingles binary")
    dealt = members.join(sets, "id").select("id", "cluster", "own", "shingles", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("id", "cluster", "own", "shingles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    links = table(dealt.groupBy("cluster", "i", "j").applyInArrow(_forest, "u long, v long"), "links")

    # equal sets and rows of one id hang together; then everything at once
    firsts = known.join(classes.select("print", F.col("id").alias("first")), "print").select("id", "first")
    same = firsts.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    all_ = connected_components(links.unionByName(same))
    out = signs.select("id", F.col("n").alias("n_shingles"))
    out = out.join(all_, out.id == all_.node, "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near-duplicates of a row with a smaller id, and but for repeated ids' copies within a group."""
    own = f"dropped_{uuid.uuid4().hex}"
    drop = near_duplicates(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(own)).distinct()
    return docs.join(drop, docs[id_col] == F.col(own), "left_anti")
