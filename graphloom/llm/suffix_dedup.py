"""Exact substring dedup by blockwise suffix sorting with difference-cover sample ranks.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller id, or same
document and earlier).  All suffixes of the corpus are too many to sort, so they are dealt into
buckets first: a LENGTH-byte window belongs to the bucket of its minimizer, the GRAM-byte string of
least hash in it.  Equal windows have equal minimizers, so a bucket whose minimizer stands once
in the corpus has no match and is dropped before any text moves.

Runs of windows of one minimizer move as one segment of text, and suffix buckets are sorted one at
a time.  Suffixes are ranked by their first COVER bytes; longer ties are settled by the ranks of a
difference-cover sample, whose phase is counted from the minimizer so that both suffixes of a
comparison meet the sample at the same distance.  A task holds one bucket at a time, without the segments that repeat
whole within a block; a bucket over 16 MB is sorted in parts of equal windows.  What bounds memory is so the largest bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .compact_windows import dealt, repeated

LENGTH, GRAM, COVER = 100, 24, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of segments sorted together; a larger bucket is sorted in parts of equal windows.
BATCH_BYTES = 2 << 20


def difference_cover(v: int) -> list[int]:
    """Residues whose differences give every residue modulo v: greedy, each step covers the most new differences."""
    cover, seen = [0], {0}
    while len(seen) < v:
        best = max(range(1, v), key=lambda r: (len(({(r - c) % v for c in cover} | {(c - r) % v for c in cover}) - seen), -r) if r not in cover else (-1, 0))
        cover.append(best)
        seen |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
    return sorted(cover)


COVERED = difference_cover(COVER)
#: For each phase the least distance of 4 to COVER + 3 bytes to a sampled position: 2 * COVER bytes from there reach the last COVER of the window.
TO_SAMPLE = np.array([next(d for d in range(LENGTH - 3 * COVER, LENGTH) if (phase + d) % COVER in COVERED) for phase in range(COVER)])
IN_SAMPLE = np.isin(np.arange(COVER), COVERED)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one minimizer: text number, start and last window (bytes in the text), minimizer's byte and hash."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    sums = tx.prefix(data)
    grams = tx.mix((sums[GRAM:] - sums[:-GRAM]) * tx.powers(tx.BASE_INVERSE, n + 1)[: n - GRAM + 1])
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :]) if SPAN > size else low
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # minimizer of the window from each byte
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[: len(at)] == of[LENGTH - 1 :]
    fresh = inside.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    starts, lasts = np.flatnonzero(fresh), np.flatnonzero(last)
    text = of[starts]
    return text, starts - offsets[text], lasts - offsets[text], at[starts] - offsets[text], grams[at[starts]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tx.blocks(batches, "text"):
        data, offsets = tx.raw(block.column("text"))
        text, start, last, at, key = segments(data, offsets)
        ids = block.column("id").to_numpy()
        place = (start << 16) | ((last - start) << 8) | (at - start)
        rows, deal, told = dealt(key)
        yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(told), pa.array(ids[text[rows]]), pa.array(place[rows])], names=["deal", "told", "id", "place"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in repeated(batches):
        yield batch.select(["id", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of text to sort; a segment that stands earlier in the batch already is a hit (empty bytes)."""
    for block in tx.blocks(batches, "text", 8 << 20):
        data, offsets = tx.raw(block.column("text"))
        ids = block.column("id").to_numpy()
        places = block.column("places")
        many = np.diff(np.append(np.asarray(places.offsets), [])).astype(np.int64)
        place = np.asarray(places.flatten())
        row = np.repeat(np.arange(len(ids)), many)
        start = place >> 16
        size = ((place >> 8) & 255) + LENGTH
        order = np.lexsort((start, ids[row]))
        row, start, size, at = row[order], start[order], size[order], (place & 255)[order]
        low = offsets[row] + start
        key = tx.spans(data, low + at, low + at + GRAM).view(np.int64)
        whole = tx.spans(data, low, low + size)
        _, first, of = np.unique(whole, return_index=True, return_inverse=True)
        new = np.zeros(len(row), bool)
        new[first] = True
        buffer = data.tobytes()
        for i in np.flatnonzero(~new).tolist():  # equal hashes are only a hint
            a, b, s = int(low[i]), int(low[first[of[i]]]), int(size[i])
            new[i] = size[first[of[i]]] != s or buffer[a : a + s] != buffer[b : b + s]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(new, key, tx.mix(whole + np.arange(len(whole), dtype=np.uint64)).view(np.int64))), pa.array(ids[row]), pa.array(start), pa.array(size), pa.array(at),
                pa.array([buffer[a : a + s] if w else b"" for a, s, w in zip(low.tolist(), size.tolist(), new.tolist(), strict=True)], pa.binary()),
            ],
            names=["key", "id", "start", "size", "at", "bytes"],
        )


def later_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte of data whether the window from there, in its segment, is equal to an earlier one.

    starts, sizes: of segments, in order of (id, position) so that an earlier byte of data is an earlier place; at: minimizers.
    """
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | wide[k : k + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)

    def doubled(rank: np.ndarray, by: int, among: np.ndarray | None = None) -> np.ndarray:
        ahead = np.concatenate((rank[by:], np.zeros(min(by, n), np.uint64)))[:n]
        pair = rank * np.uint64(n + 1) + ahead
        if among is None:
            return np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        out = np.zeros(n, np.uint64)
        out[among] = np.unique(pair[among], return_inverse=True)[1]
        return out

    rank = doubled(doubled(rank, 8), 16)  # by the first COVER bytes
    segment = np.repeat(np.arange(len(starts)), sizes)
    phase = (np.arange(n) - (starts + at)[segment]) % COVER
    sample = doubled(rank, COVER, np.flatnonzero(IN_SAMPLE[phase]))  # by 2 * COVER bytes
    window = np.flatnonzero(np.arange(n) <= (starts + sizes - LENGTH)[segment])
    ends = np.unique(rank[window] * np.uint64(n + 1) + rank[window + LENGTH - COVER], return_inverse=True)[1].astype(np.uint64)
    phase = phase[window]  # the same for equal windows; others may meet the sample elsewhere
    full = (ends * np.uint64(COVER) + phase.astype(np.uint64)) * np.uint64(n + 1) + sample[window + TO_SAMPLE[phase]]
    _, first = np.unique(full, return_index=True)
    later = np.zeros(n, bool)
    later[window] = True
    later[window[first]] = False
    return later


def _hits(ids: np.ndarray, place: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Spans covered by later windows of the segments; sorted here by place."""
    order = np.lexsort((place, ids))
    ends = np.cumsum(size)
    data = np.concatenate([data[ends[i] - size[i] : ends[i]] for i in order.tolist()])
    ids, place, size, at = ids[order], place[order], size[order], at[order]
    starts = np.cumsum(size) - size
    later = later_windows(data, starts, size, at)
    step = np.diff(np.concatenate(([0], later.astype(np.int8), [0])))
    low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    segment = np.searchsorted(starts, low, "right") - 1
    base = place[segment] - starts[segment]
    return pa.RecordBatch.from_arrays([pa.array(ids[segment]), pa.array(low + base), pa.array(high - 1 + LENGTH + base)], names=["id", "start", "stop"])


def _sort_bucket(ids: np.ndarray, place: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One batch of whole buckets; one that is too large in parts, by hash of the window: equal windows meet in a part."""
    if len(data) <= 8 * BATCH_BYTES:
        yield _hits(ids, place, size, at, data)
        return
    starts = np.cumsum(size) - size
    segment = np.repeat(np.arange(len(size)), size)
    window = np.flatnonzero(np.arange(len(data)) <= (starts + size - LENGTH)[segment])
    part = tx.spans(data, window, window + LENGTH)
    parts = -(-len(window) * LENGTH // BATCH_BYTES)
    for p in range(parts):
        own = window[part % np.uint64(parts) == p]
        if len(own):
            s = segment[own]
            picked = data[(own[:, None] + np.arange(LENGTH)).ravel()]
            yield _hits(ids[s], place[s] + own - starts[s], np.full(len(own), LENGTH), starts[s] + at[s] - own, picked)


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order: segments of text, or hits that pass through. Buckets are sorted whole, small ones together."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, size = rows.column("key").to_numpy(), np.cumsum(rows.column("size").to_numpy())
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
        at = 0
        while at < len(key):
            full = np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES)
            to = int(ends[min(np.searchsorted(ends, max(full, at + 1)), len(ends) - 1)])
            part = rows.slice(at, to - at).combine_chunks()
            data, _ = tx.raw(part.column("bytes"))
            yield from _sort_bucket(*(part.column(c).to_numpy() for c in ("id", "start", "size", "at")), data)
            at = to

    held: list[pa.RecordBatch] = []
    for batch in batches:
        hits = np.asarray(pa.compute.binary_length(batch.column("bytes"))) == 0
        if hits.any():
            found = batch.filter(pa.array(hits))
            low = found.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([found.column("id"), found.column("start"), pa.array(low + found.column("size").to_numpy())], names=["id", "start", "stop"])
            batch = batch.filter(pa.array(~hits))
        if batch.num_rows:
            held.append(batch)
            one_bucket = held[0].column("key")[0] == held[-1].column("key")[-1]  # nothing is whole yet
            if not one_bucket and sum(b.column("bytes").nbytes for b in held) >= BATCH_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                key = rows.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                yield from done(rows.slice(0, last))
                held = rows.slice(last).to_batches()
    if held:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = (text.as_py() or "").encode()
            pieces, merged, done = [], [], 0
            for low, high in sorted((s["start"], s["stop"]) for s in spans.as_py()):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            for low, high in merged:
                pieces.append(data[done:low])
                done = high
            pieces.append(data[done:])
            kept = b"".join(pieces)
            out.append((len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in merged]))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[4] for x in out], spans)], names=["id", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, removed): removed are the maximal runs of bytes that go.

    Null text is empty.  Rows of null id are neither compared nor changed.  Rows that share an id and a text are one
    document; of rows that share an id alone neither is earlier by its id, and their order is that of the places.
    Texts under LENGTH bytes never change; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signs = rows.select("id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    firsts = signs.where("id is not null").groupBy("sha").agg(F.min("id").alias("first"))
    long_ = rows.where((F.octet_length("text") >= LENGTH) & F.col("id").isNotNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = long_.mapInArrow(_anchors, "deal long, told byte, id long, place long")
    shared = anchors.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(_repeated, "id long, place long")
    own = signs.join(firsts, "sha").where("id = first").select("id").distinct()
    places = shared.groupBy("id").agg(F.collect_list("place").alias("places")).join(own, "id", "left_semi")
    cut = long_.join(places, "id").select("id", "text", "places").mapInArrow(_cut, "key long, id long, start long, size long, at long, bytes binary")
    hits = cut.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sorted_buckets, "id long, start long, stop long")
    spans = hits.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = long_.join(spans, "id").select("id", "text", "spans").mapInArrow(_remove, "id long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>")
    out = signs.join(firsts, "sha", "left").join(changed.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("stop")))
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:bigint,stop:bigint>>"))).alias("removed"),
    )
