"""Exact top-k search by inner product: distributed histogram selection.

Every query is scored against every candidate, in blocks of both.  A round makes a histogram of each
query's scores over the interval in which its k-th highest score is known to lie, one interval for each
bin; the global histogram, summed over all tasks, says which bin holds it, and that bin is the next
round's interval, until it is one score wide.  Then one more scan keeps the scores above the k-th one
and, of those equal to it, the smallest ids.

A task reports only the bins from the top down to that in which its own scores reach the wanted
number: the global bin can't lie below.  So what a round shuffles grows with queries and tasks, not with
queries times candidates, and many equal scores are one bin with a count.  Blocks of queries are copied to
each of the candidates' groups (as many as there are shuffle partitions) and joined with their blocks on the group.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import forget, table
from .vectors import EXACT, integers, largest, matrix, usable

#: Bits of a score that a round resolves, bytes of vectors in a block at most (or one vector), rows of a block at most.
BITS, BLOCK_BYTES, BLOCK_ROWS = 10, 1 << 18, 1 << 10
#: Blocks of queries whose histograms a task holds at once; older ones are reported and summed by Spark.
HELD = 4


def blocks(rows: DataFrame) -> DataFrame:
    """(id, x) -> (block, dims, ids, data): blocks of vectors of one length, as binary 64-bit integers. Block numbers hold once written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(dims: int) -> pa.RecordBatch:
            ids, data = zip(*waiting.pop(dims), strict=True)
            return pa.RecordBatch.from_pydict({"dims": [dims], "ids": [np.concatenate(ids).tobytes()], "data": [np.concatenate(data).tobytes()]}, pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            ids, x = batch.column("id").to_numpy(), batch.column("x")
            lengths = x.value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                values, most = matrix(x.take(pa.array(own)), dims), max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dims, 1))))
                at = 0
                while at < len(own):
                    held = waiting.setdefault(dims, [])
                    to = at + most - sum(len(i) for i, _ in held)
                    held.append((ids[own[at:to]], values[at:to]))
                    if to <= len(own):
                        yield out(dims)
                    at = to
        for dims in list(waiting):
            yield out(dims)

    packed = rows.select("id", "x").mapInArrow(pack, "dims int, ids binary, data binary")
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")


class Pairs:
    """Scores of the pairs of blocks that a task meets."""

    def __init__(self, exact: bool):
        self.kind = np.float64 if exact else np.int64

    def scores(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the candidates, scores as integers by query and candidate, and whether a pair counts: a query is no candidate of its own."""
        qids, cids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q = np.frombuffer(row["q_data"], np.int64).reshape(len(qids), row["q_dims"])
        c = np.frombuffer(row["data"], np.int64).reshape(len(cids), row["dims"])
        both = min(row["q_dims"], row["dims"])
        found = (q[:, :both].astype(self.kind) @ c[:, :both].astype(self.kind).T).astype(np.int64)
        return cids, found, qids[:, None] != cids[None, :]


def _histograms(pairs: DataFrame, exact: bool, shift: int, bins: int) -> DataFrame:
    """(block, row, bin, n): bins of each query's scores in its interval, from the top until the wanted number is reached."""
    schema = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def report(block: int, counts: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        row, at = np.nonzero((counts > 0) & (above < need[:, None]))
        return pa.RecordBatch.from_arrays([np.full(len(row), block), row.astype(np.int32), at.astype(np.int32), counts[row, at]], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Pairs(exact), OrderedDict()
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                _, scores, counts_ = seen.scores(row)
                low, need = np.array(row["low"], np.int64), np.array(row["need"], np.int64)
                at = (scores - low[:, None]) >> shift
                keep = counts_ & (at >= 0) & (at < bins)
                flat = (np.arange(len(low))[:, None] * bins + at)[keep]
                now = np.bincount(flat, minlength=len(low) * bins).reshape(len(low), bins)
                before = held.pop(row["q_block"], None)
                held[row["q_block"]] = (now if before is None else now + before[0], need)
                if len(held) > HELD:
                    block, kept = held.popitem(last=False)
                    yield report(block, *kept)
        for block, kept in held.items():
            yield report(block, *kept)

    return pairs.mapInArrow(count, "block long, row int, bin int, n long")


def _winners(pairs: DataFrame, exact: bool) -> DataFrame:
    """(query_id, block, row, vec_id, score): scores above the k-th, and of those equal to it the smallest ids that the task meets."""
    schema = pa.schema([("query_id", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def out(block: int, qids: np.ndarray, *found: np.ndarray) -> pa.RecordBatch:
        row, ids, scores = found
        return pa.RecordBatch.from_arrays([qids[row], np.full(len(row), block), row.astype(np.int32), ids, scores], schema=schema)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ties = Pairs(exact), OrderedDict()

        def least(block: int) -> pa.RecordBatch:
            qids, low, need, row, ids = ties.pop(block)
            return out(block, qids, row, ids, low[row])

        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                cids, scores, counts = seen.scores(r)
                low, need, qids = np.array(r["low"], np.int64), np.array(r["need"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                row, at = np.nonzero(counts & (scores > low[:, None]))
                if len(row):
                    yield out(r["q_block"], qids, row, cids[at], scores[row, at])
                row, at = np.nonzero(counts & (scores == low[:, None]))
                ids = cids[at]
                if r["q_block"] in ties:
                    *_, old, before = ties.pop(r["q_block"])
                    row, ids = np.concatenate([old, row]), np.concatenate([before, ids])
                order = np.lexsort((ids, row))
                row, ids = row[order], ids[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < need[row]
                ties[r["q_block"]] = (qids, low, need, row[keep], ids[keep])
                if len(ties) > HELD:
                    yield least(next(iter(ties)))
        for block in list(ties):
            yield least(block)

    return pairs.mapInArrow(pick, "query_id long, block long, row int, vec_id long, score long")


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of the highest inner product of integer vectors, ties to the smaller id.

    Components are floor(256 * x), x as double.  A candidate with the query's own id is none of its candidates; with fewer than
    k others all are returned, with none the query has no rows.  Vectors that are null or hold null or non-finite components, and rows
    without an id (which no result could name), take no part.  Vectors of different lengths are multiplied as far as
    both go; an empty vector scores 0.  Repeated queries are each answered; repeated candidates are candidates each.  Ids are
    longs; other columns are not read, so their names can't clash.  An empty table gives an empty result.  Scores
    must fit in 62 bits, else an error is raised before anything is scored.
    """
    spark = candidates.sparkSession
    picked = lambda df: df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", integers(F.col("v")).alias("x"))
    empty = "query_id long, rank int, vec_id long, score long"
    largest_q, dims_q = largest(picked(queries), "x")
    largest_c, dims_c = largest(picked(candidates), "x")
    bound = largest_q * largest_c * min(dims_q, dims_c)
    if bound >= 1 << 62:
        raise OverflowError("scores do not fit in 62 bits")
    exact = bound < EXACT
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = table(blocks(picked(queries).repartition(max(1, -(-picked(queries).count() // BLOCK_ROWS)))), "queries")
    held = table(blocks(picked(candidates)), "candidates").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    spread = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    bits = bound.bit_length() + 1  # of the interval [-2^(bits-1), 2^(bits-1))
    rows = F.sequence(F.lit(0), (F.length("ids") / 8 - 1).cast("int"))
    state = table(asked.select(F.col("block").alias("s_block"), F.transform(rows, lambda _: F.lit(-(1 << (bits - 1))).cast("long")).alias("low"), F.transform(rows, lambda _: F.lit(k).cast("long")).alias("need")), "state")
    pairs = lambda: held.join(spread.join(state, F.col("q_block") == F.col("s_block")), "g")
    while bits:
        shift = max(0, bits - BITS)
        found = _histograms(pairs(), exact, shift, 1 << (bits - shift)).groupBy("block", "row", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("block", "row").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0))
        wanted = state.select("s_block", F.posexplode(F.arrays_zip("low", "need")).alias("row", "s"))
        ranked = found.withColumn("upto", upto).join(wanted.select(F.col("s_block").alias("block"), "row", "s"), ["block", "row"], "right")
        chosen = ranked.groupBy("block", "row").agg(
            F.max(F.when(F.col("upto") >= F.col("s.need"), F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))).alias("hit"),
            F.coalesce(F.sum(F.when(F.col("bin") > 0, F.col("n"))), F.lit(0)).alias("rest"), F.first("s").alias("s"),
        )
        # With fewer scores than wanted in the interval all are wanted: the lowest bin.
        at, above = F.coalesce(F.col("hit.bin"), F.lit(0)), F.coalesce(F.col("hit.above"), F.col("rest"))
        chosen = chosen.select("block", F.struct("row", (F.col("s.low") + at * F.lit(1 << shift)).alias("low"), (F.col("s.need") - above).alias("need")).alias("s"))
        packed = chosen.groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most BLOCK_ROWS rows
        before, state = state, table(packed.select(F.col("block").alias("s_block"), F.col("s.low").alias("low"), F.col("s.need").alias("need")), "state")
        forget(before)
        bits = shift
    order = W.partitionBy("block", "row").orderBy(F.col("score").desc(), "vec_id")
    best = _winners(pairs(), exact).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(*[F.col(c.split()[0]) for c in empty.split(", ")])
