"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of any number of preceding words.  A context of k words is a candidate if its own k-word run is an
entry of the tree; it becomes a state if its tail is one and it passes the divergence test: its next-word distribution
beats its tail's on its own occurrences by LEAST_GAIN nats (its count times the divergence).  Entries of a state are next
words seen LEAST_COUNT times or more that it makes likelier by LEAST_ENTRY nats; the rest of its mass goes by its tail's
distribution.  The root is the add-half unigram distribution over all training words and one unknown.  The tree grows a
word at a time until no level has an entry; its thresholds are counts, the same for any corpus.

Each token is scored in the state of its longest suffix.  Since the states are closed under tails, the log probability is
the root's plus one term for each state on the way down and one for each entry.  Both belong to a run of words, which as a
context stands once before each of its next words: a text's score is a sum over the keys of its runs.  The tree is
therefore one table (key, values), never held whole anywhere: counts, divergence tests and scores are aggregations and
joins by key.

Two things of fixed size go to all workers, and change no result.  Bitmaps of BITS tell which keys may be in a table (a wrong
yes costs a row that no join matches), and the CACHE most frequent keys are looked up at once instead of by join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import forget, table, tidy

LEAST_COUNT, LEAST_GAIN, LEAST_ENTRY, SMOOTHING = 4, 6.0, 2.0, 2.0
BITS, CACHE = 27, 1 << 18
SHELF_BITS = 18
END = np.uint64(0x5851F42D4C957F2D)
BLOCK_BYTES = 4 << 20


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 5, is 1; rows without id are for training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tokens:
    """Words and one end for each text of a block: hashes, texts and places in them."""

    def __init__(self, column: pa.Array):
        words = tx.Words(column)
        self.counts = words.counts + 1
        stops = np.cumsum(self.counts)
        self.hash = np.full(int(stops[-1]) if len(stops) else 0, END, np.uint64)
        word = np.ones(len(self.hash), bool)
        word[stops - 1] = False
        self.hash[word] = words.hashes()
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.hash)) - (stops - self.counts)[self.text]

    def runs(self) -> Iterator[np.ndarray]:
        """Keys of the runs of 1, 2, .. words that end at each token; meaningless where the run would cross texts."""
        keys = self.hash
        while True:
            yield keys
            keys = longer(np.concatenate(([np.uint64(0)], keys[:-1])), keys)


def longer(context: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Key of a run: context is all but its last word, tail all but its first."""
    return tx.mix(context * np.uint64(0xD6E8FEB86659FD93) + tail)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key the place of one that is equal, and how many are; an order of equal keys is not asked for, so it need not be stable."""
    order = np.argsort(keys)
    heads = np.flatnonzero(_heads(keys[order]))
    return order[heads], np.diff(np.append(heads, len(keys)))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def shelves(keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys of each of 2**SHELF_BITS equal spans begin, and the end: keys are hashes, so a span has a few."""
    spans = np.arange(1 << SHELF_BITS, dtype=np.uint64) << np.uint64(64 - SHELF_BITS)
    return np.append(np.searchsorted(keys, spans), len(keys)).astype(np.int32)


def find(keys: np.ndarray, begins: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted keys with their shelves, or -1."""
    out = np.full(len(wanted), -1)
    shelf = (wanted >> np.uint64(64 - SHELF_BITS)).astype(np.int64)
    at, end = begins[shelf], begins[shelf + 1]
    left = np.flatnonzero(at < end)
    at, end, wanted = at[left], end[left], wanted[left]
    while len(left):
        hit = keys[at] == wanted
        out[left[hit]] = at[hit]
        at += 1
        more = np.flatnonzero(~hit & (at < end))
        left, at, end, wanted = left[more], at[more], end[more], wanted[more]
    return out


def bitmaps(keys: DataFrame, *marks: Column) -> list[np.ndarray]:
    """For each mark 2**BITS bits; two of a ``key`` are set if a row of it has the mark. Their size does not depend on the number of rows."""
    low = (1 << BITS) - 1
    keys = keys.withColumn("slot", F.explode(F.array(F.col("key").bitwiseAND(F.lit(low)), F.shiftright("key", 32).bitwiseAND(F.lit(low)))))
    slot = F.col("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    with tidy(keys.sparkSession):
        words = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(*[F.bit_or(F.when(m, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i, m in enumerate(marks)]).toArrow()
    out = []
    for i in range(len(marks)):
        bits = np.zeros(((low + 1) >> 6) or 1, np.uint64)
        bits[words.column("at").to_numpy()] = words.column(f"m{i}").to_numpy().view(np.uint64)
        out.append(bits)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(keys), bool)
    for slot in (keys & low, (keys >> np.uint64(32)) & low):
        out &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).view(np.uint64)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for block in tx.blocks(batches, "text", BLOCK_BYTES):
        yield Tokens(block.column("text").filter(pa.array([not held_out(i) for i in block.column("id").to_pylist()], pa.bool_())))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _training(batches):
        keys, n = np.unique(t.hash, return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n.astype(np.int64))], names=["key", "n"])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = longer(_unsigned(b.column("context")), _unsigned(b.column("tail")))
        yield pa.RecordBatch.from_arrays([*b.columns, _signed(key)], names=["context", "tail", "n", "key"])


def _count(rows: DataFrame, length: int, contexts: np.ndarray, tails: np.ndarray) -> DataFrame:
    """(context, tail, n, key): runs of ``length`` + 1 words with a candidate context, seen LEAST_COUNT times or more."""
    sent = rows.sparkSession.sparkContext.broadcast((contexts, tails))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _training(batches):
            runs = t.runs()
            for _ in range(length):
                keys = next(runs)
            context = np.concatenate(([np.uint64(0)], keys[:-1])) if len(keys) else keys
            at = np.flatnonzero((t.place >= length) & may_hold(sent.value[0], context) & may_hold(sent.value[1], keys))
            first, n = grouped(next(runs)[at])
            yield pa.RecordBatch.from_arrays([_signed(context[at[first]]), _signed(keys[at[first]]), pa.array(n.astype(np.int64))], names=["context", "tail", "n"])

    counted = rows.mapInArrow(run, "context long, tail long, n long").groupBy("context", "tail").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return counted.mapInArrow(_with_key, "context long, tail long, n long, key long")


def _meet(counted: DataFrame, above: DataFrame) -> DataFrame:
    """Counted runs with the count of their context (total), and their tail's log probability (up) and whether its context is a state (closed)."""
    context = above.where("entry").select(F.col("key").alias("context"), F.col("n").alias("total"))
    tail = above.select(F.col("key").alias("tail"), F.col("log").alias("up"), F.col("open").alias("closed"))
    return counted.join(tail, "tail").join(context, "context").select("context", "key", "n", "total", "up", "closed")


def _level(told: DataFrame) -> DataFrame:
    """Runs of one level of the tree: key, n, context, log (of their probability by the tree so far), open (their context is a state), entry, step and rest.

    step is what an entry adds to the log probability, rest what its state adds.
    """
    whole = F.col("total") + SMOOTHING
    told = told.withColumn("likelier", F.col("n") * (F.log(F.col("n") / whole) - F.col("up") * F.log(F.lit(10.0))) >= LEAST_ENTRY)
    mass = told.groupBy("context").agg(F.sum(F.when(F.col("likelier"), F.col("n")).otherwise(0)).alias("held"))
    p = told.join(mass, "context").withColumn("left", (whole - F.col("held")) / whole)
    p = p.withColumn("p", F.log10(F.col("n") / whole + F.col("left") * F.pow(F.lit(10.0), "up")))
    gain = F.sum(F.when(F.col("likelier"), F.col("n") * (F.col("p") - F.col("up"))).otherwise(0.0)) + F.first(F.col("total") - F.col("held")) * F.first(F.log10("left"))
    states = p.groupBy("context").agg((F.first("closed") & (gain * F.log(F.lit(10.0)) >= LEAST_GAIN)).alias("open"))
    out = p.join(states, "context").withColumn("rest", F.log10("left")).withColumn("entry", F.col("open") & F.col("likelier"))
    log = F.when(F.col("entry"), F.col("p")).when(F.col("open"), F.col("rest") + F.col("up")).otherwise(F.col("up"))
    return out.select("key", "n", "total", "context", log.alias("log"), "open", "entry", (F.col("p") - F.col("up") - F.col("rest")).alias("step"), "rest")


def learn(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(id, text) -> the tree as a table (key, n, word, base, more), its depth, and the numbers of training tokens and of distinct ones."""
    words = table(rows.mapInArrow(_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    none = F.lit(0.0)
    parts = [words.select("key", "n", F.lit(True).alias("word"), F.log10((F.col("n") + 0.5) / 0.5).alias("base"), none.alias("more"))]
    above = words.where(F.col("n") >= LEAST_COUNT).select("key", "n", F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("log"), F.lit(True).alias("open"), (F.col("key") != int(END.view(np.int64))).alias("entry"))
    length, levels = 1, [words]
    while (held := bitmaps(above, F.col("entry"), F.lit(True)))[0].any():
        counted = table(_count(rows, length, *held), "counts")
        told = table(_meet(counted, above), "runs")
        above = table(_level(told), "level")
        levels.append(above)
        forget(counted)
        forget(told)
        states = above.where("open").groupBy(F.col("context").alias("key")).agg(F.first("total").alias("n"), F.first("rest").alias("more"))
        parts += [above.where("entry").select("key", "n", F.lit(False).alias("word"), none.alias("base"), F.col("step").alias("more")), states.select("key", "n", F.lit(False).alias("word"), none.alias("base"), "more")]
        length += 1
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.unionByName(part)
    tree = table(tree.groupBy("key").agg(F.max("n").alias("n"), F.max("word").alias("word"), F.sum("base").alias("base"), F.sum("more").alias("more")), "tree")
    for level in levels:
        forget(level)
    return tree, length - 1, total, distinct


def _cached(tree: DataFrame) -> tuple[float, pa.Table]:
    """The most frequent keys, CACHE at most: all whose count reaches a bound."""
    steps = tree.groupBy(F.floor(4 * F.log2("n")).alias("bin")).count().orderBy(F.desc("bin")).collect()  # some 250 rows at most
    bound, held = 1e300, 0
    for row in steps:
        held += row["count"]
        if held > CACHE:
            break
        bound = row["bin"]
    with tidy(tree.sparkSession):
        return bound, tree.where(F.floor(4 * F.log2("n")) >= bound).select("key", "word", "base", "more").toArrow()


OWN = pa.struct([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("more", pa.float64())])
ASKED = "block long, row int, key long, times long, own struct<id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,more:double>"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Null text is empty: its end alone is scored.  Null ids count as training rows; repeated rows are
    rows like others, in training too; very long texts are read whole.  An empty table gives an empty result; without any
    training row every token is unknown.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tree, depth, total, distinct = learn(rows)
    unknown = float(np.log10(0.5 / (total + 0.5 * (distinct + 1))))
    bound, cached = _cached(tree)
    rare = tree.where(F.floor(4 * F.log2("n")) < bound)
    order = np.argsort(_unsigned(cached.column("key")))
    cache = [_unsigned(cached.column("key"))[order], *(cached.column(c).to_numpy()[order] for c in ("word", "base", "more"))]
    cache.insert(1, shelves(cache[0]))
    sent = rows.sparkSession.sparkContext.broadcast((cache, *bitmaps(rare, F.lit(True))))
    names = [x.split()[0] for x in ASKED.split(", ")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row of its own, with the sums over cached keys, and one for each other key that may be in the tree."""
        (keys, begins, is_word, base_of, more_of), bits = sent.value
        task = TaskContext.get()
        for number, block in enumerate(tx.blocks(batches, "text", BLOCK_BYTES)):
            name = ((task.partitionId() if task else 0) << 32) | number  # the same when a lost task runs again
            t, ids = Tokens(block.column("text")), block.column("id").to_pylist()
            n, sums = len(ids), np.zeros((3, len(ids)))
            asked: list[tuple[np.ndarray, np.ndarray]] = []
            runs, found = t.runs(), np.zeros(0, bool)
            for length in range(depth + 1):  # words, then runs of one word more whose context may be in the tree
                run = next(runs)
                live = np.flatnonzero(t.place >= length) if length < 2 else np.flatnonzero((t.place >= length) & np.append(False, found[:-1]))
                at = find(keys, begins, run[live])
                hit, text = at >= 0, t.text[live]
                for i, of in enumerate((is_word, base_of, more_of)):
                    sums[i] += np.bincount(text[hit], of[at[hit]], minlength=n)
                ask = np.flatnonzero(~hit)
                ask = ask[may_hold(bits, run[live[ask]])]
                asked.append((text[ask], run[live[ask]]))
                found = np.zeros(len(run), bool)
                found[live[hit]] = found[live[ask]] = True
            own = pa.StructArray.from_arrays([block.column("id"), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(t.counts.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], fields=list(OWN))
            row = np.arange(n, dtype=np.int32)
            no_key = _signed(tx.mix((np.uint64(name) << np.uint64(20)) + row.astype(np.uint64)))  # spreads these rows; of no account whatever it meets, as times is 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(row), no_key, pa.array(np.zeros(n, np.int64)), own], names=names)
            text, key = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.argsort(key + text.astype(np.uint64) * np.uint64(tx.BASE))  # equal rows follow each other; should others come between, times are told in two rows
            text, key = text[order], key[order]
            new = np.flatnonzero(_heads(text, key))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), name)), pa.array(text[new].astype(np.int32)), _signed(key[new]), pa.array(np.diff(np.append(new, len(key)))), pa.nulls(len(new), OWN)], names=names)

    met = rows.mapInArrow(local, ASKED).join(rare.select("key", "word", "base", "more").hint("shuffle_hash"), "key", "left").where("word is not null or times = 0")
    times = lambda c: F.coalesce(F.sum(F.col("times") * c), F.lit(0))
    own = [F.max(f"own.{c}").alias(f"own_{c}") for c in ("id", "held_out", "n_tokens", "n_known", "base", "more")]  # a struct's maximum would need sorted rows
    out = met.groupBy("block", "row").agg(*own, times(F.col("word").cast("long")).alias("known"), times(F.col("base")).alias("base"), times(F.col("more")).alias("more"))
    base = F.col("own_base") + F.col("base") + F.col("own_n_tokens") * F.lit(unknown)
    return out.select(F.col("own_id").alias(id_col), F.col("own_held_out").alias("held_out"), F.col("own_n_tokens").alias("n_tokens"), (F.col("own_n_known") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("own_more") + F.col("more")).alias("score"))
