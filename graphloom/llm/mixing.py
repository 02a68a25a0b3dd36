"""Mixing sources to target weights by systematic sampling.

Targets: every source gets ``weight`` shares of all words, but at most ``most_copies`` times
what it has; what is over goes to the others by weight.  That is one water level: a source
takes min(most_copies * size, level * weight), and prefix sums over the sources in the order
in which they fill up give the level.

Sampling: the expected copies of each document (target / size of its source) are prefix-summed
within the source, one random offset is added, and a document is emitted once for each integer
crossed.  Documents stand in size classes, so each source's words come near its target.  A
source is dealt into many small cells (size class and hash of the id; more with more rows), whose totals alone are
prefix-summed by source: a source with a third of all rows is no hot group.  Words are counted once, into a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import table

WORD = r"[^\x20\x09-\x0D]+"
#: A source and size class has at least so many cells, and one for so many rows of the corpus.
CELLS, ROWS_A_CELL = 64, 1 << 16


def word_count(text: Column) -> Column:
    """Number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column) -> Column:
    """The source's random offset in [0, 1): reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def cycle_weights(sizes: DataFrame, source: str, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: sources by code point, null last, take the weights in turn."""
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))


def targets(sizes: DataFrame, most_copies: int = 3) -> DataFrame:
    """(.., source_size, weight) -> adds ``target``: the water level over capped sources. One row a source."""
    cap = F.col("source_size") * most_copies
    fills = W.orderBy((cap / F.col("weight")).asc(), F.col("source_order").asc())
    upto = fills.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("source_order", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("left_size", F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(upto), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", F.when(F.col("left_size") * F.col("weight") <= cap * F.col("left_weight"), F.col("left_size") / F.col("left_weight")))
    )
    level = F.first("level", ignorenulls=True).over(fills.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).drop("left_size", "left_weight", "level", "source_order")


def cell(id_: Column, cells: int) -> Column:
    """The id's cell; a null id's is the first."""
    digits = F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8)
    return F.coalesce(F.conv(digits, 16, 10).cast("long") % cells, F.lit(0))


def expected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_copies: int = 3, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (the text if ``keep_text``) and _size, _source_size, _target, _copies (0 to most_copies) for each row.

    Null text has size 0; null source is a source of its own; a source of size 0 has target 0 and
    no copies; ids may be of any type, repeated ids and null ids are rows like others, and rows of one id and size are dealt in
    any order; texts of any length are counted whole; an empty table gives an empty result.  Columns of the names above are
    replaced.  The sources themselves are taken to be few: their totals are ranked in one task.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_copies")
    rows = docs.withColumns({"_size": word_count(F.col(text_col)), "_mx_source": F.col(source_col).cast("string")})
    rows = table(rows if keep_text else rows.drop(text_col), "sizes")
    cells = max(CELLS, -(-rows.count() // ROWS_A_CELL))
    rows = rows.withColumns({"_mx_class": F.length(F.bin("_size")), "_mx_cell": cell(F.col(id_col), cells)})
    key = ["_mx_source", "_mx_class", "_mx_cell"]
    held = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("_size").alias("words"))
    sizes = held.groupBy(F.col("_mx_source").alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(cycle_weights(sizes, "source"), most_copies)
    before = F.sum("n").over(W.partitionBy("_mx_source").orderBy("_mx_class", "_mx_cell").rowsBetween(W.unboundedPreceding, -1))
    held = held.select(*[F.col(c).alias(f"{c}_c") for c in key], F.coalesce(before, F.lit(0)).alias("_mx_before"))
    held = held.join(goal.select("source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target")), F.col("_mx_source_c").eqNullSafe(F.col("source"))).drop("source")
    rank = F.row_number().over(W.partitionBy(key).orderBy("_size", F.col(id_col).asc_nulls_last()))
    on = F.col(key[0]).eqNullSafe(F.col(f"{key[0]}_c")) & (F.col(key[1]) == F.col(f"{key[1]}_c")) & (F.col(key[2]) == F.col(f"{key[2]}_c"))
    rows = rows.withColumn("_mx_rank", rank).join(held, on, "left")
    share = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    to = F.col("_mx_before") + F.col("_mx_rank")
    copies = F.floor(offset(F.col("_mx_source")) + share * to) - F.floor(offset(F.col("_mx_source")) + share * (to - 1))
    rows = rows.withColumn("_copies", F.least(copies.cast("long"), F.lit(most_copies).cast("long")))  # a large prefix sum's rounding could cross one boundary more
    return rows.drop(*[c for c in rows.columns if c.startswith("_mx_")])


def mix_sources(docs: DataFrame, **names) -> DataFrame:
    """The mix: each row of ``docs`` once for every copy, with ``copy`` from 1."""
    rows = expected(docs, **names).where("_copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_size", "_source_size", "_target", "_copies")
