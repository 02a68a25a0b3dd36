"""Counts, reports and status folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_below, language_of
from ..schema import LANGUAGE_LIMIT


def languages(nodes: DataFrame, most: int = LANGUAGE_LIMIT) -> DataFrame:
    return nodes.where("language is not null").select("language").distinct().orderBy("language").limit(most)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node and edge counts and sorted languages."""
    n = nodes.agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # two one-row frames


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))


def samples(path: Column, most: int = 5) -> Column:
    """The first paths of a group, in order, of bounded size: a max-heap of ``most`` is not built in, so the set is sorted."""
    return F.slice(F.array_sort(F.collect_list(path)), 1, most)


def language_report(files: DataFrame, most: int = 5) -> DataFrame:
    """(language, file_count, sample_paths): by count, then name. Samples come from a ranking, so no group is gathered."""
    from pyspark.sql import Window as W

    rows = files.select("path", language_of(F.col("path")).alias("language")).where("language is not null")
    counts = rows.groupBy("language").agg(F.count("*").alias("file_count"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("language").orderBy("path"))).where(F.col("n") <= most)
    picked = first.groupBy("language").agg(F.array_sort(F.collect_list("path")).alias("sample_paths"))
    return counts.join(picked, "language").orderBy(F.col("file_count").desc(), "language")


def first_rule(paths: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(path, rule): the first rule, in order, whose condition a path meets."""
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return paths.select("path", out.alias("rule")).where("rule is not null")


def below_count(elements: DataFrame, folder: str) -> DataFrame:
    return elements.where(F.col("is_active") & is_below(F.col("path"), F.lit(folder))).agg(F.count("*").alias("n"))


def fold_run_status(results: DataFrame) -> DataFrame:
    """(run_id, status) of parser results: all fine success, some fine partial, none failed; nothing skipped."""
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status").isin("failed", "missing"))
    return results.groupBy("run_id").agg(F.when((ok > 0) & (bad == 0), "success").when(ok > 0, "partial").when(bad > 0, "failed").otherwise("skipped").alias("status"))


def ingest_status(errors: Column, nodes: Column, successes: Column) -> Column:
    return F.when((errors > 0) | ((nodes == 0) & (successes > 0)), "partial").otherwise("success")


def latest_status(runs: DataFrame, newest: int = 5) -> DataFrame:
    """(parser_id, status) over the newest runs: runs (id, started_at, results array of struct(parser_id, status)); of runs of one time that of greater id is newer."""
    some = runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(newest)
    rows = some.select(F.struct("started_at", "id").alias("at"), F.explode("results").alias("r"))
    return rows.groupBy("r.parser_id").agg(F.max_by("r.status", "at").alias("status"))


def merged_counts(reports: list[DataFrame], most: int = 5) -> DataFrame:
    """(language, file_count, sample_paths) of several detectors: counts summed, the first ``most`` of all their sample paths."""
    rows = reports[0]
    for report in reports[1:]:
        rows = rows.unionByName(report)
    return rows.groupBy("language").agg(F.sum("file_count").alias("file_count"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sample_paths")))), 1, most).alias("sample_paths"))


def bus_profile(files: DataFrame, hints: dict[str, dict[str, list[str]]]) -> DataFrame:
    """One row: for each bus the files (path, text) that hold one of its hints for their ending, and the parser: rabbit's whenever it is there."""

    def signal(bus: str) -> Column:
        out = F.lit(False)
        for ending, marks in hints[bus].items():
            for mark in marks:
                out = out | (F.col("path").endswith(ending) & F.contains("text", F.lit(mark)))
        return F.coalesce(out, F.lit(False))

    counts = files.agg(*[F.count_if(signal(bus)).alias(bus) for bus in ("rabbit", "kafka")])
    return counts.withColumn("parser_id", F.when(F.col("rabbit") > 0, "bus-rabbit").when(F.col("kafka") > 0, "bus-kafka"))


def detect(files: DataFrame, rules: list[tuple[str, str, str | None]], most: int = 5) -> DataFrame:
    """(rule, file_count, sample_paths): rules as data (name, pattern of the path, text that the content must hold or None); a file may meet several."""
    met = F.array(*[F.when(F.col("path").rlike(pattern) & (F.lit(True) if hint is None else F.coalesce(F.contains("text", F.lit(hint)), F.lit(False))), name) for name, pattern, hint in rules])
    rows = files.select("path", F.explode(F.array_compact(met)).alias("language"))
    from pyspark.sql import Window as W

    counts = rows.groupBy("language").agg(F.count("*").alias("file_count"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("language").orderBy("path"))).where(F.col("n") <= most)
    picked = first.groupBy("language").agg(F.array_sort(F.collect_list("path")).alias("sample_paths"))
    return counts.join(picked, "language").withColumnRenamed("language", "rule")


def job_order(jobs: DataFrame) -> DataFrame:
    """jobs (parser_id, language or null, artifact_type, file_count) -> with ``place``, from 1: the order in which parsers run.

    Languages come first, by number of files.  Of artifacts compose comes first and openapi last; call sites of gRPC wait for the
    methods' definitions; else the one of more files goes first, of equals the first by type.  That is the topological
    order that always takes the job of the most files among those that need not wait.  One row a parser, so one task sorts them.
    """
    from pyspark.sql import Window as W

    waits, defines, kind = F.endswith("parser_id", F.lit("grpc-calls")), F.col("parser_id") == "grpc-proto", F.coalesce("artifact_type", "language", "parser_id")
    rank = F.when(F.col("language").isNotNull(), 0).when(kind == "compose", 1).when((F.col("parser_id") == "openapi") | (kind == "openapi"), 3).otherwise(2)
    every = W.partitionBy(F.lit(1))
    defined = F.max(F.when(defines, F.struct("file_count", kind.alias("kind")))).over(every)
    rows = jobs.withColumns({"_rank": rank, "_kind": kind, "_defined": defined})
    # A job that would come before what it waits for stands right behind it.
    held = waits & F.col("_defined").isNotNull() & ((F.col("file_count") > F.col("_defined.file_count")) | ((F.col("file_count") == F.col("_defined.file_count")) & (F.col("_kind") < F.col("_defined.kind"))))
    held = F.coalesce(held, F.lit(False))
    order = W.partitionBy(F.lit(1)).orderBy("_rank", F.when(held, F.col("_defined.file_count")).otherwise(F.col("file_count")).desc(), F.when(held, F.col("_defined.kind")).otherwise(F.col("_kind")), held, F.col("file_count").desc(), "_kind", "parser_id")
    return rows.withColumn("place", F.row_number().over(order)).drop("_rank", "_kind", "_defined")


def post_sync_report(files: DataFrame, artifacts: list[tuple[str, str, str | None]], frontends: list[Column], most: int = 5) -> DataFrame:
    """(part, name, file_count, sample_paths) of files (path, text) after a sync: languages, artifacts by rule (see :func:`detect`), and the
    languages of frontends, whose detectors are conditions on the path; a file that several of them meet counts for each."""
    languages = language_report(files, most).select(F.lit("language").alias("part"), F.col("language").alias("name"), "file_count", "sample_paths")
    found = detect(files, artifacts, most).select(F.lit("artifact").alias("part"), F.col("rule").alias("name"), "file_count", "sample_paths")
    merged = merged_counts([language_report(files.where(test), most) for test in frontends], most)
    return languages.unionByName(found).unionByName(merged.select(F.lit("frontend").alias("part"), F.col("language").alias("name"), "file_count", "sample_paths"))
