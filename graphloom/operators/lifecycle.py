"""Mutations as pure functions from (old state, batch) to new state, and the choice of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestor_paths, is_below
from ..functions.text import merge_metadata
from ..schema import CASCADE_LIMIT, EDGE_TYPES, NODE_KINDS
from .filters import ready
from .joins import vanished


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows take the place of old ones of their key; of several new ones the first in the order stays (without one, that of least hash)."""
    order = order or [_hash(new)]
    new = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return old.join(new.select(keys), keys, "left_anti").select(new.columns).unionByName(new)


def _hash(rows: DataFrame) -> Column:
    return F.xxhash64(F.to_json(F.struct(*rows.columns)))


def merge_nodes(old: DataFrame, new: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """Field by field, new values that are not null first; metadata maps merged key by key.

    Duplicates of a batch are folded first: each field's last value that is not null, in the order (without one, by hash).
    """
    fields = [c for c in old.columns if c != key]
    new = new.withColumn("_at", _hash(new) if order is None else order)
    new = new.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in fields])
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in fields])
    out = o.join(new, key, "full")
    return out.select(key, *[(merge_metadata(F.col(f"o_{c}"), F.col(c)) if c == "metadata" else F.coalesce(c, f"o_{c}")).alias(c) for c in fields])


def delete_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the rows of (parser_id, path)."""
    return rows.join(paths.select("parser_id", "path").distinct(), ["parser_id", "path"], "left_anti").select(rows.columns)


def copy_run(rows: DataFrame, source: str, target: str) -> DataFrame:
    """``rows`` and a copy of one run's under another id."""
    return rows.unionByName(rows.where(F.col("run_id") == source).withColumn("run_id", F.lit(target)))


def keep_run(rows: DataFrame, project: str, run: str) -> DataFrame:
    return rows.where((F.col("project_id") != project) | (F.col("run_id") == run))


def cascade_status(elements: DataFrame, folder: str, status: str, limit: int = CASCADE_LIMIT) -> DataFrame:
    """A folder's status and its active descendants'; lifting not_needed changes the folder alone; too many descendants are an error."""
    own = F.col("path") == folder
    lifted = elements.where(own & (F.col("status") == "not_needed")).agg((F.count("*") > 0).alias("lift")).first()["lift"] and status != "not_needed"
    hit = own if lifted else own | (F.col("is_active") & is_below(F.col("path"), F.lit(folder)))
    if not lifted:
        n = elements.where(F.col("is_active") & is_below(F.col("path"), F.lit(folder))).count()
        if n > limit:
            raise ValueError(f"{n} elements below {folder}; the limit is {limit}")
    return elements.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "status_manually_set": F.when(hit, F.lit(True)).otherwise(F.col("status_manually_set"))})


def soft_delete(elements: DataFrame, seen: DataFrame) -> DataFrame:
    """Active elements that a scan did not meet turn inactive."""
    gone = vanished(elements, seen).select("id", F.lit(True).alias("_gone"))
    return elements.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone").select(elements.columns)


def sync_upserts(elements: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, type, status, is_new): what a scan writes. Unchanged rows are skipped, manual statuses stay, and new ones
    below a manual, active not_needed folder inherit that; others are auto_found."""
    old = elements.select("path", F.col("status").alias("old"), F.col("is_active").alias("was"), F.col("status_manually_set").alias("manual"), F.lit(True).alias("known"))
    muted = elements.where("status = 'not_needed' and status_manually_set and is_active").select(F.col("path").alias("a"))
    heirs = scanned.select("path", F.explode(ancestor_paths(F.col("path"))).alias("a")).join(muted, "a", "left_semi").select("path").distinct().withColumn("inherits", F.lit(True))
    rows = scanned.join(old, "path", "left").join(heirs, "path", "left")
    fresh = F.when(F.col("inherits"), "not_needed").otherwise("auto_found")
    status = F.when(F.col("known") & F.col("manual"), F.col("old")).when(F.col("inherits"), "not_needed").when(F.col("known"), F.col("old")).otherwise(fresh)
    rows = rows.withColumn("status", status)
    return rows.where(F.col("known").isNull() | ~F.col("was") | (F.col("status") != F.col("old"))).select("path", "type", "status", F.col("known").isNull().alias("is_new"))


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified (time or size) or deleted files between two snapshots."""
    b = before.select("path", F.col("mtime_ms").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("b"))
    a = after.select("path", F.col("mtime_ms").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "modified")
    return b.join(a, "path", "full").select("path", change.alias("change")).where("change is not null")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest ready run with nodes that is no shrunken increment, else the newest with the most nodes; none without nodes."""
    good = ready(runs).where("node_count > 0")
    good = good.withColumn("most", F.lit(good.agg(F.max("node_count")).first()[0]).cast("long"))
    shrunken = (F.col("node_count") < F.col("most")) & F.col("incremental") & (F.col("deleted") == 0)
    rank = F.when(~shrunken, 0).when(F.col("node_count") == F.col("most"), 1)
    return good.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.col("started_at").desc(), "id").limit(1).drop("rank", "most")


def bootstrap_source(runs: DataFrame, excluded: str) -> DataFrame:
    """The ready run with the most nodes, the newest of equals."""
    return ready(runs).where((F.col("id") != excluded) & (F.col("node_count") > 0)).orderBy(F.col("node_count").desc(), F.col("started_at").desc(), "id").limit(1)


def recover(runs: DataFrame) -> DataFrame:
    """Runs that a stop interrupted count as failed."""
    return runs.withColumn("status", F.when(F.col("status").isin("running", "pending"), "failed").otherwise(F.col("status")))


def start_job(jobs: DataFrame, kind: str, job: str, at: str) -> DataFrame:
    """A new running job; a running one of its kind is cancelled."""
    old = jobs.withColumn("status", F.when((F.col("kind") == kind) & (F.col("status") == "running"), "cancelled").otherwise(F.col("status")))
    new = jobs.sparkSession.range(1).select(F.lit(job).alias("id"), F.lit(kind).alias("kind"), F.lit("running").alias("status"), F.lit(at).alias("updated_at"))
    return old.unionByName(new)


def register(projects: DataFrame, asked: DataFrame) -> DataFrame:
    """Projects with those asked for that are not there yet, by source type and value."""
    keys = ["source_type", "source_value"]
    return projects.unionByName(asked.dropDuplicates(keys).join(projects.select(keys), keys, "left_anti").select(projects.columns))


def check_batch(nodes: DataFrame, edges: DataFrame, allowed_paths: DataFrame | None = None) -> DataFrame:
    """(item, reason): everything wrong with an external batch; a batch with any row here is refused as a whole."""
    bad = nodes.where(~F.col("kind").isin(NODE_KINDS)).select(F.col("id").alias("item"), F.lit("unknown kind").alias("reason"))
    bad = bad.unionByName(edges.where(~F.col("type").isin(EDGE_TYPES)).select(F.col("id").alias("item"), F.lit("unknown type").alias("reason")))
    if allowed_paths is not None:
        bad = bad.unionByName(nodes.join(allowed_paths.select("path"), "path", "left_anti").select(F.col("id").alias("item"), F.lit("path out of scope").alias("reason")))
    return bad


def finalize(nodes: Column, errors: Column) -> Column:
    """Status of an external graph's run: errors or no nodes fail it."""
    return F.when((F.coalesce(errors, F.lit(0)) > 0) | (F.coalesce(nodes, F.lit(0)) == 0), "failed").otherwise("success")


def prune(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (project_id, run_id, ..) without those of other runs of a project of which a run just succeeded: runs (project_id, run_id, status)."""
    done = runs.where("status = 'success'").select("project_id", F.col("run_id").alias("_kept"))
    return rows.join(done, "project_id", "left").where(F.col("_kept").isNull() | (F.col("run_id") == F.col("_kept"))).select(rows.columns)


def ui_run(runs: DataFrame, apps: DataFrame) -> DataFrame:
    """The newest ready run that has a UI app (apps: run_id), else what :func:`latest_run` chooses."""
    with_app = ready(runs).join(apps.select(F.col("run_id").alias("id")).distinct(), "id", "left_semi")
    found = with_app.orderBy(F.col("started_at").desc(), "id").limit(1)
    return found if not found.isEmpty() else latest_run(runs).select(found.columns)


def eligible_run(runs: DataFrame) -> DataFrame:
    """For the external graph job: the newest ready run, once any run came from parsers."""
    parsed = runs.where("graph_builder = 'parsers'").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(1).alias("_any"))
    newest = ready(runs).orderBy(F.col("started_at").desc(), "id").limit(1)
    return newest.withColumn("_any", F.lit(1)).join(parsed, "_any", "left_semi").select(newest.columns)


def delete_project(frames: dict[str, DataFrame], jobs: DataFrame, project: str, kept: tuple[str, ...] = ("ai_jobs",)) -> dict[str, DataFrame]:
    """All frames without a project's rows, but for those that outlive it; a running sync or analysis of the project refuses it."""
    busy = jobs.where((F.col("project_id") == project) & F.col("kind").isin("sync", "analysis") & (F.col("status") == "running"))
    if not busy.isEmpty():
        raise ValueError(f"project {project} has a running job")
    return {name: f if name in kept else f.where(~F.col("project_id").eqNullSafe(F.lit(project))) for name, f in frames.items()}


def scoped_paths(changes: DataFrame, language: str) -> DataFrame:
    """(path, role): what a language's extractor reads again (spawn) and forgets (deleted)."""
    from ..functions.paths import basename, language_of

    own = (language_of(F.col("path")) == language) | ((basename(F.col("path")) == "package.json") & F.lit(language == "javascript"))
    return changes.where(own).select("path", F.when(F.col("change") == "deleted", "deleted").otherwise("spawn").alias("role"))


def ingest(nodes: DataFrame, edges: DataFrame, old_nodes: DataFrame, old_edges: DataFrame, parser: str, paths: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One envelope into a run: forget the parser's rows of the paths, merge, link elements and drop unsound edges."""
    from .joins import linked_elements, sound

    scope = paths.select(F.lit(parser).alias("parser_id"), "path")
    kept_nodes, kept_edges = delete_paths(old_nodes, scope), delete_paths(old_edges, scope)
    all_nodes = upsert(kept_nodes, nodes.select(kept_nodes.columns), ["id"])
    return linked_elements(all_nodes, elements), upsert(kept_edges, sound(edges, all_nodes).select(kept_edges.columns), ["id"])
