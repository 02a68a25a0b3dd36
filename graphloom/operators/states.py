"""States of routers whose urls go on from their parents'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table


def state_urls(states: DataFrame) -> DataFrame:
    """states (app, state, above, url) -> (app, state, full): each state's url behind those of its parents, without queries.

    A url that begins with ^ stands alone.  A null url adds nothing, and neither does a parent that no file declares.  Pointers to the
    parents double their reach in each round, so that a chain of n states costs log n rounds; states on or above a cycle
    have a null url.  Of several states of one name the one of the least url counts.
    """
    own = F.regexp_replace(F.coalesce("url", F.lit("")), r"\?.*$", "")
    rows = states.groupBy("app", "state").agg(F.min(F.struct(F.coalesce("url", F.lit("")).alias("url"), "above")).alias("s")).select("app", "state", F.col("s.url").alias("url"), F.col("s.above").alias("above"))
    alone = F.startswith("url", F.lit("^"))
    rows = rows.select("app", "state", F.when(alone, F.substring(own, 2, 1 << 30)).otherwise(own).alias("full"), F.when(~alone, F.col("above")).alias("above"))
    known = rows.select("app", F.col("state").alias("above"), F.lit(True).alias("known"))
    rows = rows.join(known, ["app", "above"], "left").select("app", "state", "full", F.when(F.col("known"), F.col("above")).alias("above"))
    rows = table(rows, "states")
    reach, most = 1, max(1, rows.count())
    while reach <= 2 * most and not rows.where("above is not null").isEmpty():
        up = rows.select("app", F.col("state").alias("above"), F.col("full").alias("before"), F.col("above").alias("further"))
        rows = rows.join(up, ["app", "above"], "left").select("app", "state", F.concat(F.coalesce("before", F.lit("")), "full").alias("full"), F.col("further").alias("above"))
        rows = table(rows, "states")
        reach *= 2
    return rows.select("app", "state", F.when(F.col("above").isNull(), F.regexp_replace("full", "/+", "/")).alias("full"))
