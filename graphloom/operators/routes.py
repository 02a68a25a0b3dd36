"""Routes that are put together over files: url patterns that include those of other modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table


def below(prefix: Column, given: Column, regex: Column) -> Column:
    """A pattern's path below a prefix; regular expressions lose their first ^ and last $."""
    value = F.when(regex, F.regexp_replace(F.regexp_replace(given, r"^\^", ""), r"\$$", "")).otherwise(given)
    whole = F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), F.ltrim(value, F.lit("/")))
    return F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole))


def included_routes(facts: DataFrame) -> DataFrame:
    """Route facts (the schema of ``facts``) of url patterns: the prefixes of all includes, from the files that none includes down.

    An include leads to ``a/b.py`` or ``a/b/__init__.py``; one that leads nowhere gives no route.  A chain ends where it would
    enter a file that it has passed, so that cycles end; files that only a cycle reaches have no root and give no routes.
    A file that is included at several places has its routes at each.
    """
    facts = table(facts.where("fact in ('python_file', 'include', 'url_pattern')"), "patterns")
    files = facts.where("fact = 'python_file'").select(F.col("path").alias("file")).distinct()
    modules = facts.where("target is not null").select("target").distinct()
    base = F.replace("target", F.lit("."), F.lit("/"))
    tried = modules.select("target", F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("at", "file"))
    led = table(tried.join(files, "file").groupBy("target").agg(F.min_by("file", "at").alias("into")), "modules")
    patterns = facts.where("fact = 'url_pattern'").withColumn("regex", F.try_element_at("attrs", F.lit("regex")) == "true")
    steps = table(patterns.join(led, "target").select("path", "name", "regex", "into").distinct(), "includes")
    passed = facts.where("fact = 'include'").join(led, "target").select(F.col("into").alias("path")).distinct()
    level = patterns.select("path").distinct().join(passed, "path", "left_anti").select("path", F.lit("").alias("prefix"), F.array("path").alias("seen"))
    level = table(level, "prefixes")
    reached = level
    while not level.isEmpty():
        level = level.join(steps, "path").where(~F.array_contains("seen", F.col("into"))).select(F.col("into").alias("path"), below(F.col("prefix"), F.col("name"), F.col("regex")).alias("prefix"), F.concat("seen", F.array("into")).alias("seen"))
        level = table(level.distinct(), "prefixes")
        reached = reached.unionByName(level)
    ends = patterns.where("target is null").join(reached.select("path", "prefix").distinct(), "path")
    route = below(F.col("prefix"), F.col("name"), F.col("regex"))
    ends = ends.withColumns({"fact": F.lit("route"), "target": route, "name": F.concat(F.lit("GET "), route), "attrs": F.create_map(F.lit("method"), F.lit("GET"))})
    return ends.select(facts.columns).dropDuplicates([c for c in facts.columns if c != "attrs"])
