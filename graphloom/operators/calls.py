"""Calls and injections: call sites of all files joined with their symbols, through imports, inheritance and declared types.

A site is a chain: where it starts (``self``, ``super`` or candidates for a qualified name, best first) and its steps, names of
members, with (n) for a call of n arguments.  Each step is a join of what the chain has led to so far with the members of
that type and of its bases; the member's declared type leads on.  All tables stay distributed; the number of rounds is the
longest chain, the deepest inheritance and the longest chain of re-exports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table
from .joins import resolve_usages

TYPES = ["class", "interface", "enum"]
MEMBERS = ["method", "function", "property", "field", "variable", "parameter_property"]


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def big(df: DataFrame) -> DataFrame:
    """A table that grows with the code: joined by shuffles. Its files are many times smaller than its rows, and Spark would
    broadcast it, through the driver, by the files' size."""
    return df.hint("merge")


def key_of(starts: Column) -> Column:
    """A short key of a list of candidates (hundreds of characters), under which it is joined."""
    return F.unhex(F.md5(starts))


def known_names(facts: DataFrame) -> DataFrame:
    """(alias, qualified): every declared type, function, variable and module under itself, and under each name that re-exports give it; the least if there are several."""
    own = facts.where(F.col("fact").isin(*TYPES, "function", "variable", "module", "namespace")).select(F.col("qualified_name").alias("alias"), F.col("qualified_name").alias("qualified")).distinct()
    given = facts.where("fact = 'alias'").select("name", F.col("qualified_name").alias("from"), "target").distinct()
    names = table(own, "names")
    if given.isEmpty():
        return names
    given = table(given, "aliases")
    owner, last = F.regexp_extract("alias", r"^(.*)\.[^.]*$", 1), F.regexp_extract("alias", r"([^.]*)$", 1)
    while True:
        exact = given.where("name <> '*'").join(big(names), F.col("target") == F.col("alias")).select(F.col("from").alias("alias"), "qualified")
        inner = names.select("qualified", owner.alias("owner"), last.alias("last")).where("last <> 'default'")
        every = given.where("name = '*'").join(big(inner), F.col("target") == F.col("owner")).select(F.concat_ws(".", "from", "last").alias("alias"), "qualified")
        more = exact.unionByName(every).groupBy("alias").agg(F.min("qualified").alias("qualified")).join(big(names), "alias", "left_anti")
        more = table(more, "aliases")
        if more.isEmpty():
            return names
        names = names.unionByName(more)


def resolved(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mentions (starts) -> (key, qualified): the first of the candidates that is known; rows for those alone."""
    listed = mentions.where("starts is not null").distinct().select(key_of(F.col("starts")).alias("key"), F.posexplode(F.split("starts", " ")).alias("at", "alias"))
    return listed.join(big(names), "alias").groupBy("key").agg(F.min_by("qualified", "at").alias("qualified"))


def led(mentions: DataFrame, names: DataFrame, how: str = "inner") -> DataFrame:
    """mentions (starts, ..) with ``qualified``, the first known of their candidates, and without the candidates."""
    return mentions.withColumn("key", key_of(F.col("starts"))).drop("starts").join(big(resolved(mentions.select("starts"), names)), "key", how).drop("key")


def lineage(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(type, base, depth): each type with itself at 0 and all its bases, at the least depth; a cycle ends where it closes."""
    types = facts.where(F.col("fact").isin(*TYPES, "module")).select(F.col("qualified_name").alias("type")).distinct()
    stated = facts.where("fact in ('inherits', 'implements')").select("qualified_name", attr("starts").alias("starts"))
    direct = table(led(stated, names).select(F.col("qualified_name").alias("t"), F.col("qualified").alias("b")).where("t <> b").distinct(), "bases")
    found = table(types.select("type", F.col("type").alias("base"), F.lit(0).alias("depth")), "lineage")
    level = direct.select(F.col("t").alias("type"), F.col("b").alias("base"), F.lit(1).alias("depth"))
    while True:
        level = table(level.join(big(found), ["type", "base"], "left_anti"), "lineage")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
        level = level.join(big(direct), F.col("base") == F.col("t")).select("type", F.col("b").alias("base"), (F.col("depth") + 1).alias("depth")).distinct()


def usages(facts: DataFrame) -> DataFrame:
    """(from, to, type, path, line): calls of known members by known callers, and injections of known types into classes.

    Calls of a member by itself, calls on receivers whose type no declaration tells, calls through Java's ``super`` and names that
    stand for several members alike (overloads of one arity) give no row.  Facts of several files that declare one name
    (parts of a class) are one symbol.
    """
    names = known_names(facts)
    bases = lineage(facts, names)
    members = facts.where(F.col("fact").isin(MEMBERS)).select(F.col("parent").alias("owner"), "name", F.col("qualified_name").alias("member"), F.col("fact").alias("kind"), attr("type").alias("starts"), attr("params").cast("int").alias("params"))
    members = led(members, names, "left").withColumnRenamed("qualified", "leads").distinct()
    members = table(members, "members")
    sites = facts.where("fact = 'call'").select(F.col("qualified_name").alias("caller"), "path", "line", attr("starts").alias("starts"), F.split(attr("steps"), " ").alias("steps"), F.split(attr("types"), " ").alias("types")).distinct()
    sites = table(sites.withColumn("site", F.monotonically_increasing_id()), "sites")
    # Where each chain starts: own type, then the enclosing ones; the bases for super; else the candidates' first known name.
    inside = sites.where("starts = 'self'").select("site", F.posexplode("types").alias("order", "now"))
    above = sites.where("starts = 'super'").select("site", F.element_at("types", 1).alias("type")).join(big(bases.where("depth = 1")), "type").select("site", F.lit(0).alias("order"), F.col("base").alias("now"))
    told = led(sites.where("starts not in ('self', 'super')").select("site", "starts"), names).select("site", F.lit(0).alias("order"), F.col("qualified").alias("now"))
    now = table(inside.unionByName(above).unionByName(told), "chains")
    found, step = [], 0
    plan = sites.select("site", "caller", "path", "line", "steps")
    while not now.isEmpty():
        part = F.try_element_at("steps", F.lit(step + 1))
        ahead = now.join(big(plan), "site").select("site", "order", "now", "caller", "path", "line", F.regexp_extract(part, r"^([^(]*)", 1).alias("name"), F.nullif(F.regexp_extract(part, r"\((\d+)\)", 1), F.lit("")).cast("int").alias("args"), (F.size("steps") > step + 1).alias("more"))
        itself = ahead.where("name = ''").join(big(members.withColumnRenamed("name", "n")), F.col("now") == F.col("member")).withColumn("depth", F.lit(0))
        through = ahead.where("name <> ''").join(big(bases), F.col("now") == F.col("type")).join(big(members.withColumnRenamed("name", "n")), (F.col("base") == F.col("owner")) & (F.col("name") == F.col("n")))
        plain = F.col("kind").isin("method", "function")
        fits = F.when(F.col("args").isNull(), (~plain).cast("int")).otherwise(F.when(F.col("kind").isin("field", "parameter_property"), 0).otherwise(1))
        columns = ["site", "order", "depth", "args", "more", "caller", "path", "line", "member", "leads", "params"]
        met = itself.select(*columns, fits.alias("fits")).unionByName(through.select(*columns, fits.alias("fits"))).where("fits = 1")
        rank = F.struct(F.coalesce((F.col("params") != F.col("args")).cast("int"), F.lit(0)).alias("off"), "order", "depth")
        level = met.groupBy("site", "more", "caller", "path", "line", rank.alias("rank")).agg(F.min("member").alias("member"), F.max("member").alias("other"), F.min("leads").alias("leads"))
        best = level.groupBy("site", "more", "caller", "path", "line").agg(F.min(F.struct("rank", "member", "other", "leads")).alias("b")).where("b.member = b.other")
        best = table(best.select("site", "more", "caller", "path", "line", "b.member", "b.leads"), "chains")
        found.append(best.where("not more").select(F.col("caller").alias("from"), F.col("member").alias("to"), F.lit("calls").alias("type"), "path", "line"))
        now = best.where("more and leads is not null").select("site", F.lit(0).alias("order"), F.col("leads").alias("now"))
        step += 1
    given = facts.where("fact = 'inject'").select(F.col("qualified_name").alias("from"), "path", "line", attr("starts").alias("starts"))
    kinds = facts.where(F.col("fact").isin(TYPES)).select(F.col("qualified_name").alias("to")).distinct()
    injected = led(given, names).select("from", F.col("qualified").alias("to"), F.lit("injects").alias("type"), "path", "line").join(big(kinds), "to", "left_semi")
    for part in found:
        injected = injected.unionByName(part)
    return injected.where("from <> to").distinct()


def usage_edges(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, type): usages between symbols (id, qualified_name) whose names each stand for one symbol."""
    return resolve_usages(usages(facts).select("from", "to", "type").distinct(), symbols)
