"""Requirement graphs: alternatives found in the evidence of postings, nested groups as edges (CLU-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.similarity import settled
from tessera.operators.taxonomy import closure

# What separates clauses, what separates alternatives (a hit takes the first that fits), names that texts use for a skill.
CLAUSES = "[，。；;,]"
ALTERNATIVES = "/|或|或者|(?<![\\p{L}\\p{N}_])or(?![\\p{L}\\p{N}_])|至少一种|至少一门|至少一个|任选|其中一种|one[- ]?of|any[- ]?of|either"
ALIASES = (("扣子", "coze"),)
#: How many alternatives a clause asks for where it gives a number over one (our addition; the group is then a min_count group).
AT_LEAST = "(?i)(?:at least|至少)\\s*([2-9])"
CONFIDENCE = 0.8


def mentions(piece: Column, name: Column) -> Column:
    """Whether a text names a skill: by its name, an alias, or the first part of its name as a word of its own."""
    text, skill = F.lower(piece), F.lower(name)
    part = F.regexp_extract(skill, "^([a-z0-9+#]*)", 1)
    alone = F.concat(F.lit("(?<![a-z0-9])\\Q"), part, F.lit("\\E(?![a-z0-9])"))
    hit = F.contains(text, skill)
    for alias, canonical in ALIASES:
        hit = hit | ((skill == canonical) & F.contains(text, F.lit(alias)))
    return F.coalesce((F.length(skill) > 0) & (hit | ((F.length(part) >= 2) & F.rlike(text, alone))), F.lit(False))


def derived_groups(requirements: DataFrame, position: str) -> DataFrame:
    """(position, group_id, op, need, priority, children, quote, segment, confidence): alternatives among requirements that one quote names.

    requirements: position, ord, requirement_id, name, priority (required or
    preferred), quotes (array). A separator makes alternatives only of the
    skills that the pieces on both its sides name; a clause with two or more is
    a group. Requirements without id and null quotes take no part.
    """
    q = requirements.filter("requirement_id is not null").select(position, "ord", "requirement_id", "name", "priority", F.explode(F.array_distinct("quotes")).alias("quote")).filter("quote is not null")
    q = q.groupBy(position, "quote", "requirement_id").agg(F.min(F.struct("ord", "name", "priority")).alias("_r"))
    s = q.groupBy(position, "quote").agg(F.array_sort(F.collect_list(F.struct("_r.ord", "requirement_id", "_r.name", "_r.priority"))).alias("_s")).filter("size(_s) > 1")
    parts = F.filter(F.split("quote", CLAUSES, -1), lambda x: F.trim(x) != "")
    x = s.select(position, "quote", "_s", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("quote"))).alias("segment", "_text")).filter(F.rlike("_text", F.lit(ALTERNATIVES)))
    named = F.transform(F.split("_text", ALTERNATIVES, -1), lambda p: F.filter("_s", lambda r: mentions(p, r["name"])))
    x = x.withColumn("_p", named)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.when((F.size(F.element_at("_p", i)) > 0) & (F.size(F.element_at("_p", i + 1)) > 0), F.concat(F.element_at("_p", i), F.element_at("_p", i + 1))).otherwise(F.slice("_s", 1, 0)))
    x = x.filter(F.size("_p") > 1).withColumn("_m", F.array_distinct(F.flatten(pairs))).filter("size(_m) > 1")
    ids = F.transform("_m", lambda r: r["requirement_id"].cast("string"))
    kinds = F.array_distinct(F.transform("_m", lambda r: r["priority"]))
    need = F.least(F.coalesce(F.regexp_extract("_text", AT_LEAST, 1).try_cast("int"), F.lit(1)), F.size("_m"))
    name = F.concat_ws("|", "quote", (F.col("segment") + 1).cast("string"), F.array_join(ids, "|"))
    return x.select(
        position, F.concat(F.lit("derived-or:"), F.substring(F.sha2(name, 256), 1, 16)).alias("group_id"), F.when(need > 1, "min_count").otherwise("or").alias("op"), need.alias("need"),
        F.when(F.size(kinds) == 1, kinds[0]).otherwise("unknown").alias("priority"), F.transform("_m", lambda r: F.struct(r["requirement_id"].cast("string").alias("ref"), r["name"].alias("aspect"))).alias("children"),
        "quote", (F.col("segment") + 1).alias("segment"), F.lit(CONFIDENCE).alias("confidence"),
    )


def graph_edges(groups: DataFrame, position: str) -> DataFrame:
    """(position, parent, child, op, need): one row a child of a group; children are requirements or other groups, so groups nest to any depth."""
    return groups.select(position, F.col("group_id").alias("parent"), F.explode("children").alias("_c"), "op", "need").select(position, "parent", F.col("_c.ref").alias("child"), "op", "need").distinct()


def with_root(edges: DataFrame, requirements: DataFrame, position: str, root: str = "root") -> DataFrame:
    """The edges and those of an AND root over each position's top groups and the requirements that no group holds."""
    below = edges.select(position, F.col("child").alias("_n")).distinct()
    nodes = edges.select(position, F.col("parent").alias("_n")).unionByName(requirements.filter("requirement_id is not null").select(position, F.col("requirement_id").cast("string").alias("_n"))).distinct()
    top = nodes.join(below.hint("merge"), [position, "_n"], "left_anti")
    return edges.unionByName(top.select(position, F.lit(root).alias("parent"), F.col("_n").alias("child"), F.lit("and").alias("op"), F.lit(None).cast("int").alias("need")))


def depths(edges: DataFrame, position: str) -> DataFrame:
    """(position, depth, cyclic): how many levels a position's graph has, and whether groups hold each other in a circle."""
    name = lambda c: F.to_json(F.struct(F.col(position).cast("string").alias("p"), F.col(c).alias("n")))
    above = closure(edges.select(name("child").alias("c"), name("parent").alias("p")), "c", "p")
    of = F.get_json_object("node", "$.p")
    return above.groupBy(of.alias("_p")).agg(F.max("depth").alias("depth"), F.max((F.col("node") == F.col("ancestor")).cast("int")).cast("boolean").alias("cyclic")).withColumnRenamed("_p", position)


def evaluate(edges: DataFrame, values: DataFrame, position: str, key: str, levels: int) -> DataFrame:
    """(position, key, node, value) of all nodes whose children are all known to the evaluation, bottom up; values: position, key, node, value (1, 0, null).

    AND needs all children, OR one, min_count ``need``. A node is 1 (0) when its
    children make it so whatever the unknown ones are, else null. A requirement
    without a row counts as unknown. Graphs and values are unfolded rows, of
    which Spark's estimate knows too few, so no side of a join is sent whole.
    """
    edges = settled(edges)  # read at every level
    size = edges.groupBy(position, "parent").agg(F.count("*").alias("_size"), F.first("op").alias("op"), F.first("need").alias("need"))
    inner = edges.select(position, F.col("parent").alias("node")).distinct()
    leaves = edges.select(position, F.col("child").alias("node")).distinct().join(inner.hint("merge"), [position, "node"], "left_anti")
    people = values.select(position, key).distinct()
    known = settled(leaves.join(people.hint("merge"), position).join(values.hint("merge"), [position, key, "node"], "left").select(position, key, "node", "value"))
    for _ in range(levels):
        x = edges.join(known.withColumnRenamed("node", "child").hint("merge"), [position, "child"]).groupBy(position, key, "parent").agg(
            F.sum(F.coalesce((F.col("value") == 1).cast("int"), F.lit(0))).alias("_y"), F.sum(F.coalesce((F.col("value") == 0).cast("int"), F.lit(0))).alias("_n"), F.count("*").alias("_c")
        )
        g = x.join(size.hint("merge"), [position, "parent"]).filter("_c = _size")
        need = F.when(F.col("op") == "and", F.col("_size")).when(F.col("op") == "or", 1).otherwise(F.col("need"))
        value = F.when(F.col("_y") >= need, 1).when(F.col("_size") - F.col("_n") < need, 0)
        new = g.select(position, key, F.col("parent").alias("node"), value.alias("value")).join(known.select(position, key, "node").hint("merge"), [position, key, "node"], "left_anti")
        known = settled(known.unionByName(new))
    return known

