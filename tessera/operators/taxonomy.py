"""Taxonomies: the closure of a parent relation, the state of a catalog, and projections held against it (FLT-13)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.similarity import settled

#: Fixed finding names.
MISSING_CATALOG, OTHER_VERSION, COVERAGE, UNKNOWN_SKILL, CONTENT, OPEN = (
    "taxonomy_catalog_missing", "taxonomy_version_mismatch", "taxonomy_projection_coverage_mismatch",
    "taxonomy_projection_skill_missing", "taxonomy_projection_content_mismatch", "taxonomy_projection_not_closed",
)
#: Paths that one task holds, about.
PATHS = 400_000
RELATIONS = "array<struct<facet:string,code:string,is_primary:boolean>>"


def closure(edges: DataFrame, child: str, parent: str, rounds: int = 16) -> DataFrame:
    """(node, ancestor, depth): everything above each node with the fewest steps to it; a node on a cycle is its own ancestor.

    Paths double in length each round, so 16 rounds reach 65 536 levels; raises
    beyond. Edges with a null end are left out. Only the longest paths are
    prolonged: a shortest path of more steps begins with one of just so many,
    and where there is none all are known. Paths are dealt over tasks by node.
    """
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("bigint").alias("depth")).filter("node is not null and ancestor is not null").distinct()
    known, step = settled(e), 1
    for left in range(rounds, -1, -1):
        a, b = known.filter(F.col("depth") == step).alias("a"), known.alias("b")
        now = known.agg(F.count("*").alias("n"), F.count_if(F.col("depth") == step).alias("longest")).first()
        if not now.longest:
            return known
        if not left:
            break
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        dealt = known.unionByName(longer).repartition(math.ceil((now.n + now.longest * step) / PATHS), "node")
        known, step = settled(dealt.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))), 2 * step
    raise RuntimeError(f"the relation is deeper than 2^{rounds} levels")


def catalog_findings(nodes: DataFrame, edges: DataFrame, node: str, child: str, parent: str, above: DataFrame | None = None) -> DataFrame:
    """(node, code): parents that are no nodes (parent_missing), nodes on a cycle (parent_cycle), nodes with several parents (several_parents)."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("_p")).filter("node is not null and _p is not null").distinct()
    dangling = e.join(ids, e["_p"] == ids["_n"], "left_anti").select("node", F.lit("parent_missing").alias("code"))
    cycle = (above if above is not None else closure(edges, child, parent)).filter("node = ancestor").select("node", F.lit("parent_cycle").alias("code"))
    many = e.groupBy("node").count().filter("count > 1").select("node", F.lit("several_parents").alias("code"))
    return dangling.unionByName(cycle).unionByName(many).distinct()


def _ordered(x: Column) -> Column:
    return F.array_sort(x)


def projection_findings(bundles: DataFrame, resolved: DataFrame, projected: DataFrame, skills: DataFrame | None, relations: DataFrame | None, version: str | None, checked: str = "extracted-jd-bundle-v2", above: DataFrame | None = None) -> DataFrame:
    """FLT-13. (bundle, code, skill_id): the first thing that is wrong with the projected taxonomy of a bundle; bundles in order have no row.

    bundles: bundle, schema_version, taxonomy_version; only those of the checked
    schema are looked at. resolved: bundle, skill_id. projected: bundle, pos,
    skill_id, canonical_name, classifications (facet, code, is_primary). Catalog:
    skills (skill_id, canonical_name), relations (skill_id, facet, code,
    is_primary), its version; None where there is none. In this order: no
    catalog, another version, projected skills that are not exactly the resolved
    ones or repeat, and then by position a skill that the catalog lacks or whose
    name or relations differ or repeat. With ``above`` (a closure of codes) a
    projection that has a code must have all codes above it; told last.
    """
    b = bundles.filter(F.col("schema_version") == checked).select("bundle", "taxonomy_version")
    if skills is None or relations is None or version is None:
        return b.select("bundle", F.lit(MISSING_CATALOG).alias("code"), F.lit(None).cast("string").alias("skill_id"))
    none = F.array().cast("array<string>")
    text = F.col("skill_id").cast("string")
    have = resolved.filter("skill_id is not null").groupBy("bundle").agg(_ordered(F.collect_set(text)).alias("_have"))
    cover = projected.groupBy("bundle").agg(_ordered(F.collect_set(text)).alias("_shown"), F.count("*").alias("_n"), F.count("skill_id").alias("_ids"))
    # A skill's relations in the catalog are one row; a projection's are compared as sets.
    own = relations.groupBy("skill_id").agg(_ordered(F.collect_set(F.struct("facet", "code", "is_primary"))).alias("_own"))
    catalog = skills.select("skill_id", F.col("canonical_name").alias("_name")).join(own, "skill_id", "left")
    given = F.coalesce("classifications", F.array().cast(RELATIONS))
    item = projected.select("bundle", "pos", "skill_id", "canonical_name", _ordered(F.array_distinct(given)).alias("_set"), F.size(given).alias("_given")).join(catalog.withColumn("_there", F.lit(True)), "skill_id", "left")
    wrong = ~F.col("canonical_name").eqNullSafe(F.col("_name")) | (F.col("_set") != F.coalesce("_own", F.array().cast(RELATIONS))) | (F.col("_given") != F.size("_set"))
    bad = item.withColumn("_bad", F.when(F.col("_there").isNull(), UNKNOWN_SKILL).when(wrong, CONTENT))
    first = bad.filter("_bad is not null").groupBy("bundle").agg(F.min(F.struct("pos", F.col("_bad").alias("code"), text.alias("skill_id"))).alias("_first"))
    x = b.join(have, "bundle", "left").join(cover, "bundle", "left").join(first, "bundle", "left")
    uneven = (F.coalesce("_have", none) != F.coalesce("_shown", none)) | (F.coalesce("_n", F.lit(0)) != F.size(F.coalesce("_shown", none)))
    code = F.when(~F.col("taxonomy_version").eqNullSafe(F.lit(version)), OTHER_VERSION).when(uneven, COVERAGE).otherwise(F.col("_first.code"))
    x = x.select("bundle", code.alias("code"), F.when(code.isin(UNKNOWN_SKILL, CONTENT), F.col("_first.skill_id")).alias("skill_id"))
    if above is not None:
        shown = projected.select("bundle", F.explode("classifications").alias("_c")).select("bundle", F.col("_c.code").alias("_code")).distinct()
        needed = shown.join(above.select(F.col("node").alias("_code"), F.col("ancestor").alias("_above")), "_code").select("bundle", F.col("_above").alias("_code")).distinct()
        lacking = needed.join(shown, ["bundle", "_code"], "left_anti").select("bundle").distinct().withColumn("_open", F.lit(OPEN))
        x = x.join(lacking, "bundle", "left").select("bundle", F.coalesce("code", "_open").alias("code"), "skill_id")
    return x.filter("code is not null")
