"""Comparisons of versions and profiles: splits and merges of positions, diffs with evidence and context, temporal profiles, layers, counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: EVO-08. Fixed limits: skills of the largest category, responsibilities, share of all skills, comparable samples.
SKILLS, RESPONSIBILITIES, SHARE, COMPARABLE = 3, 2, 0.25, 3
#: MAT-17. Stored name -> name among the metrics.
STATISTICS = {
    "supporting_jd_count": "support_count", "deduplicated_jd_count": "support_document_count", "enterprise_count": "enterprise_coverage", "source_count": "source_diversity", "evidence_count": "support_count",
    "raw_frequency": "support_ratio", "quality_adjusted_frequency": "weighted_frequency",
}
RATIOS = {"raw_frequency", "quality_adjusted_frequency"}


def _gone(a: DataFrame, b: DataFrame, scope: str, item: str) -> DataFrame:
    """Rows of a whose (scope, item) b does not have."""
    return a.join(b.select(scope, item).distinct(), [scope, item], "left_anti")


def split_merge(before: DataFrame, after: DataFrame, tasks_before: DataFrame, tasks_after: DataFrame, scope: str, skill: str, category: str, task: str, samples: DataFrame) -> DataFrame:
    """EVO-08. (scope, event, category, cluster_skills, changed_skills, changed_tasks, share): positions that split or merge.

    before, after: one row per scope and skill with its category. samples:
    scope, before, after; both must reach ``COMPARABLE``. A split is the loss
    of ``SKILLS`` skills of one category, of ``RESPONSIBILITIES`` tasks and of
    a ``SHARE`` of all skills; a merge is the gain of as much, in a category
    of which there was one skill at most. Of equally large categories the
    least one counts.
    """
    ok = samples.filter((F.col("before") >= COMPARABLE) & (F.col("after") >= COMPARABLE)).select(scope)

    def side(event: str, own: DataFrame, other: DataFrame, own_tasks: DataFrame, other_tasks: DataFrame) -> DataFrame:
        changed = _gone(own, other, scope, skill)
        by = changed.groupBy(scope, category).agg(F.count("*").alias("n"))
        best = by.groupBy(scope).agg(F.max(F.struct("n", (-F.col(category)).alias("c"))).alias("b"), F.sum("n").alias("changed_skills"))
        tasks = _gone(own_tasks, other_tasks, scope, task).groupBy(scope).agg(F.count("*").alias("changed_tasks"))
        x = best.join(tasks, scope).join(own.groupBy(scope).agg(F.count("*").alias("_all")), scope).join(ok, scope, "left_semi").withColumns({category: -F.col("b.c"), "cluster_skills": F.col("b.n"), "share": F.col("changed_skills") / F.col("_all")})
        x = x.filter((F.col("cluster_skills") >= SKILLS) & (F.col("changed_tasks") >= RESPONSIBILITIES) & (F.col("share") >= SHARE))
        if event == "position_merge":
            known = other.groupBy(scope, category).agg(F.count("*").alias("_had"))
            x = x.join(known, [scope, category], "left").filter(F.coalesce("_had", F.lit(0)) <= 1)
        return x.select(scope, F.lit(event).alias("event"), category, "cluster_skills", "changed_skills", "changed_tasks", "share")

    return side("position_split", before, after, tasks_before, tasks_after).unionByName(side("position_merge", after, before, tasks_after, tasks_before))


def full_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str], evidence: str) -> DataFrame:
    """JOI-09. (keys, change, changed_fields, evidence_added, evidence_removed) of rows that differ in a field or in their evidence (an array).

    change is added, removed, changed (a field differs) or evidence (only the
    evidence does); lists are sorted. Null fields are equal to each other.
    """
    pack = lambda df, name: df.select(*keys, F.struct(*fields, F.array_sort(F.array_distinct(evidence)).alias(evidence)).alias(name))
    x = pack(before, "b").join(pack(after, "a"), list(keys), "full_outer")
    differs = F.filter(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]), lambda v: v.isNotNull())
    none = F.array().cast(dict(before.dtypes)[evidence])
    old, new = F.coalesce(F.col(f"b.{evidence}"), none), F.coalesce(F.col(f"a.{evidence}"), none)
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    x = x.withColumns({"changed_fields": F.when(both, F.array_sort(differs)).otherwise(F.array().cast("array<string>")), "evidence_added": F.array_except(new, old), "evidence_removed": F.array_except(old, new)})
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size("changed_fields") > 0, "changed").when((F.size("evidence_added") > 0) | (F.size("evidence_removed") > 0), "evidence")
    return x.withColumn("change", kind).filter("change is not null").select(*keys, "change", "changed_fields", "evidence_added", "evidence_removed")


def compare_profiles(events: DataFrame, profiles: DataFrame, scope: str, event: Sequence[str], pairs: DataFrame) -> DataFrame:
    """EVO-14. (a, b, status, shared, only_a, only_b): comparability and event diff of pairs of profiles.

    profiles: scope, catalog, window_start, window_end, state. A different
    catalog or window (where both say one) blocks; else a profile whose state
    is insufficient_evidence makes the pair insufficient.
    """
    e = events.select(scope, F.struct(*event).alias("_e")).distinct()
    p = lambda s: profiles.select(F.col(scope).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("catalog", "window_start", "window_end", "state")])
    x = pairs.join(p("a"), "a").join(p("b"), "b")
    differs = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))
    weak = lambda s: F.coalesce(F.col(f"state_{s}") == "insufficient_evidence", F.lit(False))
    status = F.when(differs("catalog") | differs("window_start") | differs("window_end"), "blocked").when(weak("a") | weak("b"), "insufficient_evidence").otherwise("complete")
    side = lambda s: pairs.join(e.withColumnRenamed(scope, s), s).select("a", "b", "_e", F.lit(s).alias("_s"))
    each = side("a").unionByName(side("b")).groupBy("a", "b", "_e").agg(F.count("*").alias("_n"), F.min("_s").alias("_s"))
    count = lambda c: F.count_if(c)
    diff = each.groupBy("a", "b").agg(count(F.col("_n") == 2).alias("shared"), count((F.col("_n") == 1) & (F.col("_s") == "a")).alias("only_a"), count((F.col("_n") == 1) & (F.col("_s") == "b")).alias("only_b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select("a", "b", status.alias("status")).join(diff, ["a", "b"], "left").select("a", "b", "status", zero("shared"), zero("only_a"), zero("only_b"))


def relation_statistics(stored: Mapping[str, str], metrics: Mapping[str, str]) -> list:
    """MAT-17. Statistics columns: the stored value if there is one, else the metric, else 0; both map names to columns."""
    out = []
    for name, metric in STATISTICS.items():
        have = [F.col(c) for c in (stored.get(name), metrics.get(metric)) if c]
        out.append(F.coalesce(*have, F.lit(0)).cast("double" if name in RATIOS else "bigint").alias(name))
    return out


def candidate_layers(observations: DataFrame, ident: str, date: str, content: str, company: str, region: str, source: str) -> DataFrame:
    """EMG-04. A row per evidence identity: what observing it again shows, and its market on the latest date.

    Observing a posting again is no further posting: the count of independent
    ones is 1, and growth is not available. Companies, regions and sources
    are those of the latest date. Null dates do not count as dates.
    """
    g = observations.groupBy(ident).agg(F.count("*").alias("observations"), F.countDistinct(date).alias("dates"), F.countDistinct(content).alias("contents"), F.max(date).alias("latest"))
    last = observations.join(g.select(ident, "latest"), ident).filter(F.col(date) == F.col("latest"))
    m = last.groupBy(ident).agg(F.countDistinct(company).alias("enterprises"), F.countDistinct(region).alias("regions"), F.countDistinct(source).alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.join(m, ident, "left").select(ident, "observations", "dates", "latest", (F.col("contents") <= 1).alias("same_content"), F.lit(1).cast("bigint").alias("independent_postings"), F.lit(False).alias("growth_available"), zero("enterprises"), zero("regions"), zero("sources"))


def job_counters(fetched: DataFrame, known: DataFrame, job: str, key: str) -> DataFrame:
    """SNK-06. (job, fetched, new, duplicate): a snapshot is new once, if no earlier run knows it."""
    new = fetched.select(job, key).distinct().join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(job).alias(job)).groupBy(job).agg(F.count("*").alias("new"))
    g = fetched.groupBy(job).agg(F.count("*").alias("fetched")).join(new, job, "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return g.withColumn("duplicate", F.col("fetched") - F.col("new"))


def required_fields(required: Sequence[str], parents: Mapping[str, str] | None = None):
    """FLT-10. Sorted array of the required columns that are null or blank; a column with a parent is asked for only where that is there."""
    rules = []
    for c in required:
        missing = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        parent = (parents or {}).get(c)
        rules.append(F.when(missing & F.col(parent).isNotNull() if parent else missing, F.lit(c)))
    return F.array_sort(F.filter(F.array(*rules), lambda x: x.isNotNull()))
