"""Novelty of a version against its predecessor and peers, and what kind of event it is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.scalars import clamp
from tessera.functions.text import edit_ratio, jaccard


def scaled(distance: Column, mid: float, high: float) -> Column:
    """Piecewise scale: 0..0.4 below mid, 0.4..0.7 up to high, 0.7..1 beyond."""
    return clamp(F.when(distance >= high, 0.7 + 0.3 * (distance - high) / max(1 - high, 0.01)).when(distance >= mid, 0.4 + 0.3 * (distance - mid) / max(high - mid, 0.01)).otherwise(0.4 * distance / max(mid, 0.01)))


def name_novelty(name: Column, others: Column, mid: float = 0.3, high: float = 0.6) -> Column:
    """MAT-06. Scaled least edit ratio to earlier names; null without any."""
    return F.when(F.size(others) > 0, scaled(F.array_min(F.transform(others, lambda o: edit_ratio(name, o))), mid, high))


def skill_novelty(now: Column, before: Column, peers: Column, mid: float = 0.3, high: float = 0.6) -> Column:
    """MAT-07. 0.6 of the Jaccard distance to the predecessor and 0.4 of that to the nearest peer; null without a predecessor."""
    d = 1 - jaccard(now, before, 1.0)
    near = F.coalesce(F.array_min(F.transform(peers, lambda p: 1 - jaccard(now, p, 1.0))), d)
    return F.when(before.isNotNull(), scaled(0.6 * d + 0.4 * near, mid, high))


def responsibility_novelty(now: Column, before: Column, peers: Column, high: float = 0.6) -> Column:
    """MAT-08. As MAT-07 on token sets, linear up to ``high``."""
    d = 1 - jaccard(now, before, 1.0)
    near = F.coalesce(F.array_min(F.transform(peers, lambda p: 1 - jaccard(now, p, 1.0))), d)
    return F.when(before.isNotNull(), clamp((0.6 * d + 0.4 * near) / high))


def industry_novelty(now: Column, history: Column, threshold: float = 0.3) -> Column:
    """MAT-09. Share of new codes by a threshold; null without codes or history."""
    return F.when((F.size(now) > 0) & (F.size(history) > 0), clamp(F.size(F.array_except(now, history)) / F.size(F.array_distinct(now)) / threshold))


def market_novelty(now: Column, before: Column, peer_delta: Column, enterprises: Column, places: Column, concentrated: Column, growth: float = 1.0, least: int = 2) -> Column:
    """MAT-09. Growth of ln(1+n) against the median peer, enterprises and places; concentrated sources halve it and cap it at 0.4."""
    import math

    norm = max(math.log1p(growth), 0.01)
    delta = F.log1p(now) - F.log1p(before)
    g = F.when(delta >= 0, clamp(delta / norm)).otherwise(0.1)
    g = F.when(peer_delta.isNotNull(), clamp(g + 0.5 * (delta - peer_delta) / norm)).otherwise(g)
    s = clamp(0.4 * g + 0.35 * clamp(enterprises / 10.0) + 0.25 * clamp(places / 5.0))
    return F.when(enterprises < least, 0.1).when(concentrated, F.least(s * 0.5, F.lit(0.4))).otherwise(s)


def novelty_profile(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """MAT-10. Weighted mean of the dimensions that are there (nulls are unavailable, not zero), and their number."""
    ok = [(F.col(c), w) for c, w in weights.items()]
    num = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in ok), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in ok), F.lit(0.0))
    return df.withColumn("novelty", F.when(den > 0, num / den)).withColumn("dimensions", sum((c.isNotNull().cast("bigint") for c, _ in ok), F.lit(0).cast("bigint")))


def novelty_event(name: Column, skill: Column, resp: Column, market: Column, now: Column, before: Column) -> Column:
    """MAT-10. renaming, specialization, hybridization, emergence or none, the first that holds."""
    low = lambda c, x: c.isNull() | (c < x)
    narrowed = (F.size(F.array_except(now, before)) == 0) & (F.size(now) < F.size(before)) & (1 - F.size(now) / F.size(before) >= 0.3)
    return (
        F.when((name >= 0.7) & low(skill, 0.3) & low(resp, 0.3), "renaming").when(narrowed, "specialization").when((skill >= 0.4) & (F.size(F.array_intersect(now, before)) > 0) & low(market, 0.5), "hybridization")
        .when((skill >= 0.6) & (market >= 0.5), "emergence").otherwise("none")
    )


def admission(df: DataFrame, key: str, profile: str, title: str, responsibility: str, skill: str, weights: tuple[float, float, float] = (0.4, 0.35, 0.25), admit: float = 0.6, review: float = 0.4, support: tuple[float, float] = (0.3, 0.3), signal: str | None = None) -> DataFrame:
    """EMG-05. The best profile of each candidate by weighted score, and whether it is admitted, reviewed, weak or off target.

    A candidate with a signal in its skills only (weak title and responsibility) is never admitted.
    """
    s = F.col(title) * weights[0] + F.col(responsibility) * weights[1] + F.col(skill) * weights[2]
    best = df.withColumn("combined", F.round(s, 6)).withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("combined"), F.desc(profile)))).filter("_k = 1").drop("_k")
    weak = (F.col(signal) if signal else F.lit(False)) & (F.col(title) < support[0]) & (F.col(responsibility) < support[1])
    c = F.col("combined")
    d = F.when(weak, F.when(c >= admit, "review_required").when((F.col(title) == 0) & (F.col(responsibility) == 0), "off_target").otherwise("weak_evidence")).when(c >= admit, "admit").when(c >= review, "review_required").otherwise("off_target")
    return best.withColumn("decision", d)


def identity_match(df: DataFrame, key: str, candidate: str, weights: Mapping[str, float], same: float = 0.6, margin: float = 0.1) -> DataFrame:
    """EMG-07. The best candidate of each key, its margin to the second, and the decision same, review_required or new."""
    x = df.withColumn("score", F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)), 9))
    w = W.partitionBy(key).orderBy(F.desc("score"), candidate)
    x = x.withColumn("_k", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("_k = 1")
    return x.select(key, candidate, "score", "margin", F.when(F.col("score") < same, "new").when(F.col("margin") < margin, "review_required").otherwise("same").alias("decision"))


def relation_class(df: DataFrame, name: Column, skill: Column, resp: Column, baseline: Column) -> DataFrame:
    """EMG-02, EMG-03. Relation of a cluster to its reference: no_reference, same_occupation, variant, adjacent or structurally_new."""
    far = F.greatest(F.coalesce(skill, F.lit(0.0)), F.coalesce(resp, F.lit(0.0)))
    c = F.when(~baseline, "no_reference").when((name < 0.3) & (far < 0.3), "same_occupation").when(far < 0.4, "variant").when(far < 0.6, "adjacent").otherwise("structurally_new")
    return df.withColumn("relation", c)


def definition(df: DataFrame, cluster: str, skill: str, reference: DataFrame, n: int = 5) -> DataFrame:
    """EMG-12. The n most supported skills of each cluster, and those of them that no reference has."""
    known = reference.select(F.col(skill)).distinct().withColumn("_r", F.lit(1))
    c = df.groupBy(cluster, skill).agg(F.count("*").alias("_n")).join(known, skill, "left")
    c = c.withColumn("_k", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("_n"), skill))).filter(F.col("_k") <= n)
    return c.groupBy(cluster).agg(F.array_sort(F.collect_list(skill)).alias("core_skills"), F.array_sort(F.collect_list(F.when(F.col("_r").isNull(), F.col(skill)))).alias("new_skills"))


def leakage(events: DataFrame, source: str, target: str, used: str) -> DataFrame:
    """EMG-13. Lineage events that use evidence from a window after their target, or do not point forward."""
    r = F.array_compact(F.array(F.when(F.col(used) > F.col(target), F.lit("future_evidence")), F.when(F.col(source) >= F.col(target), F.lit("not_forward"))))
    return events.withColumn("violations", r).filter(F.size("violations") > 0)
