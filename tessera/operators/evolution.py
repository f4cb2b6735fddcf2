"""Events between consecutive versions of weighted skill relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.scalars import clamp


@dataclass(frozen=True)
class EvolutionConfig:
    """EVO-01..08. Thresholds; the defaults are meant to be replaced by a policy."""

    emergence_weight: float = 0.3
    emergence_delta: float = 0.15
    decline_delta: float = 0.15
    significant: float = 0.2
    comparable: int = 3
    support: int = 3
    sources: int = 2
    weight_delta: float = 0.05
    replacement: float = 0.5
    stack: int = 2
    signal: float = 0.4
    cross: float = 0.2
    evidence: float = 0.2
    semantic: float = 0.2


def evidence_quality(support: Column, sources: Column, enterprises: Column) -> Column:
    """EVO-03. 0.3 + 0.7 of the mean of capped support (5), sources (3) and enterprises (3)."""
    cap = lambda c, k: F.least(F.lit(1.0), F.coalesce(c, F.lit(0)) / float(k))
    return clamp(0.3 + 0.7 * (cap(support, 5) + cap(sources, 3) + cap(enterprises, 3)) / 3.0)


def atomic_signals(before: DataFrame, after: DataFrame, keys: list[str], c: EvolutionConfig = EvolutionConfig()) -> DataFrame:
    """EVO-01, EVO-02. Emergence and decline signals with confidence and whether coverage drives them.

    Tables: keys (the last one is the skill), weight, confidence, support,
    sources, enterprises, samples (of the whole version), category. A skill
    that only one version has is compared with the other version's samples.
    """
    cols = ["weight", "confidence", "support", "sources", "enterprises", "category"]
    scope = keys[:-1]
    b = before.select(*keys, F.struct(*cols).alias("b"))
    a = after.select(*keys, F.struct(*cols).alias("a"))
    sb = before.groupBy(*scope).agg(F.max("samples").alias("_sb"))
    sa = after.groupBy(*scope).agg(F.max("samples").alias("_sa"))
    x = b.join(a, keys, "full").join(sb, scope, "left").join(sa, scope, "left").na.fill(0, ["_sb", "_sa"])
    wb, wa = F.col("b.weight"), F.col("a.weight")
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    delta = F.coalesce(wa, F.lit(0.0)) - F.coalesce(wb, F.lit(0.0))
    up = F.when(new, wa >= c.emergence_weight).when(gone, False).otherwise((delta >= c.emergence_delta) & (wa >= c.significant))
    down = F.when(gone, wb >= c.significant).when(new, False).otherwise((delta <= -c.decline_delta) & (wb >= c.significant))
    strength = clamp(F.when(new, wa / c.emergence_weight).when(gone, wb / c.significant).when(delta > 0, delta / c.emergence_delta).otherwise(-delta / c.decline_delta))
    active = F.coalesce(F.col("a"), F.col("b"))
    ref = F.when(delta > 0, F.col("a.confidence")).otherwise(F.col("b.confidence"))
    cross = F.when(new | gone, 0.8).when(ref >= 0.6, 0.9).otherwise(0.7)
    quality = evidence_quality(active["support"], active["sources"], active["enterprises"])
    conf = clamp(strength * c.signal + cross * c.cross + quality * c.evidence + c.semantic)
    weak = lambda s: s["support"] < c.support
    single = lambda s: s["sources"] < c.sources
    B, A = F.col("b"), F.col("a")
    changed = (F.abs(A["sources"] - B["sources"]) >= 1).cast("int") + (F.abs(A["enterprises"] - B["enterprises"]) >= 1).cast("int") + (F.abs(A["support"] - B["support"]) >= 3).cast("int")
    driven = (
        F.when(new, (F.col("_sb") < c.comparable) | weak(A) | single(A)).when(gone, (F.col("_sa") < c.comparable) | weak(B) | single(B))
        .otherwise(weak(B) | weak(A) | (single(B) & single(A)) | ((F.abs(delta) >= c.weight_delta) & (changed >= 2)))
    )
    out = x.withColumn("kind", F.when(up, "skill_emergence").when(down, "skill_decline")).filter("kind is not null")
    return out.select(*keys, "kind", wb.alias("before_weight"), wa.alias("after_weight"), delta.alias("delta"), conf.alias("signal_confidence"), quality.alias("quality"), active["confidence"].alias("relation_confidence"), active["category"].alias("category"), F.coalesce(driven, F.lit(False)).alias("coverage_driven"))


def replacements(signals: DataFrame, scope: list[str], skill: str, c: EvolutionConfig = EvolutionConfig()) -> DataFrame:
    """JOI-18. Declined and emerged skills of one category, with confidence and magnitude."""
    s = signals.filter(~F.col("coverage_driven"))
    d = s.filter("kind = 'skill_decline'").select(*scope, "category", F.col(skill).alias("old"), F.col("delta").alias("_do"), F.col("quality").alias("_qo"), F.col("relation_confidence").alias("_co"))
    e = s.filter("kind = 'skill_emergence'").select(*scope, "category", F.col(skill).alias("new"), F.col("delta").alias("_dn"), F.col("quality").alias("_qn"), F.col("relation_confidence").alias("_cn"))
    x = d.join(e, [*scope, "category"]).filter(F.col("old") != F.col("new"))
    move = F.abs("_do") + F.abs("_dn")
    strength = clamp(move / (c.emergence_delta + c.decline_delta) * 0.5)
    cross = F.when((F.col("_co") >= 0.6) & (F.col("_cn") >= 0.6), 0.9).otherwise(0.7)
    conf = clamp(strength * c.signal + cross * c.cross + F.least("_qo", "_qn") * c.evidence + c.semantic)
    return x.select(*scope, "category", "old", "new", conf.alias("confidence"), F.least(F.lit(1.0), move / 2).alias("magnitude")).filter(F.col("confidence") >= c.replacement)


def stack_migrations(repl: DataFrame, scope: list[str], c: EvolutionConfig = EvolutionConfig()) -> DataFrame:
    """EVO-06. Categories with enough replacements: their skills, mean confidence times 0.9, mean magnitude."""
    g = repl.groupBy(*scope, "category").agg(F.count("*").alias("replacements"), F.array_sort(F.collect_set("old")).alias("sources"), F.array_sort(F.collect_set("new")).alias("targets"), (F.avg("confidence") * 0.9).alias("confidence"), F.avg("magnitude").alias("magnitude"))
    return g.filter(F.col("replacements") >= c.stack)


def responsibility_shift(before: Column, after: Column, least: int = 2, similar: float = 0.5, overlap: float = 0.0) -> Column:
    """SET-04. Struct removed, added, similarity, magnitude of two sets, or null when it is no shift."""
    gone, new = F.array_sort(F.array_except(before, after)), F.array_sort(F.array_except(after, before))
    n = F.size(F.array_union(before, after))
    sim = F.when(n > 0, F.size(F.array_intersect(before, after)) / n).otherwise(1.0)
    moved = F.size(gone) + F.size(new)
    ok = (moved >= least) & (sim < similar) & (sim > overlap) & (F.size(gone) > 0) & (F.size(new) > 0)
    return F.when(ok, F.struct(gone.alias("removed"), new.alias("added"), sim.alias("similarity"), (moved / F.greatest(n, F.lit(1))).alias("magnitude")))


def role_breadth(df: DataFrame, key: str, order: str, columns: dict[str, float]) -> DataFrame:
    """EVO-07. Weighted relative change of counts against the preceding version."""
    w = W.partitionBy(key).orderBy(order)
    rel = lambda c: (F.col(c) - F.lag(c).over(w)) / F.greatest(F.lag(c).over(w), F.lit(1))
    return df.withColumn("breadth_change", sum((rel(c) * x for c, x in columns.items()), F.lit(0.0)))


def renames(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """EVO-10. Rows whose name differs from the preceding one of the key."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("previous_name", F.lag(name).over(w)).filter(F.col("previous_name") != F.col(name))


def decompose(df: DataFrame, delta: str, drift: Column, jaccard: Column, evidence: Column, category_changed: Column, name_changed: Column) -> DataFrame:
    """AGG-50. Shares of a weight change that meaning, neighbourhood and evidence explain, and a residual of 5 % at least."""
    d = F.greatest(F.abs(delta), F.lit(0.001))
    sem = drift * d + F.when(category_changed, 0.15 * d).otherwise(0.0) + F.when(name_changed, 0.08 * d).otherwise(0.0)
    top = (1 - jaccard) * d * 0.8
    evi = evidence * d
    total = sem + top + evi
    part = F.least(total / d, F.lit(0.95))
    share = lambda x: F.when(total >= 0.0001, x / total * part).otherwise(0.0)
    return df.select("*", share(sem).alias("semantic"), share(top).alias("topological"), share(evi).alias("evidence"), F.when(total >= 0.0001, 1 - part).otherwise(1.0).alias("residual"))


def attribution(total: Column, *parts: Column) -> Column:
    """AGG-49. What named parts leave unexplained."""
    return total - sum(parts, F.lit(0.0))


def watermark_reasons(left: Column, right: Column, fields: list[str]) -> Column:
    """EVO-11. Names of the fields in which two build inputs differ."""
    return F.array_compact(F.array(*[F.when(~left[f].eqNullSafe(right[f]), F.lit(f"{f}_differs")) for f in fields]))
