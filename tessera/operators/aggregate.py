"""Aggregates over evidence and skill facts: relation metrics, weights, sample sizes, evaluation metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.scalars import clamp, ratio

#: Fixed order of modalities.
MODALITY = {"unknown": 0, "bonus": 1, "preferred": 2, "required": 3}


def modality_rank(m: Column) -> Column:
    out = F
    for name, k in MODALITY.items():
        out = out.when(m == name, k)
    return out.otherwise(0)


@dataclass(frozen=True)
class RelationFormula:
    """AGG-07. Caps and weights; the defaults are illustrative and meant to be replaced."""

    source_cap: float = 3
    enterprise_cap: float = 5
    support_cap: float = 10
    modality: Mapping[str, float] = field(default_factory=lambda: {"required": 1.0, "preferred": 0.7, "bonus": 0.4, "unknown": 0.0})
    weight: Mapping[str, float] = field(default_factory=lambda: {"frequency": 0.25, "support": 0.2, "modality": 0.2, "source": 0.1, "enterprise": 0.1, "freshness": 0.1, "trusted": 0.05})
    confidence: Mapping[str, float] = field(default_factory=lambda: {"frequency": 0.3, "support": 0.4, "trusted": 0.15, "source": 0.15})


def best_modality(df: DataFrame, keys: Sequence[str], modality: str, extra: Sequence[Column] = ()) -> DataFrame:
    """AGG-05. The strongest modality of each (document, skill); unknown ones are dropped first."""
    known = df.filter(F.col(modality) != "unknown")
    return known.groupBy(*keys).agg(F.max_by(modality, modality_rank(F.col(modality))).alias(modality), *extra)


def relation_metrics(best: DataFrame, keys: Sequence[str], documents: int | Column, weight: str, source: str, enterprise: str, fresh: str, trusted: str, modality: str = "modality") -> DataFrame:
    """AGG-06. Metrics of a (position, skill) relation over documents at their best modality.

    ``documents`` is the number of included documents. Ratios by modality weigh
    documents by ``weight``; a relation mostly unknown is left out.
    """
    w = F.col(weight)
    total = F.greatest(F.sum(w), F.lit(0.0001))
    n = F.count("*")
    den = documents if isinstance(documents, Column) else F.lit(max(documents, 1))
    parts = {m: F.sum(F.when(F.col(modality) == m, w).otherwise(0.0)) / total for m in MODALITY}
    out = best.groupBy(*keys).agg(
        n.alias("support_documents"), F.countDistinct(source).alias("sources"), F.countDistinct(enterprise).alias("enterprises"), (n / F.first(den)).alias("support_ratio"),
        F.least(F.lit(1.0), total / F.first(den)).alias("weighted_frequency"), *[v.alias(f"{m}_ratio") for m, v in parts.items()], F.avg(fresh).alias("freshness"), F.avg(F.col(trusted).cast("double")).alias("trusted_ratio"),
    )
    return out.filter(F.col("unknown_ratio") <= F.greatest("required_ratio", "preferred_ratio", "bonus_ratio"))


def score_relation(df: DataFrame, f: RelationFormula = RelationFormula()) -> DataFrame:
    """AGG-07, AGG-08. weight, confidence, importance level and review reasons from relation metrics."""
    cap = lambda c, k: F.least(F.lit(1.0), F.col(c) / F.lit(float(k)))
    strength = sum((F.col(f"{m}_ratio") * x for m, x in f.modality.items()), F.lit(0.0))
    src, ent, sup = cap("sources", f.source_cap), cap("enterprises", f.enterprise_cap), cap("support_documents", f.support_cap)
    v = {"frequency": F.col("weighted_frequency"), "support": F.col("support_ratio"), "modality": strength, "source": src, "enterprise": ent, "freshness": F.col("freshness"), "trusted": F.col("trusted_ratio")}
    weight = clamp(sum((v[k] * x for k, x in f.weight.items()), F.lit(0.0)))
    c = {**v, "support": sup}
    conf = clamp(sum((c[k] * x for k, x in f.confidence.items()), F.lit(0.0)))
    out = df.withColumn("modality_strength", strength).withColumn("weight", weight).withColumn("confidence", conf)
    out = out.withColumn("importance", F.when(F.col("weight") >= 0.7, "core").when(F.col("weight") >= 0.4, "important").otherwise("supplementary"))
    why = F.concat_ws(",", F.when(F.col("confidence") < 0.7, "medium_or_low_confidence"), F.when(F.col("unknown_ratio") > 0, "unknown_modality"), F.when(F.col("support_documents") < 2, "insufficient_evidence"))
    return out.withColumn("review_reasons", why)


def aggregate_groups(df: DataFrame, kind: str, text: str, document: str, conflicting: Sequence[str] = ("education", "experience", "certificate")) -> DataFrame:
    """AGG-09. (kind, text) groups with sorted distinct documents; a conflict when a kind of a given list has several texts."""
    g = df.groupBy(kind, text).agg(F.array_sort(F.collect_set(document)).alias("documents"), F.count("*").alias("rows"))
    several = F.count("*").over(W.partitionBy(kind)) > 1
    return g.withColumn("conflict", F.col(kind).isin(*conflicting) & several).withColumn("low_confidence", F.col("rows") < 2)


def reason_histogram(df: DataFrame, reasons: str) -> DataFrame:
    """AGG-10. How often each reason of an array column occurs."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("count"))


def kish(w: str | Column) -> Column:
    """AGG-26. (sum w)^2 / sum w^2; 0 when all weights are zero."""
    x = F.col(w) if isinstance(w, str) else w
    s, q = F.sum(x), F.sum(x * x)
    return F.when(q > 0, s * s / q).otherwise(F.lit(0.0))


def entropy_size(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """AGG-27. exp of the entropy of the normalised positive weights per key."""
    p = F.col(w) / F.sum(w).over(W.partitionBy(*keys))
    x = df.filter(F.col(w) > 0).withColumn("_p", p)
    return x.groupBy(*keys).agg(F.exp(-F.sum(F.col("_p") * F.log("_p"))).alias("entropy_size"))


def cluster_weights(members: DataFrame, cluster: str, quality: str, complete: str) -> DataFrame:
    """AGG-28 v1. 0.5 + 0.5 of the best quality, halved when no member is complete."""
    g = members.groupBy(cluster).agg(F.max(quality).alias("_q"), F.max(F.col(complete).cast("int")).alias("_c"))
    return g.select(cluster, ((0.5 + 0.5 * F.col("_q")) * F.when(F.col("_c") == 1, 1.0).otherwise(0.5)).alias("weight"))


def diversity_weights(clusters: DataFrame, weight: str, caps: Mapping[str, float]) -> DataFrame:
    """AGG-28 v2. Weights times min(1, cap / size of the group) for every grouping column."""
    out = F.col(weight)
    for c, cap in caps.items():
        out = out * F.least(F.lit(1.0), F.lit(float(cap)) / F.count("*").over(W.partitionBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")))))
    return clusters.withColumn("diverse_weight", out)


def cap_mass(q, groups, caps, rounds: int = 20, tolerance: float = 1e-6):
    """AGG-29. Rescales groups above their cap and renormalises, dimension by dimension, until all hold.

    q: masses (numpy); groups: for each dimension an array of group numbers; caps likewise.
    """
    import numpy as np

    p = q / q.sum() if q.sum() > 0 else q * 0
    for _ in range(rounds if p.sum() > 0 else 0):
        for g, cap in zip(groups, caps):
            mass = np.bincount(g, weights=p)
            p = p * np.where(mass > cap, cap / np.maximum(mass, 1e-300), 1.0)[g]
            p = p / p.sum()
        if all((np.bincount(g, weights=p) - cap).max() <= tolerance for g, cap in zip(groups, caps)):
            break
    return p


def project_mass(q, groups, caps, rounds: int = 500, tolerance: float = 1e-6, rate: float = 1.0, decay: float = 0.02):
    """AGG-30. KL projection onto the caps by projected dual ascent; returns masses, worst violation and iterations."""
    import numpy as np

    q = np.maximum(q / q.sum(), 1e-12)
    lam = [np.zeros(g.max() + 1) for g in groups]
    p, worst, it = q, 0.0, 0
    for it in range(1, rounds + 1):
        before = p
        x = q * np.exp(-sum(v[g] for v, g in zip(lam, groups)))
        p = x / x.sum()
        gaps = [np.bincount(g, weights=p, minlength=len(v)) - cap for g, v, cap in zip(groups, lam, caps)]
        step = rate / (1 + decay * (it - 1))
        new = [np.maximum(0.0, v + step * d) for v, d in zip(lam, gaps)]
        moved = max(float(np.abs(a - b).max()) for a, b in zip(new, lam))
        lam = new
        worst = max(0.0, max(float(d.max()) for d in gaps))
        if worst <= tolerance and np.abs(p - before).max() <= 1e-8 and moved <= 1e-8:
            break
    return p, worst, it


def capped_weights(clusters: DataFrame, key: str, cluster: str, weight: str, caps: Mapping[str, float], dual: bool = False) -> DataFrame:
    """AGG-29, AGG-30. Mass-capped weights per ``key`` (one conclusion); the clusters of a key are one task's work."""
    import pandas as pd

    names = list(caps)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        groups = [pd.factorize(pdf[c].fillna("unknown"), sort=True)[0] for c in names]
        q = pdf[weight].to_numpy(float)
        if dual:
            p, worst, _ = project_mass(q, groups, list(caps.values()))
        else:
            p, worst = cap_mass(q, groups, list(caps.values())), 0.0
        return pd.DataFrame({key: pdf[key], cluster: pdf[cluster], "mass": p.round(8), "violation": round(worst, 6)})

    t = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}
    return clusters.select(key, cluster, weight, *names).groupBy(key).applyInPandas(run, f"{key} {t[key]}, {cluster} {t[cluster]}, mass double, violation double")


def lag_profile(df: DataFrame, source: str, lag: Column, most: float) -> DataFrame:
    """AGG-31. Valid and invalid lags per source, median, nearest-rank p90 and maximum of the valid ones."""
    x = df.select(source, lag.alias("_l")).withColumn("_v", F.when((F.col("_l") >= 0) & (F.col("_l") <= most), F.col("_l")))
    g = x.groupBy(source).agg(F.count("_v").alias("valid"), (F.count("*") - F.count("_v")).alias("invalid"), F.percentile("_v", 0.5).alias("median"), F.max("_v").alias("longest"), F.sort_array(F.collect_list("_v")).alias("_s"))
    return g.withColumn("p90", F.try_element_at("_s", F.ceil(F.size("_s") * 0.9).cast("int"))).drop("_s")


def modality_shares(df: DataFrame, keys: Sequence[str], modality: str, weight: str, total: Column) -> DataFrame:
    """AGG-19. Shares of required and bonus relations; an unknown modality counts by its weight."""
    m = F.lower(F.col(modality))
    req = (m == "required") | (~m.isin("required", "bonus", "preferred", "nice_to_have") & (F.col(weight) >= 0.5))
    bon = m.isin("bonus", "preferred", "nice_to_have") | (~m.isin("required", "bonus", "preferred", "nice_to_have") & (F.col(weight) > 0) & (F.col(weight) < 0.5))
    g = df.groupBy(*keys).agg(F.count_if(req).alias("_r"), F.count_if(bon).alias("_b"), F.first(total).alias("_t"))
    t = F.greatest(F.col("_t"), F.lit(1))
    return g.select(*keys, clamp(F.col("_r") / t).alias("required_share"), clamp(F.col("_b") / t).alias("bonus_share"), clamp((F.col("_r") + F.col("_b")) / t).alias("total_coverage"))


def coverage_state(samples: Column, sources: Column, enterprises: Column, least: int = 3) -> Column:
    """AGG-20. insufficient_evidence, source_concentrated or unresolved."""
    return F.when(samples < least, "insufficient_evidence").when((sources <= 1) | (enterprises <= 1), "source_concentrated").otherwise("unresolved")


def inflation_status(modality: Column, support: Column, required: Column, prevalence: Column, purity: Column, enterprises: Column, gate: tuple[float, int, float] = (0.2, 2, 0.5)) -> Column:
    """AGG-21. Whether the market supports a required skill; gate: prevalence, required documents, purity."""
    weak = (prevalence < gate[0]) | (required < gate[1]) | (purity < gate[2])
    return F.when(modality != "required", "not_applicable").when(~weak, "market_supported").when((enterprises >= 2) | (support >= 3), "enterprise_specific").otherwise("inflation_risk")


def dependency_pairs(baskets: DataFrame, context: str, item: str, extra: Sequence[Column] = ()) -> DataFrame:
    """AGG-22. Ordered pairs (prerequisite, advanced) with P(pre | adv) - P(adv | pre) > 0 and their joint support.

    Without ``extra`` pairs are counted where a context's items lie together:
    nothing is joined with itself, and an item with itself counts its contexts.
    """
    if extra:
        b = baskets.select(context, item).distinct()
        n = b.groupBy(item).agg(F.count("*").alias("_n"))
        pairs = b.withColumnRenamed(item, "prerequisite").join(baskets.withColumnRenamed(item, "advanced"), context).filter("prerequisite <> advanced")
        j = pairs.groupBy("prerequisite", "advanced").agg(F.countDistinct(context).alias("joint"), *extra)
    else:
        from tessera.operators.similarity import settled

        s = baskets.groupBy(context).agg(F.collect_set(item).alias("_s"))
        pairs = s.select(context, F.explode("_s").alias("prerequisite"), "_s").select(context, "prerequisite", F.explode("_s").alias("advanced"))
        j = settled(pairs.filter(F.col(context).isNotNull() | (F.col("prerequisite") == F.col("advanced"))).groupBy("prerequisite", "advanced").agg(F.count("*").alias("joint")))
        n = j.filter("prerequisite = advanced").select(F.col("prerequisite").alias(item), F.col("joint").alias("_n"))
        j = j.filter("prerequisite <> advanced")
    j = j.join(n.select(F.col(item).alias("prerequisite"), F.col("_n").alias("_np")), "prerequisite").join(n.select(F.col(item).alias("advanced"), F.col("_n").alias("_na")), "advanced")
    out = j.withColumn("p_pre_given_adv", F.col("joint") / F.col("_na")).withColumn("p_adv_given_pre", F.col("joint") / F.col("_np"))
    return out.withColumn("dependency", F.col("p_pre_given_adv") - F.col("p_adv_given_pre")).filter("dependency > 0").drop("_np", "_na")


def bootstrap_interval(pairs: DataFrame, baskets: DataFrame, context: str, item: str, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """AGG-23. Poisson bootstrap interval of the dependency score of given pairs.

    Every context weighs Poisson(1) in each round, drawn from a hash of context
    and round, so results do not depend on the partitioning and no context is
    gathered. (A sequential generator would give other, equally valid, draws.)
    """
    u = (F.pmod(F.xxhash64(context, "_r"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    weight = F
    for k, s in enumerate(steps):
        weight = weight.when(u < s, k)
    per = pairs.select("prerequisite", "advanced").join(baskets.select(context, F.col(item).alias("prerequisite"), F.lit(1).alias("_a")).distinct(), "prerequisite")
    both = pairs.select("prerequisite", "advanced").join(baskets.select(context, F.col(item).alias("advanced"), F.lit(1).alias("_b")).distinct(), "advanced")
    each = per.join(both, ["prerequisite", "advanced", context], "full").withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_w", weight.otherwise(8))
    s = each.groupBy("prerequisite", "advanced", "_r").agg(F.sum(F.when(F.col("_a").isNotNull(), F.col("_w"))).alias("np"), F.sum(F.when(F.col("_b").isNotNull(), F.col("_w"))).alias("na"), F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_w"))).alias("j"))
    d = F.when((F.col("np") > 0) & (F.col("na") > 0), F.coalesce("j", F.lit(0)) / F.col("na") - F.coalesce("j", F.lit(0)) / F.col("np")).otherwise(0.0)
    a = (1 - level) / 2
    return s.groupBy("prerequisite", "advanced").agg(F.percentile(d, a).alias("lower"), F.percentile(d, 1 - a).alias("upper"))


def binary_metrics(actual: Column, predicted: Column) -> list[Column]:
    """AGG-39. Counts, precision, recall and F1 of two boolean columns; null without a denominator."""
    tp, fp, fn = F.count_if(actual & predicted), F.count_if(~actual & predicted), F.count_if(actual & ~predicted)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """AGG-39. Confusion counts for all pairs of labels, 0 where there is none."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], [actual, predicted])
    c = df.groupBy(actual, predicted).agg(F.count("*").alias("count"))
    return grid.join(c, [actual, predicted], "left").select(actual, predicted, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def calibrate(df: DataFrame, score: str, actual: str, thresholds: Sequence[float]) -> DataFrame:
    """AGG-41. Metrics at every threshold and which one is best by (F1, precision, recall, threshold)."""
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    g = t.groupBy("threshold").agg(*binary_metrics(F.col(actual), F.col(score) >= F.col("threshold")))
    key = F.struct(F.coalesce("f1", F.lit(-1.0)), F.coalesce("precision", F.lit(-1.0)), F.coalesce("recall", F.lit(-1.0)), "threshold")
    return g.withColumn("recommended", key == F.max(key).over(W.partitionBy(F.lit(1))))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """AGG-42. Share of the majority label of each cluster."""
    return df.groupBy(cluster, label).agg(F.count("*").alias("_n")).groupBy(cluster).agg(F.max("_n").alias("majority"), F.sum("_n").alias("size")).withColumn("purity", F.col("majority") / F.col("size"))


def shapley(outcomes: DataFrame, mask: str, value: str, factors: int) -> DataFrame:
    """AGG-47. Shapley value of every factor from the values of all coalitions (bit masks)."""
    a = outcomes.select(F.col(mask).alias("_m"), F.col(value).alias("_v"))
    grid = a.withColumn("factor", F.explode(F.sequence(F.lit(0), F.lit(factors - 1)))).filter(F.col("_m").bitwiseAND(F.expr("shiftleft(1L, factor)")) == 0)
    grid = grid.withColumn("_w", F.col("_m") + F.expr("shiftleft(1L, factor)"))
    b = outcomes.select(F.col(mask).alias("_w"), F.col(value).alias("_u"))
    size = F.bit_count("_m")
    weight = F.factorial(size) * F.factorial(F.lit(factors) - size - 1) / F.factorial(F.lit(factors))
    return grid.join(b, "_w").groupBy("factor").agg(F.sum(weight * (F.col("_u") - F.col("_v"))).alias("shapley"))


def factor_interactions(outcomes: DataFrame, mask: str, value: str, factors: int) -> DataFrame:
    """AGG-47. Pairwise interaction v(ab) - v(a) - v(b) + v(0)."""
    f = outcomes.sparkSession.createDataFrame([(i, j, 1 << i, 1 << j, (1 << i) | (1 << j)) for i in range(factors) for j in range(i + 1, factors)], "factor_a int, factor_b int, ma long, mb long, mab long")
    v = outcomes.agg(F.map_from_entries(F.collect_list(F.struct(F.col(mask).cast("long"), value))).alias("m"))  # 2^factors entries
    x = f.crossJoin(F.broadcast(v))
    at = lambda k: F.try_element_at("m", k)
    return x.select("factor_a", "factor_b", (at(F.col("mab")) - at(F.col("ma")) - at(F.col("mb")) + at(F.lit(0).cast("long"))).alias("interaction"))


def concentration(df: DataFrame, key: str, member: str) -> DataFrame:
    """AGG-35. Herfindahl index and largest share of the members of each key."""
    c = df.groupBy(key, member).agg(F.count("*").alias("_n")).withColumn("_s", F.col("_n") / F.sum("_n").over(W.partitionBy(key)))
    return c.groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.max("_s").alias("max_share"), F.count("*").alias("members"))


def cluster_summary(members: DataFrame, cluster: str, member: str, item: str) -> DataFrame:
    """AGG-33. Items that at least half of a cluster's members have, by falling support, then name."""
    size = members.groupBy(cluster).agg(F.countDistinct(member).alias("_m"))
    n = members.groupBy(cluster, item).agg(F.countDistinct(member).alias("support")).join(size, cluster)
    return n.filter(F.col("support") >= F.ceil(F.col("_m") / 2)).withColumn("rank", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("support"), item)).cast("bigint")).drop("_m")


def source_dimensions(df: DataFrame, source: str, ts: str, complete: Column, parsed: Column, days: int, expected: float) -> DataFrame:
    """AGG-16. Coverage, sufficiency, completeness, parse rate and evenness (1 - variation of daily counts) in percent."""
    day = df.groupBy(source, F.to_date(ts).alias("_d")).agg(F.count("*").alias("_n"), F.count_if(complete).alias("_c"), F.count_if(parsed).alias("_p"))
    g = day.groupBy(source).agg(F.count("*").alias("_days"), F.sum("_n").alias("samples"), F.sum("_c").alias("_c"), F.sum("_p").alias("_p"), F.stddev_pop("_n").alias("_sd"), F.avg("_n").alias("_m"))
    return g.select(
        source, "samples", F.least(F.lit(100.0), 100.0 * F.col("_days") / days).alias("time_window_coverage"), F.least(F.lit(100.0), 100.0 * F.col("samples") / expected).alias("sample_sufficiency"),
        (100.0 * F.col("_c") / F.col("samples")).alias("field_completeness"), (100.0 * F.col("_p") / F.col("samples")).alias("parse_success_rate"), (100.0 * F.greatest(F.lit(0.0), 1 - F.col("_sd") / F.col("_m"))).alias("temporal_distribution"),
    )


#: AGG-17. Fixed weights of the grade and thresholds of its flags.
GRADE_WEIGHTS = {"time_window_coverage": 0.20, "sample_sufficiency": 0.20, "field_completeness": 0.15, "parse_success_rate": 0.15, "temporal_distribution": 0.10}
GRADE_FLAGS = {"time_window_coverage": ("partial_time_coverage", 50.0), "sample_sufficiency": ("low_sample", 50.0), "field_completeness": ("incomplete_fields", 70.0), "parse_success_rate": ("high_parse_failure", 80.0), "temporal_distribution": ("clustered_distribution", 50.0)}


def grade(df: DataFrame) -> DataFrame:
    """AGG-17. Weighted score (100 at most), grade and comma-joined flags of source dimensions."""
    score = F.least(sum((F.col(k) * w for k, w in GRADE_WEIGHTS.items()), F.lit(0.0)), F.lit(100.0))
    out = df.withColumn("score", score)
    flags = F.concat_ws(",", *[F.when(F.col(k) < t, F.lit(n)) for k, (n, t) in GRADE_FLAGS.items()])
    return out.withColumn("grade", F.when(F.col("score") >= 75, "good").when(F.col("score") >= 45, "degraded").otherwise("poor")).withColumn("flags", flags)
