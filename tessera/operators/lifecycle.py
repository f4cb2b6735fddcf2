"""State machines over ordered windows, as folds of one shared transition function."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: EMG-09. Fixed order of promotion and its thresholds (windows, support, companies, emergence, identity stability).
PROMOTION = {"weak_signal": "incubating", "incubating": "emerging_candidate", "emerging_candidate": "stable_emerging_role"}
REQUIRED = {"incubating": (2, 3, 2, 0.3, 0), "emerging_candidate": (3, 5, 3, 0.5, 2), "stable_emerging_role": (5, 10, 5, 0.6, 3)}
NOISE = (4, 2, 1, 0.2)
STATES = ("not_observed", "emerging", "bonus", "required", "core")


@dataclass(frozen=True)
class RoleConfig:
    """WIN-33. Thresholds of the role-state machine."""

    emerge: float = 0.15
    vanish: float = 0.08
    bonus: float = 0.20
    unbonus: float = 0.15
    required: float = 0.40
    unrequired: float = 0.33
    core: float = 0.65
    uncore: float = 0.58
    jitter: float = 0.04
    fall: float = -0.15
    recover: float = 0.05
    absent: int = 3


def promote(status: Column, windows: Column, support: Column, companies: Column, emergence: Column, stability: Column) -> Column:
    """EMG-09. The next status: noise after repeated weak evidence, one promotion if all thresholds hold, else the same."""
    noise = (windows >= NOISE[0]) & (support <= NOISE[1]) & (companies <= NOISE[2]) & (emergence <= NOISE[3])
    out = F.when(status.isin("noise", "dead", "merged", "official_position"), status).when(noise, "noise")
    for now, nxt in PROMOTION.items():
        r = REQUIRED[nxt]
        out = out.when((status == now) & (windows >= r[0]) & (support >= r[1]) & (companies >= r[2]) & (emergence >= r[3]) & (stability >= r[4]), nxt)
    return out.otherwise(status)


def promotion_gap(df: DataFrame, target: str, columns: Mapping[str, str]) -> DataFrame:
    """EMG-11. What each threshold of a target status still lacks, and whether all hold."""
    names = ("windows", "support", "companies", "emergence", "stability")
    gaps = [F.greatest(F.lit(0.0), F.lit(float(r)) - F.col(columns[n])).alias(f"missing_{n}") for n, r in zip(names, REQUIRED[target]) if n in columns]
    ok = [F.col(columns[n]) >= r for n, r in zip(names, REQUIRED[target]) if n in columns]
    every = ok[0]
    for x in ok[1:]:
        every = every & x
    return df.select("*", *gaps, every.alias("satisfied"))


def lifecycle(df: DataFrame, key: str, order: str, support: str, companies: str, emergence: str, stability: str, start: str = "weak_signal", dead_after: int = 3, window: str | None = None) -> DataFrame:
    """EMG-09, EMG-10. Status after every window: a fold over the key's windows, which are an array of one row per window.

    With ``window`` (consecutive numbers), a gap of ``dead_after`` windows or
    more kills a candidate before its next observation.
    """
    cols = list(dict.fromkeys(c for c in (order, support, companies, emergence, stability, window) if c))
    v = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_v"))
    first = F.element_at("_v", 1)
    zero = F.struct(F.lit(start).alias("status"), F.lit(0).alias("n"), (first[window] if window else F.lit(0)).cast("bigint").alias("last"), F.array().cast("array<string>").alias("out"))

    def go(s, x):
        n = s["n"] + 1
        at = (x[window] if window else F.lit(0)).cast("bigint")
        missed = F.when(at - s["last"] > dead_after, F.lit("dead")).otherwise(s["status"]) if window else s["status"]
        nxt = promote(missed, n, x[support], x[companies], x[emergence], x[stability])
        return F.struct(nxt.alias("status"), n.alias("n"), at.alias("last"), F.concat(s["out"], F.array(nxt)).alias("out"))

    states = F.aggregate("_v", zero, go, lambda s: s["out"])
    return v.select(key, F.explode(F.arrays_zip("_v", states.alias("st"))).alias("_x")).select(key, F.col(f"_x._v.{order}").alias(order), F.col("_x.st").alias("status"))


def role_state(share: Column, total: Column, weak: Column, before: Column, before_share: Column, absent: Column, c: RoleConfig = RoleConfig()) -> Column:
    """WIN-33. The next role state from shares, evidence and the previous state (hysteresis, jitter gate, reactivation)."""
    rank = F
    for i, s in enumerate(STATES):
        rank = rank.when(before == s, i)
    rank = rank.otherwise(-1)
    climb = F.when(share >= c.core, "core").when(share >= c.required, "required").when(share >= c.bonus, "bonus").when(share >= c.emerge, "emerging").when(before.isin("emerging", "bonus", "required", "declining") & (share >= c.vanish), before).otherwise("not_observed")
    from_core = F.when(share < c.vanish, "not_observed").when(share < c.unbonus, "emerging").when(share < c.unrequired, "bonus").when(share < c.uncore, "required").otherwise("core")
    move = share - before_share
    falling = F.when(before == "declining", move < c.recover).otherwise((move <= c.fall) & (before_share >= 0.10))
    back = F.when(share >= c.bonus, "bonus").when(share >= c.emerge, "emerging").otherwise("retired")
    return (
        F.when(weak, F.when((total > 0) & before.isNotNull() & ~before.isin("not_observed", "retired"), before).otherwise("not_observed"))
        .when(total == 0, F.when(absent >= c.absent, "retired").otherwise("not_observed"))
        .when(before.isNotNull() & before_share.isNotNull() & (before != "retired") & (F.abs(move) < c.jitter), before)
        .when(F.coalesce(falling, F.lit(False)), "declining").when(before == "retired", back).when(rank == 4, from_core).otherwise(climb)
    )


def role_states(df: DataFrame, key: list[str], order: str, share: str, total: str, weak: str, c: RoleConfig = RoleConfig()) -> DataFrame:
    """WIN-33. Role states of every window, folded over the key's ordered windows."""
    v = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, share, total, weak))).alias("_v"))
    zero = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("w"), F.lit(0).alias("a"), F.array().cast("array<string>").alias("out"))

    def go(s, x):
        gone = F.when(x[total] == 0, s["a"] + 1).otherwise(0)
        nxt = role_state(x[share], x[total], x[weak], s["s"], s["w"], gone, c)
        return F.struct(nxt.alias("s"), x[share].cast("double").alias("w"), gone.alias("a"), F.concat(s["out"], F.array(nxt)).alias("out"))

    out = F.aggregate("_v", zero, go, lambda s: s["out"])
    return v.select(*key, F.explode(F.arrays_zip("_v", out.alias("st"))).alias("_x")).select(*key, F.col(f"_x._v.{order}").alias(order), F.col(f"_x._v.{share}").alias(share), F.col("_x.st").alias("state"))


def role_transitions(df: DataFrame, key: list[str], order: str, state: str, share: str) -> DataFrame:
    """WIN-34. Type of the change from the preceding state and the change of the share."""
    w = W.partitionBy(*key).orderBy(order)
    x = df.withColumn("before_state", F.lag(state).over(w)).withColumn("share_delta", F.col(share) - F.lag(share).over(w)).filter("before_state is not null")
    rank = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), c), F.lit(0))
    b, a = F.col("before_state"), F.col(state)
    kind = (
        F.when(b == a, "no_change").when(b.isin("declining", "retired") & a.isin("emerging", "bonus", "required", "core"), "reactivation").when((b == "not_observed") & (a != "not_observed"), "entry")
        .when(a.isin("not_observed", "retired"), "exit").when(a == "core", "consolidation").when(a == "declining", "demotion").when(rank(a) > rank(b), "promotion").otherwise("demotion")
    )
    return x.withColumn("transition", kind)


def stage2(df: DataFrame, structural: Column, postings: Column, enterprises: Column, sources: Column, windows: Column, least: tuple[int, int, int, int] = (3, 2, 2, 2)) -> DataFrame:
    """EMG-01. Decision of the structural, diffusion and persistence gates, and with each gate switched off (ablation)."""
    gates = {"structural": structural, "diffusion": (enterprises >= least[1]) & (sources >= least[2]), "persistence": windows >= least[3]}
    out = df.withColumn("ablation", F.explode(F.array(F.lit("none"), *[F.lit(g) for g in gates])))
    ok = F.lit(True)
    for g, c in gates.items():
        ok = ok & (c | (F.col("ablation") == g))
    return out.withColumn("decision", F.when(postings < least[0], "insufficient").when(ok, "emerging").when(structural, "weak_signal").otherwise("not_emerging"))


def identity_reasons(title: Column, skill: Column, responsibility: Column, overlap: Column, limits: tuple[float, float, float] = (0.7, 0.5, 0.5)) -> Column:
    """EMG-06. Reasons for one identity: any shared member, the title, or skills with responsibilities."""
    return F.array_compact(F.array(F.when(overlap > 0, F.lit("membership_overlap")), F.when(title >= limits[0], F.lit("title")), F.when((skill >= limits[1]) & (responsibility >= limits[2]), F.lit("skills_and_responsibilities"))))


def germination(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """MAT-11. Weighted mean of available dimensions (nulls keep out of both sums)."""
    num = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("germination", F.when(den > 0, num / den))


def reference_distance(candidates: DataFrame, references: DataFrame, candidate: str, reference: str, element: str) -> DataFrame:
    """MAT-12. (candidate, distance): 1 less the greatest Jaccard similarity of a candidate's elements with any reference's.

    Both tables hold one element a row. Sets meet by their elements, so pairs
    without a common one are never made; a candidate that meets none has 1.
    """
    a = candidates.select(F.col(candidate).alias("_c"), F.col(element).alias("_e")).distinct()
    b = references.select(F.col(reference).alias("_r"), F.col(element).alias("_e")).distinct()
    na, nb = a.groupBy("_c").agg(F.count("*").alias("_na")), b.groupBy("_r").agg(F.count("*").alias("_nb"))
    both = a.join(b, "_e").groupBy("_c", "_r").agg(F.count("*").alias("_k")).join(nb, "_r").join(na, "_c")
    best = both.groupBy("_c").agg(F.max(F.col("_k") / (F.col("_na") + F.col("_nb") - F.col("_k"))).alias("_s"))
    return na.join(best, "_c", "left").select(F.col("_c").alias(candidate), (1 - F.coalesce("_s", F.lit(0.0))).alias("distance"))
