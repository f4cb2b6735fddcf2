"""Matching of candidates with requirements: constraints, scores, gates, what-if outcomes, action sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from tessera.functions.scalars import clamp, ordinal

#: Fixed ranks of recommendations and gates.
RECOMMENDATION = {"insufficient_information": 0, "not_recommended": 0, "weak_match": 1, "potential_match": 2, "strong_match": 3}
GATE = {"failed": 0, "uncertain": 1, "passed": 2, "not_applicable": 2}
OWNERSHIP = {"unknown": 0, "declared": 0, "used": 1, "participated": 1, "implemented": 2, "owned": 3, "designed": 4, "led": 5}


def scalar_match(required: Column, candidates: Column, one_of: Column) -> Column:
    """MAT-21. Equality with any candidate value, or for one_of an overlap with the values split at | and comma."""
    low = F.transform(candidates, lambda x: F.lower(F.trim(x)))
    parts = F.filter(F.transform(F.split(required, "[|,]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(one_of, F.arrays_overlap(parts, low)).otherwise(F.array_contains(low, F.lower(F.trim(required))))


def experience_status(required: Column, lower: Column, upper: Column) -> Column:
    """MAT-22. pass if the lower bound reaches the requirement, fail if the upper one does not, else unknown; nothing required passes."""
    return F.when(required.isNull(), "unresolved").when(required <= 0, "pass").when(lower.isNull(), "unknown").when(lower >= required, "pass").when(upper < required, "fail").otherwise("unknown")


def hard_gate(df: DataFrame, key: Sequence[str], status: str) -> DataFrame:
    """MAT-20. Gate of each pair: failed if any constraint fails, uncertain if any is unknown, passed, or not applicable."""
    n = lambda *s: F.count_if(F.col(status).isin(*s))
    g = F.when(n("fail") > 0, "failed").when(n("unknown", "unresolved") > 0, "uncertain").when(n("pass") > 0, "passed").otherwise("not_applicable")
    return df.groupBy(*key).agg(g.alias("gate"))


def skill_status(capability: Column, declared: Column, level: Column, required_level: Column) -> Column:
    """MAT-23. matched, weak, declared_only or missing for a requirement and the best capability (nulls: none)."""
    return F.when(capability.isNull() & declared, "declared_only").when(capability.isNull(), "missing").when(required_level.isNull() | (level >= required_level), "matched").when(level.isNull(), "unknown").otherwise("weak")


def item_score(status: Column, match_type: Column, relation_confidence: Column, weights: Mapping[str, float] | None = None) -> Column:
    """MAT-24. Score of an item by status and match type; null for uncertain ones, which stay out of denominators."""
    w = {"weak": 0.5, "declared_only": 0.3, "equivalent": 0.9, "transferable": 0.6, "parent_child": 0.0, "prerequisite": 0.0} | dict(weights or {})
    return (
        F.when(status.isin("unknown", "unresolved"), None).when(status == "missing", 0.0).when(status == "weak", w["weak"]).when(status == "declared_only", w["declared_only"])
        .when(match_type == "exact", 1.0).when(match_type == "equivalent", w["equivalent"]).when(match_type == "transferable", w["transferable"] * F.coalesce(relation_confidence, F.lit(1.0)))
        .when(match_type == "parent_child", w["parent_child"]).when(match_type == "prerequisite", w["prerequisite"]).when(match_type == "related", 0.0)
    )


def ownership_factor(required: Column, candidate: Column) -> Column:
    """WIN-35, MAT-24. 1 if the candidate's ownership reaches the required one, else (own + 1) / (required + 1)."""
    r, c = ordinal(F.lower(required), OWNERSHIP), F.coalesce(ordinal(F.lower(candidate), OWNERSHIP), F.lit(0))
    return F.when(r.isNull() | (r == 0) | (c >= r), 1.0).otherwise((c + 1) / (r + 1))


def dimension_score(items: DataFrame, key: Sequence[str], dimension: str, score: str, confidence: str, weights: Mapping[str, float]) -> DataFrame:
    """MAT-25. Weighted score of each pair over the dimensions that have scored items, their weights renormalised; 0 to 100.

    Dimensions whose items are all uncertain reserve their weight: they lower
    the coverage, not the score.
    """
    w = F
    for d, x in weights.items():
        w = w.when(F.col(dimension) == d, x)
    g = items.groupBy(*key, dimension).agg(F.avg(score).alias("_s"), F.avg(F.when(F.col(score).isNotNull(), F.col(confidence))).alias("_c")).withColumn("_w", w.otherwise(0.0))
    ok = F.col("_s").isNotNull()
    scored = F.sum(F.when(ok, F.col("_w")))
    return g.groupBy(*key).agg(
        (100 * F.sum(F.col("_s") * F.when(ok, F.col("_w"))) / F.nullif(scored, F.lit(0.0))).alias("score"), (F.sum(F.col("_c") * F.when(ok, F.col("_w"))) / F.nullif(scored, F.lit(0.0))).alias("confidence"),
        (F.coalesce(scored, F.lit(0.0)) / F.sum("_w")).alias("coverage"),
    )


def recommendation(score: Column, confidence: Column, gate: Column, limits: tuple[float, float, float] = (75.0, 55.0, 35.0), least: float = 0.4) -> Column:
    """MAT-28. Banding; a failed gate is never recommended, a strong match needs a passed gate."""
    return (
        F.when(gate == "failed", "not_recommended").when(score.isNull() | (confidence < least), "insufficient_information").when((score >= limits[0]) & gate.isin("passed", "not_applicable"), "strong_match")
        .when(score >= limits[1], "potential_match").when(score >= limits[2], "weak_match").otherwise("not_recommended")
    )


def expected_dimensions(expected: Column, produced: Column) -> Column:
    """MAT-26. Expected dimensions that were not produced."""
    return F.array_sort(F.array_except(expected, produced))


def transferable_coverage(items: DataFrame, key: Sequence[str], status: str, score: str) -> DataFrame:
    """MAT-29. Mean score of the items that can be evaluated, null without any."""
    ok = ~F.col(status).isin("unknown", "unresolved")
    return items.groupBy(*key).agg(F.avg(F.when(ok, F.coalesce(score, F.lit(0.0)))).alias("transferable_coverage"))


def _each_key(df: DataFrame, key: str, columns: Sequence[str], run: Callable[..., list[tuple]], fields: str) -> DataFrame:
    """(key, fields) of ``run``'s rows for each key; it gets a key's columns as lists, sorted by the first. Keys go through a task in batches, not as a data frame each."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns)), lambda a, b: F.when(a[columns[0]] < b[columns[0]], -1).when(a[columns[0]] > b[columns[0]], 1).otherwise(0)).alias("_v"))
    out = StructType.fromDDL(f"`{key}` {df.schema[key].dataType.simpleString()}, {fields}")
    kinds = [f.type for f in to_arrow_schema(out)]

    def batch(batches):
        for b in batches:
            v = b.column(1)
            at = v.offsets.to_numpy()
            cols = [c.to_pylist() for c in v.flatten().flatten()]
            at = at - at[0]
            rows = [run(*(c[i:j] for c in cols)) for i, j in zip(at[:-1], at[1:])]
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows])))
            flat = [x for r in rows for x in r]
            yield pa.RecordBatch.from_arrays([keys.cast(kinds[0])] + [pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds[1:])], names=out.names)

    return lists.mapInArrow(batch, out)


def water_fill(totals: Sequence[float], mass: float, share: float) -> list[float]:
    """MAT-27. Totals capped at ``share * mass``; what is cut goes to those below the cap, by their room; the rest stays unallocated."""
    cap = share * mass
    t = [min(x, cap) for x in totals]
    for _ in range(len(t) + 1):
        spare = mass - sum(t)
        room = [cap - x if x < cap else 0.0 for x in t]
        if spare <= 1e-9 or sum(room) <= 1e-9:
            break
        t = [min(x + spare * r / sum(room), cap) for x, r in zip(t, room)]
    return t


def capped_shares(df: DataFrame, key: str, requirement: str, weight: str, share: float, mass: float = 1.0) -> DataFrame:
    """MAT-27. Requirement weights of each key after capping; a key's requirements are one task's work."""

    def run(reqs: list, weights: list) -> list[tuple]:
        w = np.array(weights, float)
        w = w / w.sum() * mass if w.sum() > 0 else w
        return list(zip(reqs, water_fill(w.tolist(), mass, share)))

    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _each_key(df, key, [requirement, weight], run, f"{requirement} {t[requirement]}, weight double")


def gaps(items: DataFrame, key: Sequence[str], requirement: str, score: str, importance: str, cost: str, budget: float) -> DataFrame:
    """MAT-31. Items below full score by falling loss per requirement, with the running cost and whether it stays in the budget."""
    loss = (1 - F.coalesce(F.col(score), F.lit(0.0))) * F.col(importance)
    g = items.withColumn("loss", loss).filter("loss > 0")
    w = W.partitionBy(*key).orderBy(F.desc("loss"), requirement)
    g = g.withColumn("priority", F.row_number().over(w).cast("bigint")).withColumn("running_cost", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.withColumn("within_budget", F.col("running_cost") <= budget)


def what_if(items: DataFrame, actions: DataFrame, key: Sequence[str], requirement: str, score: str, weight: str) -> DataFrame:
    """MAT-32. Score of every scenario: its actions raise the requirements they name, all else stays; with the change to the baseline.

    actions: scenario, requirement, new_score. Each pair meets each scenario
    once; scenarios and actions are few and are sent, never the items.
    """
    scenarios = F.broadcast(actions.select("scenario").distinct())
    raised = F.broadcast(actions.withColumnRenamed(requirement, "_r"))
    x = items.crossJoin(scenarios).join(raised, (F.col(requirement) == F.col("_r")) & (actions["scenario"] == scenarios["scenario"]), "left").select(*key, scenarios["scenario"], score, weight, "new_score")
    after = F.greatest(F.coalesce(score, F.lit(0.0)), F.coalesce("new_score", F.lit(0.0)))
    mean = lambda v: 100 * F.sum(v * F.col(weight)) / F.sum(weight)
    g = x.groupBy(*key, "scenario").agg(mean(F.coalesce(score, F.lit(0.0))).alias("baseline"), mean(after).alias("scenario_score"))
    return g.withColumn("delta", F.col("scenario_score") - F.col("baseline"))


def what_if_outcome(gate_before: Column, gate_after: Column, rec_before: Column, rec_after: Column, delta: Column, reached: Column, resolved: Column, meaningful: float = 5.0) -> Column:
    """MAT-33. Outcome ladder: a lost gate is no effect, a failed one blocks, then reached, insufficient, partial, none."""
    gb, ga = ordinal(gate_before, GATE), ordinal(gate_after, GATE)
    better = ordinal(rec_after, RECOMMENDATION) > ordinal(rec_before, RECOMMENDATION)
    return (
        F.when(ga < gb, "no_effect").when(gate_after == "failed", "hard_blocked").when(reached, "reached").when(rec_after == "insufficient_information", "insufficient_information")
        .when(better | (delta >= meaningful) | resolved, "partial_effective").otherwise("no_effect")
    )


def greedy_actions(df: DataFrame, key: str, action: str, requirement: str, gain: str, effort: str, target: float, most: int = 5) -> DataFrame:
    """MAT-34. Actions picked one by one by marginal gain (then effort, then id) until the target or the limit; gains of one requirement do not add up."""

    def run(actions: list, reqs: list, gains: list, efforts: list) -> list[tuple]:
        # A null gain adds nothing; null requirements are not one requirement.
        rows = [(a, object() if r is None else r, float("nan") if g is None else g, float("nan") if e is None else e) for a, r, g, e in zip(actions, reqs, gains, efforts)]
        have: dict = {}
        out: list[tuple] = []
        while rows and len(out) < most and sum(have.values()) < target - 1e-12:
            best = min(rows, key=lambda r: (-round(max(0.0, r[2] - have.get(r[1], 0.0)), 9), r[3], r[0]))
            plus = max(0.0, best[2] - have.get(best[1], 0.0))
            if plus <= 1e-9:
                break
            have[best[1]] = have.get(best[1], 0.0) + plus
            out.append((best[0], len(out) + 1, plus, sum(have.values())))
            rows.remove(best)
        return out

    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _each_key(df, key, [action, requirement, gain, effort], run, f"{action} {t[action]}, step long, marginal double, cumulative double")


def best_subset(df: DataFrame, key: str, action: str, gain: str, target: float, most: int = 62) -> DataFrame:
    """MAT-35. The smallest subset of a key's actions (the first ``most`` by id, as bits of mask) whose gains reach the target; ties to the larger gain, then the lesser mask.

    Gains add up, so the best subset of each size holds the largest gains: one
    sort of a key's actions and a running sum, no enumeration.
    """
    a = df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(action)) - 1).filter(F.col("_k") < most)
    v = a.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col(gain).cast("double")).alias("g"), F.col("_k").alias("k")))).alias("_v"))
    none = F.struct(F.lit(0.0).alias("gain"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mask"))

    def add(s, x):
        more = F.struct((s["gain"] - x["g"]).alias("gain"), (s["size"] + 1).alias("size"), s["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["k"])).alias("mask"))
        return F.when((s["size"] > 0) & (s["gain"] >= target), s).otherwise(more)

    return v.select(key, F.aggregate("_v", none, add).alias("_b")).filter(F.col("_b.gain") >= target).select(key, "_b.mask", "_b.size", "_b.gain")


def sufficiency(df: DataFrame, blocking: Mapping[str, Column], material: Mapping[str, Column], minor: Mapping[str, Column], failed: Column) -> DataFrame:
    """MAT-40. blocking, material, minor or sufficient, with all reasons; a definite failure makes blocking reasons void."""
    part = lambda d: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in d.items()]))
    b = F.when(failed, F.array().cast("array<string>")).otherwise(part(blocking))
    m, n = part(material), part(minor)
    level = F.when(F.size(b) > 0, "blocking").when(F.size(m) > 0, "material").when(F.size(n) > 0, "minor").otherwise("sufficient")
    return df.withColumn("level", level).withColumn("reasons", F.concat(b, m, n))


def requirement_tree(leaves: DataFrame, groups: DataFrame, key: str, depth: int) -> DataFrame:
    """CLU-17. Bottom-up evaluation of AND, OR and min_count groups with three values (1, 0, null).

    leaves: key, node, value. groups: node, parent is given as (parent, child,
    op, need) rows. A group is 1 (0) when its children make it so whatever the
    unknown ones are, else null. The tree is sent to the tasks; leaves, of which
    Spark's estimate knows too few once they are unfolded, never are.
    """
    known = leaves.select(key, "node", "value")
    for _ in range(depth):
        x = known.join(F.broadcast(groups), known["node"] == groups["child"])
        g = x.groupBy(key, "parent").agg(F.first("op").alias("op"), F.first("need").alias("need"), F.sum((F.col("value") == 1).cast("int")).alias("_y"), F.sum(F.coalesce((F.col("value") == 0).cast("int"), F.lit(0))).alias("_n"), F.count("*").alias("_c"))
        size = groups.groupBy("parent").agg(F.count("*").alias("_size"))
        g = g.join(F.broadcast(size), "parent").filter("_c = _size")
        need = F.when(F.col("op") == "and", F.col("_size")).when(F.col("op") == "or", 1).otherwise(F.col("need"))
        y = F.coalesce("_y", F.lit(0))
        v = F.when(y >= need, 1).when(F.col("_size") - F.col("_n") < need, 0)
        new = g.select(key, F.col("parent").alias("node"), v.alias("value")).join(known.select(key, "node").hint("merge"), [key, "node"], "left_anti")
        known = known.unionByName(new)
    return known


def clamp_score(x: Column) -> Column:
    return clamp(x, 0.0, 100.0)
