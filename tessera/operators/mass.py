"""Mass caps over sparse, fractional memberships, with certificates (AGG-29, AGG-30).

A conclusion's clusters carry masses; each cluster belongs to groups of several
dimensions in fractions; the mass of a group may not pass its dimension's cap.
Both methods scale clusters of equal memberships by one factor, so Spark first
adds up such clusters to one *pattern*. What is solved per conclusion grows
with the patterns that occur, not with clusters, and the factors are joined
back.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Smallest mass of a cluster before it is projected.
FLOOR = 1e-12


def memberships(members: DataFrame, key: str, cluster: str, fields: Sequence[str], fractional: bool = True, order: str | None = None) -> DataFrame:
    """(key, cluster, dimension, group, fraction) of the members of clusters; a dimension is a field.

    Fractional: every different value of a cluster's members gets 1 / their
    number, to eight decimals. Otherwise the first value by ``order`` that is
    there gets all. Null and empty values are "unknown", and so is a cluster
    that has none.
    """
    value = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), value(c).alias("group")) for c in fields)))
    long = members.select(key, cluster, *([F.col(order).alias("_o")] if order else []), pairs.alias("_x")).select("*", "_x.*").drop("_x")
    if not fractional:
        first = F.min_by("group", F.when(F.col("group").isNotNull(), F.struct("_o", "group"))) if order else F.min("group")
        one = long.groupBy(key, cluster, "dimension").agg(F.coalesce(first, F.lit("unknown")).alias("group"))
        return one.withColumn("fraction", F.lit(1.0))
    every = long.select(key, cluster, "dimension", F.coalesce("group", F.lit("unknown")).alias("group")).distinct()
    count = every.groupBy(key, cluster, "dimension").agg(F.collect_set("group").alias("_g"))
    return count.select(key, cluster, "dimension", F.explode("_g").alias("group"), F.round(1.0 / F.size("_g"), 8).alias("fraction"))


@dataclass
class Problem:
    """Patterns of one conclusion: masses that sum to one, the largest mass of a single cluster of each, memberships as triples."""

    mass: np.ndarray
    largest: np.ndarray
    row: np.ndarray  # pattern of a membership
    group: np.ndarray  # number of its group
    fraction: np.ndarray
    dimension: np.ndarray  # of each group
    cap: np.ndarray  # of each group

    def masses(self, p: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, weights=p[self.row] * self.fraction, minlength=len(self.cap))

    def at_patterns(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=v[self.group] * self.fraction, minlength=len(self.mass))


@dataclass
class Certificate:
    converged: bool = False
    infeasible: bool = False
    infeasible_dimensions: list[str] = field(default_factory=list)
    iterations: int = 0
    max_violation: float = 0.0
    max_probability_delta: float = 0.0
    max_lambda_delta: float = 0.0
    complementarity: float = 0.0
    slackness: float = 0.0
    objective_kl: float = 0.0


CERTIFICATE = "converged boolean, infeasible boolean, infeasible_dimensions array<string>, iterations int, max_violation double, max_probability_delta double, max_lambda_delta double, complementarity double, slackness double, objective_kl double"


def _infeasible(x: Problem, names: Sequence[str], tolerance: float) -> list[str]:
    """Dimensions whose groups cannot hold all mass even when each is full."""
    return sorted(n for k, n in enumerate(names) if (x.dimension == k).any() and x.cap[x.dimension == k].sum() < 1 - tolerance)


def dual_projection(x: Problem, names: Sequence[str], rounds: int = 500, tolerance: float = 1e-6, still: float = 1e-8, rate: float = 1.0, decay: float = 0.02) -> tuple[np.ndarray, Certificate]:
    """The masses nearest in relative entropy that keep the caps, by projected ascent on the multipliers; factors of the patterns.

    The factor of a pattern is exp(-A'v) / Z for the multipliers v of its
    groups; each moves by a falling step along (mass - cap) and stays at zero or
    above. The residuals of the optimality conditions are those of the last
    step: violation (primal), the moves of masses and multipliers, v times what
    is over the cap (complementarity) and v times the distance from it on
    either side (slackness).
    """
    c = Certificate(infeasible_dimensions=_infeasible(x, names, tolerance))
    c.infeasible = bool(c.infeasible_dimensions)
    v, factor, m = np.zeros(len(x.cap)), np.ones(len(x.mass)), np.zeros(len(x.cap))
    for c.iterations in range(1, rounds + 1):
        raw = np.exp(-x.at_patterns(v))
        new = raw / (x.mass * raw).sum()
        c.max_probability_delta = float((x.largest * np.abs(new - factor)).max(initial=0.0))
        factor = new
        m = x.masses(x.mass * factor)
        up = np.maximum(0.0, v + rate / (1 + decay * (c.iterations - 1)) * (m - x.cap))
        c.max_lambda_delta = float(np.abs(up - v).max(initial=0.0))
        v = up
        c.max_violation = float(np.maximum(m - x.cap, 0).max(initial=0.0))
        if c.max_violation <= tolerance and c.max_probability_delta <= still and c.max_lambda_delta <= still:
            c.converged = True
            break
    c.complementarity = float((v * np.maximum(m - x.cap, 0)).max(initial=0.0))
    c.slackness = float((v * np.abs(m - x.cap)).max(initial=0.0))
    c.objective_kl = float((x.mass * factor * np.log(factor)).sum())
    return factor, c


def capped_rescaling(x: Problem, names: Sequence[str], rounds: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, Certificate]:
    """Groups over their cap are scaled down to it, one dimension after the other, and all mass is made one again, until all hold.

    A pattern in several groups of a dimension is scaled by the mean of their
    scales, each weighing as its fraction.
    """
    c = Certificate(infeasible_dimensions=_infeasible(x, names, tolerance))
    c.infeasible = bool(c.infeasible_dimensions)
    factor = np.ones(len(x.mass))
    for c.iterations in range(1, rounds + 1):
        before = factor
        for k in range(len(names)):
            own = x.dimension[x.group] == k
            m = x.masses(x.mass * factor)
            scale = np.where(m > x.cap, x.cap / np.maximum(m, 1e-300), 1.0)
            part = np.bincount(x.row[own], weights=(x.fraction * scale[x.group])[own], minlength=len(x.mass))
            whole = np.bincount(x.row[own], weights=x.fraction[own], minlength=len(x.mass))
            factor = factor * np.where(whole > 0, part / np.maximum(whole, 1e-300), 1.0)
            factor = factor / max((x.mass * factor).sum(), 1e-300)
        c.max_violation = float(np.maximum(x.masses(x.mass * factor) - x.cap, 0).max(initial=0.0))
        c.max_probability_delta = float((x.largest * np.abs(factor - before)).max(initial=0.0))
        if c.max_violation <= tolerance:
            c.converged = True
            break
    c.objective_kl = float((x.mass * factor * np.log(np.maximum(factor, 1e-300))).sum())
    return factor, c


METHODS = {"dual": dual_projection, "rescale": capped_rescaling}


def patterns(masses: DataFrame, membership: DataFrame, key: str, cluster: str, weight: str) -> DataFrame:
    """(key, cluster, share of the key's mass, its memberships in order): one row a cluster; clusters without memberships have none.

    Shares are of the masses above zero and at least ``FLOOR``; a key without mass has shares of zero.
    """
    g = membership.groupBy(key, cluster).agg(F.sort_array(F.collect_list(F.struct("dimension", "group", "fraction"))).alias("_m"))
    total = masses.groupBy(key).agg(F.sum(F.greatest(F.col(weight).cast("double"), F.lit(0.0))).alias("_t"))
    x = masses.select(key, cluster, F.greatest(F.col(weight).cast("double"), F.lit(0.0)).alias("_w")).join(total, key).join(g, [key, cluster], "left")
    share = F.when(F.col("_t") > 0, F.greatest(F.coalesce("_w", F.lit(0.0)) / F.col("_t"), F.lit(FLOOR))).otherwise(0.0)
    return x.select(key, cluster, share.alias("_q"), F.coalesce("_m", F.array().cast("array<struct<dimension:string,group:string,fraction:double>>")).alias("_m"))


def project(masses: DataFrame, membership: DataFrame, key: str, cluster: str, weight: str, caps: Mapping[str, float], method: str = "dual", **more) -> DataFrame:
    """(key, cluster, mass, and the certificate's columns) under ``caps`` by dimension; method: dual (AGG-30) or rescale (AGG-29).

    Dimensions without a cap do not bind. A key whose masses are all zero keeps
    masses of zero with a certificate that has not converged. Clusters appear
    once in ``masses``; of an empty table nothing comes.
    """
    names, solve = list(caps), METHODS[method]
    rows = patterns(masses, membership, key, cluster, weight).withColumn("_m", F.filter("_m", lambda s: s["dimension"].isin(names)))
    rows = rows.select(key, cluster, "_q", F.to_json("_m").alias("_p"))  # a pattern's name
    grouped = rows.groupBy(key, "_p").agg(F.sum("_q").alias("_s"), F.max("_q").alias("_x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        lists = [[(m["dimension"], m["group"], m["fraction"]) for m in json.loads(p)] for p in pdf["_p"]]
        total = pdf["_s"].sum()
        if not total > 0:
            factor, c = np.zeros(len(pdf)), Certificate()
        else:
            groups = {g: k for k, g in enumerate(sorted({(d, g) for ms in lists for d, g, _ in ms}))}
            dims = np.array([names.index(d) for d, _ in groups], dtype=int)
            triples = [(r, groups[d, g], f) for r, ms in enumerate(lists) for d, g, f in ms]
            row, group, fraction = (np.array(z) for z in zip(*triples)) if triples else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            x = Problem(pdf["_s"].to_numpy() / total, pdf["_x"].to_numpy() / total, row.astype(int), group.astype(int), fraction, dims, np.array([float(caps[names[d]]) for d in dims]))
            factor, c = solve(x, names, **more)
            factor = factor / total
        out = pd.DataFrame({key: pdf[key], "_p": pdf["_p"], "_f": factor})
        for name, v in asdict(c).items():
            out[name] = [v] * len(out)
        return out

    kinds = {f.name: f.dataType for f in masses.schema.fields}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField("_p", T.StringType()), T.StructField("_f", T.DoubleType()), *T._parse_datatype_string(CERTIFICATE).fields])
    solved = grouped.groupBy(key).applyInPandas(run, schema)
    return rows.join(solved, [key, "_p"]).select(key, cluster, (F.col("_q") * F.col("_f")).alias("mass"), *Certificate.__dataclass_fields__)


def certificates(projected: DataFrame, key: str) -> DataFrame:
    """One row a key: its certificate and the effective number of clusters, 1 / sum of squared masses."""
    return projected.groupBy(key).agg(*(F.first(c).alias(c) for c in Certificate.__dataclass_fields__), F.sum("mass").alias("mass"), (1 / F.sum(F.col("mass") * F.col("mass"))).alias("effective_size"))
