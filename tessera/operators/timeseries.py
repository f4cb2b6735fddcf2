"""Operators on series: one row per subject and window, ordered within the subject.

Every operator takes the names of the subject, order and score columns and adds
columns; none collects or loops over rows. Order ties must not occur within a
subject (aggregate first). Null scores give null results.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.scalars import ratio

EPS = 1e-9


@dataclass(frozen=True)
class TrendConfig:
    """Thresholds of the trend analysis. Fixed default values; any subset can be replaced."""

    positive: float = 0.04
    negative: float = -0.04
    acceleration: float = 0.02
    stable: float = 0.03
    volatility: float = 0.40
    baseline: int = 3
    z: float = 2.0
    min_change: float = 0.15
    persistence: int = 2
    consistency: float = 0.75
    reverse: float = 0.25
    span: int = 4
    max_sources: int = 6
    min_support: float = 0.6
    weights: Mapping[str, float] = field(default_factory=lambda: {"magnitude": 0.35, "persistence": 0.25, "diversity": 0.20, "stability": 0.20})


def _w(subject: str, order: str):
    return W.partitionBy(subject).orderBy(order)


def growth(df: DataFrame, subject: str, order: str, score: str, duration: str | None = None) -> DataFrame:
    """WIN-01. absolute_growth, relative_growth, baseline_status, growth_rate and acceleration.

    growth_rate is absolute growth per unit of duration if durations differ
    within the subject. Relative growth is null without a comparable baseline:
    a zero one is ``newly_observed`` or ``no_baseline``, the first row null.
    """
    w = _w(subject, order)
    s = F.col(score)
    before = F.lag(s).over(w)
    out = df.withColumn("absolute_growth", s - before)
    out = out.withColumn("relative_growth", ratio(F.col("absolute_growth"), before))
    out = out.withColumn("baseline_status", F.when(before != 0, "comparable").when((before == 0) & (s > 0), "newly_observed").when(before == 0, "no_baseline"))
    rate = F.col("absolute_growth")
    if duration is not None:
        every = W.partitionBy(subject)
        d = F.greatest(F.coalesce(F.col(duration).cast("double"), F.lit(1.0)), F.lit(EPS))
        rate = F.when(F.max(d).over(every) > F.min(d).over(every), rate / d).otherwise(rate)
    out = out.withColumn("growth_rate", rate)
    return out.withColumn("acceleration", F.col("growth_rate") - F.lag("growth_rate").over(w))


def volatility(df: DataFrame, subject: str, order: str, score: str, span: int = 4) -> DataFrame:
    """WIN-02. Population deviation over the last rows by the size of their mean."""
    w = _w(subject, order).rowsBetween(1 - span, 0)
    return df.withColumn("volatility", F.stddev_pop(score).over(w) / F.greatest(F.abs(F.avg(score).over(w)), F.lit(EPS)))


def stability(df: DataFrame, subject: str, order: str, score: str, span: int = 4) -> DataFrame:
    """WIN-03. Share of the most frequent direction among the last steps; 1 on the first row."""
    w = _w(subject, order)
    step = F.col(score) - F.lag(score).over(w)
    out = df.withColumn("_step", step)
    recent = w.rowsBetween(1 - span, 0)
    tally = [F.sum(F.when(c, 1).otherwise(0)).over(recent) for c in (F.col("_step") > EPS, F.col("_step") < -EPS, F.abs("_step") <= EPS)]
    n = F.count("_step").over(recent)
    return out.withColumn("window_stability", F.when(n > 0, F.greatest(*tally) / n).otherwise(F.lit(1.0))).drop("_step")


def state(growth_rate: Column, acceleration: Column, vol: Column, c: TrendConfig = TrendConfig()) -> Column:
    """WIN-04. volatile, accelerating, rising, declining or stable."""
    return (
        F.when(vol > c.volatility, "volatile").when((growth_rate > c.positive) & (acceleration > c.acceleration), "accelerating")
        .when(growth_rate > c.positive, "rising").when(growth_rate < c.negative, "declining").otherwise("stable")
    )


def state_confidence(name: Column, growth_rate: Column, acceleration: Column, vol: Column, stable: Column, c: TrendConfig = TrendConfig()) -> Column:
    """WIN-04. 0.6 of how far the signal passes its threshold (1 at most) and 0.4 of the stability."""
    g, a = F.coalesce(growth_rate, F.lit(0.0)), F.coalesce(acceleration, F.lit(0.0))
    up = F.greatest(g, F.lit(0.0)) / c.positive
    signal = (
        F.when(name == "volatile", vol / c.volatility).when(name == "accelerating", F.greatest(up, F.greatest(a, F.lit(0.0)) / c.acceleration))
        .when(name == "rising", up).when(name == "declining", -F.least(g, F.lit(0.0)) / abs(c.negative))
    )
    calm = 1 - F.least(F.abs(g) / c.stable, F.lit(1.0))
    return F.when(name == "insufficient_evidence", F.lit(0.0)).otherwise(0.6 * F.when(signal.isNotNull(), F.least(signal, F.lit(1.0))).otherwise(calm) + 0.4 * stable)


def change_candidates(df: DataFrame, subject: str, order: str, score: str, c: TrendConfig = TrendConfig()) -> DataFrame:
    """WIN-05. z_score against the preceding rows (two at least) and whether the row is a change candidate."""
    w = _w(subject, order).rowsBetween(-c.baseline, -1)
    out = df.withColumn("baseline_mean", F.avg(score).over(w)).withColumn("_n", F.count(score).over(w)).withColumn("_sd", F.stddev_pop(score).over(w))
    out = out.withColumn("z_score", F.when(F.col("_n") >= 2, (F.col(score) - F.col("baseline_mean")) / F.greatest(F.col("_sd"), F.lit(EPS))))
    hit = (F.abs("z_score") >= c.z) & (F.abs(F.col(score) - F.col("baseline_mean")) >= c.min_change)
    return out.withColumn("is_candidate", F.coalesce(hit, F.lit(False))).drop("_n", "_sd")


def change_runs(df: DataFrame, subject: str, order: str, score: str, c: TrendConfig = TrendConfig()) -> DataFrame:
    """WIN-06, WIN-07. Runs of consecutive candidates that persist: one row per run, keyed by its first row.

    Input: the result of change_candidates. Gives run_length, before_mean,
    after_mean (from the trigger to the end of the series), magnitude and
    direction.
    """
    w = _w(subject, order)
    out = df.withColumn("_island", F.sum(F.when(F.col("is_candidate"), 0).otherwise(1)).over(w))
    out = out.withColumn("after_mean", F.avg(score).over(w.rowsBetween(0, W.unboundedFollowing)))
    own = W.partitionBy(subject, "_island")
    out = out.filter("is_candidate").withColumn("run_length", F.count("*").over(own)).withColumn("_first", F.row_number().over(own.orderBy(order)))
    out = out.filter((F.col("_first") == 1) & (F.col("run_length") >= max(1, c.persistence)))
    out = out.withColumn("before_mean", F.col("baseline_mean")).withColumn("magnitude", F.abs(F.col("after_mean") - F.col("before_mean")))
    return out.withColumn("direction", F.when(F.col("after_mean") >= F.col("before_mean"), "rising").otherwise("declining")).drop("_island", "_first")


def change_confidence(before: Column, after: Column, length: Column, sources: Column, stable: Column, c: TrendConfig = TrendConfig()) -> Column:
    """WIN-07. Weighted magnitude, persistence, source diversity and stability, each 1 at most."""
    one = F.lit(1.0)
    return (
        c.weights["magnitude"] * F.least(F.abs(after - before) / F.greatest(F.abs(before), F.lit(EPS)), one) + c.weights["persistence"] * F.least(length / max(1, c.persistence), one)
        + c.weights["diversity"] * F.least(sources / max(1, c.max_sources), one) + c.weights["stability"] * stable
    )


def turning_points(df: DataFrame, subject: str, order: str, score: str, c: TrendConfig = TrendConfig()) -> DataFrame:
    """WIN-08. First peak and first trough of each subject whose tail goes the other way to the end.

    The tail's steps agree in ``consistency`` of the cases, no counter-step is
    over ``reverse * min_change``, the first step is gentle and the move to the
    end is ``min_change`` at least.
    """
    w = _w(subject, order)
    s = F.col(score)
    out = df.withColumn("_up", s - F.lag(s).over(w)).withColumn("_next", F.lead(s).over(w) - s)
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    out = out.withColumn("_n", F.count("_next").over(ahead)).withColumn("_end", F.last(score).over(ahead))
    out = out.withColumn("_fall", F.sum(F.when(F.col("_next") <= EPS, 1).otherwise(0)).over(ahead)).withColumn("_rise", F.sum(F.when(F.col("_next") >= -EPS, 1).otherwise(0)).over(ahead))
    out = out.withColumn("_most", F.max("_next").over(ahead)).withColumn("_least", F.min("_next").over(ahead))
    limit = c.min_change * c.reverse
    gentle = (F.abs("_next") < c.min_change) & (F.col("_n") >= max(1, c.persistence))
    peak = (F.col("_up") > EPS) & (F.col("_next") < -EPS) & gentle & (F.col("_fall") / F.col("_n") >= c.consistency) & (F.col("_most") <= F.greatest(F.lit(limit), F.lit(EPS))) & (s - F.col("_end") >= c.min_change)
    trough = (F.col("_up") < -EPS) & (F.col("_next") > EPS) & gentle & (F.col("_rise") / F.col("_n") >= c.consistency) & (-F.col("_least") <= F.greatest(F.lit(limit), F.lit(EPS))) & (F.col("_end") - s >= c.min_change)
    out = out.withColumn("direction", F.when(peak, "declining").when(trough, "rising")).filter("direction is not null")
    first = W.partitionBy(subject, "direction").orderBy(order)
    return out.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_up", "_next", "_n", "_end", "_fall", "_rise", "_most", "_least", "_k")


def merge_turning_points(points: DataFrame, turns: DataFrame, subject: str, index: str) -> DataFrame:
    """WIN-09. Turning points that are not next to (or on) a change point or an accepted earlier turning point.

    index: consecutive row numbers within the subject. As a subject has two
    turning points at most, the second is compared with the first directly.
    """
    near = turns.alias("t").join(points.select(subject, F.col(index).alias("_p")).alias("p"), (F.col(f"t.{subject}") == F.col(f"p.{subject}")) & (F.abs(F.col(f"t.{index}") - F.col("p._p")) <= 1), "left_anti")
    w = W.partitionBy(subject).orderBy(index)
    return near.withColumn("_gap", F.col(index) - F.lag(index).over(w)).filter("_gap is null or _gap > 1").drop("_gap")


def support_gate(df: DataFrame, subject: str, support: str, c: TrendConfig = TrendConfig()) -> DataFrame:
    """WIN-10. sufficient: whether the subject's peak support reaches the gate."""
    return df.withColumn("sufficient", F.max(support).over(W.partitionBy(subject)) >= c.min_support)


def analyze_series(df: DataFrame, subject: str, order: str, score: str, support: str | None = None, sources: str | None = None, c: TrendConfig = TrendConfig()) -> DataFrame:
    """WIN-11. All of the above per row, with change points marked; insufficient subjects get no strong state."""
    w = _w(subject, order)
    src = F.col(sources) if sources else F.lit(0)
    base = stability(volatility(growth(df, subject, order, score), subject, order, score, c.span), subject, order, score, c.span)
    base = base.withColumn("window_index", F.row_number().over(w).cast("bigint")).withColumn("_src", src)
    base = support_gate(base, subject, support, c) if support else base.withColumn("sufficient", F.lit(True))
    cand = change_candidates(base, subject, order, score, c)
    runs = change_runs(cand, subject, order, score, c).select(subject, "window_index", "before_mean", "after_mean", "run_length", "direction", F.lit("rolling_baseline").alias("method"))
    turns = turning_points(base, subject, order, score, c)
    spans = base.withColumn("before_mean", F.avg(score).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("after_mean", F.avg(score).over(w.rowsBetween(0, W.unboundedFollowing))).withColumn("run_length", F.count("*").over(w.rowsBetween(0, W.unboundedFollowing)))
    kept = merge_turning_points(runs, turns.select(subject, "window_index", "direction"), subject, "window_index")
    turned = spans.select(subject, "window_index", "before_mean", "after_mean", "run_length").join(kept, [subject, "window_index"]).select(subject, "window_index", "before_mean", "after_mean", "run_length", "direction", F.lit("direction_reversal").alias("method"))
    marks = runs.unionByName(turned)
    out = cand.join(marks.withColumnRenamed("direction", "change_direction").withColumnRenamed("method", "change_method"), [subject, "window_index"], "left")
    conf = change_confidence(F.col("before_mean"), F.col("after_mean"), F.col("run_length"), F.col("_src"), F.col("window_stability"), c)
    ok = F.col("sufficient")
    name = F.when(ok, state(F.col("growth_rate"), F.col("acceleration"), F.col("volatility"), c)).otherwise("insufficient_evidence")
    out = out.withColumn("trend_state", name).withColumn("is_change_point", ok & F.col("change_method").isNotNull())
    out = out.withColumn("change_confidence", F.when(F.col("is_change_point"), conf))
    return out.withColumn("state_confidence", state_confidence(F.col("trend_state"), F.col("growth_rate"), F.col("acceleration"), F.col("volatility"), F.col("window_stability"), c)).drop("_src")


def pearson(x: str, y: str) -> Column:
    """Aggregate Pearson correlation; null for constant or single-row input instead of an error."""
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def lead_lag(df: DataFrame, source: str, index: str, score: str, max_lag: int = 3, min_samples: int = 5, subject: str | None = None) -> DataFrame:
    """WIN-12. For each pair of sources the lag (leading, lagging) of the largest absolute correlation over complete pairs.

    index: window numbers. Ties go to the lowest lag, then to the leading source by name.
    """
    keys = [subject] if subject else []
    a = df.select(*keys, F.col(source).alias("leading"), F.col(index).alias("_i"), F.col(score).alias("_x"))
    a = a.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("_j", F.col("_i") + F.col("lag"))
    b = df.select(*keys, F.col(source).alias("lagging"), F.col(index).alias("_j"), F.col(score).alias("_y"))
    pairs = a.join(b, [*keys, "_j"]).filter((F.col("leading") != F.col("lagging")) & ((F.col("lag") > 0) | (F.col("leading") < F.col("lagging"))))
    each = pairs.groupBy(*keys, "leading", "lagging", "lag").agg(F.count("*").cast("bigint").alias("samples"), F.round(F.coalesce(pearson("_x", "_y"), F.lit(0.0)), 6).alias("correlation")).filter(F.col("samples") >= min_samples)
    each = each.withColumn("source_a", F.least("leading", "lagging")).withColumn("source_b", F.greatest("leading", "lagging"))
    w = W.partitionBy(*keys, "source_a", "source_b").orderBy(F.desc(F.abs("correlation")), "lag", "leading")
    return each.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def cross_correlation(df: DataFrame, index: str, a: str, b: str, max_lag: int = 4, keys: list[str] | None = None) -> DataFrame:
    """WIN-13. Correlation of a with b for lags -max..max (positive: a leads) and whether it is the largest in size.

    The best lag is the one of the largest absolute correlation, ties to the lowest lag; constant slices give 0.
    """
    keys = keys or []
    left = df.select(*keys, F.col(index).alias("_i"), F.col(a).alias("_x")).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("_j", F.col("_i") + F.col("lag"))
    right = df.select(*keys, F.col(index).alias("_j"), F.col(b).alias("_y"))
    each = left.join(right, [*keys, "_j"]).groupBy(*keys, "lag").agg(F.count("*").cast("bigint").alias("samples"), F.round(F.coalesce(pearson("_x", "_y"), F.lit(0.0)), 4).alias("correlation")).filter("samples >= 2")
    w = W.partitionBy(*keys).orderBy(F.desc(F.abs("correlation")), "lag") if keys else W.partitionBy(F.lit(1)).orderBy(F.desc(F.abs("correlation")), "lag")
    return each.withColumn("is_best", F.row_number().over(w) == 1)


def rolling_stability(df: DataFrame, subject: str, order: str, score: str, span: int = 4) -> DataFrame:
    """WIN-14. One row per subject: range of rolling means, range of values, and whether the former is under half the latter.

    A constant series is not under half of zero, so it counts as not stationary; one shorter than the span is stationary.
    """
    w = _w(subject, order)
    out = df.withColumn("_k", F.count(score).over(w.rowsBetween(1 - span, 0))).withColumn("_m", F.round(F.avg(score).over(w.rowsBetween(1 - span, 0)), 4))
    full = F.when(F.col("_k") == span, F.col("_m"))
    out = out.groupBy(subject).agg(F.count("*").cast("bigint").alias("n"), (F.max(full) - F.min(full)).alias("mean_range"), (F.max(score) - F.min(score)).alias("value_range"))
    return out.withColumn("is_stationary", F.when(F.col("n") < span, F.lit(True)).otherwise(F.col("mean_range") < 0.5 * F.col("value_range")))


def spurious_warnings(df: DataFrame, key: str, index: str, a: str, b: str, min_samples: int = 8, significant: float = 0.5) -> DataFrame:
    """WIN-15. Per key: small_sample, non_stationary_a, non_stationary_b and no_lag_consistency (halves lead in opposite directions)."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    sa = rolling_stability(df, key, index, a).select(key, F.col("is_stationary").alias("_sa"))
    sb = rolling_stability(df, key, index, b).select(key, F.col("is_stationary").alias("_sb"))
    size = W.partitionBy(key)
    rank = df.withColumn("_r", F.row_number().over(size.orderBy(index))).withColumn("_half", (F.col("_r") > F.floor(F.count("*").over(size) / 2)).cast("int"))
    halves = cross_correlation(rank, "_r", a, b, 2, [key, "_half"]).filter("is_best").groupBy(key).agg(F.max(F.when(F.col("_half") == 0, F.col("lag"))).alias("_l0"), F.max(F.when(F.col("_half") == 1, F.col("lag"))).alias("_l1"))
    whole = cross_correlation(rank, "_r", a, b, 4, [key]).filter("is_best").select(key, F.col("correlation").alias("_c"))
    out = n.join(sa, key).join(sb, key).join(whole, key, "left").join(halves, key, "left")
    return out.select(
        key, (F.col("n") < min_samples).alias("small_sample"), (~F.col("_sa")).alias("non_stationary_a"), (~F.col("_sb")).alias("non_stationary_b"),
        F.coalesce((F.col("n") >= 5) & (F.abs("_c") >= significant) & (F.col("_l0") * F.col("_l1") < 0), F.lit(False)).alias("no_lag_consistency"),
    )


def source_ablation(df: DataFrame, subject: str, source: str, score: str) -> DataFrame:
    """WIN-16. Leave one source out: mean of each subject's other sources and its rank among all subjects then.

    df: a row per subject and source. Subjects with one source keep their own
    mean when another subject's source is removed, and are no result
    themselves. rank_delta is baseline minus new rank (0 is best), so it is
    positive for an improvement; rank_drop is the fall. Ties rank by subject.
    """
    total = df.groupBy(subject).agg(F.sum(score).alias("_s"), F.count("*").alias("_n"), F.avg(score).alias("base_score"))
    base = total.withColumn("base_rank", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("base_score"), subject)) - 1).cast("bigint"))
    removed = df.select(F.col(source).alias("removed")).distinct()
    own = df.select(subject, F.col(source).alias("removed"), F.col(score).alias("_x"))
    grid = base.crossJoin(removed).join(own, [subject, "removed"], "left")
    rest = F.col("_n") - F.when(F.col("_x").isNotNull(), 1).otherwise(0)
    grid = grid.withColumn("ablated_score", F.when(rest > 0, (F.col("_s") - F.coalesce("_x", F.lit(0.0))) / rest).otherwise(F.col("base_score")))
    grid = grid.withColumn("ablated_rank", (F.row_number().over(W.partitionBy("removed").orderBy(F.desc(F.round("ablated_score", 9)), subject)) - 1).cast("bigint"))
    out = grid.filter("_x is not null and _n > 1")
    return out.select(subject, "removed", "base_score", "base_rank", "ablated_score", "ablated_rank", (F.col("base_rank") - F.col("ablated_rank")).alias("rank_delta"), (F.col("ablated_rank") - F.col("base_rank")).alias("rank_drop"), (F.col("base_score") - F.col("ablated_score")).alias("score_delta"))


def enterprise_ablation(base: Column, weight: Column) -> Column:
    """WIN-17. Relative loss of a score without an enterprise's weight."""
    return (base - F.greatest(F.lit(0.0), base - weight)) / F.greatest(base, F.lit(0.001))


def series_array(df: DataFrame, subject: str, order: str, score: str) -> DataFrame:
    """(subject, values): the series as one array, in order."""
    return df.groupBy(subject).agg(F.sort_array(F.collect_list(F.struct(order, score))).alias("_v")).select(subject, F.transform("_v", lambda x: x[score].cast("double")).alias("values"))


def moving_average_forecast(v: Column, period: int = 4) -> Column:
    """WIN-18. Mean of the last values; 0 for an empty series."""
    recent = F.when(F.size(v) > period, F.slice(v, -period, period)).otherwise(v)
    return F.when(F.size(v) > 0, F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / F.size(recent)).otherwise(F.lit(0.0))


def ewma_forecast(v: Column, alpha: float = 0.3) -> Column:
    """WIN-19. Exponentially weighted level."""
    return F.when(F.size(v) > 0, F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.try_element_at(v, F.lit(1)), lambda a, x: alpha * x + (1 - alpha) * a)).otherwise(F.lit(0.0))


def ridge_forecast(v: Column, step: Column | int = 1, penalty: float = 0.1) -> Column:
    """WIN-20. Ridge trend line in closed form, floored at zero; a single value repeats."""
    n = F.size(v)
    mid = (n - 1) / 2
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    num = F.aggregate(F.transform(v, lambda x, i: x * (i - mid)), F.lit(0.0), lambda a, x: a + x)
    den = n * (n * n - 1) / 12.0 + penalty
    ahead = step if isinstance(step, Column) else F.lit(step)
    return F.when(n >= 2, F.greatest(F.lit(0.0), mean + num / den * (n + ahead - 1 - mid))).when(n == 1, F.try_element_at(v, F.lit(1))).otherwise(F.lit(0.0))


def holt_forecast(v: Column, step: int = 1, alpha: float = 0.3, beta: float = 0.1, phi: float = 0.9) -> Column:
    """WIN-26. Damped Holt smoothing, floored at zero."""
    n = F.size(v)
    first, last = F.try_element_at(v, F.lit(1)), F.try_element_at(v, F.lit(-1))
    start = F.struct(first.alias("level"), ((last - first) / F.greatest(n - 1, F.lit(1))).alias("trend"))

    def go(s, x):
        level = alpha * x + (1 - alpha) * (s["level"] + phi * s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * phi * s["trend"]).alias("trend"))

    damp = sum(phi**k for k in range(step))
    fitted = F.aggregate(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), start, go, lambda s: s["level"] + damp * s["trend"])
    return F.when(n >= 2, F.greatest(F.lit(0.0), fitted)).when(n == 1, first).otherwise(F.lit(0.0))


def naive_forecast(v: Column) -> Column:
    """WIN-28. The last value."""
    return F.coalesce(F.try_element_at(v, F.lit(-1)), F.lit(0.0))


#: UDF-03. One-step forecasts by name, as column builders on a series array.
FORECASTS = {"moving_average": moving_average_forecast, "ewma": ewma_forecast, "ridge": ridge_forecast, "holt": holt_forecast, "naive": naive_forecast}


def one_step_errors(series: DataFrame, method: str, min_train: int = 3) -> DataFrame:
    """Rolling origins: (.., origin, forecast, actual) for every prefix of min_train values or more. series has ``values``."""
    out = series.filter(F.size("values") > min_train).withColumn("origin", F.explode(F.sequence(F.lit(min_train), F.size("values") - 1)))
    return out.withColumn("forecast", FORECASTS[method](F.slice("values", F.lit(1), F.col("origin")))).withColumn("actual", F.element_at("values", F.col("origin") + 1))


def backtest(series: DataFrame, subject: str, method: str, min_train: int = 3, max_horizon: int = 4) -> DataFrame:
    """WIN-21. MAE, RMSE and MAPE of each origin over up to max_horizon steps."""
    out = series.filter(F.size("values") > min_train).withColumn("origin", F.explode(F.sequence(F.lit(min_train), F.size("values") - 1)))
    out = out.withColumn("_t", F.slice("values", F.lit(1), F.col("origin"))).withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_horizon), F.size("values") - F.col("origin")))))
    f = ridge_forecast(F.col("_t"), F.col("step")) if method == "ridge" else FORECASTS[method](F.col("_t"))
    e = F.abs(f - F.element_at("values", F.col("origin") + F.col("step")))
    size = F.greatest(F.abs(F.element_at("values", F.col("origin") + F.col("step"))), F.lit(1e-6))
    return out.withColumn("_e", e).withColumn("_p", e / size).groupBy(subject, "origin").agg(F.count("*").cast("bigint").alias("horizon"), F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_p").alias("mape"))


def forecast_rows(series: DataFrame, subject: str, method: str, steps: int = 3) -> DataFrame:
    """WIN-22. Observed rows and ``steps`` generated ones: position, value, is_observed."""
    seen = series.select(subject, F.posexplode("values").alias("_p", "value")).select(subject, (F.col("_p") + 1).cast("bigint").alias("position"), "value", F.lit(True).alias("is_observed"))
    ahead = series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    f = ridge_forecast(F.col("values"), F.col("step")) if method == "ridge" else FORECASTS[method](F.col("values"))
    return seen.unionByName(ahead.select(subject, (F.size("values") + F.col("step")).cast("bigint").alias("position"), f.alias("value"), F.lit(False).alias("is_observed")))


def conformal_interval(series: DataFrame, subject: str, method: str = "ridge", level: float = 0.8, min_history: int = 5, span: int = 4, top: float | None = 1.0) -> DataFrame:
    """WIN-23. Interval around the next forecast from the last absolute one-step residuals; unreliable with a short history."""
    res = one_step_errors(series, method, 2).groupBy(subject).agg(F.sort_array(F.collect_list(F.struct("origin", F.abs(F.col("actual") - F.col("forecast")).alias("e")))).alias("_e"))
    res = res.withColumn("_r", F.array_sort(F.transform(F.when(F.size("_e") > span, F.slice("_e", -span, span)).otherwise(F.col("_e")), lambda x: x["e"])))
    at = F.greatest(F.lit(1), F.least(F.ceil(F.lit(level) * F.size("_r")), F.size("_r"))).cast("int")
    out = series.withColumn("forecast", FORECASTS[method](F.col("values"))).join(res.withColumn("radius", F.try_element_at("_r", at)), subject, "left")
    ok = (F.size("values") >= min_history) & (F.coalesce(F.size("_e"), F.lit(0)) >= 3)
    hi = F.col("forecast") + F.col("radius")
    return out.select(subject, "forecast", ok.alias("is_reliable"), F.when(ok, F.greatest(F.lit(0.0), F.col("forecast") - F.col("radius"))).otherwise(0.0).alias("lower"), F.when(ok, F.least(F.lit(top), hi) if top is not None else hi).otherwise(0.0).alias("upper"))


def bottom_up(leaves: DataFrame, levels: list[str], value: str) -> DataFrame:
    """WIN-24. Sums of the leaves at every level of a hierarchy (level, node, value) by rollup."""
    out = leaves.rollup(*levels).agg(F.sum(value).alias("value"), F.grouping_id().alias("_g"))
    depth = F.lit(len(levels)) - F.when(F.col("_g") == 0, 0).otherwise(F.floor(F.log2(F.col("_g").cast("double") + 1)))
    return out.select(depth.cast("bigint").alias("level"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string")) for c in levels]).alias("node"), "value")


def top_down(children: DataFrame, parent: str, child: str, forecast: str, total: str) -> DataFrame:
    """WIN-24. Splits the parent's total over its children by their forecasts; a parent without any keeps them as they are."""
    share = F.sum(forecast).over(W.partitionBy(parent))
    return children.withColumn("reconciled", F.when(share > 0, F.col(total) * F.col(forecast) / share).otherwise(F.col(forecast)))


def weekly_terms(df: DataFrame, week: str, term: str, back: int = 4) -> DataFrame:
    """AGG-11. Latest observed week's count of each term against the mean of up to ``back`` preceding observed weeks.

    growth is null without history (insufficient_history) or when the term is new (newly_observed).
    """
    counts = df.groupBy(week, term).agg(F.count("*").alias("_n"))
    weeks = counts.select(week).distinct().withColumn("_r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(week))))
    near = counts.join(weeks.filter(F.col("_r") <= back + 1), week)
    prior = weeks.filter((F.col("_r") > 1) & (F.col("_r") <= back + 1)).agg(F.count("*").alias("_weeks"))
    per = near.groupBy(term).agg(F.sum(F.when(F.col("_r") == 1, F.col("_n"))).alias("count"), F.coalesce(F.sum(F.when(F.col("_r") > 1, F.col("_n"))), F.lit(0)).alias("_before")).filter("count is not null")
    out = per.crossJoin(F.broadcast(prior))
    return out.select(
        term, "count", F.when((F.col("_weeks") > 0) & (F.col("_before") > 0), F.col("count") / (F.col("_before") / F.col("_weeks")) - 1).alias("growth"),
        F.when(F.col("_weeks") == 0, "insufficient_history").when(F.col("_before") == 0, "newly_observed").otherwise("observed").alias("trend_status"),
    )


def share_growth(df: DataFrame, cluster: str, window: str) -> DataFrame:
    """WIN-30. Change of each cluster's share of all rows from the first to the last window, and 0.5 + 0.5 tanh of it."""
    totals = df.groupBy(window).agg(F.count("*").alias("_t"))
    ends = totals.agg(F.min_by("_t", window).alias("_t0"), F.max_by("_t", window).alias("_t1"), F.min(window).alias("_w0"), F.max(window).alias("_w1"), F.count("*").alias("windows"))
    own = df.crossJoin(F.broadcast(ends)).groupBy(cluster, "_t0", "_t1", "windows").agg(F.sum((F.col(window) == F.col("_w0")).cast("int")).alias("_c0"), F.sum((F.col(window) == F.col("_w1")).cast("int")).alias("_c1"))
    s0, s1 = F.col("_c0") / F.col("_t0"), F.col("_c1") / F.col("_t1")
    change = (s1 - s0) / F.greatest(s0, 1 / F.col("_t0"))
    return own.filter("windows >= 3").select(cluster, s0.alias("first_share"), s1.alias("last_share"), change.alias("relative_change"), (0.5 + 0.5 * F.tanh(change)).alias("growth_score"))


def trajectory_signals(df: DataFrame, key: str, order: str, columns: list[str], ema_of: str, alpha: float = 0.5) -> DataFrame:
    """WIN-31. Last minus first of each column and the exponential mean of one, over the ordered windows."""
    packed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_v"))
    out = [F.size("_v").cast("bigint").alias("window_count")]
    out += [(F.element_at("_v", -1)[c] - F.element_at("_v", 1)[c]).alias(f"delta_{c}") for c in columns]
    v = F.transform("_v", lambda x: x[ema_of].cast("double"))
    return packed.select(key, *out, ewma_forecast(v, alpha).alias(f"ema_{ema_of}"))


def survival(observations: DataFrame, transitions: DataFrame, key: str, window: str, event: str) -> DataFrame:
    """WIN-32. Per key and event: first observed window, window of the first transition, duration in windows, censoring.

    window: consecutive numbers over all windows; the observation ends with the last one seen for any key.
    """
    end = observations.agg(F.max(window).alias("_end"))
    start = observations.groupBy(key).agg(F.min(window).alias("start_window"), F.max(window).alias("last_observed_window"))
    kinds = transitions.select(event).distinct()
    hit = transitions.groupBy(key, event).agg(F.min(window).alias("event_window"))
    out = start.crossJoin(kinds).join(hit, [key, event], "left").crossJoin(F.broadcast(end))
    return out.select(key, event, "start_window", "last_observed_window", "event_window", F.greatest(F.lit(0), F.coalesce("event_window", "_end") - F.col("start_window")).alias("duration"), F.col("event_window").isNull().alias("censored"))


def merged_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """WIN-36. Union of overlapping or touching [start, end) date intervals; empty and reversed ones are dropped."""
    w = W.partitionBy(key).orderBy(start, end)
    own = df.filter(F.col(end) > F.col(start))
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w))
    return own.groupBy(key, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_g")


def months_of(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """WIN-36. Months covered by the union of intervals, a month being 30.4375 days."""
    return merged_intervals(df, key, start, end).groupBy(key).agg((F.sum(F.datediff("end", "start")) / 30.4375).alias("months"))
