"""Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.when(b != 0, a / b)


def big(x: Column) -> Column:
    return x.cast("bigint")


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Array of the names of all rules that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def bands(x: Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first limit that x reaches, limits falling."""
    out = F
    for limit, name in limits:
        out = out.when(x >= limit, name)
    return out.otherwise(otherwise)


def ordinal(x: Column, ranks: Mapping[str, int]) -> Column:
    """Rank of a label, null for unknown ones."""
    out = F
    for name, rank in ranks.items():
        out = out.when(x == name, F.lit(rank).cast("bigint"))
    return out.otherwise(F.lit(None).cast("bigint"))


def log_support(n: Column, expected: float) -> Column:
    """min(ln(1+n) / ln(1+expected), 1)."""
    return F.least(F.log1p(n) / F.log1p(F.lit(float(expected))), F.lit(1.0))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, floored at zero."""
    return F.greatest(F.lit(0), F.datediff(later, earlier))


def freshness(now: Column, seen: Column, decay_days: float) -> Column:
    """exp(-days / decay)."""
    return F.exp(-days_between(now, seen) / F.lit(float(decay_days)))


def half_life(age_days: Column, half_life_days: float) -> Column:
    """2^(-age / half-life); negative ages count as zero."""
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), age_days.cast("double")) / F.lit(float(half_life_days)))


def week_start(ts: Column) -> Column:
    """Monday of the week as yyyy-MM-dd."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def month_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def strict_utc(text: Column) -> Column:
    """ISO-8601 text with an explicit offset as a UTC timestamp; naive, empty or malformed text is null."""
    return F.when(text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))
