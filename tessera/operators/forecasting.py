"""Forecast models that need linear algebra (WIN-25, WIN-27, MAT-14) and the model competition (WIN-29)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .timeseries import FORECASTS, one_step_errors


def fourier_trend(y: np.ndarray, steps: int, period: float = 7.0, order: int = 3, changes: float = 0.05, ridge: float = 0.1) -> np.ndarray:
    """WIN-25. Ridge fit of a piecewise linear trend with Fourier terms, floored at zero."""
    n = len(y)
    if n < 2:
        return np.full(steps, y[-1] if n else 0.0)
    k = max(1, int(n * changes))
    knots = np.array([int(n * (i + 1) / (k + 1)) for i in range(k)])

    def design(t: np.ndarray) -> np.ndarray:
        waves = [f(2 * np.pi * j * t / period) for j in range(1, order + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones(len(t)), t, np.maximum(0, t[:, None] - knots), *waves])

    x = design(np.arange(n, dtype=float))
    beta = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    return np.maximum(0, design(np.arange(n, n + steps, dtype=float)) @ beta)


def arima(y: np.ndarray, steps: int, p: int = 2, q: int = 1, ridge: float = 0.01) -> np.ndarray:
    """WIN-27. First differences with a ridge AR(p) and the mean of the last q residuals; added up again, floored at zero."""
    d = np.diff(y)
    if len(y) < 2 or len(d) <= p:
        return np.full(steps, y[-1] if len(y) else 0.0)
    x = np.column_stack([d[p - 1 - j : len(d) - 1 - j] for j in range(p)])
    a = np.linalg.solve(x.T @ x + ridge * np.eye(p), x.T @ d[p:])
    shock = float((d[p:] - x @ a)[-q:].mean()) if q else 0.0
    w, level, out = list(d), float(y[-1]), []
    for _ in range(steps):
        w.append(float(np.dot(a, w[: -p - 1 : -1])) + shock)
        level += w[-1]
        out.append(max(0.0, level))
    return np.array(out)


MODELS = {"fourier_trend": fourier_trend, "arima": arima}


def model_forecast(series: DataFrame, subject: str, model: str, steps: int = 3) -> DataFrame:
    """(subject, step, forecast) of a NumPy model, one subject at a time; series has ``values``."""

    def run(batches):
        for pdf in batches:
            rows = [(s, i + 1, float(f)) for s, v in zip(pdf[subject], pdf["values"]) for i, f in enumerate(MODELS[model](np.asarray(v, float), steps))]
            yield pd.DataFrame(rows, columns=[subject, "step", "forecast"])

    kind = series.schema[subject].dataType.simpleString()
    return series.select(subject, "values").mapInPandas(run, f"{subject} {kind}, step long, forecast double")


def model_errors(series: DataFrame, subject: str, model: str, least: int = 3) -> DataFrame:
    """(subject, error): mean absolute one-step error over rolling origins."""
    if model in FORECASTS:
        e = one_step_errors(series, model, least)
        return e.groupBy(subject).agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("error"))

    def run(batches):
        for pdf in batches:
            rows = []
            for s, v in zip(pdf[subject], pdf["values"]):
                v = np.asarray(v, float)
                e = [abs(MODELS[model](v[:k], 1)[0] - v[k]) for k in range(least, len(v))]
                if e:
                    rows.append((s, float(np.mean(e))))
            yield pd.DataFrame(rows, columns=[subject, "error"])

    kind = series.schema[subject].dataType.simpleString()
    return series.select(subject, "values").mapInPandas(run, f"{subject} {kind}, error double")


def competition(series: DataFrame, subject: str, models: list[str], champion: str = "ridge") -> DataFrame:
    """WIN-29. Error of every model per subject, its rank (ties to the champion, then by name) and whether it beats the champion."""
    every = None
    for m in models:
        e = model_errors(series, subject, m).withColumn("model", F.lit(m))
        every = e if every is None else every.unionByName(e)
    w = W.partitionBy(subject)
    base = F.max(F.when(F.col("model") == champion, F.col("error"))).over(w)
    rank = F.row_number().over(w.orderBy(F.round("error", 9), (F.col("model") != champion).cast("int"), "model"))
    return every.withColumn("rank", rank.cast("bigint")).withColumn("beats_champion", F.col("error") < base)
