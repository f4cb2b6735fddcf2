"""Keyed state: the candidate lifecycle as a stream, with the batch operator's thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.lifecycle import NOISE, PROMOTION, REQUIRED


def next_status(status: str, windows: int, support: float, companies: float, emergence: float, stability: float) -> str:
    """EMG-09 for one observation; the same rules as the batch operator, from the same tables."""
    if status in ("noise", "dead", "merged", "official_position"):
        return status
    if windows >= NOISE[0] and support <= NOISE[1] and companies <= NOISE[2] and emergence <= NOISE[3]:
        return "noise"
    goal = PROMOTION.get(status)
    if goal and all(x >= r for x, r in zip((windows, support, companies, emergence, stability), REQUIRED[goal])):
        return goal
    return status


def lifecycle_stream(df: DataFrame, key: str, order: str, support: str, companies: str, emergence: str, stability: str, start: str = "weak_signal") -> DataFrame:
    """EMG-08, EMG-09, EMG-14 as a stream: (key, order, status) after every observation; state is the status and the window count.

    Observations of a key must arrive in order across batches; within a batch they are sorted.
    """

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (start, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            n += 1
            status = next_status(status, n, getattr(r, support), getattr(r, companies), getattr(r, emergence), getattr(r, stability))
            out.append((k[0], getattr(r, order), status))
        state.update((status, n))
        yield pd.DataFrame(out, columns=[key, order, "status"])

    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {t[key]}, {order} {t[order]}, status string", "status string, n long", "append", "NoTimeout")
