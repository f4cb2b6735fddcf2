"""Review queues: independent value ranks and greedy list-wise ranks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SRT-04. Fixed scales and weights of a task's value.
SCALE = {"uncertainty": 5.0, "impact": 10.0, "reuse": 10.0, "wait": 30.0}
VALUE = {"blocking": 0.40, "uncertainty": 0.25, "impact": 0.20, "reuse": 0.13, "wait": 0.02}
COVERAGE = {"object": 0.30, "type": 0.20, "subject": 0.15, "candidate": 0.15, "bucket": 0.20}


def value(blocking: Column, uncertainty: Column, impact: Column, reuse: Column, wait: Column) -> Column:
    """SRT-04. Weighted value of a review task, each signal capped at its scale."""
    cap = lambda c, k: F.least(F.greatest(F.coalesce(c, F.lit(0)).cast("double"), F.lit(0.0)), F.lit(SCALE[k])) / SCALE[k]
    return VALUE["blocking"] * blocking.cast("double") + VALUE["uncertainty"] * cap(uncertainty, "uncertainty") + VALUE["impact"] * cap(impact, "impact") + VALUE["reuse"] * cap(reuse, "reuse") + VALUE["wait"] * cap(wait, "wait")


def priority(signals: Mapping[str, float]) -> Column:
    """SRT-11. Weighted sum of signal columns whose weights sum to one."""
    if abs(sum(signals.values()) - 1) > 1e-9 or min(signals.values()) < 0:
        raise ValueError("weights must be non-negative and sum to one")
    return sum((F.col(c) * w for c, w in signals.items()), F.lit(0.0))


#: Tasks of queues that one Spark task orders.
ROWS = 100_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal codes; nulls are below 0, equal to each other unless they are numbers."""
    x = column.combine_chunks()
    code = pc.fill_null(x.dictionary_encode().indices, -1).to_numpy().astype("int64")
    number = pa.types.is_integer(x.type) or pa.types.is_floating(x.type)
    return np.where(code < 0, -1 - np.arange(len(code)), code) if number else code


def greedy_queue(df: DataFrame, queue: str, task: str, value_col: str, features: Sequence[str], blend: float = 0.7, cost: str | None = None, power: float = 0.5, penalty: float = 0.0, group: str | None = None, blocking: str | None = None, mode: str = "coverage") -> DataFrame:
    """SRT-05..08. Greedy order of each queue; a queue is one task's work, and all queues of an Arrow batch take their next action at once.

    mode ``mmr``: value / cost^power less ``1 - blend`` times the largest share
    of equal features with a task already picked. mode ``coverage``: blend of
    value and the features newly covered. ``penalty`` lowers tasks of a group
    already picked, by its log; blocking tasks come first. Ties go to the least
    task id. What a pick changes is added to each task of its queue, so the work
    is the square of a queue.
    """
    weights = [COVERAGE[k] for k in list(COVERAGE)[: len(features)]]
    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = list(dict.fromkeys([queue, task, value_col, *features, *[c for c in (cost, group, blocking) if c]]))

    def order(x: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        floats = lambda c: pc.cast(x[c], pa.float64()).to_numpy()
        base = floats(value_col)
        if cost:
            unlike, at = np.unique(floats(cost), return_inverse=True)
            base = base / np.array([max(c, 1e-9) ** power for c in unlike.tolist()])[at]
        code = np.stack([_codes(x[f]) for f in features]) if features else np.zeros((0, len(x)), "int64")
        own = _codes(x[group]) if group else np.zeros(len(x), "int64")
        first = pc.fill_null(x[blocking], False).to_numpy().astype(bool) if blocking else np.zeros(len(x), bool)
        like, seen, times, row, picked = np.zeros(len(x)), code < 0, np.zeros(len(x), int), np.arange(len(x)), np.zeros(len(x), bool)
        position, score = np.zeros(len(x), "int64"), np.zeros(len(x))
        logs, step = np.array([math.log1p(k) for k in range(int(sizes.max(initial=0)) + 1)]), 0
        while len(sizes):
            step += 1
            if mode == "mmr":
                s = base - (1 - blend) * like
            else:
                s = blend * base + (1 - blend) * sum((w * ~h for w, h in zip(weights, seen)), np.zeros(len(row))) / (sum(weights) or 1.0)
            if group:
                s = s - penalty * logs[times]
            starts = np.cumsum(sizes) - sizes
            key = np.where(picked, -np.inf, np.where(np.isnan(s), -np.finfo(float).max, np.round(s, 9)))
            if blocking:
                open_ = first & ~picked
                key[np.repeat(np.logical_or.reduceat(open_, starts), sizes) & ~open_] = -np.inf
            at = np.minimum.reduceat(np.where(key == np.repeat(np.maximum.reduceat(key, starts), sizes), np.arange(len(row)), len(row)), starts)
            position[row[at]], score[row[at]], picked[at] = step, s[at], True
            best = np.repeat(at, sizes)
            same = code == code[:, best]
            like = np.maximum(like, sum((w * e for w, e in zip(weights, same)), np.zeros(len(row))) / (sum(weights) or 1.0))
            seen, times = seen | same, times + (own == own[best])
            if (sizes == step).any():  # queues that are empty leave
                keep = np.repeat(sizes > step, sizes)
                base, like, times, row, picked, own, first = (y[keep] for y in (base, like, times, row, picked, own, first))
                code, seen, sizes = code[:, keep], seen[:, keep], sizes[sizes > step]
        return pa.RecordBatch.from_arrays([x[queue].combine_chunks(), x[task].combine_chunks(), pa.array(position), pa.array(score)], names=[queue, task, "position", "score"])

    def run(batches):
        rest: pa.Table | None = None
        for x in batches:
            x = pa.Table.from_batches([x])
            x = x if rest is None else pa.concat_tables([rest, x])
            if not len(x):
                continue
            # Rows lie by queue; the last one may go on in the next batch.
            code = x[queue].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(x))
            whole = int(ends[-2]) if len(ends) > 1 else 0
            rest = x.slice(whole)
            if whole:
                yield order(x.slice(0, whole), np.diff(ends[:-1], prepend=0))
        if rest is not None and len(rest):
            yield order(rest, np.array([len(rest)]))

    rows = df.select(*cols)
    tasks = min(max(1, math.ceil(rows.count() / ROWS)), 2000)
    return rows.repartition(tasks, queue).sortWithinPartitions(queue, task).mapInArrow(run, f"{queue} {t[queue]}, {task} {t[task]}, position long, score double")


def expected_review_value(blocking: Column, impact: Column, group_size: Column, reviewed: Column, changed: Column, cost: Column, wait: Column, eta: float = 1.0, prior: float = 0.31, strength: float = 2.0) -> Column:
    """SRT-07. Rank value v5 of a task by itself: the chance that a review changes something, times what hangs on it, over its cost.

    The chance is a Beta posterior of the group's reviews (the prior without
    any); what hangs on it is 0.4 for blocking, 0.3 for the impact (capped at
    10) and 0.3 for the share of the group still open, on a log scale. Costs
    count from 0.05 on; waiting adds up to 0.02. ``greedy_queue`` adds what a
    task brings to a list.
    """
    n, c = F.coalesce(reviewed, F.lit(0)), F.coalesce(changed, F.lit(0))
    p = F.when(n > 0, F.round((c + prior * strength) / (n + strength), 6)).otherwise(prior)
    size = F.coalesce(group_size, F.lit(0))
    left = F.greatest(size - n, F.lit(0))
    spread = F.when(size > 0, F.log1p(left) / F.log1p(F.greatest(size, F.lit(1)))).otherwise(0.0)
    value = p * (0.4 * blocking.cast("double") + 0.3 * F.least(F.coalesce(impact, F.lit(0)) / 10.0, F.lit(1.0)) + 0.3 * spread)
    return value / F.pow(F.greatest(F.coalesce(cost, F.lit(1.0)), F.lit(0.05)), F.lit(eta)) + 0.02 * F.least(F.greatest(F.coalesce(wait, F.lit(0.0)), F.lit(0.0)), F.lit(30.0)) / 30.0


def normalized_value(value_col: Column, similarity: Column, blend: float = 0.6) -> Column:
    """SRT-07. Rank value v3: value over the sum of all weights, blended with the novelty against what is picked (1 - similarity)."""
    return blend * F.least(F.greatest(value_col, F.lit(0.0)) / sum(VALUE.values()), F.lit(1.0)) + (1 - blend) * (1 - F.coalesce(similarity, F.lit(0.0)))
