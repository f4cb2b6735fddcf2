"""SRT-05..08: all queues of a batch at once, in the order that one action after the other gives."""

import math
import random

import pytest

from tessera.operators import ranking as rk

WEIGHT = [0.30, 0.20, 0.15]


def plain(rows, mode, cost, group, blocking, blend=0.7, penalty=0.05):
    out = []
    for q in sorted({r["q"] for r in rows}):
        left, picked = sorted((r for r in rows if r["q"] == q), key=lambda r: r["t"]), []

        def gain(r):
            if mode == "mmr":
                like = max((sum(w for w, f in zip(WEIGHT, "axy") if r[f] == p[f]) / sum(WEIGHT) for p in picked), default=0.0)
                s = (r["v"] / r["c"] ** 0.5 if cost else r["v"]) - (1 - blend) * like
            else:
                s = blend * r["v"] + (1 - blend) * sum(w for w, f in zip(WEIGHT, "axy") if r[f] is not None and all(p[f] != r[f] for p in picked)) / sum(WEIGHT)
            return s - penalty * math.log1p(sum(p["a"] == r["a"] for p in picked)) if group else s

        while left:
            pool = [r for r in left if r["b"]] if blocking and any(r["b"] for r in left) else left
            best = max(pool, key=lambda r: round(gain(r), 9))
            out.append((q, best["t"], len(picked) + 1, round(gain(best), 12)))
            picked.append(best)
            left.remove(best)
    return sorted(out)


@pytest.mark.parametrize("batch", [10_000, 7])
@pytest.mark.parametrize("mode, cost, group, blocking", [("mmr", True, False, False), ("coverage", False, False, False), ("coverage", False, True, True), ("mmr", False, True, True)])
def test_queues_of_a_batch_are_ordered_at_once(spark, batch, mode, cost, group, blocking):
    rng = random.Random(6)
    rows = [{"q": q, "t": 1000 * q + k, "v": rng.choice([0.1, 0.25, 0.5, rng.random()]), "a": rng.randrange(3), "b": rng.choice([True, False, None]), "c": float(rng.randint(1, 3))} for q in range(12) for k in range(rng.choice([1, 2, 9, 20]))]
    rows = [r | {"x": rng.choice(["u", "v", None]), "y": rng.randrange(2)} for r in rows]
    df = spark.createDataFrame([(r["q"], r["t"], r["v"], r["a"], r["x"], r["y"], r["c"], r["b"]) for r in rows], "q long, t long, v double, a long, x string, y long, c double, b boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = rk.greedy_queue(df, "q", "t", "v", ["a", "x", "y"], cost="c" if cost else None, penalty=0.05 if group else 0.0, group="a" if group else None, blocking="b" if blocking else None, mode=mode)
        got = sorted((r.q, r.t, r.position, round(r.score, 12)) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain(rows, mode, cost, group, blocking)
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan  # no call a queue


def test_no_queues(spark):
    df = spark.createDataFrame([], "q long, t long, v double, a long")
    assert rk.greedy_queue(df, "q", "t", "v", ["a"], mode="mmr").count() == 0
