"""Candidate profiles as keyed state with event-time timers (EMG-08, EMG-14).

An observation waits in state until the watermark has passed the end of its
window; then a timer folds it, so the order in which batches bring windows does
not matter. ``profiles`` and ``operators.lifecycle.lifecycle`` say the same of a
batch, in DataFrame operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.operators.lifecycle import NOISE, PROMOTION, REQUIRED

#: Windows that count as recent, windows a title token must support to be core (or all, if there are fewer), weight of the newest emergence.
RECENT, CORE, ALPHA = 3, 2, 0.4
OUT = "candidate string, window_start timestamp, kind string, status string, windows int, skill_support map<string,double>, core_titles array<string>, recent_skills array<string>, emergence_trend double"


def next_status(status: str, windows: int, support: float, companies: float, emergence: float, stability: float) -> str:
    """EMG-09 for one observation."""
    if status in ("noise", "dead", "merged", "official_position"):
        return status
    if windows >= NOISE[0] and support <= NOISE[1] and companies <= NOISE[2] and emergence <= NOISE[3]:
        return "noise"
    goal = PROMOTION.get(status)
    if goal and all(x >= r for x, r in zip((windows, support, companies, emergence, stability), REQUIRED[goal])):
        return goal
    return status


def _start(status: str) -> dict:
    return {"status": status, "windows": 0, "last": None, "skills": {}, "titles": {}, "recent": [], "trend": None}


def _fold(p: dict, window: int, o: dict, step: int, dead_after: int) -> dict:
    """The profile after one more window (start in microseconds, its observation)."""
    if p["last"] is not None and (window - p["last"]) // step > dead_after:
        p["status"] = "dead"
    p["windows"] += 1
    p["last"] = window
    p["status"] = next_status(p["status"], p["windows"], o["support"], o["companies"], o["emergence"], o["stability"])
    for s in o["skills"]:
        p["skills"][s] = p["skills"].get(s, 0) + 1
    for t in o["titles"]:
        p["titles"][t] = p["titles"].get(t, 0) + 1
    p["recent"] = [*p["recent"], o["skills"]][-RECENT:]
    p["trend"] = o["emergence"] if p["trend"] is None else ALPHA * o["emergence"] + (1 - ALPHA) * p["trend"]
    return p


def _row(key: str, window: int, kind: str, p: dict | None) -> dict:
    p = p or _start("")
    least = min(CORE, p["windows"])
    return {
        "candidate": key, "window_start": pd.Timestamp(window, unit="us"), "kind": kind, "status": p["status"], "windows": p["windows"],
        "skill_support": {s: n / p["windows"] for s, n in sorted(p["skills"].items())}, "core_titles": sorted(t for t, n in p["titles"].items() if n >= least),
        "recent_skills": sorted({s for r in p["recent"] for s in r}), "emergence_trend": p["trend"] if p["trend"] is not None else float("nan"),
    }


class Profiles(StatefulProcessor):
    """State of a candidate: observations by window that wait for the watermark, and the profile folded so far."""

    def __init__(self, start: str, step: int, dead_after: int):
        self.first, self.step, self.dead_after = start, step, dead_after

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start bigint", "observation string")
        self.profile = handle.getValueState("profile", "profile string")

    def _known(self) -> dict:
        return json.loads(self.profile.get()[0]) if self.profile.exists() else _start(self.first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late, known = [], self._known()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                window = int(pd.Timestamp(r.window_start).value // 1000)
                o = {"titles": sorted({t for t in (r.titles if r.titles is not None else []) if t}), "skills": sorted({s for s in (r.skills if r.skills is not None else []) if s})}
                o |= {c: float(getattr(r, c)) for c in ("support", "companies", "emergence", "stability")}
                if known["last"] is not None and window <= known["last"]:
                    late.append(_row(key[0], window, "late", None))
                    continue
                if self.waiting.containsKey((window,)):
                    before = json.loads(self.waiting.getValue((window,))[0])
                    o = {c: sorted({*v, *before[c]}) if isinstance(v, list) else max(v, before[c]) for c, v in o.items()}
                self.waiting.updateValue((window,), (json.dumps(o),))
                self.handle.registerTimer((window + self.step) // 1000)
        if late:
            yield pd.DataFrame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(w[0] for w in self.waiting.keys() if w[0] + self.step <= until)
        out, p = [], self._known()
        for window in due:
            p = _fold(p, window, json.loads(self.waiting.getValue((window,))[0]), self.step, self.dead_after)
            self.waiting.removeKey((window,))
            out.append(_row(key[0], window, "profile", p))
        if out:
            self.profile.update((json.dumps(p),))
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def profile_stream(df: DataFrame, late: str, step_seconds: int, start: str = "weak_signal", dead_after: int = 3) -> DataFrame:
    """EMG-08, EMG-14. A row for each closed window of a candidate: its status and profile after it; kind is late for windows that came behind a folded one.

    df: candidate string, window_start timestamp, titles and skills
    array<string>, support, companies, emergence, stability double. Windows are
    ``step_seconds`` long; a window is folded when the watermark (``late`` behind
    the newest start) has passed its end. Several observations of a window are
    one: sets are united, numbers take the greatest. What comes behind a folded
    window is never folded: Spark drops what is behind the watermark of the batch
    before and counts it, the rest is told as late. The session must use the
    RocksDB state store.
    """
    cols = ["candidate", "window_start", "titles", "skills", *(F.col(c).cast("double").alias(c) for c in ("support", "companies", "emergence", "stability"))]
    x = df.select(*cols).withWatermark("window_start", late)
    processor = Profiles(start, step_seconds * 1_000_000, dead_after)
    return x.groupBy("candidate").transformWithStateInPandas(processor, OUT, "append", "eventTime")


def merged_windows(df: DataFrame) -> DataFrame:
    """One observation a candidate and window: sets united, numbers at their greatest."""
    union = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))), lambda s: s != ""))).alias(c)
    return df.groupBy("candidate", "window_start").agg(union("titles"), union("skills"), *(F.max(F.col(c).cast("double")).alias(c) for c in ("support", "companies", "emergence", "stability")))


def _support(x: DataFrame, column: str) -> DataFrame:
    """(candidate, map of each element to the number of its windows)."""
    n = x.select("candidate", F.explode(column).alias("_e")).groupBy("candidate", "_e").agg(F.count("*").alias("_n"))
    return n.groupBy("candidate").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_e", "_n")))).alias(f"_{column}"))


def profiles(df: DataFrame) -> DataFrame:
    """EMG-08 over a batch: (candidate, windows, skill_support, core_titles, recent_skills, emergence_trend) after a candidate's last window."""
    x = merged_windows(df)
    nothing: Column = F.create_map().cast("map<string,bigint>")
    order = F.sort_array(F.collect_list(F.struct("window_start", "skills", "emergence")))
    v = x.groupBy("candidate").agg(order.alias("_v")).withColumn("windows", F.size("_v"))
    trend = F.aggregate(F.slice("_v", 2, F.size("_v")), F.col("_v")[0]["emergence"], lambda s, o: ALPHA * o["emergence"] + (1 - ALPHA) * s)
    recent = F.array_sort(F.array_distinct(F.flatten(F.transform(F.slice(F.reverse("_v"), 1, RECENT), lambda o: o["skills"]))))
    j = v.join(_support(x, "skills"), "candidate", "left").join(_support(x, "titles"), "candidate", "left")
    titles = F.map_filter(F.coalesce("_titles", nothing), lambda _, n: n >= F.least(F.lit(CORE), F.col("windows")))
    return j.select(
        "candidate", "windows", F.transform_values(F.coalesce("_skills", nothing), lambda _, n: n / F.col("windows")).alias("skill_support"),
        F.array_sort(F.map_keys(titles)).alias("core_titles"), recent.alias("recent_skills"), trend.alias("emergence_trend"),
    )
