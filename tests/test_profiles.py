"""Profiles as a stream equal the batch, whatever the order of the batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lifecycle as lc
from tessera.streaming import events as st
from tessera.streaming import profiles as pf

DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "candidate string, window_start timestamp, titles array<string>, skills array<string>, support double, companies double, emergence double, stability double"
STEP = 3 * 86_400


def observations():
    rng = random.Random(3)
    rows = []
    for c in range(6):
        windows = sorted(rng.sample(range(14), 9)) if c else [0, 1, 2, 3, 9, 10]  # the first has a gap that kills
        for k, w in enumerate(windows):
            rows.append((f"c{c}", DAY0 + dt.timedelta(days=3 * w), rng.sample(["data", "ai", "lead"], rng.randint(0, 2)), rng.sample(["sql", "spark", "go", "r"], rng.randint(0, 3)), 3.0 + k + c, 2.0 + k, round(rng.uniform(0.3, 0.9), 3), float(k)))
    rows += [rows[3][:4] + (99.0, 1.0, 0.1, 9.0), ("n", DAY0, None, None, 1.0, 1.0, 0.1, 0.0)]  # a window seen twice; nulls
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def as_dict(rows):
    return {r.candidate: (r.windows, {k: round(v, 9) for k, v in r.skill_support.items()}, list(r.core_titles), list(r.recent_skills), round(r.emergence_trend, 9)) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_under_shuffled_batches(rocks, tmp_path, seed):
    spark, rows = rocks, observations()
    batch = spark.createDataFrame(rows, SCHEMA)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    end = ("zz", DAY0 + dt.timedelta(days=400), [], [], 0.0, 0.0, 0.0, 0.0)  # moves the watermark past all windows
    for k in range(4):
        part = shuffled[k::4] if k < 3 else shuffled[3::4] + [end]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = st.drain(pf.profile_stream(stream, "60 days", STEP), "append", f"{tmp_path}/check").collect()
    assert {r.kind for r in out} == {"profile"}
    last = {}
    for r in sorted((r for r in out), key=lambda r: r.window_start):
        last[r.candidate] = r
    assert as_dict(last.values()) == as_dict(pf.profiles(batch).collect())
    numbered = pf.merged_windows(batch).withColumn("w", (F.datediff("window_start", F.lit(DAY0.date())) / 3).cast("bigint"))
    want = {(r.candidate, r.w): r.status for r in lc.lifecycle(numbered, "candidate", "w", "support", "companies", "emergence", "stability", window="w").select("candidate", "w", "status").collect()}
    assert {(r.candidate, (r.window_start - DAY0).days // 3): r.status for r in out} == want
    assert "dead" in want.values()


def test_late_windows_are_told(rocks, tmp_path):
    spark = rocks
    row = lambda c, w: (c, DAY0 + dt.timedelta(days=3 * w), ["ai"], ["sql"], 3.0, 2.0, 0.5, 1.0)
    for part in ([row("a", 5), row("b", 90)], [row("b", 91)], [row("a", 88), row("b", 92)], [row("b", 300)], [row("a", 60), row("b", 301)], [row("b", 302)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = st.drain(pf.profile_stream(stream, "30 days", STEP), "append", f"{tmp_path}/check").collect()
    a = [((r.window_start - DAY0).days // 3, r.kind) for r in out if r.candidate == "a"]
    assert sorted(w for w, kind in a if kind == "profile") == [5, 88] and set(a) <= {(5, "profile"), (88, "profile"), (60, "late")}


def test_empty_batch(spark):
    assert pf.profiles(spark.createDataFrame([], SCHEMA)).count() == 0
