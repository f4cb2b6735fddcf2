"""JOI-14: what set joins keep of sets, and what they leave on disk."""

import collections
import random
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import sets as st
from tessera.operators import similarity as sim


def test_shared_elements_of_batches_that_are_cut(spark, monkeypatch):
    monkeypatch.setattr(st, "STEP", 40)
    rng = random.Random(8)
    rows = [(i, rng.sample(range(-150, 150), rng.randint(1, 12))) for i in range(60)] + [(70, [2**63 - 1, -(2**63), 5000]), (71, [2**63 - 1, -(2**63), 6000]), (72, [7000]), (73, []), (74, None)]
    rows += [(80 + k, rows[k][1][::-1]) for k in range(4)]
    df = spark.createDataFrame(rows, "_id long, _s array<long>").repartition(3)
    got = {r._id: r for r in st.shared_elements(df, "bigint", 0.5).collect()}
    times = collections.Counter(e for _, s in rows for e in s or [])
    want = {i: sorted((e for e in s if times[e] > 1), key=lambda e: (times[e], e)) for i, s in rows if s}
    want = {i: s for i, s in want.items() if s and len(s) >= 0.5 * len(dict(rows)[i])}
    assert {i: list(r._s) for i, r in got.items()} == want and all(r._n == len(dict(rows)[i]) for i, r in got.items())
    assert all((got[k]._c, got[k]._d) == (got[80 + k]._c, got[80 + k]._d) for k in range(4)) and len({(r._c, r._d) for r in got.values()}) == len({frozenset(dict(rows)[i]) for i in got})


def test_overlaps_of_places_that_are_cut(spark, monkeypatch):
    monkeypatch.setattr(st, "PAIRS", 5)
    rng = random.Random(9)
    sets = {i: rng.sample(range(30), rng.randint(3, 12)) for i in range(25)}
    df = spark.createDataFrame([(i, len(s) + i % 2, s) for i, s in sets.items()], "_id long, _n int, _s array<long>")
    near = [(a, b) for a in sets for b in sets if a < b and rng.random() < 0.5]
    like = lambda a, b: (k := len(set(sets[a]) & set(sets[b]))) / (len(sets[a]) + a % 2 + len(sets[b]) + b % 2 - k)
    got = {(r.left, r.right): r.similarity for r in st.overlaps(spark.createDataFrame(near, "left long, right long"), df, "bigint", 0.2).collect()}
    assert got == {(a, b): like(a, b) for a, b in near if like(a, b) >= 0.2} and got


def test_elements_of_one_set_alone_are_not_written(spark):
    folders = {Path(f.removeprefix("file:")) for f in (sim.shared_dir(spark), spark.sparkContext.getCheckpointDir())}
    size = lambda: sum(p.stat().st_size for f in folders for p in f.rglob("*") if p.is_file())
    df = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.xxhash64("id", k)).alias("s"))
    df = df.unionByName(df.filter("id < 3").select((F.col("id") + 5000).alias("id"), F.slice("s", 1, 150).alias("s")))
    before = size()
    assert {(r.left, r.right, r.similarity) for r in sim.set_join(df, "id", "s", 0.5).collect()} == {(k, 5000 + k, 0.75) for k in range(3)}
    assert size() - before < 500_000  # the sets have 3.2 MB


def test_event_clusters_write_no_shingles(spark):
    folders = {Path(f.removeprefix("file:")) for f in (sim.shared_dir(spark), spark.sparkContext.getCheckpointDir())}
    size = lambda: sum(p.stat().st_size for f in folders for p in f.rglob("*") if p.is_file())
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.hex(F.xxhash64("id", k))), " ")
    df = spark.range(1500).select("id", F.timestamp_seconds("id").alias("ts"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), words.alias("body"))
    df = df.unionByName(df.filter("id < 3").withColumns({"id": F.col("id") + 5000, "title": F.concat("title", F.lit(" again and again")), "body": F.concat("body", F.lit(" end"))}))
    before = size()
    got = {r.id: r.event for r in sim.event_groups(df, "id", "ts", "url", "title", "body").collect()}
    assert all(got[5000 + k] == got[k] for k in range(3)) and len(got) == 1503
    assert size() - before < 700_000  # the shingles have 2.4 MB
