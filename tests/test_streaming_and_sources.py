"""Streams give what the batch gives; sources and sinks round-trip."""

import json

from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import lifecycle as lc
from tessera.sources import connectors
from tessera.streaming import events as st
from tessera.streaming import lifecycle_stream


def rows(df):
    return sorted(map(str, df.collect()))


def folder(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_windows_equal_batch(spark, sf, tmp_path):
    path = folder(spark, sf, tmp_path)
    batch = spark.read.schema(st.SCHEMA).parquet(path)
    for f in (lambda d: st.weekly_counts(d, "ts", "60 days", "event_type"), lambda d: st.sliding_counts(d, "ts", "60 days", "event_type"), lambda d: st.closed_windows(d, "ts", "1 day", "60 days", "event_type").drop("v")):
        assert rows(st.drain(f(st.read_events(spark, path)), "complete")) == rows(f(batch))


def test_observed_once(spark, sf, tmp_path):
    path = folder(spark, sf, tmp_path)
    s = st.drain(st.observed_once(st.read_events(spark, path), "ts", "60 days", "user_id").select("user_id"))
    assert rows(s) == rows(spark.read.schema(st.SCHEMA).parquet(path).select("user_id").distinct())


def test_bad_rows_and_changes(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", 2)], "k int, s string, v int")
    good, bad = st.split_bad(df, F.col("s") == "a")
    assert good.count() == 1 and bad.count() == 2
    known = spark.createDataFrame([(1, 1), (3, 1)], "k int, v int")
    assert {r.k: r.change for r in st.changes(df, known, ["k"], "v").collect()} == {1: "repeated", 2: "new", 3: "updated"}


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    data = [(k, w, 4.0 + k + w, 1.0 + w, 0.2 * w + 0.1 * k, float(w)) for k in range(6) for w in range(1, 8)]
    schema = "k bigint, w bigint, s double, c double, e double, i double"
    df = spark.createDataFrame(data, schema)
    want = rows(lc.lifecycle(df, "k", "w", "s", "c", "e", "i").select("k", "w", "status"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert rows(st.drain(lifecycle_stream(stream, "k", "w", "s", "c", "e", "i"), "append")) == want


def test_history_and_bundle(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/wayback_1.csv").write_text("jd_text,title,company\n" + "x" * 40 + ",dev,acme\nshort,dev,acme\n")
    (tmp_path / "h/other.csv").write_text("full_text,job_title\n\"" + "multi\nline, " * 5 + "\",lead\n")
    got = {(r.source_platform, r.title, r.company) for r in sources.read_history(spark, f"{tmp_path}/h").collect()}
    assert got == {("wayback", "dev", "acme"), ("unknown", "lead", "")}
    df = spark.createDataFrame([(i, "é") for i in range(10)], "a int, b string")
    sources.write_bundle(df, f"{tmp_path}/b")
    r = sources.verify_bundle(spark, f"{tmp_path}/b").first()
    assert (r.record_count, r.valid) == (10, True)
    df.limit(3).write.mode("append").json(f"{tmp_path}/b/records")
    assert not sources.verify_bundle(spark, f"{tmp_path}/b").first().valid


def test_replace_run(spark, tmp_path):
    p = f"{tmp_path}/r"
    sources.replace_run(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, v string"), p)
    sources.replace_run(spark.createDataFrame([(2, "c")], "run_id int, v string"), p)
    assert {(r.run_id, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c")}


def test_connectors(spark):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>T</title><summary>S</summary><link href='u'/><published>2024</published></entry></feed>"
    assert list(connectors.parse_atom(atom)) == [("1", "T", "S", "u", "2024")]
    for cls in sources.REGISTRY.values():
        spark.dataSource.register(cls)
    got = spark.read.format("tessera_snapshot").option("rows", json.dumps([{"id": 1, "title": "x"}])).load().collect()
    assert [(r.external_id, r.title) for r in got] == [("1", "x")]
    flagged = spark.read.format("tessera_feed").option("url", "http://127.0.0.1:9/{start}").load().first()
    assert flagged.external_id is None and flagged.title == "fetch_failed"
