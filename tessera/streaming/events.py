"""Event streams. The operators take any DataFrame, so batch and stream share them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """STM-01. Parquet files of events as a stream; checkpoints and retries stand in for leases (STM-02)."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def closed_windows(df: DataFrame, ts: str, length: str, late: str, *keys: str) -> DataFrame:
    """Tumbling windows with a watermark: count and sum of values per window and key."""
    w = df.withWatermark(ts, late) if df.isStreaming else df
    return w.groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), *keys, "n", "v")


def weekly_counts(df: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """STM-06. Weeks from Monday (windows of 7 days from the epoch's Thursday, shifted by four days)."""
    w = df.withWatermark(ts, late) if df.isStreaming else df
    return w.groupBy(F.window(ts, "7 days", startTime="4 days"), *keys).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), *keys, "n")


def sliding_counts(df: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """STM-07. Windows of nine days every three days: each sees itself and two predecessors."""
    w = df.withWatermark(ts, late) if df.isStreaming else df
    return w.groupBy(F.window(ts, "9 days", "3 days"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").cast("string").alias("start"), *keys, "n")


def session_groups(df: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    """STM-08. Session windows per key."""
    w = df.withWatermark(ts, late) if df.isStreaming else df
    return w.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def observed_once(df: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """STM-05. The first row of each key within the watermark; over a batch, of each key."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def late_split(df: DataFrame, ts: str, closed: str) -> DataFrame:
    """STM-09. Marks rows whose window ended before the last closed one: they belong to a backfill."""
    return df.withColumn("is_late", F.col(ts) < F.lit(closed).cast("timestamp"))


def split_bad(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """STM-04. (good rows, rows for the dead-letter sink); a null condition is bad."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)


def changes(df: DataFrame, known: DataFrame, keys: list[str], version: str) -> DataFrame:
    """STM-10, STM-11. new, updated or repeated against a static table of keys and versions."""
    k = known.groupBy(*keys).agg(F.collect_set(version).alias("_seen"))
    x = df.join(k, keys, "left")
    return x.withColumn("change", F.when(F.col("_seen").isNull(), "new").when(F.array_contains("_seen", F.col(version)), "repeated").otherwise("updated")).drop("_seen")


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote to memory (for tests and small replays).

    STM-03: in production use foreachBatch with the batch id as key, which
    makes retried batches idempotent.
    """
    name = f"drain_{uuid.uuid4().hex}"
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
