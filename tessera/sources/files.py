"""File sources and sinks on any file system that Spark knows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SRC-11. Fixed column fallbacks and file-name labels of history files.
FALLBACK = {"jd_text": ("jd_text", "text_preview", "full_text"), "title": ("title", "job_title"), "snapshot_date": ("snapshot_timestamp", "publish_time"), "source_url": ("source_url",), "company": ("company",)}
LABELS = {"wayback": "wayback", "cache": "search_cache", "niuke": "niuke", "maimai": "maimai", "wechat": "wechat", "paid": "paid"}

SNAPSHOT = T.StructType(
    [T.StructField("external_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("url", T.StringType()), T.StructField("published_at", T.TimestampType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)


def read_history(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """SRC-11. CSV files of differing columns as one table; rows of ``least`` characters or fewer are dropped.

    Each file's header rules its columns; the source label comes from its name.
    """
    paths = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names only
    every = None
    for p in sorted(paths):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
        have = {c.lstrip("﻿"): c for c in df.columns}
        cols = [F.coalesce(*[F.col(f"`{have[c]}`") for c in names if c in have], F.lit("")).alias(out) for out, names in FALLBACK.items()]
        name = p.rsplit("/", 1)[-1].lower()
        label = next((v for k, v in LABELS.items() if k in name), "unknown")
        part = df.select(*cols, F.lit(label).alias("source_platform")).filter(F.length("jd_text") > least)
        every = part if every is None else every.unionByName(part)
    return every


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10. JSON lines of source snapshots with a declared schema."""
    return spark.read.schema(SNAPSHOT).json(path)


def archive_signals(events: DataFrame, topics: Mapping[str, str]) -> DataFrame:
    """SRC-06. Stars, forks and distinct repositories per topic of watch and fork events (columns type and repo).

    A repository counts for the first topic, in the given order, that its name contains.
    """
    name = F.replace(F.lower("repo"), F.lit("_"), F.lit("-"))
    topic = F
    for t in topics:
        topic = topic.when(F.contains(name, F.lit(t)), t)
    domain = F
    for t, d in topics.items():
        domain = domain.when(F.col("topic") == t, d)
    x = events.filter(F.col("type").isin("WatchEvent", "ForkEvent")).withColumn("topic", topic.otherwise(F.lit(None).cast("string"))).filter("topic is not null").withColumn("domain", domain.otherwise(F.lit(None).cast("string")))
    return x.groupBy("topic", "domain").agg(F.count_if(F.col("type") == "WatchEvent").alias("stars"), F.count_if(F.col("type") == "ForkEvent").alias("forks"), F.countDistinct(F.lower("repo")).alias("repositories"))


def write_bundle(df: DataFrame, path: str) -> None:
    """SNK-01, SNK-03. JSON lines with a manifest of the record count and an order-free content hash."""
    df.write.mode("overwrite").json(f"{path}/records")
    back = df.sparkSession.read.text(f"{path}/records")
    _digest(back).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _digest(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("record_count"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("content_hash"))


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13. One row: counts and whether records match their manifest."""
    m = spark.read.schema("record_count long, content_hash string").json(f"{path}/manifest")
    d = _digest(spark.read.text(f"{path}/records"))
    return d.crossJoin(m.select(F.col("record_count").alias("_c"), F.col("content_hash").alias("_h"))).select("record_count", ((F.col("record_count") == F.col("_c")) & (F.col("content_hash") == F.col("_h"))).alias("valid"))


def replace_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """SNK-07. Replaces the rows of the runs in df and no others (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
