"""Connected components and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the rows a[i] and b[i] in a flat forest of least roots, in place."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch -> a star for each of its components: as many rows as nodes at most."""
    for b in batches:
        e = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        node, at = np.unique(e, return_inverse=True)
        at = at.reshape(e.shape)
        root = np.arange(len(node))
        hook(root, at[0], at[1])
        rest = np.flatnonzero(root != np.arange(len(node)))
        yield pa.record_batch([pa.array(node[rest]), pa.array(node[root[rest]])], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that can be reached. Edges: two long columns.

    Large-star and small-star steps in turn until nothing changes, on edges
    only; hubs are aggregated, never gathered. Nodes without an edge to
    another node are left out. Empty edges give an empty result.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").mapInArrow(_forest, "u long, v long")
    e = checkpoint(e.distinct())
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.filter("v > u").join(least, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("_m"))
        small = down.join(low, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        e = checkpoint(small.unionByName(low.select("u", F.col("_m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
