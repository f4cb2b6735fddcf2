"""Vector scalars on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """MAT-01. Cosine similarity; 0 for a zero vector or vectors of different length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector divided by its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """CLU-22. (key, centroid): the normalised mean of the vectors of each key."""
    x = df.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    v = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_v")).select(key, F.transform("_v", lambda s: s["_x"]).alias("centroid"))
    return v.withColumn("centroid", unit(F.col("centroid")))
