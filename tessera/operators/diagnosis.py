"""Diagnosis of clusters: coherence per view, concentration and distributions, without a row for a pair of members (CLU-06)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Different sets that are compared with as many at a time.
BLOCK = 1024


def mean_tfidf_cosine(df: DataFrame, key: str, member: str, tokens: str) -> DataFrame:
    """(key, members, coherence): mean cosine of all pairs of a key's members, TF-IDF taken within the key.

    From the sum S of the unit vectors: (|S|^2 - number of vectors that are not
    zero) / (n (n - 1)); 0 for a single member. Members are unique in a key.
    """
    n = df.groupBy(key).agg(F.count("*").alias("members"))
    t = df.select(key, F.col(member).alias("_m"), F.size(tokens).alias("_l"), F.explode(tokens).alias("_t")).groupBy(key, "_m", "_t", "_l").agg(F.count("*").alias("_c"))
    seen = t.groupBy(key, "_t").agg(F.count("*").alias("_df"))
    x = t.join(seen, [key, "_t"]).join(n, key).withColumn("_x", F.col("_c") / F.col("_l") * (F.log((1 + F.col("members")) / (1 + F.col("_df"))) + 1))
    x = x.withColumn("_x", F.col("_x") / F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(key, "_m"))))
    whole = x.groupBy(key, "_t").agg(F.sum("_x").alias("_s")).groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    some = df.filter(F.size(tokens) > 0).groupBy(key).agg(F.count("*").alias("_v"))
    j = n.join(whole, key, "left").join(some, key, "left")
    pairs = F.col("members") * (F.col("members") - 1)
    return j.select(key, "members", F.when(pairs > 0, (F.coalesce("_q", F.lit(0.0)) - F.coalesce("_v", F.lit(0))) / pairs).otherwise(0.0).alias("coherence"))


def _jaccard_sum(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> float:
    """Sum of the Jaccard similarities of all member pairs between two blocks of different sets, or within one."""
    words = {w: i for i, w in enumerate(sorted({w for s in (*a["_s"], *b["_s"]) for w in s}))}

    def matrix(x: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(x), len(words)), np.float32)
        for r, s in enumerate(x["_s"]):
            m[r, [words[w] for w in s]] = 1
        return m

    ma, mb = matrix(a), matrix(b)
    both = (ma @ mb.T).astype(float)
    union = ma.sum(axis=1)[:, None] + mb.sum(axis=1)[None, :] - both
    j = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    na, nb = a["_n"].to_numpy(float), b["_n"].to_numpy(float)
    if not same:
        return float(na @ j @ nb)
    inside = (na * (na - 1) / 2 * np.diag(j)).sum()
    return float((na @ j @ na - (na * na * np.diag(j)).sum()) / 2 + inside)


def mean_jaccard(df: DataFrame, key: str, elements: str, block: int = BLOCK) -> DataFrame:
    """(key, members, coherence): mean Jaccard similarity of all pairs of a key's members; empty sets have 0 with all; 0 for a single member.

    Equal sets are one row with a count. Blocks of different sets meet blocks,
    a task for two blocks, and only sums leave it: the work is quadratic in the
    different sets of a key, its rows are not.
    """
    sets = df.select(key, F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(elements), F.array().cast("array<string>"))))).alias("_s"))
    one = sets.groupBy(key, "_s").agg(F.count("*").alias("_n"))
    kinds = one.groupBy(key).agg(F.sum("_n").alias("members"), F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    b = one.join(kinds.select(key, "_blocks"), key).withColumn("_b", F.pmod(F.xxhash64("_s"), "_blocks").cast("int"))
    wide = b.select(key, "_s", "_n", "_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_p"))
    wide = wide.select(key, "_s", "_n", "_b", F.least("_b", "_p").alias("_i"), F.greatest("_b", "_p").alias("_j"))
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_o=["\x1f".join(s) for s in pdf["_s"]]).sort_values(["_b", "_o"])  # sums in one order
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        a, c = pdf[pdf["_b"] == i], pdf[pdf["_b"] == j]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_x": [_jaccard_sum(a, c, i == j) if len(a) and len(c) else 0.0]})

    sums = wide.groupBy(key, "_i", "_j").applyInPandas(run, f"`{key}` {kind}, _x double").groupBy(key).agg(F.sum("_x").alias("_x"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    return kinds.join(sums, key).select(key, "members", F.when(pairs > 0, F.col("_x") / pairs).otherwise(0.0).alias("coherence"))


def distribution(df: DataFrame, key: str, column: str, unknown: str = "unknown") -> DataFrame:
    """(key, map of each value to its members, values in order, and the sum of squared shares)."""
    value = F.coalesce(F.when(F.col(column).cast("string") != "", F.col(column).cast("string")), F.lit(unknown))
    c = df.groupBy(key, value.alias("_v")).agg(F.count("*").alias("_n"))
    g = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_e"), F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    return g.select(key, F.map_from_entries("_e").alias("distribution"), (F.col("_q") / (F.col("_t") * F.col("_t"))).alias("hhi"))


def contradictions(df: DataFrame, key: str, families: str) -> DataFrame:
    """(key, families that at least two members have and at least two have not)."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    f = df.select(key, F.explode(F.array_distinct(families)).alias("_f")).groupBy(key, "_f").agg(F.count("*").alias("_c"))
    g = f.join(n, key).groupBy(key).agg(F.count(F.when((F.col("_c") >= 2) & (F.col("_c") <= F.col("_n") - 2), 1)).alias("contradictions"))
    return n.select(key).join(g, key, "left").select(key, F.coalesce("contradictions", F.lit(0)).cast("bigint").alias("contradictions"))


def diagnose(df: DataFrame, key: str, member: str, text: str, skills: str, title: str, families: str, company: str, window: str, date: str, source: str, weights: Sequence[float] = (0.6, 0.4)) -> DataFrame:
    """CLU-06. One row a cluster: size, coherence of text, skills, titles and both combined, concentration, distributions, time.

    text, skills, title and families are arrays of strings, a member is one row
    of its cluster. combined is the weighted mean of text and skills pair by
    pair, which is that of their means.
    """
    flat = F.array_join(title, " ")
    base = df.groupBy(key).agg(
        F.count("*").alias("member_count"), F.count_distinct(F.when(F.size(title) > 0, flat)).alias("_t"), F.count(F.when(F.size(title) > 0, 1)).alias("_c"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_distinct(F.col(window)).alias("window_count"), F.count_distinct(F.col(source)).alias("source_count"),
    )
    views: Mapping[str, DataFrame] = {"text_coherence": mean_tfidf_cosine(df, key, member, text), "skill_coherence": mean_jaccard(df, key, skills), "title_coherence": mean_jaccard(df, key, title)}
    for name, v in views.items():
        base = base.join(v.select(key, F.col("coherence").alias(name)), key)
    companies = distribution(df, key, company).select(key, F.col("distribution").alias("companies"), F.col("hhi").alias("company_hhi"))
    windows = distribution(df, key, window).select(key, F.col("distribution").alias("windows"))
    out = base.join(companies, key).join(windows, key).join(contradictions(df, key, families), key)
    return out.select(
        key, "member_count", "text_coherence", "skill_coherence", "title_coherence", (weights[0] * F.col("text_coherence") + weights[1] * F.col("skill_coherence")).alias("combined_coherence"),
        F.when(F.col("_c") > 0, F.col("_t") / F.col("_c")).alias("title_distinct_ratio"), "companies", "company_hhi", F.size("companies").cast("bigint").alias("company_count"), "windows", "window_count", "source_count", "contradictions", "first_date", "last_date",
    )
