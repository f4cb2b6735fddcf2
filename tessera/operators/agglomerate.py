"""Average-link agglomeration of a block in one task's memory, and in rounds over the whole table (CLU-04).

Both merge what a sequential run would merge anyway, since nothing that
is still open could come before it at the clusters it touches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import unit
from tessera.operators.similarity import settled

#: Clusters that one task compares with as many; similarities that a block holds at a time.
ROWS, STEP = 1024, 1 << 22


def average_link_block(ids: np.ndarray, vectors: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their ids, and for each the place in that order of its cluster's least id; ``threshold`` is over 0.

    Equal vectors are one cluster from the start, and rows without a neighbour
    at the threshold are done. Of the rest, a chain goes from each cluster to
    its nearest until two are each other's, which are merged. What is kept is a
    mean vector a cluster: similarities are computed again for one cluster at a
    time, and only where its nearest was merged. Similarities have twelve
    decimals, ties go to the least id.
    """
    order = np.argsort(ids, kind="stable")
    v = vectors[order]
    length = np.linalg.norm(v, axis=1)
    v = v / np.where(length == 0, 1, length)[:, None]
    place = np.arange(len(v))
    if not len(v):
        return order, place
    _, first, same = np.unique(np.round(v, 12) + 0.0, axis=0, return_index=True, return_inverse=True)
    root = first[same.ravel()]
    root[length == 0] = place[length == 0]  # a zero vector is like nothing, itself included
    name, count = np.unique(root, return_counts=True)
    m, n = v[name], count.astype(float)
    many, near = max(1, step // len(m)), np.zeros(len(m), bool)
    for lo in range(0, len(m), many):
        s = m[lo : lo + many] @ m.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        near[lo : lo + many] = s.max(axis=1) >= threshold - 1e-9
    name, m, n = name[near], m[near], n[near]
    while len(m):
        # What is merged or done is a zero row; rows are taken out when they are half of all.
        best, seen, made, open_ = np.full(len(m), -1), np.zeros(len(m), int), np.zeros(len(m), int), np.ones(len(m), bool)
        chain: list[int] = []
        start, left = 0, len(m)
        while chain or left > len(m) // 2:
            if not chain:
                start += int(open_[start:].argmax())
                chain = [start]
            i = chain[-1]
            j = best[i]
            if j < 0 or made[j] != seen[i]:
                s = np.round(m @ m[i], 12)
                s[i] = -np.inf
                j = int(s.argmax())
                if s[j] < threshold:
                    chain.pop()
                    m[i], open_[i] = 0, False
                    left -= 1
                    continue
                best[i], seen[i] = j, made[j]
            if j not in chain:
                chain.append(j)
                continue
            a, b = min(i, j), max(i, j)
            m[a] = (m[a] * n[a] + m[b] * n[b]) / (n[a] + n[b])
            n[a] += n[b]
            root[name[b]] = name[a]
            m[b], open_[b], best[a] = 0, False, -1
            made[a] += 1
            made[b] += 1
            left -= 1
            del chain[chain.index(j) if len(chain) > 1 and chain[-2] == j else 0 :]
        name, m, n = name[open_], m[open_], n[open_]
    for k in np.flatnonzero(root != place):  # each hangs on a lesser one
        root[k] = root[root[k]]
    return order, root


def _nearest(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> list[tuple]:
    """(id, other, similarity) of the nearest in b of each cluster of a; ties go to the least other."""
    b = b.sort_values("_id")
    mean = lambda x: np.array(x["_s"].tolist(), float).reshape(len(x), -1) / x["_n"].to_numpy(float)[:, None]
    s = np.round(mean(a) @ mean(b).T, 12) + 0.0
    ids, others = a["_id"].to_numpy(), b["_id"].to_numpy()
    if same:
        s[ids[:, None] == others[None, :]] = -np.inf
    at = s.argmax(axis=1)
    best = s[np.arange(len(s)), at]
    return [(i, others[k], float(x)) for i, k, x in zip(ids, at, best) if np.isfinite(x)]


def average_link_rounds(df: DataFrame, block: str, ident: str, vector: str, threshold: float, rows: int = ROWS, rounds: int = 500) -> DataFrame:
    """CLU-04. (block, id, cluster): average-link agglomeration within blocks down to a similarity (over 0), by rounds of mutual nearest pairs.

    The similarity of two clusters is the mean cosine of their members, the
    product of the means of their unit vectors, to twelve decimals. Pairs are
    ordered by falling similarity, then ids; a pair that comes first at both of
    its clusters is merged. Average link never brings a merged cluster nearer
    to a third than its parts were, so this is what merging the first pair of
    all gives. Equal vectors are one cluster from the start. Clusters without a
    neighbour at the threshold are done and leave. A cluster is named by its
    least id; null vectors and ids are left out. Raises after ``rounds``.
    Checkpoints keep the estimate of what they came from, vectors included, so
    no side of a join over clusters is left to be sent whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    x = df.filter(F.col(vector).isNotNull() & F.col(ident).isNotNull()).select(F.col(block).alias("_k"), F.col(ident).alias("_m"), unit(F.col(vector)).alias("_v"))
    # A zero vector is like nothing, itself included.
    zero = F.forall("_v", lambda v: v == 0)
    x = settled(x.withColumn("_h", F.when(zero, F.concat(F.lit("0"), F.col("_m").cast("string"))).otherwise(F.array_join(F.transform("_v", lambda v: F.round(v, 12).cast("string")), ","))))
    first = x.groupBy("_k", "_h").agg(F.min("_m").alias("_id"))
    members = settled(x.join(first.hint("merge"), ["_k", "_h"]).select("_k", "_m", F.col("_id").alias("_c")))
    size = members.groupBy("_k", F.col("_c").alias("_id")).agg(F.count("*").cast("double").alias("_n"))
    play = x.select("_k", F.col("_m").alias("_id"), "_v").join(size.hint("merge"), ["_k", "_id"]).select("_k", "_id", "_n", F.transform("_v", lambda v: v * F.col("_n")).alias("_s"))
    play = settled(play)
    out = f"_k {kinds[block]}, _id {kinds[ident]}, _o {kinds[ident]}, _x double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, k = pdf["_i"].iloc[0], pdf["_j"].iloc[0], pdf["_k"].iloc[0]
        a, b = pdf[pdf["_b"] == i], pdf[pdf["_b"] == j]
        found = [] if not len(a) or not len(b) else _nearest(a, b, i == j) + ([] if i == j else _nearest(b, a, False))
        return pd.DataFrame([(k, *f) for f in found], columns=["_k", "_id", "_o", "_x"])

    for _ in range(rounds):
        if play.isEmpty():
            break
        count = play.groupBy("_k").agg(F.ceil(F.count("*") / rows).cast("int").alias("_blocks"))
        b = play.join(count, "_k").withColumn("_b", F.pmod(F.xxhash64("_id"), "_blocks").cast("int"))
        wide = b.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("_k", "_id", "_n", "_s", "_b", F.least("_b", "_p").alias("_i"), F.greatest("_b", "_p").alias("_j"))
        near = wide.groupBy("_k", "_i", "_j").applyInPandas(run, out).groupBy("_k", "_id").agg(F.min(F.struct((-F.col("_x")).alias("x"), F.col("_o").alias("o"))).alias("_best"))
        near = settled(near.filter(-F.col("_best.x") >= threshold).select("_k", "_id", F.col("_best.o").alias("_o")))
        both = near.groupBy("_k", F.least("_id", "_o").alias("_lo"), F.greatest("_id", "_o").alias("_hi")).agg(F.count("*").alias("_two")).filter("_two = 2").drop("_two")
        moved = settled(both.select("_k", F.col("_hi").alias("_id"), F.col("_lo").alias("_to")))
        if moved.isEmpty():
            break
        # What has no neighbour at the threshold never gets one.
        active = play.join(near.select("_k", "_id").hint("merge"), ["_k", "_id"], "left_semi").join(moved.hint("merge"), ["_k", "_id"], "left").withColumn("_to", F.coalesce("_to", "_id"))
        sums = F.aggregate(F.collect_list("_s"), F.array_repeat(F.lit(0.0), F.size(F.first("_s"))), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
        play = settled(active.groupBy("_k", F.col("_to").alias("_id")).agg(F.sum("_n").alias("_n"), sums.alias("_s")))  # two rows a group at most
        members = settled(members.join(moved.withColumnRenamed("_id", "_c").hint("merge"), ["_k", "_c"], "left").select("_k", "_m", F.coalesce("_to", "_c").alias("_c")))
    else:
        raise RuntimeError(f"clusters still merge after {rounds} rounds")
    return members.select(F.col("_k").alias(block), F.col("_m").alias(ident), F.col("_c").alias("cluster"))

