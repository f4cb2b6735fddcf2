"""Text embeddings by a distributed truncated SVD of TF-IDF, fused with skill indicators (CLU-20).

The matrix stays sparse entries in a table. Subspace iteration multiplies it
with blocks of a few dozen columns, one row a term or a document; only the Gram
matrix of a block (columns x columns) is on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.similarity import settled

#: Columns kept beyond the components while iterating; rounds at most; change of the singular values at which it ends.
SPARE, ROUNDS, STILL = 16, 40, 1e-12


def tfidf(df: DataFrame, ident: str, tokens: str) -> DataFrame:
    """(id, term, x): share of a term in its document times ln((1 + N) / (1 + df)) + 1; N counts documents without tokens too."""
    n = df.count()
    t = df.select(F.col(ident).alias("_id"), F.size(tokens).alias("_len"), F.explode(tokens).alias("_t")).groupBy("_id", "_t", "_len").agg(F.count("*").alias("_c"))
    seen = t.groupBy("_t").agg(F.count("*").alias("_df"))
    return t.join(seen, "_t").select("_id", "_t", (F.col("_c") / F.col("_len") * (F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1)).alias("_x"))


def _names(width: int) -> list[str]:
    return [f"v{i}" for i in range(width)]


def _times(entries: DataFrame, to: str, along: str, block: DataFrame, width: int) -> DataFrame:
    """Matrix (or its transpose) times a block: rows by ``to``."""
    return entries.join(block, along).groupBy(to).agg(*(F.sum(F.col("_x") * F.col(v)).alias(v) for v in _names(width)))


def _gram(block: DataFrame, width: int) -> np.ndarray:
    v = _names(width)
    at = [(i, j) for i in range(width) for j in range(i, width)]

    def partial(parts):
        total = np.zeros((width, width))
        for pdf in parts:
            m = pdf[v].to_numpy(float)
            total += m.T @ m
        yield pd.DataFrame({"i": [i for i, _ in at], "j": [j for _, j in at], "g": [total[i, j] for i, j in at]})

    g = np.zeros((width, width))
    for r in block.select(*v).mapInPandas(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        g[r.i, r.j] = g[r.j, r.i] = r.g
    return g


def _turn(block: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Block times a small matrix."""
    v, out = _names(matrix.shape[0]), _names(matrix.shape[1])
    kind = block.schema[key].dataType.simpleString()

    def go(parts):
        for pdf in parts:
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(pdf[v].to_numpy(float) @ matrix, columns=out)], axis=1)

    return block.mapInPandas(go, f"`{key}` {kind}, {', '.join(f'{c} double' for c in out)}")


def _basis(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the eigenvalues above noise, falling, and the matrix that makes the block's columns orthonormal."""
    value, vector = np.linalg.eigh(gram)
    order = np.argsort(-value)
    value, vector = value[order], vector[:, order]
    keep = value > max(value.max(initial=0.0), 0.0) * 1e-13
    s = np.sqrt(value[keep])
    return s, vector[:, keep] / s


def truncated_svd(entries: DataFrame, components: int, spare: int = SPARE, rounds: int = ROUNDS, still: float = STILL) -> tuple[DataFrame, np.ndarray]:
    """(id, v0, v1, ...) of the left singular vectors times their values, and the values, of sparse entries (_id, _t, _x).

    As many columns as components, or as the rank where that is less. The sign
    of a column makes the entry of the least id over 1e-12 positive. Rows
    without entries have none. Exact up to rounding where the rank is at most
    components + spare, otherwise to ``still``.
    """
    entries, width = settled(entries), components + spare
    start = entries.select("_t").distinct()
    # Directions from a hash of the term: the same in every run and partitioning.
    z = settled(start.select("_t", *((F.xxhash64("_t", F.lit(i)) / F.lit(2.0**63)).alias(v) for i, v in enumerate(_names(width)))))
    last = None
    for _ in range(rounds):
        y = settled(_times(entries, "_id", "_t", z, width))
        _, q = _basis(_gram(y, width))
        if not q.shape[1]:
            return y.select("_id"), np.zeros(0)
        z = settled(_times(entries, "_t", "_id", _turn(y, "_id", q), q.shape[1]))
        s, turn = _basis(_gram(z, q.shape[1]))
        z = settled(_turn(z, "_t", turn))
        width = turn.shape[1]
        now = s[:components]
        if last is not None and len(now) == len(last) and np.abs(now - last).max() <= still * now.max():
            break
        last = now
    y = settled(_times(entries, "_id", "_t", z, width))
    value, vector = np.linalg.eigh(_gram(y, width))
    order = np.argsort(-value)[:components]
    value, vector = np.sqrt(np.maximum(value[order], 0)), vector[:, order]
    vector = vector[:, value > value.max(initial=0) * 1e-7]
    value = value[value > value.max(initial=0) * 1e-7]
    out = settled(_turn(y, "_id", vector))
    first = out.agg(*(F.min_by(v, F.when(F.abs(v) > 1e-12, F.col("_id"))).alias(v) for v in _names(len(value)))).first()
    flip = [(-1.0 if first[v] is not None and first[v] < 0 else 1.0) for v in _names(len(value))]
    return out.select("_id", *((F.col(v) * f).alias(v) for v, f in zip(_names(len(value)), flip))), value


def fused_embedding(df: DataFrame, ident: str, tokens: str, skills: str, components: int = 8, text_weight: float = 0.7, **more) -> DataFrame:
    """CLU-20. (id, text, skills): the unit SVD features times text_weight, and a map of each different skill to (1 - text_weight) / sqrt(their number).

    The map is the row of a one-hot matrix over the whole vocabulary without its
    zeros. Documents without tokens have zeros, those without skills an empty
    map. Ids are unique.
    """
    made, value = truncated_svd(tfidf(df, ident, tokens), components, **more)
    width = len(value)
    row = F.array(*map(F.col, _names(width))) if width else F.array().cast("array<double>")
    text = made.select(F.col("_id"), row.alias("_v"))
    have = F.array_distinct(F.coalesce(F.array_compact(skills), F.array().cast("array<string>")))
    x = df.select(F.col(ident).alias("_id"), have.alias("_s")).join(text, "_id", "left")
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, v: s + v * v))
    unit = F.when(length > 0, F.transform("_v", lambda v: F.round(v / length * text_weight, 12))).otherwise(F.array_repeat(F.lit(0.0), width))
    share = F.round((1 - text_weight) / F.sqrt(F.size("_s")), 12)
    return x.select(F.col("_id").alias(ident), unit.alias("text"), F.map_from_arrays("_s", F.transform("_s", lambda _: share)).alias("skills"))


def fused_cosine(a_text: Column, a_skills: Column, b_text: Column, b_skills: Column) -> Column:
    """Cosine of two fused embeddings; 0 where one is empty."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    over = lambda x, y: F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + x[k] * F.coalesce(F.try_element_at(y, k), F.lit(0.0)))
    norm = F.sqrt((dot(a_text, a_text) + over(a_skills, a_skills)) * (dot(b_text, b_text) + over(b_skills, b_skills)))
    return F.when(norm > 0, (dot(a_text, b_text) + over(a_skills, b_skills)) / norm).otherwise(0.0)

