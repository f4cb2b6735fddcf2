"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpoint


def fold(id_col: str, modulus: int):
    """The fold of a row: crc32 of its id as text, modulo modulus."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most ``most`` labelled documents of each class outside the held-out fold, of ``most_bytes`` bytes of text in all.

    Which ones is set by a hash of the id; a text that no longer fits is left
    out, those taken are whole. Only ids and sizes are sent around. The sample
    is written once to the shared folder.
    """
    ok = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    ok = ok.filter(fold("id", modulus) != held_out)
    picked = None
    for y in (0, 1):
        part = ok.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = checkpoint(text.join(F.broadcast(picked), "id").select("id", "y", "text"))
    sizes = rows.groupBy("id").agg(F.sum(F.octet_length("text")).alias("n"), F.xxhash64("id").alias("o")).orderBy("o", "id").collect()  # 2 * most rows
    room, dropped = most_bytes, []
    for r in sizes:
        if r.n <= room:
            room -= r.n
        else:
            dropped.append(r.id)
    return rows.filter(~F.col("id").isin(dropped)) if dropped else rows


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression (the last is the bias) by damped Newton steps; classes weigh as they occur."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2 * max(1, len(y)))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w
