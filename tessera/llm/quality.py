"""Quality classifier: a byte-level convolutional network in numpy.

A document is read as overlapping chunks of ``CHUNK`` bytes that cover it
whole; the last is filled with zero bytes. Learned filters of ``WIDTH`` bytes
run over each chunk every ``STRIDE`` bytes. As the input is one byte of 256 at
each place, a filter bank is a table per place, and a response is a sum of
table rows. Rectified responses are max-pooled over the chunk; the chunks of a
document are combined by their mean and maximum, and a logistic unit gives the
probability of label 1.

It is trained by Adam on all chunks of at most ``SAMPLE`` labelled documents of
each class, ``SAMPLE_BYTES`` of text at most, so neither the driver's memory nor
the cost of training depends on the size of the corpus. Scoring reads every
byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .columns import free
from .labelled import fold, labelled_sample, sigmoid

CHUNK, OVERLAP, WIDTH, STRIDE, FILTERS = 512, 32, 8, 4, 24
SAMPLE, SAMPLE_BYTES, STEPS, BATCH, RATE = 1500, 64 << 20, 900, 48, 4e-3
HELD_MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
_SPOTS = (CHUNK - WIDTH) // STRIDE + 1
Model = dict[str, np.ndarray]


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks of a text of that many bytes, one at least."""
    n = 1 if size <= CHUNK else 1 + -(-(size - CHUNK) // (CHUNK - OVERLAP))
    return np.arange(n) * (CHUNK - OVERLAP)


def chunks_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks (rows of CHUNK bytes) that begin at starts; bytes from ends on are zero."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(buf):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8)


def responses(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Filter responses of chunks: (chunks, spots, filters)."""
    out = np.zeros((len(x), _SPOTS, table.shape[2]), np.float32)
    for k in range(WIDTH):
        out += table[k][x[:, k : k + (_SPOTS - 1) * STRIDE + 1 : STRIDE]]
    return out


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Model:
    """docs: the chunks of each document (n, CHUNK)."""
    rng = np.random.default_rng(seed)
    m: Model = {
        "table": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "last": np.zeros(1, np.float32),
    }
    y = np.asarray(y, np.float32)
    if len(docs) < 2 or y.min() == y.max():
        m["table"][:] = m["out"][:] = 0
        share = (float(y.sum()) + 1) / (len(y) + 2)
        m["last"][:] = np.log(share / (1 - share))
        return m
    mean = {k: np.zeros_like(v) for k, v in m.items()}
    var = {k: np.zeros_like(v) for k, v in m.items()}
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    prior = len(classes[1]) / len(y)
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        own = [docs[i] for i in pick]
        n = np.array([len(d) for d in own])
        x = np.concatenate(own)
        at = np.cumsum(n) - n
        r = responses(x, m["table"])
        best = r.argmax(axis=1)
        pooled = np.take_along_axis(r, best[:, None, :], 1)[:, 0] + m["bias"]
        live = pooled > 0
        pooled = np.where(live, pooled, 0)
        avg = np.add.reduceat(pooled, at) / n[:, None]
        top = np.maximum.reduceat(pooled, at)
        f = np.concatenate([avg, top], axis=1)
        d = ((sigmoid(f @ m["out"] + m["last"]) - y[pick]) / len(pick)).astype(np.float32)
        g = {"out": f.T @ d + 1e-4 * m["out"], "last": np.array([d.sum()], np.float32)}
        row = np.repeat(np.arange(len(n)), n)
        df = d[:, None] * m["out"]
        dp = (df[:, :FILTERS] / n[:, None])[row] + df[:, FILTERS:][row] * (pooled == top[row])
        dp *= live
        g["bias"] = dp.sum(axis=0)
        g["table"] = np.zeros_like(m["table"])
        c, k = np.nonzero(dp)
        spot = best[c, k] * STRIDE
        for j in range(WIDTH):
            np.add.at(g["table"][j], (x[c, spot + j], k), dp[c, k])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for key in m:
            mean[key] += 0.1 * (g[key] - mean[key])
            var[key] += 0.01 * (g[key] ** 2 - var[key])
            m[key] -= rate * (mean[key] / (1 - 0.9**step)) / (np.sqrt(var[key] / (1 - 0.99**step)) + 1e-7)
    m["last"] = m["last"] + np.float32(np.log(prior / (1 - prior)))  # batches hold as many of either class
    return m


def score_texts(buf: np.ndarray, offs: np.ndarray, m: Model) -> np.ndarray:
    """Probability of label 1 for each text of a buffer."""
    sizes = np.diff(offs)
    n = np.where(sizes <= CHUNK, 1, 1 + -(-(sizes - CHUNK) // (CHUNK - OVERLAP)))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    starts = offs[:-1][row] + (np.arange(len(row)) - first[row]) * (CHUNK - OVERLAP)
    ends = offs[1:][row]
    pooled = np.empty((len(row), FILTERS), np.float32)
    for lo in range(0, len(row), 512):
        hi = lo + 512
        pooled[lo:hi] = responses(chunks_of(buf, starts[lo:hi], ends[lo:hi]), m["table"]).max(axis=1)
    pooled = np.maximum(pooled + m["bias"], 0)
    f = np.concatenate([np.add.reduceat(pooled, first) / n[:, None], np.maximum.reduceat(pooled, first)], axis=1)
    return sigmoid((f @ m["out"] + m["last"]).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Trains on labelled rows outside the held-out fold."""
    t = labelled_sample(docs, labels, label, HELD_MODULUS, HELD_OUT, sample, SAMPLE_BYTES, id_col, text_col).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    held = []
    for text in t["text"].to_pylist():
        own = np.frombuffer(text.encode(), np.uint8)
        starts = chunk_starts(len(own))
        held.append(chunks_of(own, starts, np.full(len(starts), len(own))))
    return train(held, t["y"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "_score") -> DataFrame:
    """docs with a column ``name``: the probability of label 1. Null texts score as empty ones; ``name`` must be new to docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tx.string_buffers(b.column(at))
            out = [score_texts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], sent.value) for lo, hi in tx.doc_runs(offs)]
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*b.schema.names, name])

    return docs.mapInArrow(tx.tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row.

    Null ids count as not held out. Null and empty texts score as one chunk of
    zero bytes; texts of any length are read whole. Without labels of both
    classes the score is their share. A repeated label counts as the greater.
    Repeated rows give repeated results; other columns are left out.
    """
    made = score(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")), fit(docs, labels, label, id_col, text_col), "i", "t")
    held = F.coalesce(fold("i", HELD_MODULUS) == HELD_OUT, F.lit(False))
    return made.select(F.col("i").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    name = free("score", docs.columns)
    return score(docs, fit(docs, labels, "quality", id_col, text_col), id_col, text_col, name).filter(F.col(name) >= threshold).drop(name)
