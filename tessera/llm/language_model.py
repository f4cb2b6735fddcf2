"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Corpus statistics come from all training documents: how often each token
occurs, N and V. The most frequent words are symbols of their own; any other
word is known to the network by its shape (script, length, case, signs) and by
the band of its rank. The network (``gru``) reads symbols and predicts the next
class: a group of head words, a tail class, or the end. P(word) is
P(class | state) times P(word | class): a softmax on the state within a head
group, and the share of the corpus count within a tail class, where all unknown
words of a shape are one more word with count zero. So the factors sum to one.

Training reads every training document whole. A hash of the row deals them out
in shards of about ``SHARD`` tokens, so there are more shards as the corpus
grows. A first network is fitted on about ``WARM`` tokens. Then, in ``ROUNDS``
rounds, each shard fits a copy of the common network on its part of the
documents of that round (truncated backpropagation, the state carried on to the
end of each document), and the copies are averaged. Shards are read in an order
set by hash and averaged in whole numbers, so neither the layout of the table
nor a lost executor changes the weights.

Documents are tokenised twice: to count, and to write their symbols to the
shared folder, from which the network learns and scores. Scoring reads every
symbol: windows follow each other with the state carried on, so the sum is the
log-likelihood of the whole document.

The ``LEXICON`` most frequent words are sent to all tasks with their counts;
counts of the others reach the documents by a join on the word.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from . import textops as tx
from .cluster import shared_dir
from .gru import BANDS, END, HEAD, SHAPES, TAILS
from .labelled import fold

U64 = np.uint64
LEXICON, SHARD, WARM, ROUNDS, MOST_PARTS = 200_000, 2_000_000, 1_000_000, 2, 20_000
#: Rates of the first fit and of the rounds; tokens that the first fit reads at least, over again if need be, and how often at most.
FIRST_RATE, RATE, READ_AT_LEAST, PASSES = 8e-3, 3e-3, 1_500_000, 6
#: Ranks at which the bands of tail words end; what is not in the lexicon is in the last band.
EDGES = (16_384,)
HELD_MODULUS, HELD_OUT = 5, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_WIDE = np.arange(256) >= 128
_END_HASH = U64(0x5851F42D4C957F2D)
_FIX = float(1 << 28)
_BLOCK = 4096


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[tx.Words, np.ndarray, np.ndarray]:
    """Words with A-Z lower-cased, their hashes and their shapes."""
    words = tx.Words(_LOWER[buf], offs)
    if not words.n:
        return words, np.zeros(0, U64), np.zeros(0, np.int64)
    h = words.hashes()
    b = words.buf
    n = words.end - words.start
    wide = np.concatenate([[0], np.cumsum(_WIDE[b])])
    signs = np.concatenate([[0], np.cumsum(~(_LETTER[b] | _WIDE[b]))])
    foreign = wide[words.end] > wide[words.start]
    sign = signs[words.end] > signs[words.start]
    size = np.searchsorted([4, 7, 11], n)
    return words, h, (size + 4 * foreign + 8 * sign).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], most: int = 1_200_000) -> Iterator[pa.RecordBatch]:
    """Token counts of a partition, summed before they leave."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    load = docs = 0

    def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, k = (np.concatenate([p[i] for p in parts]) for i in range(3))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, np.bincount(back, weights=n, minlength=len(u)).astype(np.int64), k[first]

    def out(u, n, k) -> pa.RecordBatch:
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(n), pa.array(k.astype(np.int32))], names=["h", "n", "shape"])

    for b in batches:
        buf, offs = tx.string_buffers(b.column(0))
        docs += len(b)
        for lo, hi in tx.doc_runs(offs):
            _, h, k = tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, n, k[first]))
            load += len(u)
            if load > most:
                parts = [merge()]
                load = len(parts[0][0])
                if load > most // 2:
                    yield out(*parts[0])
                    parts, load = [], 0
    parts.append((np.full(min(docs, 1), _END_HASH), np.full(min(docs, 1), docs), np.full(min(docs, 1), -1)))
    yield out(*merge())


def tail_class(rank: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Tail class of words by rank (-1: not in the lexicon) and shape."""
    return shape + SHAPES * np.where(rank < 0, BANDS - 1, np.searchsorted(EDGES, rank, side="right"))


class Lexicon:
    """The most frequent words with counts; the first HEAD of them are symbols."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        rank = np.arange(len(h))
        order = np.argsort(h, kind="stable")
        self.h, self.n, self.rank = h[order], n[order], rank[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, rank or -1)."""
        if not len(self.h):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.n[at], -1), np.where(hit, self.rank[at], -1)


def symbols(lex: Lexicon, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol sequences with ends, first of each, text of each word, hashes, counts or -1, tail classes or -1)."""
    words, h, shape = tokens(buf, offs)
    u, back = np.unique(h, return_inverse=True)
    n, rank = lex.find(u)
    n, rank = n[back], rank[back]
    tail = np.where((rank >= 0) & (rank < HEAD), -1, tail_class(rank, shape))
    first = words.first_word + np.arange(words.n_docs + 1)
    seq = np.full(first[-1], END)
    doc = words.doc_of_word()
    seq[np.arange(words.n) + doc] = np.where(tail < 0, rank, HEAD + tail)
    return seq, first, doc, h, n, tail


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, symbols) of each row (shard, seq)."""
    for b in batches:
        for shard, seq in zip(b.column(0).to_pylist(), b.column(1)):
            yield shard, np.frombuffer(seq.as_py(), np.int16)


def _first_fit(spark, docs: DataFrame, model: gru.Model) -> gru.Model:
    """A network fitted on the rows (shard, key, seq), a bounded share of the corpus, in one task."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [s for _, s in _sequences(batches)]
        size = sum(map(len, texts))
        if size:
            passes = min(PASSES, max(1, math.ceil(READ_AT_LEAST / size)))
            m = gru.train(sent.value, (t for _ in range(passes) for t in texts), FIRST_RATE, passes * size, min(gru.ROWS, max(8, size // 4096)))
            yield pa.record_batch([pa.array([gru.flat(m).tobytes()], pa.binary())], names=["m"])

    made = docs.repartition(1, F.lit(0)).sortWithinPartitions("key", "shard").select("shard", "seq").mapInArrow(tx.tidied(run), "m binary").collect()  # one row
    return gru.unflat(np.frombuffer(made[0].m, np.float32)) if made else model


def _round(spark, docs: DataFrame, model: gru.Model, shards: int, planned: int) -> gru.Model:
    """The mean of the networks that the shards of the rows (shard, key, seq) fit, each from ``model`` on."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _sequences(batches)
        row = next(rows, None)
        total, n = None, 0
        while row is not None:
            shard = row[0]

            def own() -> Iterator[np.ndarray]:
                nonlocal row
                while row is not None and row[0] == shard:
                    yield row[1]
                    row = next(rows, None)

            x = np.rint(gru.flat(gru.train(sent.value, own(), RATE, planned)).astype(np.float64) * _FIX).astype(np.int64)
            total, n = (x if total is None else total + x), n + 1
        if total is not None:
            parts = [total[i : i + _BLOCK].tolist() for i in range(0, len(total), _BLOCK)]
            yield pa.record_batch([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), n)), pa.array(parts, pa.list_(pa.int64()))], names=["block", "n", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for block, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = x.values.to_numpy()
                had = sums.get(block)
                sums[block] = (n, x.copy()) if had is None else (had[0] + n, had[1] + x)
        for block, (n, x) in sums.items():
            yield pa.record_batch([pa.array([block]), pa.array([n]), pa.array([x.tolist()], pa.list_(pa.int64()))], names=["block", "n", "x"])

    kind = "block long, n long, x array<long>"
    made = docs.repartition(min(shards, MOST_PARTS), "shard").sortWithinPartitions("shard", "key").select("shard", "seq").mapInArrow(tx.tidied(run), kind)
    got = sorted(made.repartition("block").mapInArrow(tx.tidied(add), kind).collect())  # the size of the network
    return gru.unflat(np.concatenate([np.array(r.x, np.float64) / r.n for r in got]) / _FIX) if got else model


def fit(docs: DataFrame, model: gru.Model, n_tokens: int, shard: int = SHARD, warm: int = WARM, rounds: int = ROUNDS) -> gru.Model:
    """Fits the network on all rows (_k1, _k2, seq) of about ``n_tokens`` symbols."""
    spark = docs.sparkSession
    shards = max(1, -(-n_tokens // shard))
    draw = lambda k, n: F.pmod(F.xxhash64("_k1", "_k2", F.lit(k)), F.lit(n))
    rows = docs.select(draw(1, shards).alias("shard"), F.xxhash64("_k1", "_k2").alias("key"), draw(2, rounds).alias("round"), draw(3, 1_000_000).alias("lot"), "seq")
    share = min(1.0, warm / max(1, n_tokens))
    model = _first_fit(spark, rows.filter(F.col("lot") < math.ceil(share * 1_000_000)), model)
    for k in range(rounds):
        model = _round(spark, rows.filter(F.col("round") == k), model, shards, min(n_tokens, shard) // rounds)
    return model


_MARKED = "doc int, _id long, _k1 long, _k2 long, held boolean, h long, times long, n_tokens long, n_known long, base double, net double, seq binary"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON, shard: int = SHARD, warm: int = WARM, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. Ids are integers.

    Null and empty texts consist of the end alone; texts of any length are
    read whole, in training too. Null ids are not held out. Words that occur
    equally often are ranked by hash. Without training documents (or rows) N is
    0 and every token unknown. Repeated rows are counted, learned from and
    scored as often as they are there. Other columns are left out.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold("_id", HELD_MODULUS) == HELD_OUT, F.lit(False))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text")).withColumn("_held", held)
    base = f"{shared_dir(spark).rstrip('/')}/language-model-{uuid.uuid4().hex}"
    own.filter("not _held").select("_text").mapInArrow(tx.tidied(_count), "h long, n long, shape int").groupBy("h").agg(F.sum("n").alias("n"), F.min("shape").alias("shape")).write.parquet(f"{base}/words")
    vocab = spark.read.schema("h long, n long, shape int").parquet(f"{base}/words")
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = vocab.filter("shape < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = vocab.filter("shape >= 0").orderBy(F.desc("n"), "h").limit(lexicon).toArrow()
    top_n, top_shape = top["n"].to_numpy(), top["shape"].to_numpy()
    sent_lex = spark.sparkContext.broadcast(Lexicon(top["h"].to_numpy().view(U64), top_n))
    # Room and counts of the tail classes: those of the lexicon by band, all other words in the last band.
    words, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in vocab.filter("shape >= 0").groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # a row per shape
        words[TAILS - SHAPES + r["shape"]], kinds[TAILS - SHAPES + r["shape"]] = r["n"], r["k"]
    np.subtract.at(words, TAILS - SHAPES + top_shape, top_n)
    np.subtract.at(kinds, TAILS - SHAPES + top_shape, 1)
    tail = tail_class(np.arange(HEAD, len(top_n)), top_shape[HEAD:])
    np.add.at(words, tail, top_n[HEAD:])
    np.add.at(kinds, tail, 1)
    room = words + 0.5 * kinds
    room[TAILS - SHAPES :] += 0.5
    sent_room = spark.sparkContext.broadcast(room)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx, rest = sent_lex.value, sent_room.value
        names = [c.split(" ")[0] for c in _MARKED.split(", ")]
        for b in batches:
            ident, k1, k2, is_held = (b.column(i) for i in range(4))
            buf, offs = tx.string_buffers(b.column(4))
            for lo, hi in tx.doc_runs(offs):
                k = hi - lo
                seq, first, doc, h, n, tails = symbols(lx, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                raw = seq.astype(np.int16).tobytes()
                known = n >= 0
                here = np.bincount(doc[known], weights=np.log10(n[known] + 0.5), minlength=k) + np.log10(ends + 0.5)
                fine = known & (tails >= 0)
                far = np.flatnonzero(~known)
                net = np.bincount(doc[fine], weights=np.log10(n[fine] + 0.5) - np.log10(rest[tails[fine]]), minlength=k) - np.bincount(doc[far], weights=np.log10(rest[tails[far]]), minlength=k)
                zero, one = np.zeros(k, np.int64), np.ones(k, np.int32)
                yield pa.record_batch(
                    [pa.array(one), *(c.slice(lo, k) for c in (ident, k1, k2, is_held)), pa.array(zero), pa.array(zero), pa.array(np.diff(first)), pa.array(np.bincount(doc[known], minlength=k) + int(ends > 0)), pa.array(here), pa.array(net, pa.float64()), pa.array([raw[2 * s : 2 * e] for s, e in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())],
                    names=names,
                )
                if len(far):
                    d, hh = doc[far], h[far]
                    o = np.lexsort((hh, d))
                    d, hh = d[o], hh[o]
                    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (hh[1:] != hh[:-1])]))
                    row = pa.array(d[new] + lo)
                    k = len(new)
                    opens = np.concatenate([[True], np.diff(d[new]) != 0]).astype(np.int64)  # one row of each text says that it is there
                    yield pa.record_batch(
                        [pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.int64()), k1.take(row), k2.take(row), pa.nulls(k, pa.bool_()), pa.array(hh[new].view(np.int64)), pa.array(np.diff(np.append(new, len(d)))), pa.array(opens), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.binary())],
                        names=names,
                    )

    keyed = own.select("_id", F.coalesce("_id", F.lit(0)).alias("_k1"), F.xxhash64("_text", F.col("_id").isNull()).alias("_k2"), "_held", "_text")
    keyed.mapInArrow(tx.tidied(mark), _MARKED).write.parquet(f"{base}/symbols")
    marked = spark.read.schema(_MARKED).parquet(f"{base}/symbols")
    mine, far = marked.filter("doc = 1"), marked.filter("doc = 0")
    head_n = top_n[:HEAD]
    model = gru.start(head_n, words, ends)
    if total:
        model = fit(mine.filter("not held").select("_k1", "_k2", "seq"), model, int(total), shard, warm, rounds)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(s.as_py(), np.int16) for s in b.column(6)]
            if seqs:
                lp = gru.log10_probability(sent.value, np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
                yield pa.record_batch([*b.columns[:5], pa.array(b.column(5).to_numpy() + lp)], names=["_id", "_k1", "_k2", "n_tokens", "n_known", "net"]).append_column("base", b.column(7))

    cols = ["_id", "_k1", "_k2", "n_tokens", "n_known", "net", "seq", "base"]
    each = mine.select(*cols).mapInArrow(tx.tidied(run), "_id long, _k1 long, _k2 long, n_tokens long, n_known long, net double, base double")
    c = F.coalesce(F.col("c"), F.lit(0))
    more = (
        far.select("_k1", "_k2", "h", "times", F.col("n_tokens").alias("m")).join(vocab.select("h", F.col("n").alias("c")), "h", "left").groupBy("_k1", "_k2")
        .agg(F.sum("m").alias("m"), F.sum(F.col("times") * F.log10(c + F.lit(0.5))).alias("add"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
        .select("_k1", "_k2", (F.col("add") / F.col("m")).alias("add"), (F.col("known") / F.col("m")).cast("long").alias("known"))
    )
    out = each.join(more, ["_k1", "_k2"], "left")
    add = F.coalesce("add", F.lit(0.0))
    denominator = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(
        F.col("_id").alias("doc_id"), held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(denominator)).alias("base_score"), (F.col("net") + add).alias("score"),
    )
