"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of words; the words under its zeros are
ignored, so a hash survives substitutions there. Hashes of all benchmark
positions are looked up from every position of every document. A hit fixes a
diagonal (document position minus item position), along which the words are
compared: an equal word scores 1 and any other -3. All maximal scoring segments
of the diagonal (as Ruzzo and Tompa define them) are found, so over 75 % of a
segment's words are equal and passages of one item that lie apart are separate.
Segments of ``least`` words or more (or of a whole shorter item) are overlaps.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, so
punctuation does not hide a passage. Items of fewer than ``shortest`` words are
no passages and not searched. The benchmark is shipped to the tasks in parts of
``part`` words at most, each with its own pass over the documents, so memory is
bounded however large it grows; items with equal texts are searched once. Hits
are handled in slices of ``HITS``, so boilerplate cannot fill a worker.
Documents are never shuffled to be searched; dropping them is a filter inside
the search, or, for a benchmark of several parts, a join with the rows found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import checkpoint
from .columns import free

U64 = np.uint64
#: The fixed masks: 1 counts, 0 is ignored.
MASKS = ("11101011", "1101100101", "11001010011", "1010011010011")
LEAST, PART, SHORT, HITS, BROADCAST = 13, 2_000_000, 5, 1_000_000, 1_000_000
_FOLD = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
_WEIGHT = np.random.default_rng(11).integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)


def _masks(n_words: int) -> list[list[int]]:
    """Offsets of the masks for an item: all that fit, or the whole item if none does."""
    fit = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS if len(m) <= n_words]
    return fit or [list(range(n_words))]


def _keys(h: np.ndarray, mask: list[int], first: np.ndarray) -> np.ndarray:
    total = np.full(len(first), U64(len(mask) * 1000 + mask[-1]))
    for k, off in enumerate(mask):
        total += h[first + off] * _WEIGHT[k]
    return tx.mix(total)


def _fold(buf: np.ndarray, offs: np.ndarray) -> tx.Words:
    return tx.Words(_FOLD[buf], offs)


def segments(same: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments (start, end) of equal words at 1 and other words at -3, in order."""
    if not len(same):
        return []
    edge = np.concatenate([[0], np.flatnonzero(np.diff(same)) + 1, [len(same)]])
    total = 0
    held: list[tuple[int, int, int, int]] = []  # start, end, score before, score after
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if not same[s]:
            total -= 3 * (e - s)
            continue
        own = (s, e, total, total + e - s)
        total += e - s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= own[2]:
                j -= 1
            if j < 0 or held[j][3] >= own[3]:
                held.append(own)
                break
            own = (held[j][0], own[1], held[j][2], own[3])
            del held[j:]
    return [(s, e) for s, e, _, _ in held]


class Bench:
    """Hash index of a bounded part of the benchmark; equal texts are one item."""

    def __init__(self, ids: list[int], texts: list[str], shortest: int = SHORT):
        same: dict[str, list[int]] = {}
        for i, t in zip(ids, texts):
            same.setdefault(t, []).append(i)
        buf, offs = tx.string_buffers(pa.array(list(same), pa.string()))
        words = _fold(buf, offs)
        self.ids, self.h, self.first = list(same.values()), words.hashes(), words.first_word
        index: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, n in enumerate(words.counts().tolist()):
            if n >= shortest:
                for m in _masks(n):
                    index.setdefault(tuple(m), []).extend((i, j) for j in range(n - m[-1]))
        self.index = []
        for m, at in index.items():
            at = np.array(at, np.int64)
            key = _keys(self.h, list(m), self.first[at[:, 0]] + at[:, 1])
            order = np.argsort(key, kind="stable")
            near = np.zeros(1 << 20, bool)
            near[(key >> U64(44)).astype(np.int64)] = True
            self.index.append((list(m), key[order], at[order], near))

    def diagonals(self, words: tx.Words) -> np.ndarray:
        """Columns (text, item, shift), distinct, that some mask hits."""
        h, left, doc = words.hashes(), words.words_left(), words.doc_of_word()
        found = [np.zeros((3, 0), np.int64)]
        for mask, key, at, near in self.index:
            pos = np.flatnonzero(left > mask[-1])
            k = _keys(h, mask, pos)
            some = near[(k >> U64(44)).astype(np.int64)]
            pos, k = pos[some], k[some]
            lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            hit = hi > lo
            pos, lo, n = pos[hit], lo[hit], (hi - lo)[hit]
            total = np.cumsum(n)
            i = 0
            while i < len(pos):  # slices of about HITS, one position at least
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + HITS, "right")))
                m = n[i:j]
                row = np.repeat(np.arange(i, j), m)
                which = np.repeat(lo[i:j] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                item, off = at[which, 0], at[which, 1]
                found.append(np.unique(np.stack([doc[pos[row]], item, pos[row] - off]), axis=1))
                if len(found) > 8:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                i = j
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def search(self, words: tx.Words, least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, text start, item start, words, equal words) of every segment of every diagonal that is long enough."""
        h = words.hashes()
        for d, item, shift in self.diagonals(words).T.tolist():
            a, b = self.first[item], self.first[item + 1]
            lo, hi = max(shift, words.first_word[d]), min(shift + b - a, words.first_word[d + 1])
            same = h[lo:hi] == self.h[a + lo - shift : a + hi - shift]
            for s, e in segments(same):
                if e - s >= min(least, b - a):
                    yield d, item, int(lo + s - words.first_word[d]), int(lo + s - shift), e - s, int(same[s:e].sum())


def bench_parts(benchmark: DataFrame, item_col: str, item_text: str, part: int) -> list:
    """The benchmark in broadcast parts of about ``part`` words, by content: equal texts are in one part."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // (part * 6)))
    out = []
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).orderBy("i", "t").collect()  # bounded by part
        out.append(spark.sparkContext.broadcast(([r.i for r in rows], [r.t for r in rows])))
    return out


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, part: int = PART, shortest: int = SHORT
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_equal): overlaps of documents with benchmark items.

    One row per document, item, diagonal and maximal segment, so a passage that
    a document holds twice is there twice, and so are two passages of one item.
    Ties do not arise: segments of a diagonal are disjoint and in order. Texts
    of any length are searched whole. Null or empty texts and items overlap
    with nothing; an empty benchmark gives no rows; repeated rows (of either
    table) give repeated results; ids may be null; other columns are left out.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = f"doc_id {own.schema['i'].dataType.simpleString()}, item_id long, doc_start int, item_start int, n_words int, n_equal int"
    out = None
    for sent in bench_parts(benchmark, item_col, item_text, part):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Bench(*sent.value, shortest)
            for b in batches:
                buf, offs = tx.string_buffers(b.column(1))
                for lo, hi in tx.doc_runs(offs):
                    row, ids, made = [], [], []
                    for m in bench.search(_fold(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), least):
                        for i in bench.ids[m[1]]:
                            row.append(m[0] + lo)
                            ids.append(i)
                            made.append(m[2:])
                    if row:
                        cols = np.array(made, np.int32).T
                        yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), pa.array(ids, pa.int64()), *map(pa.array, cols)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

        each = own.mapInArrow(tx.tidied(run), schema)
        out = each if out is None else out.unionByName(each)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, part: int = PART, shortest: int = SHORT
) -> DataFrame:
    """docs, all columns, without the rows whose text overlaps with the benchmark; rows are judged by their texts alone."""
    parts = bench_parts(benchmark, item_col, item_text, part)
    at = docs.columns.index(text_col)

    def bad(bench: Bench, col: pa.Array) -> np.ndarray:
        buf, offs = tx.string_buffers(col)
        out = np.zeros(len(col), bool)
        for lo, hi in tx.doc_runs(offs):
            out[[lo + m[0] for m in bench.search(_fold(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), least)]] = True
        return out

    if len(parts) == 1:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Bench(*parts[0].value, shortest)
            for b in batches:
                yield b.filter(pa.array(~bad(bench, b.column(at).cast(pa.string()))))

        return docs.mapInArrow(tx.tidied(keep), docs.schema)
    found = None
    for sent in parts:

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Bench(*sent.value, shortest)
            for b in batches:
                yield b.select([1]).filter(pa.array(bad(bench, b.column(0))))

        text = F.col(f"`{text_col}`").cast("string")
        each = docs.select(text.alias("t"), F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")).alias("k")).mapInArrow(tx.tidied(hits), "k struct<a:long,b:int>")
        found = each if found is None else found.unionByName(each)
    key = free("bad", docs.columns)
    found = checkpoint(found.select(F.col("k").alias(key)).distinct())
    if found.count() <= BROADCAST:  # 24 bytes a row
        found = F.broadcast(found)
    text = F.col(f"`{text_col}`").cast("string")
    return docs.join(found, F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")) == F.col(key), "left_anti")
