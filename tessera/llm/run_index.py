"""Exact byte-level deduplication with a run-length index over all documents.

Every window of ``window`` bytes has an anchor, the least hash of its
``gram``-byte strings, so equal windows have equal anchors. A block is a run of
windows of one document with one anchor, and holds the bytes under them; each
window of the corpus lies in one block. Anchors that occur in one block only
match nothing, unless it has the anchor at several places. Equal blocks are one entry with a count, and an entry that
stands for several blocks is repeated as a whole. The different blocks of an
anchor go to one index: their Burrows-Wheeler transform is kept as runs, with a
sample at both ends of each run (a place, and how far its suffix agrees with
the suffix next to it in order). Between samples these lengths fall by one a
byte, so a pass over the text that looks up the last sample before each place
streams the matching statistics of all blocks against each other. A window is
repeated where they reach ``window``.

Skew: blocks are counted before they are shuffled, and text is fetched once for
each different block. The different blocks of a crowded anchor are texts of
their own to the same steps with a longer ``gram``: windows that reach far out
of what the texts share then have anchors of their own and leave. The last
level takes whole windows as anchors, so each index stays bounded and nothing
is left to compare in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .cluster import shared_dir

U64 = np.uint64
WINDOW, GRAM = 400, 32
#: Windows of a block at most; longer runs (one byte over and over) are cut.
BLOCK = 4096
#: Different blocks of an anchor that one index takes.
CROWD = 512
#: Bytes of the blocks that are indexed together, beyond which no anchor is added.
BATCH = 1 << 20
#: Bytes of a long text whose windows are hashed at a time.
SLICE = 1 << 20


class Hashes:
    """64-bit hashes of byte ranges of a buffer by prefix sums."""

    def __init__(self, buf: np.ndarray):
        up, self.down = tx._powers(tx._B1, len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, U64)
        np.cumsum(tx._BYTE[buf] * up[: len(buf)], out=self.total[1:])

    def ranges(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return tx.mix((self.total[start + size] - self.total[start]) * self.down[start] + np.asarray(size).astype(U64) * U64(tx._B2))

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return tx.mix((self.total[size:] - self.total[:n]) * self.down[:n])


def _blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Texts -> (anchor, block hash, row, first window, windows, whether it has its anchor at several places, whether its text is done) of their blocks; long texts in slices."""
    for b in batches:
        k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
        done = b.column(3).to_numpy(zero_copy_only=False) if b.num_columns > 3 else np.zeros(len(b), bool)
        buf, offs = tx.string_buffers(b.column(2))
        for lo, hi in tx.doc_runs(offs):
            for at in range(int(offs[lo]), int(offs[hi]), SLICE):
                own = buf[at : min(at + SLICE + window - 1, int(offs[hi]))]
                if len(own) < window:
                    break
                h = Hashes(own)
                x, span = h.all_of(gram), window - gram + 1
                least = tx.sliding(x, span, np.minimum)[:SLICE]
                start = at + np.arange(len(least))
                doc = np.searchsorted(offs, start, side="right") - 1
                whole = np.flatnonzero(offs[doc + 1] - start >= window)
                if not len(whole):
                    continue
                a, d = least[whole], doc[whole]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(whole) != 1) | (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
                size = np.diff(np.append(new, len(whole)))
                parts = -(-size // BLOCK)  # a run of windows beyond a block's length is several
                nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                new = np.repeat(new, parts) + nth * BLOCK
                size = np.minimum(np.repeat(size, parts) - nth * BLOCK, BLOCK)
                first, d, a = whole[new], d[new], a[new]
                pad = np.zeros(span - 1, U64)
                anchored = np.flatnonzero(tx.sliding(np.concatenate([pad, least, pad]), span, np.maximum) == x[: len(least) + span - 1])
                lo_hit, hi_hit = np.searchsorted(anchored, first), np.searchsorted(anchored, first + size + span - 1)
                hits = np.arange(int((hi_hit - lo_hit).sum())) - np.repeat(np.cumsum(hi_hit - lo_hit) - hi_hit, hi_hit - lo_hit)
                block = np.repeat(np.arange(len(first)), hi_hit - lo_hit)
                several = np.bincount(block[x[anchored[hits]] == a[block]], minlength=len(first)) > 1
                yield pa.record_batch(
                    [pa.array(a.view(np.int64)), pa.array(h.ranges(first, size + window - 1).view(np.int64)), pa.array(k1[d]), pa.array(k2[d]), pa.array((at + first - offs[d]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(several), pa.array(done[d])],
                    names=["anchor", "block", "_k1", "_k2", "at", "n", "several", "done"],
                )


def _sorted_pairs(first: np.ndarray, second: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places by (first, second), all numbers below 2**bits; where a new first begins, and where a new pair does."""
    if 3 * bits <= 63:  # one number each: far cheaper to sort
        both = (first << 2 * bits) | (second << bits) | place
        both.sort()
        at, both = both & ((1 << bits) - 1), both >> bits
        one = both >> bits
    else:
        order = np.lexsort((second, first))
        at, one, both = place[order], first[order], second[order]
    opens = np.concatenate([[True], one[1:] != one[:-1]])
    return at, opens, opens | np.concatenate([[True], both[1:] != both[:-1]])


def suffix_ranks(text: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, ranks of all suffixes by their first that many bytes), by doubling; left: bytes up to the end of a suffix's block.

    The last ranks differ unless two suffixes are equal to their ends.
    """
    n, bits = len(text), int(len(text) + 1).bit_length()
    code = np.zeros(257, np.int64)
    code[:256][np.bincount(text, minlength=256) > 0] = 1  # 0: behind the end
    code = np.cumsum(code) * code
    width = int(code.max()).bit_length()
    step = max(1, (min(2 * bits, 62)) // width)
    key, padded = np.zeros(n, np.int64), np.concatenate([code[text], np.zeros(step, np.int64)])
    for k in range(step):
        key = (key << width) | np.where(left > k, padded[k : k + n], 0)
    i = np.arange(n)
    at, _, fresh = _sorted_pairs(key >> bits, key & ((1 << bits) - 1), i, bits)
    rank = np.empty(n, np.int64)
    rank[at] = np.maximum.accumulate(np.where(fresh, i, 0))
    levels, live, alive = [(step, rank.astype(np.int32))], i, np.ones(n, bool)
    while True:
        alive[at[fresh & np.append(fresh[1:], True)]] = False  # nothing shares its rank
        live = live[alive[live]]
        if not len(live) or step >= left[live].max():
            return levels
        after = np.where(left[live] > step, rank[np.minimum(live + step, n - 1)] + 1, 0)
        at, opens, fresh = _sorted_pairs(rank[live], after, live, bits)
        i = np.arange(len(live))
        rank[at] += np.maximum.accumulate(np.where(fresh, i, 0)) - np.maximum.accumulate(np.where(opens, i, 0))
        step *= 2
        levels.append((step, rank.astype(np.int32)))


def common_prefix(text: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a[i] and b[i] have in common, up to the end of either's block."""
    most, common, last = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64), len(text) - 1
    for step, rank in reversed(levels):
        common += np.where((common < most) & (rank[np.minimum(a + common, last)] == rank[np.minimum(b + common, last)]), step, 0)
    going = common < most
    for _ in range(levels[0][0]):
        going &= (common < most) & (text[np.minimum(a + common, last)] == text[np.minimum(b + common, last)])
        common += going
    return np.minimum(common, most)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of blocks, with the place and the agreement with its neighbour sampled at both ends of each run."""

    def __init__(self, text: np.ndarray, starts: np.ndarray):
        n = len(text)
        self.n = n
        ends = np.append(starts[1:], n)
        self.left = np.repeat(ends, ends - starts) - np.arange(n)
        levels = suffix_ranks(text, self.left)
        order = np.argsort(levels[-1][1], kind="stable")
        before = text[order - 1].astype(np.int64)
        opens = np.zeros(n, bool)
        opens[starts] = True
        before[opens[order]] = 256 + np.arange(len(starts))  # nothing is before a block: a run of its own
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.symbols, self.lengths = before[head], np.diff(np.append(head, n))
        agree = common_prefix(text, self.left, levels, order[head[1:] - 1], order[head[1:]])  # across each border of two runs
        tail = np.append(head[1:], n) - 1
        self.heads = self._sorted(order[head], np.append(0, agree))
        self.tails = self._sorted(order[tail], np.append(agree, 0))

    @staticmethod
    def _sorted(place: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(place)
        return place[by], agree[by]

    def _stream(self, samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        place, agree = samples
        back = np.diff(np.append(place, self.n))
        return np.repeat(agree + place, back) - np.arange(self.n)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, how far its suffix agrees with the one before it in order, and with the one behind it."""
        return self._stream(self.heads), self._stream(self.tails)


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Different blocks sorted by anchor -> their runs of repeated windows (at, n)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        buf, offs = tx.string_buffers(t["bytes"])
        prev, after = RunIndex(buf, offs[:-1]).matching_statistics()
        i = np.flatnonzero(np.maximum(prev, after) >= window)
        row = np.searchsorted(offs, i, side="right") - 1
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (row[1:] != row[:-1])])) if len(i) else i
        rows = row[edge]
        n = np.diff(np.append(edge, len(i)))
        return pa.record_batch([t["anchor"].combine_chunks().take(pa.array(rows)), t["block"].combine_chunks().take(pa.array(rows)), pa.array((i[edge] - offs[rows]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "block", "at", "n"])

    held: list[pa.RecordBatch] = []
    load = 0
    for b in batches:
        held.append(b)
        load += b.column(2).nbytes
        if load < BATCH:
            continue
        t = pa.Table.from_batches(held)
        anchor, size = t["anchor"].to_numpy(), np.cumsum(pc.binary_length(t["bytes"]).to_numpy())
        border = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        done = 0
        for k, cut in enumerate(border):  # whole anchors of about BATCH bytes; the last one may go on
            if k == len(border) - 1 or size[border[k + 1] - 1] - (size[done - 1] if done else 0) > BATCH:
                yield solve(t.slice(done, cut - done))
                done = int(cut)
        held = t.slice(done).combine_chunks().to_batches()
        load = sum(x.column(2).nbytes for x in held)
    if held and sum(map(len, held)):
        yield solve(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(text, wanted blocks) -> the blocks with their bytes."""
    for b in batches:
        buf, offs = tx.string_buffers(b.column(0))
        raw, flat = memoryview(buf), b.column(1).flatten()
        anchor, block, crowded, done, at, n = (flat.field(k) for k in range(6))
        row = np.repeat(np.arange(len(b)), b.column(1).value_lengths().to_numpy())
        lo = offs[row] + at.to_numpy()
        hi = lo + n.to_numpy() + window - 1
        for i in range(0, len(lo), 4096):
            k = slice(i, i + 4096)
            data = pa.array([raw[s:e].tobytes() for s, e in zip(lo[k].tolist(), hi[k].tolist())], pa.binary())
            yield pa.record_batch([*(c[i : i + 4096] for c in (anchor, block, crowded, done)), data], names=["anchor", "block", "crowded", "done", "bytes"])


def repeated_windows(texts: DataFrame, folder: str, window: int, grams: list[int], crowd: int) -> DataFrame:
    """(_k1, _k2, _m): runs (at, n) of windows that start elsewhere too, of texts (_k1, _k2, _text: string or binary, _done) that have any.

    Texts that are done are repeated as a whole: others are compared with them, but nothing is looked up for them.

    ``grams`` are those of this level and the deeper ones, ending with whole
    windows. Tables between passes are written to ``folder``.
    """
    spark, key, gram, last = texts.sparkSession, ["_k1", "_k2"], grams[0], len(grams) == 1

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{gram}-{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{gram}-{name}")

    blocks = written(texts.mapInArrow(tx.tidied(lambda it: _blocks(it, window, gram)), "anchor long, block long, _k1 long, _k2 long, at int, n int, several boolean, done boolean"), "blocks")
    kinds = written(blocks.groupBy("anchor", "block").agg(F.count("*").alias("times"), F.min(F.struct("_k1", "_k2", "at", "n")).alias("one"), F.max("several").alias("several")), "kinds")
    anchors = kinds.groupBy("anchor").agg(F.sum("times").alias("_times"), F.count("*").alias("_kinds"), F.max("several").alias("_several")).filter("_times > 1 or _several")
    anchors = written(anchors.select("anchor", "_several", (F.col("_kinds") > 1).alias("_mixed"), (F.lit(False) if last else F.col("_kinds") > crowd).alias("crowded")), "anchors")
    known = kinds.join(anchors, "anchor")
    wanted = known.filter("_mixed or _several").select("one._k1", "one._k2", F.struct("anchor", "block", "crowded", (F.col("times") > 1).alias("done"), "one.at", "one.n").alias("_w"))
    wanted = wanted.groupBy(*key).agg(F.collect_list("_w").alias("_w"))  # of one text
    pieces = written(texts.join(wanted, key).select("_text", "_w").mapInArrow(tx.tidied(lambda it: _cut(it, window)), "anchor long, block long, crowded boolean, done boolean, bytes binary"), "pieces")
    found = pieces.filter("not crowded").select("anchor", "block", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tx.tidied(lambda it: _search(it, window)), "anchor long, block long, at int, n int")
    whole = known.filter("times > 1").select("anchor", "block", F.lit(0).alias("at"), "one.n")
    marks = found.unionByName(whole).groupBy("anchor", "block").agg(F.collect_list(F.struct("at", "n")).alias("_m"))  # at most a block's windows each
    if not anchors.filter("crowded").isEmpty():
        crowded = pieces.filter("crowded").select(F.col("anchor").alias("_k1"), F.col("block").alias("_k2"), F.col("bytes").alias("_text"), F.col("done").alias("_done"))
        deeper = repeated_windows(crowded, folder, window, grams[1:], crowd)
        marks = marks.unionByName(deeper.select(F.col("_k1").alias("anchor"), F.col("_k2").alias("block"), "_m"))
    marks = written(marks, "marks")
    spans = blocks.filter("not done").select("anchor", "block", *key, "at").join(marks, ["anchor", "block"]).select(*key, F.transform("_m", lambda x: F.struct((x["at"] + F.col("at")).alias("at"), x["n"].alias("n"))).alias("_m"))
    return spans.groupBy(*key).agg(F.flatten(F.collect_list("_m")).alias("_m"))


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _finish(batches: Iterator[pa.RecordBatch], window: int, names: list[str], others: list[str], order: list[str], text_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest, runs = b.column(2), b.column(1)
        buf, offs = tx.string_buffers(b.column(0))
        known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
        at, n = (runs.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        ends = np.concatenate([[0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy())])
        sizes, removed, counts, shas, spans, kept = np.diff(offs), [], [], [], [], []
        for r in range(len(b)):
            own = buf[offs[r] : offs[r + 1]]
            s, m = at[ends[r] : ends[r + 1]], n[ends[r] : ends[r + 1]]
            if len(s):
                mark = np.zeros(len(own) + 1, np.int64)
                np.add.at(mark, s, 1)
                np.add.at(mark, s + m + window - 1, -1)
                drop = np.cumsum(mark[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8))).reshape(-1, 2)
                own = own[~drop]
            else:
                edges = np.zeros((0, 2), np.int64)
            raw = own.tobytes()
            removed.append(int(sizes[r]) - len(raw))
            counts.append(len(edges))
            shas.append(hashlib.sha256(raw).hexdigest())
            spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
            kept.append(raw.decode(errors="ignore") if known[r] else None)
        cols = {c: rest.field(f"c{k}") for k, c in enumerate(others)}
        cols[text_col] = pa.array(kept, pa.string())
        extra = [pa.array(sizes), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        yield pa.record_batch([*(cols[c] for c in order), *extra], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, prefix: str = "_") -> DataFrame:
    """Removes every byte under a string of ``window`` bytes that also starts elsewhere, in the same or another document.

    Returns the other columns of docs with ``text_col`` replaced by what is kept
    (decoded; what is left of a cut character goes), and behind them, their
    names begun by ``prefix``, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the kept bytes) and spans (their bounds). A column of
    docs by such a name is replaced; names may hold any character.

    A null text has no bytes and stays null; texts shorter than ``window`` lose
    nothing; texts of any length are read whole. Strings are judged on the
    input, so all places of a repeated string lose it, none is preferred. A row
    that is there twice is a copy of itself. Ids may be of any type that Spark
    hashes, null or repeated. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    report = T._parse_datatype_string(REPORT).fields
    made = [prefix + f.name for f in report]
    order = [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    others = [c for c in order if c != text_col]
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    base = docs.select(
        F.xxhash64(ident, ident.isNull()).alias("_k1"), F.xxhash64(text).alias("_k2"), text.alias("_text"),
        F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("_rest"),
    )
    folder = f"{shared_dir(spark).rstrip('/')}/run-index-{uuid.uuid4().hex}"
    grams = sorted({min(gram, window), window - max(1, window // 20), window})
    spans = repeated_windows(base.select("_k1", "_k2", "_text", F.lit(False).alias("_done")), folder, window, grams, crowd)
    schema = T.StructType([*(docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in order), *(T.StructField(m, f.dataType) for m, f in zip(made, report))])
    names = schema.fieldNames()
    return base.join(spans, ["_k1", "_k2"], "left").select("_text", "_m", "_rest").mapInArrow(tx.tidied(lambda it: _finish(it, window, names, others, order, text_col)), schema)
