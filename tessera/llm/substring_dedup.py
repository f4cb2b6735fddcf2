"""Substring deduplication by relative Lempel-Ziv parsing over all documents.

The reference is the whole corpus, cut into blocks at content-defined anchors.
Every window of ``window`` words contains an anchor: a ``gram``-word hash that
is minimal in it, so equal windows lie in blocks with equal anchors. Blocks
whose anchor occurs once match nothing and leave early. The rest are indexed by
anchor, each keeping the hashes of its windows, and each block is factored
against all blocks of its anchor: from its first window that starts elsewhere
too, the longest run of windows that goes on in the same way at any one other
place is a factor, and parsing goes on behind it. The longest match is a
neighbour in the sorted order of all suffixes. Factors that go on in the next
block of both texts are joined. So factors reach ``window`` words at least, each
window is looked at where a factor begins or ends, and the words under factors
are the duplicate spans.

Skew: the blocks of an anchor with over ``hot`` occurrences are cut where their
content says so and reduced to different pieces (partial sums before the
shuffle), whose windows are then aggregated; a join that adaptive execution can
split brings the result back. There a factor is a run of windows whose first
other occurrences follow each other. No task gathers such a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .columns import free

U64 = np.uint64
WINDOW, GRAM, HOT, PIECE = 35, 8, 512, 8


def _keyed(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """Rows under neutral names; (_k1, _k2) tells rows apart even if ids repeat or are null."""
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    text = F.col(f"`{text_col}`").cast("string")
    ident = F.col(f"`{id_col}`")
    return docs.select(
        F.coalesce(ident.cast("long"), F.lit(0)).alias("_k1"),
        F.xxhash64(text, ident.isNull()).alias("_k2"),
        text.alias("_text"),
        F.struct(F.lit(0).alias("none"), *rest).alias("_rest"),
    )


def _minima(words: tx.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, gram hashes and, for each window start, the least gram hash in it (0: no window)."""
    h = words.hashes()
    x = tx.ngram_hashes(h, gram)
    if words.n < window:
        return h, x, np.zeros(0, U64)
    least = tx.sliding(x, window - gram + 1, np.minimum)
    least[words.words_left()[: len(least)] < window] = 0
    return h, x, least


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
        for lo, _, words in tx.word_runs(b.column(2)):
            _, x, least = _minima(words, window, gram)
            if not len(least):
                continue
            pad = np.zeros(window - gram, U64)
            most = tx.sliding(np.concatenate([pad, least, pad]), window - gram + 1, np.maximum)
            at = np.flatnonzero(most == x)
            doc = words.doc_of_word()[at]
            order = np.lexsort((x[at], doc))
            a, d = x[at][order], doc[order]
            if not len(a):
                continue
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
            n = np.diff(np.append(new, len(a)))
            rows = d[new] + lo
            yield pa.record_batch([pa.array(a[new].view(np.int64)), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(n.astype(np.int32))], names=["anchor", "_k1", "_k2", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """One row per run of windows that share an anchor known to repeat; with n over zero, runs that the text repeats itself."""
    names = ["anchor", "_k1", "_k2", "at", "hot", "windows", "n", "ref_at"]
    for b in batches:
        k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
        warm, hot = b.column(3), b.column(4)
        for lo, hi, words in tx.word_runs(b.column(2)):
            h, _, least = _minima(words, window, gram)
            if not len(least):
                continue
            known, heat = (np.unique(c.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) for c in (warm, hot))
            every = np.union1d(known, heat)
            if not len(every):
                continue
            at = np.minimum(np.searchsorted(every, least), len(every) - 1)
            keep = np.flatnonzero((every[at] == least) & (least != 0))
            if not len(keep):
                continue
            doc = words.doc_of_word()[keep]
            wide = tx.ngram_hashes(h, window)[keep]
            pos = keep - words.first_word[doc]
            # A window that its own text repeats is settled here; the index gets it once.
            order = np.lexsort((pos, wide, doc))
            fresh = np.concatenate([[True], (wide[order][1:] != wide[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
            size = np.diff(np.append(np.flatnonzero(fresh), len(order)))
            group = np.cumsum(fresh) - 1
            first = order[np.flatnonzero(fresh)][group]
            second = order[np.minimum(np.flatnonzero(fresh) + 1, len(order) - 1)][group]
            twice = np.zeros(len(keep), bool)
            target, once = np.empty(len(keep), np.int64), np.zeros(len(keep), bool)
            twice[order] = size[group] > 1
            target[order] = np.where(order == first, second, first)
            once[order] = fresh
            i = np.flatnonzero(twice)
            if len(i):
                t = pos[target[i]]
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(keep[i]) != 1) | (doc[i][1:] != doc[i][:-1]) | (np.diff(t) != 1)]))
                rows = doc[i][edge] + lo
                none = np.zeros(len(edge), np.int64)
                yield pa.record_batch(
                    [pa.array(none), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(pos[i][edge].astype(np.int32)), pa.array(none > 0), tx.lists(pa.array(none[:0]), none), pa.array(np.diff(np.append(edge, len(i))).astype(np.int32)), pa.array(t[edge].astype(np.int32))],
                    names=names,
                )
            keep, doc, wide, pos = keep[once], doc[once], wide[once], pos[once]
            own = least[keep]
            # Crowded blocks are cut where their content says so: what documents share falls into equal pieces.
            cut = np.isin(own, heat) & (wide % U64(PIECE) == 0)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(keep) != 1) | (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | cut[1:]]))
            n = np.diff(np.append(new, len(keep)))
            rows, a = doc[new] + lo, own[new]
            zero = pa.array(np.zeros(len(new), np.int32))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(pos[new].astype(np.int32)), pa.array(np.isin(a, heat)), tx.lists(pa.array(wide.view(np.int64)), n), zero, zero], names=names)


def longest_matches(kind: np.ndarray, opens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window, how many windows from it on some other place repeats, and that place.

    kind: equal for equal windows; opens: whether a run begins; first: an order
    of the windows, in which equal suffixes are sorted. Suffixes of runs are
    ranked by doubling; a longest match is a neighbour in their order.
    """
    n = len(kind)
    run = np.cumsum(opens) - 1
    end = np.append(np.flatnonzero(opens)[1:], n)[run]
    left = end - np.arange(n)
    ranks, step = [np.unique(kind, return_inverse=True)[1].reshape(-1)], 1
    while step < left.max():
        after = np.minimum(np.arange(n) + step, n - 1)
        second = np.where(left > step, ranks[-1][after] + 1, 0)
        ranks.append(np.unique(ranks[-1] * (n + 1) + second, return_inverse=True)[1].reshape(-1))
        step *= 2
    tie = np.empty(n, np.int64)
    tie[first] = np.arange(n)
    order = np.lexsort((tie, ranks[-1]))
    a, b = order[:-1], order[1:]
    most = np.minimum(left[a], left[b])
    common = np.zeros(n - 1, np.int64)
    for rank in reversed(ranks):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += np.where((common < most) & (rank[x] == rank[y]), step, 0)
        step //= 2
    common = np.minimum(common, most)
    up, down = np.append(0, common), np.append(common, 0)
    size, other = np.empty(n, np.int64), np.empty(n, np.int64)
    size[order] = np.maximum(up, down)
    other[order] = np.where(up >= down, np.append(order[:1], a), np.append(b, order[-1:]))
    return size, other


def greedy(kind: np.ndarray, opens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, place of the match) of the greedy factors of all runs; arguments as in ``longest_matches``."""
    size, other = longest_matches(kind, opens, first)
    at = np.flatnonzero(opens)
    end = np.append(at[1:], len(kind))
    out = []
    while len(at):  # one factor of every run at a time
        out.append(at)
        at = at + np.maximum(size[at], 1)
        at, end = at[at < end], end[at < end]
    at = np.sort(np.concatenate(out))
    return at, size[at], other[at]


def _factors(batches: Iterator[pa.RecordBatch], flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor -> runs of windows that also start elsewhere, with where."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        w = t["windows"].combine_chunks() if isinstance(t["windows"], pa.ChunkedArray) else t["windows"]
        n = np.diff(w.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        wh = w.flatten().to_numpy().view(U64)
        anchor, k1, k2, at = (t[c].to_numpy() for c in ("anchor", "_k1", "_k2", "at"))
        pos = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((wh, anchor[row]))
        new = np.concatenate([[True], (wh[order][1:] != wh[order][:-1]) | (anchor[row][order][1:] != anchor[row][order][:-1])])
        kind = np.empty(len(wh), np.int64)
        kind[order] = np.cumsum(new) - 1
        i = np.flatnonzero((np.bincount(kind) > 1)[kind])  # windows that start elsewhere too
        if not len(i):
            return None
        at, size, ref = greedy(kind[i], np.concatenate([[True], (np.diff(i) != 1) | (np.diff(row[i]) != 0)]), np.lexsort((pos[i], k2[row[i]], k1[row[i]])))
        ks, kr = row[i[at]], row[i[ref]]
        return pa.record_batch(
            [pa.array(k1[ks]), pa.array(k2[ks]), pa.array(pos[i[at]].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(k1[kr]), pa.array(pos[i[ref]].astype(np.int32))],
            names=["_k1", "_k2", "at", "n", "ref", "ref_at"],
        )

    held: list[pa.RecordBatch] = []
    load = 0
    for b in batches:
        held.append(b)
        load += len(b.column(5).flatten())
        if load < flush:
            continue
        anchors = np.concatenate([x.column(0).to_numpy() for x in held])
        cut = int(np.searchsorted(anchors, anchors[-1]))  # sorted: the last group may go on
        if cut:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if (out := solve([whole.slice(0, cut)])) is not None:
                yield out
            held = [whole.slice(cut)]
            load = len(held[0].column(5).flatten())
    if held and sum(len(x) for x in held) and (out := solve(held)) is not None:
        yield out


def _parse(factors: list[dict] | None, n_words: int, window: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Greedy parse: joins runs whose targets go on; returns the covered words and the factors (start, words, ref, ref start)."""
    out: list[list[int]] = []
    for f in sorted(factors or [], key=lambda f: (f["at"], -f["n"])):
        if out and f["at"] == out[-1][0] + out[-1][1] and f["ref"] == out[-1][2] and f["ref_at"] == out[-1][3] + out[-1][1]:
            out[-1][1] += f["n"]
        else:
            out.append([f["at"], f["n"], f["ref"], f["ref_at"]])
    mark = np.zeros(n_words + 1, np.int64)
    for s, n, _, _ in out:
        mark[s] += 1
        mark[min(n_words, s + n + window - 1)] -= 1
    return np.cumsum(mark[:-1]) > 0, [(s, n + window - 1, r, p) for s, n, r, p in out]


REPORT = "n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,words:int,source:long,source_start:int>>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, prefix: str = "_") -> DataFrame:
    """Removes every word under a run of ``window`` words that also starts elsewhere.

    Returns the other columns of docs with ``text_col`` replaced by what is
    kept (its own white space stays), and behind them, their names begun by
    ``prefix``, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and factors (array of start, words, source id, source start). A
    column of docs by such a name is replaced. Ids are integers and may be null
    or repeat.

    Null and empty texts have no words and stay as they are; texts shorter than
    ``window`` words lose nothing; texts of any length are parsed whole. A row
    that is there twice is a copy of itself, so both lose all their windows.
    Of equally long matches a neighbour by id is the source. Windows are judged
    on the input. An empty table gives an empty one.
    """
    report = T._parse_datatype_string(REPORT).fields
    made_names = [prefix + f.name for f in report]
    order = [c for c in docs.columns if c.lower() not in {m.lower() for m in made_names}]
    others = [c for c in order if c != text_col]
    base = _keyed(docs, id_col, text_col, others)
    plain = base.select("_k1", "_k2", "_text")
    key = ["_k1", "_k2"]
    anchors = plain.mapInArrow(tx.tidied(lambda it: _anchors(it, window, gram)), "anchor long, _k1 long, _k2 long, n int")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("_n")).filter("_n > 1").select("anchor", (F.col("_n") > hot).alias("_hot"))
    flags = (
        anchors.select("anchor", *key).join(repeated, "anchor").groupBy(*key)
        .agg(F.collect_list(F.when(~F.col("_hot"), F.col("anchor"))).alias("warm"), F.collect_list(F.when(F.col("_hot"), F.col("anchor"))).alias("hot"))
    )
    blocks = base.join(flags, key).select(*key, "_text", "warm", "hot").mapInArrow(
        tx.tidied(lambda it: _blocks(it, window, gram)), "anchor long, _k1 long, _k2 long, at int, hot boolean, windows array<long>, n int, ref_at int"
    )
    few = (
        blocks.filter("not hot and n = 0").select("anchor", *key, "at", "hot", "windows").repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(tx.tidied(_factors), "_k1 long, _k2 long, at int, n int, ref long, ref_at int")
    )
    # A crowded anchor: equal blocks are one, and only windows of different blocks meet.
    crowd = blocks.filter("hot").select("anchor", *key, "at", "windows").withColumn("_d", F.xxhash64("windows"))
    here = F.struct("_k1", "_k2", "at")
    kinds = crowd.groupBy("anchor", "_d").agg(F.count("*").alias("_n"), F.min(here).alias("_lo"), F.max(here).alias("_hi"), F.first("windows").alias("windows"))
    each = kinds.select("anchor", "_d", "_n", "_lo", "_hi", F.posexplode("windows").alias("_i", "_w"))
    moved = lambda s: F.struct(s["_k1"].alias("_k1"), s["_k2"].alias("_k2"), (s["at"] + F.col("_i")).alias("at"))
    seen = each.groupBy("anchor", "_w").agg(F.sum("_n").alias("_m"), F.min(moved(F.col("_lo"))).alias("_first"), F.max(moved(F.col("_hi"))).alias("_last")).filter("_m > 1")
    solved = each.select("anchor", "_d", "_i", "_w").join(seen, ["anchor", "_w"]).groupBy("anchor", "_d").agg(F.collect_list(F.struct("_i", "_first", "_last")).alias("_s"))

    def factor(x):
        at = F.col("at") + x["_i"]
        own = (x["_first"]["_k1"] == F.col("_k1")) & (x["_first"]["_k2"] == F.col("_k2")) & (x["_first"]["at"] == at)
        return F.struct(at.alias("at"), F.lit(1).alias("n"), F.when(own, x["_last"]["_k1"]).otherwise(x["_first"]["_k1"]).alias("ref"), F.when(own, x["_last"]["at"]).otherwise(x["_first"]["at"]).alias("ref_at"))

    lots = crowd.select("anchor", "_d", *key, "at").join(solved, ["anchor", "_d"]).select(*key, F.transform("_s", factor).alias("_a"))
    alone = few.select(*key, F.array(F.struct("at", "n", "ref", "ref_at")).alias("_a"))
    inside = blocks.filter("n > 0").select(*key, F.array(F.struct("at", "n", F.col("_k1").alias("ref"), "ref_at")).alias("_a"))
    found = alone.unionByName(lots).unionByName(inside).groupBy(*key).agg(F.flatten(F.collect_list("_a")).alias("_f"))

    schema = T.StructType([*(docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in order), *(T.StructField(m, f.dataType) for m, f in zip(made_names, report))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, factors, rest = b.column(0), b.column(1).to_pylist(), b.column(2)
            kept, n_words, n_removed, sha, spans = [], [], [], [], []
            row = 0
            for lo, hi, words in tx.word_runs(text):
                raw = words.buf.tobytes()
                for d in range(hi - lo):
                    i, j = int(words.first_word[d]), int(words.first_word[d + 1])
                    own = raw[words.offs[d] : words.offs[d + 1]]
                    drop, made = _parse(factors[row], j - i, window) if factors[row] else (None, [])
                    n_words.append(j - i)
                    if drop is None or not drop.any():
                        n_removed.append(0)
                        joined = b" ".join(own.split())
                        kept.append(own.decode() if text[row].is_valid else None)
                    else:
                        n_removed.append(int(drop.sum()))
                        joined = b" ".join([raw[s:e] for s, e in zip(words.start[i:j][~drop].tolist(), words.end[i:j][~drop].tolist())])
                        out, at = [], int(words.offs[d])
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8))).reshape(-1, 2)
                        for s, e in edges.tolist():  # a removed span takes the white space after it
                            out.append(raw[at : words.start[i + s]])
                            at = int(words.start[i + e]) if i + e < j else int(words.offs[d + 1])
                        out.append(raw[at : words.offs[d + 1]])
                        kept.append(b"".join(out).decode())
                    sha.append(hashlib.sha256(joined).hexdigest())
                    spans.append([dict(zip(("start", "words", "source", "source_start"), m)) for m in made])
                    row += 1
            cols = {c: rest.field(f"c{k}") for k, c in enumerate(others)}
            cols[text_col] = pa.array(kept, pa.string())
            made_type = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
            extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, made_type)]
            yield pa.record_batch([*(cols[c] for c in order), *extra], names=schema.fieldNames())

    return base.join(found, key, "left").select("_text", "_f", "_rest").mapInArrow(tx.tidied(finish), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, **more) -> DataFrame:
    """docs, their own columns, without repeated passages; ``size_col`` takes the characters of texts that lost words."""
    mark = free("", docs.columns)
    out = substring_dedup(docs, id_col, text_col, prefix=mark, **more)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    if size_col in docs.columns:
        size = F.when(F.col(f"{mark}n_removed") > 0, F.length(F.col(f"`{text_col}`")).cast(docs.schema[size_col].dataType)).otherwise(F.col(f"`{size_col}`"))
        cols[docs.columns.index(size_col)] = size.alias(size_col)
    return out.select(*cols)
