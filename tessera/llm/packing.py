"""Packing of documents into token sequences by bin completion branch-and-bound.

Documents are tokenised, closed by an end id and, only if longer than a
sequence, cut. Which sequence a piece enters depends on its length alone, so
the problem is the histogram of lengths: as many rows as a sequence has tokens
at most, whatever the corpus holds. It is counted by Spark, solved once, and
the solution is a table from (length, number among the pieces of that length)
to places. Pieces are numbered by Spark: each length is dealt out in slices by
hash, numbered inside a slice, and slices begin where those before them end.
How the table is partitioned changes nothing in how many sequences are used.

Bin completion: the largest length left gets a sequence, and the ways to fill
the room around it are enumerated by falling length, those without waste
first. Fillings that leave room for a further piece, or that another filling
dominates (its pieces can hold theirs), are dropped, as are those that waste
more than an improvement on the incumbent can afford. A filling is applied as
often as the counts allow, then also once. A branch is pruned when the
sequences used plus the bound on the rest (tokens left over the capacity, or
pieces over half of it) reach the incumbent, which is the best-fit decreasing
solution at first. ``effort`` bounds the steps of the whole search; beyond it
the incumbent stands.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textops as tx
from .cluster import checkpoint
from .columns import free
from .tokens import default_path, encode_column

#: Tokens of a sequence; end id; steps of the search; pieces of a slice; pieces of a filling up to which dominance is tested.
CAPACITY, END, EFFORT, SLICE, TESTED = 2048, 0, 1_000_000, 5_000, 8
Filling = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document.

    Null and empty texts are one piece, the end id alone. A text of any length
    is cut into pieces. Ids may be null, repeat or be of any type; repeated
    rows give repeated pieces. Other columns are left out.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in encode_column(b.column(1), path):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
            yield pa.record_batch(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return own.mapInArrow(tx.tidied(run), f"doc_id {own.schema['i'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of the counts by length needs."""
    sizes = np.arange(len(counts))
    return max(-(-int((counts * sizes).sum()) // capacity), int(counts[capacity // 2 + 1 :].sum()))


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Fillings and how often each is used; every filling takes, in turn, the largest piece that still fits."""
    left = counts.copy()
    out: list[Filling] = []
    top = len(left) - 1
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        own, room = [], capacity
        while room:
            fit = np.flatnonzero(left[1 : min(room, top) + 1])
            if not len(fit):
                break
            size = int(fit[-1]) + 1
            own.append(size)
            left[size] -= 1
            room -= size
        use = np.bincount(own, minlength=len(left))
        some = use > 0
        more = int((left[some] // use[some]).min())
        left -= use * more
        out.append((tuple(own), 1 + more))


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b, in groups, fit into the pieces of a."""
    if sum(b) > sum(a):
        return False
    room = sorted(a, reverse=True)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        for k in range(len(room)):
            if room[k] >= b[i] and (k == 0 or room[k] != room[k - 1]):
                room[k] -= b[i]
                if place(i + 1):
                    room[k] += b[i]
                    return True
                room[k] += b[i]
        return False

    return place(0)


class Effort:
    """Steps that a search may still take."""

    def __init__(self, left: int):
        self.left = left

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(left: np.ndarray, room: int, least: int, most: int, effort: Effort) -> Iterator[tuple[int, ...]]:
    """Fillings of the room with a waste of ``least`` to ``most`` that no piece left fits into, by falling length."""
    sizes = (np.flatnonzero(left[1 : room + 1]) + 1)[::-1].tolist()
    falls = [-s for s in sizes]
    have = {s: int(left[s]) for s in sizes}
    own: list[int] = []
    rest = room
    stack = [0]
    fresh = True
    while stack:
        if fresh:  # a new partial filling
            fresh = False
            if rest == 0 or not any(have[s] for s in reversed(sizes[bisect_left(falls, -rest) :])):
                if least <= rest <= most:
                    yield tuple(own)
                stack[-1] = len(sizes)
        k = max(stack[-1], bisect_left(falls, -rest))
        while k < len(sizes) and not have[sizes[k]] and effort.spend():
            k += 1
        if not effort.spend():
            return
        if k < len(sizes):
            stack[-1] = k + 1
            own.append(sizes[k])
            have[sizes[k]] -= 1
            rest -= sizes[k]
            stack.append(k)
            fresh = True
        else:
            stack.pop()
            if own:
                have[own[-1]] += 1
                rest += own.pop()


def undominated(options: Iterator[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
    """Fillings that none before them dominates; long ones are not tested, which only makes the search wider."""
    kept: list[tuple[int, ...]] = []
    for f in options:
        if len(f) <= TESTED:
            if any(dominates(k, f) for k in kept):
                continue
            kept.append(f)
        yield f


def complete(counts: np.ndarray, capacity: int, effort: int = EFFORT) -> list[Filling]:
    """The best packing found for the counts by length (index 0 unused)."""
    best = best_fit_decreasing(counts, capacity)
    used = sum(n for _, n in best)
    floor = bound(counts, capacity)
    budget = Effort(effort)
    size = np.arange(len(counts))
    # Each level: counts left, fillings so far, sequences so far, fillings still to try, one that may also be applied once.
    stack: list[list] = []

    def push(left: np.ndarray, made: list[Filling], n: int) -> None:
        nonlocal best, used
        some = np.flatnonzero(left)
        if not len(some):
            if n < used:
                best, used = made, n
            return
        if n + bound(left, capacity) >= used:
            return
        top = int(some[-1])
        waste = (used - 1 - n) * capacity - int((left * size).sum())
        rest = left.copy()
        rest[top] -= 1
        room = capacity - top
        ways = itertools.chain(fillings(rest, room, 0, 0, budget), fillings(rest, room, 1, waste, budget) if waste else ())
        stack.append([left, made, n, ((top, *f) for f in undominated(ways)), None])

    push(counts, [], 0)
    while stack and budget.left > 0 and used > floor:
        left, made, n, ways, again = level = stack[-1]
        if again is not None:
            level[4] = None
            push(left - np.bincount(again, minlength=len(left)), [*made, (again, 1)], n + 1)
            continue
        own = next(ways, None)
        if own is None:
            stack.pop()
            continue
        use = np.bincount(own, minlength=len(left))
        some = use > 0
        times = int((left[some] // use[some]).min())
        if times > 1:
            level[4] = own
        push(left - use * times, [*made, (own, times)], n + times)
    return best


def slots(solution: list[Filling]) -> np.ndarray:
    """Rows (length, first number, pieces of a filling, first sequence, offset), sorted: where pieces of a length go from that number on.

    A filling that is used k times uses up a length of the histogram, so rows
    are bounded by the lengths and the different sizes that fit in a sequence.
    """
    out, seen, base = [], Counter(), 0
    for own, times in solution:
        at = 0
        for size, k in sorted(Counter(own).items(), reverse=True):
            out.append((size, seen[size], k, base, at))
            seen[size] += k * times
            at += size * k
        base += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def place(table: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces, each the ``number``-th of its length."""
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (table[:, 0] << 48) + table[:, 1]
    _, first, per, base, at = table[np.searchsorted(key, (length.astype(np.int64) << 48) + number, side="right") - 1].T
    turn = number - first
    return base + turn // per, at + length * (turn % per)


def pack(made: DataFrame, capacity: int = CAPACITY, effort: int = EFFORT, slice_rows: int = SLICE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a column length (1 to capacity).

    An empty table gives an empty one; equal rows are separate pieces. Columns
    sequence_id and offset of the input are replaced, all others kept.
    """
    made = checkpoint(made.drop("sequence_id", "offset"))
    names = made.columns
    part, number, before, size = (free(s, names) for s in ("slice", "number", "before", "size"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").count().collect():  # a row per length
        counts[r[0]] = r[1]
    sent = made.sparkSession.sparkContext.broadcast(slots(complete(counts, capacity, effort)))
    # Slices by length: only lengths of many pieces have several.
    cut = made.sparkSession.createDataFrame([(k, int(-(-n // slice_rows))) for k, n in enumerate(counts.tolist()) if n] or [(0, 1)], f"`{size}` long, `{before}` int")
    deal = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    keyed = made.join(F.broadcast(cut), F.col("length") == F.col(size)).withColumn(part, F.pmod(deal, F.col(before)).cast("int")).drop(size, before)
    whole = W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = keyed.groupBy("length", part).count().select("length", part, F.coalesce(F.sum("count").over(whole), F.lit(0)).alias(before))
    numbered = keyed.withColumn(number, F.row_number().over(W.partitionBy("length", part).orderBy(deal, *[F.col(f"`{c}`") for c in names])) - 1)
    numbered = numbered.join(starts, ["length", part]).select(*[F.col(f"`{c}`") for c in names], (F.col(number) + F.col(before)).alias(number))
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = place(sent.value, b.column(at).to_numpy(), b.column(len(names)).to_numpy())
            yield pa.record_batch([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return numbered.mapInArrow(tx.tidied(run), f"{types}, sequence_id long, offset long")
