"""Vectorised word and n-gram hashing over Arrow string columns.

All functions work on the UTF-8 buffer of a column, never row by row. A word
is a maximal run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in runs of about this many bytes, which bounds memory.
CHUNK_BYTES = 1 << 19

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_B1 = 0x9E3779B97F4A7C15
_B2 = 0xD6E8FEB86659FD93
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n + (n >> 3), 1 << 17)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 2**64), U64)
        up[0] = down[0] = 1
        have = _tables[base] = (np.cumprod(up), np.cumprod(down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def one_thread() -> None:
    """Keeps numpy's matrix products to one thread: Spark runs a task on every core already."""
    with contextlib.suppress(OSError, AttributeError):
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
        for path in paths:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    break


def tidied(run: Callable) -> Callable:
    """A batch function that keeps to one thread and gives the memory of its worker back when its task ends; workers live on."""

    def go(batches):
        one_thread()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return go


class Words:
    """Words of a run of texts: byte bounds, 64-bit hashes, first word of each text.

    cuts: bytes before which a word ends, whether or not white space is there.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None):
        n = len(buf)
        self.buf, self.offs, self.n_docs = buf, offs, len(offs) - 1
        inside = ~_WS[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        if cuts is not None:
            edge[:n] |= cuts
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.start, offs)
        self.n = len(self.start)

    def hashes(self) -> np.ndarray:
        up, down = _powers(_B1, len(self.buf))
        value = _BYTE[self.buf] * up[: len(self.buf)]
        total = np.cumsum(value)
        h = (total[self.end - 1] - total[self.start] + value[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(U64) * U64(_B2))

    def counts(self) -> np.ndarray:
        return np.diff(self.first_word)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def words_left(self) -> np.ndarray:
        """For each word, how many words its text still has from there on."""
        return np.repeat(self.first_word[1:], self.counts()) - np.arange(self.n)


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (length n-k+1, order matters)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = _powers(_B2, n)
    value = h * up[:n]
    total = np.cumsum(value)
    span = total[k - 1 :].copy()
    span[1:] -= total[: n - k]
    return mix(span * down[: n - k + 1])


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of w values, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null rows get no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


def doc_runs(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about limit bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_runs(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for runs of rows of a string column."""
    buf, offs = string_buffers(col)
    for lo, hi in doc_runs(offs, limit):
        yield lo, hi, Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Consecutive values gathered into lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
