"""Cross-tokenizer alignment: which ids of two vocabularies stand for the same bytes, corpus-wide.

Each text is encoded by a byte-level BPE (A) and a sentence-piece model (B).
Byte offsets where tokens of both end cut it into groups, and all A-B pairs of
a group are links. A pair's count is the number of documents that hold it
linked; the best pairs of an A id are those of its highest count.

Counts are dense matrices in stripes of A ids (id modulo the number of
stripes, so frequent ids, which are neighbours, are spread). Pairs are counted
within a run of documents before they are shuffled, and np.add.at adds them to
the block of their stripe, whose row maxima tell the best. Links are
partitioned by stripe too, with a share of the runs each, so a task scores them
against one block at a time; a block's size is set by the two vocabularies, not
by the data.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textops as tx
from .cluster import shared_dir
from .columns import free

STRIPES = 256
#: Bytes of texts whose links are gathered together (one text at least).
RUN = 2 << 20
#: Links of a row at most: what a batch of rows takes stays small.
ROW = 512
#: Runs that one task scores against a stripe.
SHARE = 256
_FIRST = np.uint64(0x5851F42D4C957F2D)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Chunks:
    """A run of texts cut before spaces and line ends behind other characters, which no token of either vocabulary crosses."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        before = np.zeros(n, np.uint8)
        before[1:] = buf[:-1]
        cut = ((buf == 0x20) | (buf == 0x0A)) & (before > 0x20) & (before != 0x7F)
        # White space beyond ASCII before a space is one run with it, so what may be its last byte cuts nothing.
        for i in (1, 2):
            lead = np.zeros(n, np.uint8)
            lead[i + 1 :] = buf[: -i - 1]
            cut &= ~((before >= 0x80) & (np.isin(lead, (0xC2,)) if i == 1 else np.isin(lead, (0xE1, 0xE2, 0xE3))))
        full = offs[:-1][np.diff(offs) > 0]
        cut[(offs[1:] - 1)[np.diff(offs) > 0]] = False  # a last space stays with what is before it
        cut[full] = True
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], n)[: len(self.start)]
        self.first = np.searchsorted(self.start, offs)
        self.opens = np.isin(self.start, full)
        up, down = tx._powers(tx._B1, n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx._BYTE[buf] * up[:n])])
        h = tx.mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(tx._B2))
        self.hashes = np.where(self.opens, h ^ _FIRST, h)


class Pair:
    """Both tokenizers, and what they make of each chunk met so far: counts, the groups as text, the linked pairs."""

    known: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        char = _byte_of_char()
        vocab = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(char[c] for c in entry) if all(c in char for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.width, self.most = len(self.b_bytes), most
        self.a_table, self.b_table = self._table(self.a_bytes), self._table(self.b_bytes)
        inner = any("▁" in p.lstrip("▁") or "\n" in p for p in map(self.b.id_to_piece, range(self.width)))
        assert not inner, "a piece goes on behind a space or a line end: texts can't be cut there"
        self.clear()

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries' bytes, where each begins and its size."""
        size = np.array([len(e) for e in entries])
        return np.frombuffer(b"".join(entries) + b"\0", np.uint8), np.cumsum(size) - size, size

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Pair:
        if paths not in cls.known:
            cls.known[paths] = cls(*paths)
        return cls.known[paths]

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.groups: list[bytes] = []
        self.sums = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, 1 if the bytes differ
        self.pairs, self.times, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, keys: list[int], chunks: list[str]) -> None:
        """Encodes chunks and keeps what ``_encode`` needs of each: all of them at once, token by token only in large groups."""
        sides = []
        encoded = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # The model adds a space to what it gets: that of the chunk, or one that is taken off before a line end.
        pieces = [y if c[0] == " " else y[1:] for c, y in zip(chunks, self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1))]
        raw = np.frombuffer("".join(chunks).encode(), np.uint8)
        chunk_size = np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks))
        end_of_chunk = np.cumsum(chunk_size)
        bad = np.zeros(len(chunks), bool)
        for lists, (table, first, size) in ((encoded, self.a_table), (pieces, self.b_table)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            chunk = np.repeat(np.arange(len(chunks)), n)
            total = np.concatenate([[0], np.cumsum(size[ids])])
            ends = np.concatenate([[0], np.cumsum(n)])
            wrong = np.diff(total[ends]) != chunk_size
            # Bytes of chunks of the right length, held against the text.
            t = np.flatnonzero(~wrong[chunk])
            start = total[:-1][t] - total[ends[chunk[t]]] + (end_of_chunk - chunk_size)[chunk[t]]
            at = np.arange(int(size[ids[t]].sum())) - np.repeat(np.cumsum(size[ids[t]]) - size[ids[t]], size[ids[t]])
            differs = table[np.repeat(first[ids[t]], size[ids[t]]) + at] != raw[np.repeat(start, size[ids[t]]) + at]
            if differs.any():
                wrong[np.repeat(chunk[t], size[ids[t]])[differs]] = True
            bad |= wrong
            sides.append((ids, chunk, total[1:] - np.repeat(total[ends[:-1]], n)))
        (a, chunk_a, end_a), (b, chunk_b, end_b) = ((x[~bad[c]], c[~bad[c]], e[~bad[c]]) for x, c, e in sides)
        span = int(chunk_size.max(initial=0)) + 1
        code_a, code_b = chunk_a * span + end_a, chunk_b * span + end_b
        both = np.intersect1d(code_a, code_b, assume_unique=True)  # the end of a group on both sides
        of_group = both // span
        last_a, last_b = np.searchsorted(code_a, both), np.searchsorted(code_b, both)
        n_a, n_b = np.diff(np.append(-1, last_a)), np.diff(np.append(-1, last_b))
        first_a, first_b = last_a + 1 - n_a, last_b + 1 - n_b
        # Decimal ids in the order of the text: a group's A tokens, its B tokens.
        place_a = np.arange(len(a)) + np.repeat(first_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, n_b)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        digits = (ids[:, None] // 10 ** np.arange(6, -1, -1)) % 10
        shown = np.maximum.accumulate(digits > 0, axis=1)
        shown[:, -1] = True
        grid = np.concatenate([(digits + 48).astype(np.uint8), mark[:, None]], axis=1)
        keep = np.concatenate([shown, np.ones((len(ids), 1), bool)], axis=1)
        said = grid[keep].tobytes()
        said_end = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
        count = lambda x, w=None: np.bincount(x, weights=w, minlength=len(chunks)).astype(np.int64)
        tokens_a, tokens_b = count(chunk_a), count(chunk_b)
        text_end = said_end[np.cumsum(tokens_a + tokens_b)]
        # Links: small groups in one step, large ones by their different ids.
        links = n_a * n_b
        small = links <= 4096
        g = np.flatnonzero(small)
        k = np.arange(int(links[g].sum())) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
        width = np.repeat(n_b[g], links[g])
        pairs = a[np.repeat(first_a[g], links[g]) + k // width] * self.width + b[np.repeat(first_b[g], links[g]) + k % width]
        chunk_of, times = np.repeat(of_group[g], links[g]), np.ones(len(pairs), np.int64)
        more = [[chunk_of], [pairs], [times]]
        for g in np.flatnonzero(~small).tolist():
            x, many_x = np.unique(a[first_a[g] : last_a[g] + 1], return_counts=True)
            y, many_y = np.unique(b[first_b[g] : last_b[g] + 1], return_counts=True)
            for part, new in zip(more, (np.full(len(x) * len(y), of_group[g]), (x[:, None] * self.width + y).ravel(), (many_x[:, None] * many_y).ravel())):
                part.append(new)
        chunk_of, pairs, times = map(np.concatenate, more)
        order = np.argsort(chunk_of, kind="stable")
        base = len(self.groups)
        self.at.update(zip(keys, range(base, base + len(keys))))
        ends = text_end.tolist()
        self.groups.extend(said[s:e] for s, e in zip([0, *ends[:-1]], ends))
        sums = np.column_stack([tokens_a, tokens_b, count(of_group), np.zeros(len(chunks), np.int64), bad])
        np.add.at(sums[:, 3], of_group, links)
        self.sums = np.concatenate([self.sums, sums.astype(np.int64)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs[order]]), np.concatenate([self.times, times[order]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count(chunk_of))])

    def chunk_ids(self, c: Chunks, buf: np.ndarray) -> np.ndarray:
        if len(self.groups) > self.most:
            self.clear()
        u, first, back = np.unique(c.hashes, return_index=True, return_inverse=True)
        new = [k for k, h in enumerate(u.tolist()) if h not in self.at]
        raw = memoryview(buf)
        for i in range(0, len(new), 10_000):
            k = np.array(new[i : i + 10_000])
            f = first[k]
            self.learn(u[k].tolist(), [(" " if o else "") + bytes(raw[s:e]).decode() for s, e, o in zip(c.start[f].tolist(), c.end[f].tolist(), c.opens[f].tolist())])
        return np.fromiter((self.at[h] for h in u.tolist()), np.int64, len(u))[back.reshape(-1)]


def linked(pair: Pair, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of a run, one entry for each document and pair, unordered; ids: chunks of the documents."""
    span = len(pair.groups) + 1
    code, n = np.unique(doc * span + ids, return_counts=True)
    d, c = code // span, code % span
    size = pair.first[c + 1] - pair.first[c]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - pair.first[c], size)
    return np.repeat(d, size), pair.pairs[at], pair.times[at] * np.repeat(n, size)


def _column(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    ends = np.append(edge, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _encode(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], stripes: int, id_type: pa.DataType, most: int, links_of_row: int) -> Iterator[pa.RecordBatch]:
    """Documents -> a row for each (stripe -1), and rows of links by run and stripe: A row and B id as key, documents of a key, their places in the run, their links."""
    pair = Pair.of(paths)
    run = TaskContext.get().partitionId() << 32
    names = ["run", "stripe", "place", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts", "docs", "links"]
    for b in batches:
        buf, offs = tx.string_buffers(b.column(1))
        for lo, hi in tx.doc_runs(offs, most):
            own, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            c = Chunks(own, o)
            ids = pair.chunk_ids(c, own)
            total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(pair.sums[ids], axis=0)])[c.first]
            sums = np.diff(total, axis=0)
            good = (sums[:, 4] == 0) & (sums[:, 0] > 0)
            sums[~good] = 0
            said = [hashlib.sha256(b"".join([pair.groups[i] for i in ids[c.first[k] : c.first[k + 1]].tolist()])[:-1]).hexdigest() if g else "" for k, g in enumerate(good)]
            n = hi - lo
            none = pa.nulls(n, pa.binary())
            yield pa.record_batch([pa.array(np.full(n, run)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n, dtype=np.int32)), b.column(0).slice(lo, n), *(pa.array(sums[:, k]) for k in range(4)), pa.array(said, pa.string()), none, none, none, none], names=names)
            of_chunk = np.repeat(np.arange(n), np.diff(c.first))
            keep = good[of_chunk]
            doc, both, links = linked(pair, ids[keep], of_chunk[keep])
            a, b_id = both // pair.width, both % pair.width
            stripe, key = a % stripes, a // stripes * pair.width + b_id
            order = np.lexsort((doc, key, stripe))
            doc, key, stripe, links = doc[order], key[order], stripe[order], links[order]
            if len(doc):
                # Chunks of a document may hold the same pair.
                one = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(key) != 0) | (np.diff(stripe) != 0)]))
                doc, key, stripe, links = doc[one], key[one], stripe[one], np.add.reduceat(links, one)
                opens = np.concatenate([[True], np.diff(stripe) != 0])
                i = np.arange(len(doc))
                opens |= (i - np.maximum.accumulate(np.where(opens, i, 0))) % links_of_row == 0
                row = np.flatnonzero(opens)
                edge = np.flatnonzero(opens | np.concatenate([[True], np.diff(key) != 0]))
                counts = np.diff(np.append(edge, len(doc))).astype(np.int32)
                at = np.searchsorted(edge, row)
                empty = [pa.nulls(len(row), t) for t in (pa.int32(), id_type, *[pa.int64()] * 4, pa.string())]
                yield pa.record_batch([pa.array(np.full(len(row), run)), pa.array(stripe[row].astype(np.int32)), *empty, _column(key[edge].astype(np.int32), at), _column(counts, at), _column(doc.astype(np.int32), row), _column(links, row)], names=names)
            run += 1


def _ints(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    buf, offs = tx.string_buffers(col)
    return np.frombuffer(buf.tobytes(), kind), np.diff(offs) // np.dtype(kind).itemsize


def _summed(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(stripe, keys, counts) -> the same, added up within the task."""

    def flush(held):
        stripe, key, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key, stripe))
        stripe, key, n = stripe[order], key[order], n[order]
        one = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(stripe) != 0)]))
        return stripe[one], key[one], np.add.reduceat(n, one)

    def rows(stripe, key, n):
        opens = np.concatenate([[True], np.diff(stripe) != 0])
        i = np.arange(len(key))
        opens |= (i - np.maximum.accumulate(np.where(opens, i, 0))) % ROW == 0
        row = np.flatnonzero(opens)
        return pa.record_batch([pa.array(stripe[row].astype(np.int32)), _column(key.astype(np.int32), row), _column(n.astype(np.int64), row)], names=["stripe", "keys", "counts"])

    held, load = [], 0
    for b in batches:
        key, size = _ints(b.column(1), np.int32)
        n, _ = _ints(b.column(2), np.int32)
        if not len(key):
            continue
        held.append((np.repeat(b.column(0).to_numpy(), size), key, n.astype(np.int64)))
        load += len(key)
        if load > most:
            held = [flush(held)]
            if (load := len(held[0][0])) > most // 2:
                yield rows(*held[0])
                held, load = [], 0
    if held:
        yield rows(*flush(held))


def _tallied(batches: Iterator[pa.RecordBatch], width: int, height: int) -> Iterator[pa.RecordBatch]:
    """(stripe, keys, counts) sorted by stripe -> (stripe, keys, counts, best: 1 if its A id has no greater count) over the whole corpus."""
    block, now = np.zeros((height, width), np.int64), None

    def rows():
        flat = block.reshape(-1)
        key = np.flatnonzero(flat)
        best = (flat[key] == block.max(axis=1)[key // width]).astype(np.int8)
        row = np.arange(0, len(key), 8 * ROW)
        return pa.record_batch([pa.array(np.full(len(row), now, np.int32)), _column(key.astype(np.int32), row), _column(flat[key], row), _column(best, row)], names=["stripe", "keys", "counts", "best"])

    for b in batches:
        stripes = b.column(0).to_numpy()
        key, size = _ints(b.column(1), np.int32)
        n, _ = _ints(b.column(2), np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        for r, s in enumerate(stripes.tolist()):
            if s != now:
                if now is not None:
                    yield rows()
                    block[:] = 0
                now = s
            np.add.at(block.reshape(-1), key[ends[r] : ends[r + 1]], n[ends[r] : ends[r + 1]])
    if now is not None:
        yield rows()


def _added(run: np.ndarray, doc: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n and s added up for each document of a run, sorted."""
    order = np.lexsort((doc, run))
    run, doc, n, s = run[order], doc[order], n[order], s[order]
    one = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(doc) != 0)]))
    return run[one], doc[one], np.add.reduceat(n, one), np.add.reduceat(s, one)


def _by_run(run: np.ndarray, doc: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """One row a run: its documents' places and sums."""
    row = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0]))
    return pa.record_batch([pa.array(run[row]), _column(doc.astype(np.int32), row), _column(n, row), _column(s, row)], names=["run", "places", "bests", "sums"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs, sorted by run -> (run, place, n_best, count_sum) of each document."""

    def rows(held):
        run, doc, n, s = _added(*(np.concatenate(x) for x in zip(*held)))
        return pa.record_batch([pa.array(run), pa.array(doc), pa.array(n), pa.array(s)], names=["run", "place", "n_best", "count_sum"])

    held, now = [], None
    for b in batches:
        runs = b.column(0).to_numpy()
        (doc, size), (n, _), (s, _) = _ints(b.column(1), np.int32), _ints(b.column(2), np.int64), _ints(b.column(3), np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        for r, run in enumerate(runs.tolist()):
            if held and run != now:
                yield rows(held)
                held = []
            now, k = run, slice(ends[r], ends[r + 1])
            held.append((np.full(size[r], run), doc[k], n[k], s[k]))
    if held:
        yield rows(held)


def _scored(batches: Iterator[pa.RecordBatch], width: int, height: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A stripe's block (kind 0), then its links of a share of the runs (kind 1) -> rows of runs with their documents' sums, added up within the task."""
    count, best, now = np.zeros(height * width, np.int64), np.zeros(height * width, bool), None
    held, load = [], 0

    def flush():
        run, doc, n, s = (np.concatenate(x) for x in zip(*held))
        return _added(run, doc, n, s)

    def rows(x):
        return _by_run(*x)

    for b in batches:
        stripes, kinds, runs = (b.column(k).to_numpy() for k in (0, 2, 3))
        key, size = _ints(b.column(4), np.int32)
        raw, starts = tx.string_buffers(b.column(5))
        doc, docs = _ints(b.column(6), np.int32)
        link, _ = _ints(b.column(7), np.int64)
        flag, flags = _ints(b.column(8), np.int8)
        k_end, d_end, f_end = (np.concatenate([[0], np.cumsum(x)]) for x in (size, docs, flags))
        for r, s in enumerate(stripes.tolist()):
            keys = key[k_end[r] : k_end[r + 1]]
            own = raw[starts[r] : starts[r + 1]].tobytes()
            if kinds[r] == 0:
                if s != now:
                    count[:], best[:], now = 0, False, s
                count[keys] = np.frombuffer(own, np.int64)
                best[keys] = flag[f_end[r] : f_end[r + 1]] != 0
                continue
            times, d = np.frombuffer(own, np.int32), slice(d_end[r], d_end[r + 1])
            held.append((np.full(d.stop - d.start, runs[r]), doc[d], link[d] * np.repeat(best[keys], times), link[d] * np.repeat(count[keys], times)))
            load += d.stop - d.start
            if load > most:
                held = [flush()]
                if (load := len(held[0][0])) > most // 2:
                    yield rows(held[0])
                    held, load = [], 0
    if held:
        yield rows(flush())


REPORT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, stripes: int = STRIPES, run: int = RUN, row: int = ROW, share: int = SHARE) -> DataFrame:
    """The id and, for each document, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Special tokens' names inside texts are plain text. A null or empty text,
    and one whose tokens of either vocabulary do not join to its bytes, has no
    tokens: zeros and an empty digest; it counts for no pair. Each row is a
    document, so repeated rows count twice; ids may be null, repeated and of
    any type. Ties for the best count are all best. Other columns of docs are
    not read; where the id's name is one of the report's, the report's names
    begin with an underscore. An empty table gives an empty one. A text is
    encoded whole, whatever its length, in one task.
    """
    spark, paths = docs.sparkSession, paths or default_paths()
    folder = f"{shared_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    pair = Pair.of(paths)
    width, height = pair.width, -(-len(pair.a_bytes) // stripes)
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    kind = base.schema["_id"].dataType
    id_type = to_arrow_type(kind)
    fields = T._parse_datatype_string("run long, stripe int, place int").fields + [T.StructField("_id", kind)]
    fields += T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, counts binary, docs binary, links binary").fields
    base.mapInArrow(tx.tidied(lambda it: _encode(it, paths, stripes, id_type, run, row)), T.StructType(fields)).write.parquet(f"{folder}/links")
    written = spark.read.schema(T.StructType(fields)).parquet(f"{folder}/links")
    links = written.filter("stripe >= 0")

    counted = links.select("stripe", "keys", "counts").mapInArrow(tx.tidied(_summed), "stripe int, keys binary, counts binary")
    counted = counted.repartition("stripe").sortWithinPartitions("stripe")
    counted.mapInArrow(tx.tidied(lambda it: _tallied(it, width, height)), "stripe int, keys binary, counts binary, best binary").write.parquet(f"{folder}/counts")
    totals = spark.read.schema("stripe int, keys binary, counts binary, best binary").parquet(f"{folder}/counts")

    shares = max(1, -(-written.filter("place = 0").count() // share))
    nothing = F.lit(None).cast("binary")
    of_run = F.pmod(F.xxhash64("run"), F.lit(shares)).cast("int")
    blocks = totals.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("run"), "keys", "counts", nothing.alias("docs"), nothing.alias("links"), "best")
    scored = blocks.unionByName(links.select("stripe", of_run.alias("share"), F.lit(1).alias("kind"), "run", "keys", "counts", "docs", "links", nothing.alias("best")))
    scored = scored.repartition("stripe", "share").sortWithinPartitions("stripe", "share", "kind").mapInArrow(tx.tidied(lambda it: _scored(it, width, height)), "run long, places binary, bests binary, sums binary")
    sums = scored.repartition("run").sortWithinPartitions("run").mapInArrow(tx.tidied(_gathered), "run long, place int, n_best long, count_sum long")
    out = written.filter("stripe = -1").select("run", "place", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ["run", "place"], "left").fillna(0, ["n_best", "count_sum"])
    made = [f.name for f in T._parse_datatype_string(REPORT).fields]
    mark = free("", [id_col]) if id_col.lower() in made else ""
    return out.select(F.col("_id").alias(id_col), *(F.col(m).alias(mark + m) for m in made))
