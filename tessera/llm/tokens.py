"""Token ids of whole texts, with each distinct piece of text tokenised once per worker.

The vocabulary is a word-level BPE whose pattern never matches across white
space, nor from an ASCII letter into an ASCII sign, and whose normaliser
lower-cases. So the ids of a text are those of its pieces in a row, and a
worker keeps the ids of the pieces it has met. Texts that hold the start of a
special token's name are only cut at white space and keep their case.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textops as tx

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "|"]] = True
_known: dict[str, PieceCache] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceCache:
    """Ids of pieces by 64-bit hash; emptied when it holds too many."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, key: np.ndarray, pieces: list[str]) -> None:
        """key: sorted and new."""
        found = [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        where = np.searchsorted(self.key, key)
        self.key, self.at, self.size = (np.insert(old, where, new) for old, new in ((self.key, key), (self.at, at), (self.size, size)))
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, words: tx.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        if not words.n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        u, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.key) > self.most:
            self.clear()
        at = np.searchsorted(self.key, u)
        new = np.ones(len(u), bool)
        if len(self.key):
            new = self.key[np.minimum(at, len(self.key) - 1)] != u
        if new.any():
            raw = words.buf.tobytes()
            f = first[new]
            self.learn(u[new], [raw[s:e].decode() for s, e in zip(words.start[f].tolist(), words.end[f].tolist())])
            at = np.searchsorted(self.key, u)
        begin, size = self.at[at][back], self.size[at][back]
        total = np.cumsum(size)
        return self.ids[np.repeat(begin - (total - size), size) + np.arange(int(total[-1]))], size


def encode_column(col: pa.Array, path: str):
    """Yields (row, ids) for every row of a string column, nulls as empty."""
    cache = _known.get(path)
    if cache is None:
        cache = _known[path] = PieceCache(path)
    buf, offs = tx.string_buffers(col)
    for lo, hi in tx.doc_runs(offs, 1 << 21):
        own, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        if b"<|" in own.tobytes():
            words = tx.Words(own, o)
        else:
            own = _LOWER[own]
            cuts = np.zeros(len(own), bool)
            cuts[1:] = _LETTER[own[:-1]] & _SIGN[own[1:]]
            words = tx.Words(own, o, cuts)
        ids, size = cache.encode(words)
        ends = np.concatenate([[0], np.cumsum(size)])[words.first_word]
        for i in range(hi - lo):
            yield lo + i, ids[ends[i] : ends[i + 1]]
