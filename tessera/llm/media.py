"""Media columns: WAV payloads, spectrograms and spectral-peak fingerprints.

A payload is stored as the samples of a WAV file (8-bit, one channel), a
binary column ``media``. Features are computed from the stored bytes: they are
read by the wave module, a short-time Fourier transform gives local spectral
peaks, and each peak is paired with the next ones in time. A pair is stored in
an array as ``time << 24 | code``; the code holds both frequencies and the
time between them.

Long payloads are transformed in runs of frames, so memory does not follow
their length. A row depends on its own payload only: equal payloads give equal
features.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx

RATE, FRAME, HOP, PEAKS, FAN, REACH, PAD, RUN = 8000, 256, 128, 3, 3, 31, 64, 4096
_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def padded(payload: bytes, multiple: int = PAD) -> bytes:
    """payload with zero bytes up to a positive multiple."""
    size = max(multiple, -(-len(payload) // multiple) * multiple)
    return payload + bytes(size - len(payload))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as 8-bit samples of a mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of 8-bit mono samples."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono WAV of 8-bit samples")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of the strongest local peaks of each frame, by time and frequency."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for lo in range(0, n, RUN):
        hi = min(n, lo + RUN)
        a, b = max(0, lo - 1), min(n, hi + 1)
        s = np.abs(np.fft.rfft(frames[a:b] * _WINDOW, axis=1)).astype(np.float32)
        full = np.zeros((hi - lo + 2, s.shape[1]), np.float32)
        full[a - lo + 1 : b - lo + 1] = s
        mid = full[1:-1, 1:-1]
        top = (mid > full[1:-1, :-2]) & (mid >= full[1:-1, 2:]) & (mid > full[:-2, 1:-1]) & (mid >= full[2:, 1:-1])
        t, f = np.nonzero(top)
        order = np.lexsort((f, -mid[t, f], t))
        t, f = t[order], f[order]
        first = np.searchsorted(t, np.arange(hi - lo))
        strong = np.arange(len(t)) - first[t] < PEAKS
        t, f = t[strong], f[strong]
        order = np.lexsort((f, t))
        times.append(t[order] + lo)
        bins.append(f[order] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of spectral peaks."""
    t, f = spectral_peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        ok = (dt > 0) & (dt <= REACH)
        out.append((t[:-k][ok] << 24) | (f[:-k][ok] << 14) | (f[k:][ok] << 5) | dt[ok])
    return np.sort(np.concatenate(out)).astype(np.int64)


def encode_media(rows: DataFrame, id_col: str, payload: str, media_col: str = "media", rate: int = RATE) -> DataFrame:
    """(id_col, n_bytes, media): a column of texts or bytes stored as WAV. Nulls are empty payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in b.column(1).to_pylist()]
            size = pa.array([len(x) for x in data], pa.int64())
            yield pa.record_batch([b.column(0), size, pa.array([to_wav(padded(x), rate) for x in data], pa.binary())], names=[id_col, "n_bytes", media_col])

    own = rows.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{payload}`").cast("binary").alias("_p"))
    schema = T.StructType([own.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])
    return own.mapInArrow(tx.tidied(run), schema)


def media_features(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """Replaces the media column by what its stored bytes hold.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 64 payload
    bytes), media_bytes, media_sha256 and fingerprint (array<long>). A null
    media value gives nulls and an empty fingerprint.
    """
    keep = [c for c in rows.columns if c != media_col]
    extra = T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>")
    schema = T.StructType([*(rows.schema[c] for c in keep), *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, tail, stored, own, marks = [], [], [], [], [], []
            for i in range(len(b)):
                media = b.column(len(keep))[i].as_py()
                if media is None:
                    for x in (size, sha, tail, stored, own):
                        x.append(None)
                    marks.append(np.zeros(0, np.int64))
                    continue
                payload = from_wav(media)
                size.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                tail.append(zlib.crc32(payload[-PAD:]))
                stored.append(len(media))
                own.append(hashlib.sha256(media).hexdigest())
                marks.append(fingerprint(np.frombuffer(payload, np.uint8)))
            counts = np.fromiter(map(len, marks), np.int64, len(marks))
            flat = pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
            yield pa.record_batch(
                [*(b.column(i) for i in range(len(keep))), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(stored, pa.int64()), pa.array(own, pa.string()), lists],
                names=schema.fieldNames(),
            )

    return rows.select(*keep, media_col).mapInArrow(tx.tidied(run), schema)
