import gzip
import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from tessera.llm import media, warc


def test_round_trip(spark):
    long = "<html>" + "é\r\n\r\nWARC/1.1\r\n" * 20 + "</html>"
    rows = [(4, "http://a.b/c?d", long), (2, "http://x.y", long), (9, "http://x.y/z", long), (1, "", None), (3, "u", ""), (5, "u\r\nX: y", "short"), (6, "u", "short"), (None, "u", long), (2, "http://x.y", long)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, type string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != 2
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_parse_members_and_orphans(spark):
    one = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <q>\r\nWARC-Concurrent-To: <r>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Type: text/html\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = list(warc.parse_warc(gzip.compress(one) + gzip.compress(two)))
    assert [r["type"] for r in rows] == ["request", "response"] and rows[0]["payload"] == b"body" and rows[1]["payload_bytes"] == 0
    assert list(warc.parse_warc(one + two)) == rows
    step, warc.STEP = warc.STEP, 3  # records across the steps of reading
    try:
        assert list(warc.parse_warc(gzip.compress(one) + gzip.compress(two) + gzip.compress(one)))[:2] == rows
        assert list(warc.parse_warc(one + two)) == rows
    finally:
        warc.STEP = step
    for cut in (one[:-10], gzip.compress(one)[:-12], one + b"WARC/1.0\r\nWARC"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse_warc(cut))
    assert list(warc.parse_warc(b"")) == []


def test_round_trip_of_many_files_and_layouts(spark):
    big = "x" * 3_000_000
    rows = [(i, f"u{i % 7}", big if i in (3, 90) else ("same " * 30 if i % 3 else f"page {i} " * 20)) for i in range(120)] + [(5, "u5", "same " * 30)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = None
    for parts in (1, 9):
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df.repartition(parts), file_bytes=40_000).collect()), key=str)
        want = want or got
        assert got == want and len(got) == len(rows)
    assert [r for r in want if r[0] == 90] == [(90, 3_000_000, "revisit", 3)]


def test_media(spark):
    texts = ["", None, "abc", "x" * 64, "é" * 5000, "abc", "hello world " * 400]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    stored = media.encode_media(df, "doc_id", "text")
    got = {r.doc_id: r for r in media.media_features(stored).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[2].fingerprint == got[5].fingerprint and got[2].media_sha256 == got[5].media_sha256
    w = stored.filter("doc_id = 6").first().media
    with wave.open(io.BytesIO(bytes(w))) as f:
        assert f.readframes(f.getnframes()).startswith(texts[6].encode())
    assert media.media_features(stored.limit(0)).count() == 0


def test_peaks_of_a_tone():
    t = np.arange(4000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8)
    _, f = media.spectral_peaks(tone)
    assert np.bincount(f).argmax() == 1000 * media.FRAME // media.RATE
    whole = media.spectral_peaks(np.tile(tone, 200))
    run, media.RUN = media.RUN, 64
    try:
        cut = media.spectral_peaks(np.tile(tone, 200))
    finally:
        media.RUN = run
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
