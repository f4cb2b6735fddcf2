import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import run_index
from tessera.llm.run_index import RunIndex, remove_repeats


def brute(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        drop = [False] * len(t)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                drop[k : k + size] = [True] * size
        kept = bytes(x for x, d in zip(t, drop) if not d)
        spans = sum(d and not (k and drop[k - 1]) for k, d in enumerate(drop))
        out.append((i, len(t), sum(drop), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **more):
    return sorted([(r.doc_id, r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in remove_repeats(df, **more).collect()], key=str)


def corpus(shared_in=12):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé ñ\n漢") for _ in range(n))
    passage, edge, base = text(500), "e" + "x" * 398, text(1500)
    rows = [(i, text(rng.randint(0, 900))) for i in range(25)]
    rows += [(100 + i, f"{text(rng.randint(0, 300))}{passage}{text(rng.randint(0, 300))}") for i in range(shared_in)]
    for i in range(8):  # near copies
        t = list(base)
        t[rng.randrange(1500)] = "Z"
        rows.append((200 + i, "".join(t)))
    rows += [(300, f"{text(9)}{edge}{text(9)}"), (301, f"{text(9)}{edge}{text(9)}"), (302, None), (303, ""), (304, "a" * 5000), (305, "ab" * 700), (306, "\0" * 401), (307, "\0" * 400), (308, base + base)]
    rows += [(309, text(700))] * 2 + [(None, text(450)), (None, text(450)), (310, "é" * 200), (311, "xé" + "é" * 200)]
    return rows


@pytest.mark.parametrize("crowd", [512, 2])
def test_matches_brute_force(spark, crowd):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, crowd=crowd) == brute(rows, run_index.WINDOW)


def test_crowded_anchor_is_dealt_to_several_indexes(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + passage + "".join(rng.choice("ab") for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df, window=40, gram=8, crowd=4) == brute(rows, 40)


def test_slices_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(run_index, "SLICE", 1000)
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(20_000))
    rows = [(1, long), (2, "q" + long[4321:6789] + "q"), (3, long[:399]), (4, long[-400:])]
    parts = list(run_index._blocks(iter([__import__("pyarrow").record_batch([[1, 2], [3, 4], [long, long[990:2500]]], names=["a", "b", "c"])]), 400, 32))
    assert sum(sum(p.column(5).to_pylist()) for p in parts) == 20_000 - 399 + 1510 - 399
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 400)


def test_long_text_clashing_names_and_spans(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "x " + long[100_000:100_700] + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _n_bytes", "2 as _k1", "3 as `a.b`", "4 as anchor", "5 as `_Spans`", "6 as c0")
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert out[2].text == "x  y" and out[2]["a.b"] == 3 and out[2].c0 == 6 and out[2]._k1 == 2
    assert [(s.start, s.end) for s in out[1]._spans] == [(100_000, 100_700)] and out[1]._n_bytes == 300_000


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_matching_statistics_from_run_ends(blocks):
    text = np.frombuffer(b"".join(blocks), np.uint8)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    index = RunIndex(text, starts)
    suffixes = [b[i:] for b in blocks for i in range(len(b))]

    def agree(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [max([agree(a, b) for j, b in enumerate(suffixes) if j != i], default=0) for i, a in enumerate(suffixes)]
    prev, after = index.matching_statistics()
    assert np.maximum(prev, after).tolist() == want
    assert index.lengths.sum() == len(text) and len(index.symbols) == len(index.heads[0]) == len(index.tails[0])


def test_a_block_meets_one_mark(spark, tmp_path):
    """What is known to be repeated as a whole is not looked up again on the deeper levels."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    base = [word() for _ in range(20)]
    rows = []
    for i in range(60):  # near copies: some of their blocks are equal, and an anchor has many different ones
        t = list(base)
        t[rng.randrange(20)] = word()
        rows.append((i, i, "".join(t), False))
    texts = spark.createDataFrame(rows, "_k1 long, _k2 long, _text string, _done boolean")
    run_index.repeated_windows(texts, str(tmp_path), 40, [8, 38, 40], 4).collect()
    marks = spark.read.parquet(f"{tmp_path}/8-marks")
    assert marks.count() == marks.select("anchor", "block").distinct().count() > 0
