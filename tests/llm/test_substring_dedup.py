import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.substring_dedup import greedy, substring_dedup, without_repeats


def brute(rows, size=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        drop = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                drop[k : k + size] = [True] * size
        kept = b" ".join(x for x, d in zip(w, drop) if not d)
        out.append((i, len(w), sum(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyzé")
    text = lambda n: " ".join(word() + str(rng.randint(0, 40)) for _ in range(n))
    shared, edge = text(60), text(34)
    rows = [(i, text(rng.randint(0, 120))) for i in range(30)]
    rows += [(100 + i, f"{text(rng.randint(0, 20))}\n{shared}\t{text(rng.randint(0, 50))}") for i in range(12)]
    rows += [(200, f"{text(5)} {edge} {text(5)}"), (201, f"{text(5)} {edge} {text(5)}"), (202, None), (203, ""), (204, " \n "), (205, "na " * 500), (206, "a b " * 90)]
    rows += [(300, rows[3][1] or "x"), (301, text(70)), (301, text(70)), (302, shared), (302, shared), (None, text(50))]
    return rows


@pytest.mark.parametrize("hot", [512, 2])
def test_matches_brute_force(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, `_text` string").repartition(5)
    got = sorted([(r.doc_id, r._n_words, r._n_removed, r._kept_sha256) for r in substring_dedup(df, hot=hot).collect()], key=str)
    assert got == brute(rows)


def test_small_windows_and_kept_text(spark):
    rows = [(1, "one two  three four\nfive six"), (2, "zero two three four seven"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(df, window=3, gram=2).collect()}
    assert got[1].text == "one five six" and got[2].text == "zero seven" and got[3].text is None
    f = got[1]._factors[0]
    assert (f.start, f.words, f.source, f.source_start) == (1, 3, 2, 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).count() == 0


def brute_greedy(runs):
    """Greedy factors of runs of numbers, all of which occur at another place too: (run, start, size)."""
    out = []
    for k, r in enumerate(runs):
        i = 0
        while i < len(r):
            best = 0
            for q, o in enumerate(runs):
                for j in range(len(o)):
                    n = 0
                    while (q, j) != (k, i) and i + n < len(r) and j + n < len(o) and r[i + n] == o[j + n]:
                        n += 1
                    best = max(best, n)
            out.append((k, i, best))
            i += max(best, 1)
    return out


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_factors_are_greedy_and_longest(runs):
    flat = np.array([x for r in runs for x in r])
    opens = np.array([i == 0 for r in runs for i in range(len(r))])
    start = np.flatnonzero(opens)
    at, size, ref = greedy(flat, opens, np.arange(len(flat)))
    run = np.searchsorted(start, at, side="right") - 1
    assert list(zip(run.tolist(), (at - start[run]).tolist(), size.tolist())) == brute_greedy(runs)
    for a, n, r in zip(at.tolist(), size.tolist(), ref.tolist()):
        assert n == 0 or (a != r and flat[a : a + n].tolist() == flat[r : r + n].tolist())


def test_long_text_and_clashing_names(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[20_000:20_100]) + " y"), (2, "other text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _n_words", "'a' as `_N_Removed`", "2 as _k1", "3 as _rest", "4 as n_chars", "5 as __x", "6 as c0")
    got = {r.text[:5]: r for r in substring_dedup(df).collect()}
    assert got["x y"]._n_removed == 100 and got["other"]._n_removed == 0 and got["x y"]._k1 == 2 and got["x y"].c0 == 6
    assert [(f.start, f.words, f.source, f.source_start) for f in got["x y"]._factors] == [(1, 100, 1, 20_000)]
    kept = without_repeats(df, size_col="n_chars")
    assert kept.columns == df.columns
    assert {(r.doc_id, r.n_chars, r._n_words, r._N_Removed) for r in kept.collect()} == {(1, sum(map(len, words)) + 59_899 - sum(map(len, words[20_000:20_100])), 1, "a"), (2, 3, 1, "a"), (2, 4, 1, "a")}
