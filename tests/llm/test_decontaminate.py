import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate, overlaps, segments


def test_overlaps(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    item, short = text(40), text(6)
    w = item.split()
    swapped = " ".join(x if k % 5 else "zzzzz" for k, x in enumerate(w[5:35]))
    docs = [(1, f"{text(30)} {item} {text(10)}"), (2, f"{text(9)}. {item.upper().replace(' ', ', ')}!"), (3, f"{text(20)} {swapped}"), (4, text(200)), (5, " ".join(w[:8])), (6, None), (7, ""), (8, f"x {short} y"), (9, " ".join(w[10:30])), (1, item)]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(10, item), (11, short), (12, None), (13, "a b"), (14, "")], "item_id long, text string")
    rows = overlaps(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 10), (2, 10), (3, 10), (8, 11), (9, 10)}
    full = next(r for r in rows if r.doc_id == 1 and r.doc_start == 30)
    assert (full.n_words, full.n_equal, full.item_start) == (40, 40, 0)
    assert {(r.doc_id, r.item_id, r.doc_start) for r in overlaps(d, b, part=20).collect()} == {(r.doc_id, r.item_id, r.doc_start) for r in rows}
    assert sorted(r.doc_id for r in decontaminate(d, b).collect()) == [4, 5, 6, 7]
    assert overlaps(d, b.limit(0)).count() == 0 and overlaps(d.limit(0), b).count() == 0


def brute_segments(same, at=0):
    """Best segment (shortest, then first, of equal scores), then what is left and right of it."""
    best = None
    for s in range(len(same)):
        score = 0
        for e in range(s + 1, len(same) + 1):
            score += 1 if same[e - 1] else -3
            if score > 0 and (best is None or (score, s - e) > best[0]):
                best = ((score, s - e), s, e)
    if best is None:
        return []
    _, s, e = best
    return brute_segments(same[:s], at) + [(at + s, at + e)] + brute_segments(same[e:], at + e)


@given(st.lists(st.booleans(), max_size=40))
@settings(max_examples=200, deadline=None)
def test_segments_are_all_maximal_ones(same):
    assert segments(np.array(same, bool)) == brute_segments(same)


def test_all_segments_of_all_diagonals(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop")
    item = [word() for _ in range(60)]
    other = [word() for _ in range(25)]
    noise = lambda n: ["z" + word() for _ in range(n)]
    docs = [
        (1, item[:20] + noise(20) + item[40:]), (2, noise(7) + item[3:30] + noise(9) + item[3:30]), (3, other + item + other), (4, noise(500)), (5, (item[:30] + noise(1)) * 40),
        (6, noise(20_000) + [w if k % 5 else "q" for k, w in enumerate(item)]), (None, item), (1, item[:20] + noise(20) + item[40:]),
    ]
    items = [(10, item), (11, other), (12, item), (10, other)]
    want = []
    for i, d in docs:
        for j, t in items:
            for shift in range(-len(t) + 1, len(d)):
                lo, hi = max(0, shift), min(len(d), shift + len(t))
                if sum(d[k] == t[k - shift] for k in range(lo, hi)) >= 8:
                    want += [(i, j, lo + s, lo + s - shift, e - s) for s, e in segments(np.array([d[k] == t[k - shift] for k in range(lo, hi)])) if e - s >= min(13, len(t))]
    d = spark.createDataFrame([(i, " ".join(t), "x") for i, t in docs], "doc_id long, text string, i string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words) for r in overlaps(d, b).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for part in (20, 2_000_000):
        kept = decontaminate(d.withColumn("_bad", F.lit(1)), b, part=part)
        assert kept.columns == ["doc_id", "text", "i", "_bad"] and [r.doc_id for r in kept.collect()] == [4]


def test_recall_by_share_of_substituted_words(spark):
    rng = random.Random(8)
    items = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)] for _ in range(100)]
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for rate, least in ((0.05, 1.0), (0.1, 0.98), (0.15, 0.9)):
        d = spark.createDataFrame([(i, " ".join(w if rng.random() > rate else "qq" for w in t)) for i, t in enumerate(items)], "doc_id long, text string")
        assert overlaps(d, b).filter("doc_id = item_id").select("doc_id").distinct().count() >= least * len(items)
