"""Coherence from sums against all pairs, blocks of sets against all pairs, and the rest of a cluster's diagnosis."""

import collections
import itertools
import math
import random

import pytest

from tessera.operators import diagnosis as dg


def members():
    rng = random.Random(12)
    rows = []
    for c in range(4):
        for m in range([1, 2, 9, 30][c]):
            pick = lambda pool, lo, hi: rng.sample(pool, rng.randint(lo, hi))
            rows.append((c, m, pick(list("abcdefgh"), 0, 5) * rng.randint(1, 2), pick(["x", "y", "z", "w"], 0, 3), pick(["lead", "data", "eng"], 0, 2), pick(["dev", "ops"], 0, 2), rng.choice(["acme", "b", "", None]), rng.choice(["w1", "w2"]), f"2024-01-{rng.randint(10, 28)}", "s"))
    return rows


SCHEMA = "c long, m long, text array<string>, skills array<string>, title array<string>, families array<string>, company string, window string, date string, source string"


def jac(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0


def cosines(docs):
    df = collections.Counter(t for d in docs for t in set(d))
    vec = []
    for d in docs:
        v = {t: d.count(t) / len(d) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(d)}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({t: x / n for t, x in v.items()})
    return [sum(x * b.get(t, 0) for t, x in a.items()) for a, b in itertools.combinations(vec, 2)]


def mean(x):
    x = list(x)
    return sum(x) / len(x) if x else 0.0


@pytest.mark.parametrize("block", [1024, 3, 1])
def test_mean_jaccard_equals_all_pairs(spark, block):
    rows = members()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.c: r.coherence for r in dg.mean_jaccard(df, "c", "skills", block).collect()}
    for c in range(4):
        assert got[c] == pytest.approx(mean(jac(a[3], b[3]) for a, b in itertools.combinations([r for r in rows if r[0] == c], 2)), abs=1e-9)


def test_diagnosis(spark):
    rows = members()
    out = {r.c: r for r in dg.diagnose(spark.createDataFrame(rows, SCHEMA).repartition(4), "c", "m", "text", "skills", "title", "families", "company", "window", "date", "source").collect()}
    for c in range(4):
        own = [r for r in rows if r[0] == c]
        r = out[c]
        text, skill = mean(cosines([x[2] for x in own])), mean(jac(a[3], b[3]) for a, b in itertools.combinations(own, 2))
        assert r.member_count == len(own) and r.text_coherence == pytest.approx(text, abs=1e-9) and r.combined_coherence == pytest.approx(0.6 * text + 0.4 * skill, abs=1e-9)
        assert r.title_coherence == pytest.approx(mean(jac(a[4], b[4]) for a, b in itertools.combinations(own, 2)), abs=1e-9)
        companies = collections.Counter(x[6] or "unknown" for x in own)
        assert r.companies == dict(companies) and r.company_hhi == pytest.approx(sum((n / len(own)) ** 2 for n in companies.values()))
        titles = [" ".join(x[4]) for x in own if x[4]]
        assert r.title_distinct_ratio == (pytest.approx(len(set(titles)) / len(titles)) if titles else None)
        families = collections.Counter(f for x in own for f in x[5])
        assert r.contradictions == sum(2 <= n <= len(own) - 2 for n in families.values())
        assert (r.first_date, r.last_date) == (min(x[8] for x in own), max(x[8] for x in own))


def test_copies_are_one_row(spark):
    df = spark.createDataFrame([(1, i, ["a"], ["x", "y"] if i else ["x"]) for i in range(3000)], "c long, m long, text array<string>, skills array<string>")
    got = dg.mean_jaccard(df, "c", "skills").first()
    assert got.coherence == pytest.approx((2999 * 2998 / 2 + 2999 * 0.5) / (3000 * 2999 / 2)) and got.members == 3000
    assert dg.mean_tfidf_cosine(df, "c", "m", "text").first().coherence == pytest.approx(1)
    assert dg.mean_jaccard(df.limit(0), "c", "skills").count() == 0
