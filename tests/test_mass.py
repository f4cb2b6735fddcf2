"""Capped masses against an independent solver (cyclic projections), certificates, infeasible caps and edge rows."""

import numpy as np
import pytest

from tessera.operators import mass


def cyclic(q, rows, caps, rounds=4000):
    """KL projection on {A p <= cap, sum p = 1} by Bregman projections with corrections, one constraint at a time; rows: fractions of each group."""
    p = np.array(q, float) / np.sum(q)
    z = np.zeros(len(rows))
    for _ in range(rounds):
        for k, (a, cap) in enumerate(zip(rows, caps)):
            p = p * np.exp(a * z[k])  # take the last correction back
            lo, hi = 0.0, 60.0
            if p @ a > cap:
                for _ in range(80):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if (p * np.exp(-a * mid)) @ a > cap else (lo, mid)
                z[k] = hi
            else:
                z[k] = 0.0
            p = p * np.exp(-a * z[k])
        p = p / p.sum()
    return p


def tables(spark, q, member):
    m = spark.createDataFrame([(1, i, float(w)) for i, w in enumerate(q)], "c long, cluster long, w double").repartition(3)
    g = spark.createDataFrame([(1, i, d, grp, f) for i, d, grp, f in member], "c long, cluster long, dimension string, `group` string, fraction double").repartition(2)
    return m, g


def test_fractional_projection_matches_cyclic_projections(spark):
    rng = np.random.default_rng(3)
    q = rng.uniform(0.2, 3, 14)
    member = []
    for i in range(14):
        sources = sorted({f"s{x}" for x in rng.integers(0, 4, rng.integers(1, 4))})
        member += [(i, "source", s, round(1 / len(sources), 8)) for s in sources] + [(i, "company", f"e{i % 6}", 1.0)]
    caps = {"source": 0.3, "company": 0.2}
    m, g = tables(spark, q, member)
    out = mass.project(m, g, "c", "cluster", "w", caps, rounds=5000).orderBy("cluster").collect()
    names = sorted({(d, x) for _, d, x, _ in member})
    a = np.zeros((len(names), 14))
    for i, d, x, f in member:
        a[names.index((d, x)), i] = f
    want = cyclic(q, a, [caps[d] for d, _ in names])
    got = np.array([r.mass for r in out])
    assert out[0].converged and not out[0].infeasible and out[0].max_violation <= 1e-6 and out[0].slackness < 1e-4
    assert np.abs(got - want).max() < 2e-4 and (a @ got <= np.array([caps[d] for d, _ in names]) + 2e-6).all()
    p = q / q.sum()
    assert out[0].objective_kl == pytest.approx((got * np.log(got / p)).sum(), abs=1e-9)


def test_equal_memberships_are_one_pattern(spark):
    member = [(i, "source", "a" if i < 600 else f"b{i % 3}", 1.0) for i in range(1000)]
    m, g = tables(spark, [1.0] * 1000, member)
    out = mass.project(m, g, "c", "cluster", "w", {"source": 0.4})
    got = mass.certificates(out, "c").first()
    assert got.converged and got["mass"] == pytest.approx(1) and got.effective_size == pytest.approx(1 / (600 * (0.4 / 600) ** 2 + 400 * (0.6 / 400) ** 2), rel=1e-4)


@pytest.mark.parametrize("method", ["dual", "rescale"])
def test_infeasible_caps_are_flagged(spark, method):
    member = [(i, "source", f"s{i % 2}", 1.0) for i in range(4)] + [(i, "company", f"e{i}", 1.0) for i in range(4)]
    m, g = tables(spark, [1, 2, 3, 4], member)
    r = mass.project(m, g, "c", "cluster", "w", {"source": 0.4, "company": 0.5}, method).first()
    assert r.infeasible and r.infeasible_dimensions == ["source"] and not r.converged and r.max_violation > 0.05


def test_rescaling_keeps_caps_and_mass(spark):
    member = [(i, "source", f"s{min(i, 3)}", 1.0) for i in range(8)]
    m, g = tables(spark, [1, 1, 1, 4, 4, 4, 4, 4], member)
    out = mass.project(m, g, "c", "cluster", "w", {"source": 0.5}, "rescale", rounds=80).orderBy("cluster").collect()
    assert sum(r.mass for r in out) == pytest.approx(1) and sum(r.mass for r in out[3:]) <= 0.5 + 1e-6 and out[0].converged
    assert out[0].mass == pytest.approx(out[2].mass) and out[3].mass == pytest.approx(out[7].mass)


def test_memberships(spark):
    rows = [(1, 10, 3, "a", None), (1, 10, 1, "b", ""), (1, 10, 2, "b", "x"), (1, 11, 1, None, None), (2, 10, 1, "", "y")]
    d = spark.createDataFrame(rows, "c long, cluster long, n int, source string, company string")
    got = {(r.c, r.cluster, r.dimension, r.group): r.fraction for r in mass.memberships(d, "c", "cluster", ["source", "company"]).collect()}
    assert got == {
        (1, 10, "source", "a"): 0.5, (1, 10, "source", "b"): 0.5, (1, 10, "company", "unknown"): 0.5, (1, 10, "company", "x"): 0.5,
        (1, 11, "source", "unknown"): 1.0, (1, 11, "company", "unknown"): 1.0, (2, 10, "source", "unknown"): 1.0, (2, 10, "company", "y"): 1.0,
    }
    hard = {(r.c, r.cluster, r.dimension): r.group for r in mass.memberships(d, "c", "cluster", ["source", "company"], False, "n").collect()}
    assert hard[1, 10, "source"] == "b" and hard[1, 10, "company"] == "x" and hard[1, 11, "source"] == "unknown"


def test_edges(spark):
    m, g = tables(spark, [0, 0], [(0, "source", "a", 1.0)])
    out = mass.project(m, g, "c", "cluster", "w", {"source": 0.5}).collect()
    assert [r.mass for r in out] == [0, 0] and not out[0].converged
    m, g = tables(spark, [3, -1], [(0, "other", "a", 1.0)])
    out = {r.cluster: r for r in mass.project(m, g, "c", "cluster", "w", {"source": 0.5}).collect()}
    assert out[0].mass == pytest.approx(1) and out[1].mass == pytest.approx(1e-12, rel=1e-3) and out[0].converged
    assert mass.project(m.limit(0), g, "c", "cluster", "w", {"source": 0.5}).count() == 0
