"""Hand-computed cases: ties, nulls, constant series, empty tables, and properties such as partition invariance."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions import text as tx
from tessera.functions import vectors as vec
from tessera.operators import aggregate as ag
from tessera.operators import evolution as ev
from tessera.operators import forecasting as fc
from tessera.operators import lifecycle as lc
from tessera.operators import matching as mt
from tessera.operators import ranking as rk
from tessera.operators import relational as rel
from tessera.operators import retrieval as ret
from tessera.operators import similarity as sim
from tessera.operators import timeseries as ts


def series(spark, **values):
    return spark.createDataFrame([(s, i, float(v)) for s, vs in values.items() for i, v in enumerate(vs)], "s string, i long, x double")


def one(spark, col, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first().v


def test_growth_zero_baseline(spark):
    got = {(r.s, r.i): r for r in ts.growth(series(spark, a=[0, 2, 1], b=[0, 0]), "s", "i", "x").collect()}
    assert got["a", 1].relative_growth is None and got["a", 1].baseline_status == "newly_observed"
    assert got["a", 2].relative_growth == -0.5 and got["a", 2].acceleration == -3
    assert got["b", 1].baseline_status == "no_baseline" and got["b", 0].baseline_status is None


def test_volatility_and_stability_of_constants(spark):
    x = ts.stability(ts.volatility(series(spark, a=[3, 3, 3, 3]), "s", "i", "x"), "s", "i", "x").collect()
    assert all(r.volatility == 0 and r.window_stability == 1 for r in x)
    assert not ts.rolling_stability(series(spark, a=[3] * 6), "s", "i", "x").first().is_stationary


def test_change_run_and_turning_point(spark):
    x = ts.change_candidates(series(spark, a=[1, 1.01, 0.99, 2, 2.6, 1]), "s", "i", "x")
    r = ts.change_runs(x, "s", "i", "x").collect()
    assert [(q.i, q.run_length, q.direction) for q in r] == [(3, 2, "rising")]
    t = ts.turning_points(series(spark, b=[1, 1.2, 1.1, 1.0, 0.9], c=[1, 1.2, 0.9]), "s", "i", "x").collect()
    assert [(q.s, q.i, q.direction) for q in t] == [("b", 1, "declining")]


def test_forecasts(spark):
    v = series(spark, a=[1, 2, 3, 4, 5], b=[7], c=[2, 2])
    s = {r.s: r for r in ts.series_array(v, "s", "i", "x").select("s", *[f(F.col("values")).alias(n) for n, f in ts.FORECASTS.items()]).collect()}
    assert s["a"].naive == 5 and s["a"].moving_average == 3.5 and abs(s["a"].ridge - (3 + 10 / 10.1 * 3)) < 1e-9
    assert s["b"].ridge == s["b"].ewma == s["b"].holt == 7 and s["c"].holt == 2
    assert np.allclose(fc.arima(np.array([1.0, 2, 3, 4, 5, 6]), 2), [7, 8], atol=0.05)
    assert fc.fourier_trend(np.array([4.0]), 2).tolist() == [4, 4]


def test_lead_lag_finds_the_shift(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=40)
    rows = [("a", i, float(a[i])) for i in range(40)] + [("b", i, float(a[i - 2])) for i in range(2, 40)]
    r = ts.lead_lag(spark.createDataFrame(rows, "src string, i long, x double"), "src", "i", "x").first()
    assert (r.leading, r.lagging, r.lag) == ("a", "b", 2) and r.correlation == 1


def test_merged_intervals(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    x = spark.createDataFrame([(1, d(0), d(10)), (1, d(5), d(20)), (1, d(20), d(25)), (1, d(40), d(50)), (1, d(60), d(60)), (2, d(9), d(3))], "k int, a date, b date")
    assert [(r.start, r.end) for r in ts.merged_intervals(x, "k", "a", "b").orderBy("start").collect()] == [(d(0), d(25)), (d(40), d(50))]


def test_snapshot_diff_nulls(spark):
    b = spark.createDataFrame([(1, None, 5), (2, "x", 5), (3, "y", 1)], "k int, m string, n int")
    a = spark.createDataFrame([(1, "z", 5), (2, "x", 5), (4, "w", 2)], "k int, m string, n int")
    got = {r.k: (r.change, r.changed_fields) for r in rel.snapshot_diff(b, a, ["k"], ["m", "n"]).collect()}
    assert got == {1: ("changed", "m"), 3: ("removed", ""), 4: ("added", "")}


def test_bounded_paths_have_no_cycles(spark):
    e = spark.createDataFrame([(1, 2, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 3, 1.0, 1.0), (1, 3, 5.0, 1.0), (3, 3, 0.0, 1.0)], "source int, target int, cost double, confidence double")
    got = {(r.source, r.target): (r.hops, r.cost) for r in rel.bounded_paths(e, 4).collect()}
    assert got[1, 3] == (2, 2.0) and (1, 1) not in got and (3, 3) not in got


def test_within_days_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(60)))) for i in range(80)]
    got = {(r.left, r.right) for r in rel.within_days(spark.createDataFrame(rows, "id long, k long, d date"), "id", ["k"], "d", 7).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs((a[2] - b[2]).days) <= 7}
    assert got == want


def test_decay_trim_keeps_minimum(spark):
    h = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.4, 0.39, 0.1])], "k int, id int, s double")
    assert rel.decay_trim(h, "k", "s", "id").count() == 3


def test_set_join_is_lossless(spark):
    rng = np.random.default_rng(3)
    sets = [sorted({int(x) for x in rng.integers(0, 15, rng.integers(0, 9))}) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, s array<long>")
    for t in (0.3, 0.5, 0.8, 1.0):
        got = {(r.left, r.right) for r in sim.set_join(df, "id", "s", t).collect()}
        j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
        first = {i: min(k for k in range(60) if sets[k] == sets[i]) for i in range(60)}
        reps = sorted(set(first.values()))
        want = {(a, b) for a in reps for b in reps if a < b and j(sets[a], sets[b]) >= t - 1e-12 and sets[a] and sets[b]}
        assert got == want | {(first[i], i) for i in range(60) if first[i] != i and sets[i]}


def test_copies_are_not_expanded(spark):
    df = spark.range(500).select("id", F.array(*[F.lit(k) for k in range(9)]).alias("s"))
    assert sim.set_join(df, "id", "s", 0.5).count() == 499


def test_components_raise_when_they_do_not_settle(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        sim.components(e, e.select("a"), rounds=1)


def test_event_groups_are_those_of_all_pairs(spark):
    import datetime
    import difflib
    import random

    r = random.Random(3)
    word = lambda: f"w{r.randrange(500)}"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = []
    for k in range(12):
        base = [word() for _ in range(r.randrange(20, 60))]
        for n in range(4):
            x = list(base)
            for _ in range(n):
                x[r.randrange(len(x))] = word()
            rows.append((len(rows), day(r.randrange(20)), f"u{r.randrange(30)}" if n == 3 else None, f"title {k} {word()} {word()}", " ".join(x)))
    got = {g.id: g.event for g in sim.event_groups(spark.createDataFrame(rows, "id long, ts timestamp, url string, title string, body string"), "id", "ts", "url", "title", "body").collect()}
    reps, urls, group = [], {}, {}
    for i, ts, u, h, b in sorted(rows, key=lambda x: (x[1], x[0])):
        g = urls.get(u) if u else None
        if g is None:
            for k, (t0, h0, b0) in enumerate(reps):
                if (ts - t0).days <= 14 and (difflib.SequenceMatcher(None, h0, h).ratio() >= 0.88 or difflib.SequenceMatcher(None, b0, b.split()).ratio() >= 0.85):
                    g = k
                    break
        if g is None:
            g = len(reps)
            reps.append((ts, h, b.split()))
        if u:
            urls.setdefault(u, g)
        group[i] = g
    assert got == {i: min(k for k in group if group[k] == g) for i, g in group.items()}


def test_components_and_lineage(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 51)], "a long, b long")
    n = spark.createDataFrame([(i,) for i in range(60)], "n long")
    got = {r.node: r.cluster for r in sim.components(e, n).collect()}
    assert got[30] == 0 and got[51] == 50 and got[55] == 55
    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.5), (3, 11, 0.8), (3, 12, 0.7), (4, 13, 0.6), (5, 14, 0.1)], "b long, a long, s double")
    prev, cur = spark.createDataFrame([(i,) for i in range(1, 6)], "b long"), spark.createDataFrame([(i,) for i in range(10, 15)], "a long")
    got = {(r.b, r.a): r.relation for r in sim.lineage(pairs, prev, cur, "b", "a", "s", 0.4).collect()}
    assert got == {(1, 10): "merge", (2, 10): "absorbed", (3, 11): "split", (3, 12): "split", (4, 13): "continue", (5, None): "decline", (None, 14): "birth"}


def test_mean_pair_cosine_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12, 5))
    df = spark.createDataFrame([(i % 2, x.tolist()) for i, x in enumerate(v)] + [(9, [0.0] * 5)], "k long, v array<double>")
    got = {r.k: r.cohesion for r in sim.mean_pair_cosine(df, "k", "v").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in (0, 1):
        m = u[k::2]
        assert abs(got[k] - (np.sum(m @ m.T) - len(m)) / (len(m) * (len(m) - 1))) < 1e-9


def test_text_conventions(spark):
    x, y = F.lit(""), F.lit("ab")
    assert one(spark, tx.trigram_similarity(x, y)) == 1.0  # neither has a 3-gram
    assert one(spark, tx.edit_ratio(x, x)) == 0.0 and one(spark, tx.edit_ratio(x, y)) == 1.0
    e = F.array().cast("array<string>")
    assert one(spark, tx.jaccard(e, e)) == 0.0 and one(spark, tx.jaccard(e, e, 1.0)) == 1.0 and one(spark, tx.dice(e, e)) == 1.0
    assert one(spark, tx.canonical_url(F.lit("HTTP://www.A.com:80//b///c/?utm_x=1&z=2&a=1&REF=q#f"))) == "http://a.com/b/c?a=1&z=2"
    assert one(spark, tx.identity_url(F.lit("https://A.com:443/b/?q=1#f"))) == "https://a.com/b?q=1"
    assert sorted(one(spark, tx.mixed_tokens(F.lit("机器学习 / LLM 大")))) == sorted(["机器", "器学", "学习", "llm", "大"])
    assert one(spark, tx.normalize_key(F.lit("Ａ　 ß"))) == "a ss"
    assert one(spark, tx.occurrence(F.lit("abcabc"), F.lit("bc"), 1)) == 4 and one(spark, tx.occurrence(F.lit("abc"), F.lit("bc"), 1)) is None
    assert one(spark, tx.redact(F.lit("mail me at a.b@c.org"))) == "[redacted]" and one(spark, tx.redact(F.lit("fine"))) == "fine"
    assert one(spark, tx.degree(F.lit("博士优先，硕士亦可"))) == "doctor" and one(spark, tx.years_months(F.lit("3-5年"))) == 36


def test_strict_utc(spark):
    got = [one(spark, F.date_format(sc.strict_utc(F.lit(t)), "HH:mm")) for t in ("2024-01-01T08:00:00+08:00", "2024-01-01T08:00:00", "", "zzZ")]
    assert got == ["00:00", None, None, None]


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vec.cosine(a, a)) == 1 and one(spark, vec.cosine(a, z)) == 0 and one(spark, vec.cosine(a, F.array(F.lit(1.0)))) == 0


def test_weights():
    q = np.array([5.0, 3, 1, 1])
    g = [np.array([0, 0, 1, 1]), np.array([0, 1, 2, 3])]
    p = ag.cap_mass(q, g, [0.6, 0.4])
    assert abs(p.sum() - 1) < 1e-9 and p[:2].sum() <= 0.6 + 1e-4 and p.max() <= 0.4 + 1e-4
    d, worst, _ = ag.project_mass(q, g, [0.6, 0.4])
    assert abs(d.sum() - 1) < 1e-9 and worst < 1e-3
    assert mt.water_fill([0.7, 0.2, 0.1], 1.0, 0.4) == pytest.approx([0.4, 0.32, 0.28])
    assert sum(mt.water_fill([0.7, 0.3], 1.0, 0.3)) == pytest.approx(0.6)


def test_shapley_of_an_additive_game(spark):
    v = spark.createDataFrame([(m, float((m & 1) * 3 + (m >> 1 & 1) * 5)) for m in range(4)], "m long, v double")
    assert {r.factor: r.shapley for r in ag.shapley(v, "m", "v", 2).collect()} == {0: 3.0, 1: 5.0}
    assert ag.factor_interactions(v, "m", "v", 2).first().interaction == 0


def test_signals_need_support(spark):
    cols = "p int, k int, weight double, confidence double, support int, sources int, enterprises int, samples int, category int"
    b = spark.createDataFrame([(1, 1, 0.5, 0.9, 5, 3, 3, 9, 0), (1, 2, 0.6, 0.9, 5, 3, 3, 9, 0)], cols)
    a = spark.createDataFrame([(1, 2, 0.2, 0.9, 5, 3, 3, 9, 0), (1, 3, 0.8, 0.9, 1, 3, 3, 9, 0)], cols)
    got = {r.k: (r.kind, r.coverage_driven) for r in ev.atomic_signals(b, a, ["p", "k"]).collect()}
    assert got == {1: ("skill_decline", False), 2: ("skill_decline", False), 3: ("skill_emergence", True)}


def test_role_states(spark):
    rows = [(1, i, s, t, False) for i, (s, t) in enumerate([(0.1, 0.1), (0.7, 0.8), (0.69, 0.8), (0.3, 0.5), (0.31, 0.5), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "k int, i int, share double, total double, weak boolean")
    got = [r.state for r in lc.role_states(df, ["k"], "i", "share", "total", "weak").orderBy("i").collect()]
    assert got == ["not_observed", "core", "core", "declining", "declining", "not_observed", "not_observed", "retired"]


def test_recommendation_gate(spark):
    r = lambda s, c, g: one(spark, mt.recommendation(F.lit(s), F.lit(c), F.lit(g)))
    assert r(90.0, 0.9, "failed") == "not_recommended" and r(90.0, 0.9, "uncertain") == "potential_match" and r(90.0, 0.1, "passed") == "insufficient_information"


def test_greedy_queue_blocking_first(spark):
    rows = [(1, i, v, b, o) for i, (v, b, o) in enumerate([(0.9, False, "a"), (0.1, True, "a"), (0.8, False, "b"), (0.8, False, "a")])]
    df = spark.createDataFrame(rows, "q int, t int, v double, b boolean, o string")
    got = [r.t for r in rk.greedy_queue(df, "q", "t", "v", ["o"], blocking="b", group="o", penalty=0.3).orderBy("position").collect()]
    assert got == [1, 2, 0, 3]


def test_fusion_and_bm25_empty(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "d long, t array<string>")
    q = spark.createDataFrame([(7, ["a", "a"]), (8, ["zzz"])], "q long, t array<string>")
    got = ret.bm25(d, q, "d", "q", "t").collect()
    assert [(r.q, r.d) for r in got] == [(7, 1)] and got[0].score > 0
    r = ret.ranked(ret.bm25(d, q, "d", "q", "t"), "q", "d", "score", 5)
    assert ret.fuse([(r, 0.7), (r, 0.3)], "q", "d").first().relative == 1


@pytest.mark.parametrize("n", [1, 7])
def test_partition_invariance(spark, sf, n):
    from tessera import plans

    name = "joi16_near_duplicates"
    want = sorted(map(tuple, plans.QUERIES[name](spark, sf).collect()))
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        assert sorted(map(tuple, plans.QUERIES[name](spark, sf).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_best_subset_equals_enumeration(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(k, a, round(rng.uniform(-0.2, 1.0), 3)) for k in range(25) for a in range(k % 8)] + [(30, a, 0.5) for a in range(6)]
    got = {r.k: (r.mask, r["size"], round(r.gain, 9)) for r in mt.best_subset(spark.createDataFrame(rows, "k long, a long, g double"), "k", "a", "g", 1.4).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        g = [x for kk, _, x in sorted(rows) if kk == k]
        fits = [(n, -round(sum(g[i] for i in s), 9), sum(1 << i for i in s)) for n in range(1, len(g) + 1) for s in itertools.combinations(range(len(g)), n) if sum(g[i] for i in s) >= 1.4]
        if fits:
            n, gain, mask = min(fits)
            want[k] = (mask, n, -gain)
    assert got == want and got[30] == (7, 3, 1.5)
