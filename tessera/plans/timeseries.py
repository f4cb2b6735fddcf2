"""Series queries on ``events``: daily scores of twenty subjects (event type and user group).

Scores carry an irrational factor, so that no mean is a decimal tie that two
engines could round differently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import big, log_support, week_start
from tessera.operators import timeseries as ts

from .registry import query, table

S = """s AS (SELECT event_type || ':' || CAST(user_id % 4 AS VARCHAR) AS subject, CAST(ts AS DATE) AS day, avg(value) / (16 * pi()) AS score,
      count(*) AS n, count(DISTINCT user_id) AS sources FROM events GROUP BY 1, 2)"""
V = f"WITH {S}, v AS (SELECT subject, list(score ORDER BY day) AS v, count(*) AS n FROM s GROUP BY 1)"


def daily(spark, d):
    e = table(spark, d, "events")
    subject = F.concat(F.col("event_type"), F.lit(":"), (F.col("user_id") % 4).cast("string"))
    return e.groupBy(subject.alias("subject"), F.to_date("ts").alias("day")).agg((F.avg("value") / (16 * F.pi())).alias("score"), F.count("*").alias("n"), F.countDistinct("user_id").alias("sources"))


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _day(name="day"):
    return F.col(name).cast("string").alias(name)


@query("win01_growth", f"""WITH {S}, a AS (SELECT *, lag(score) OVER w AS p, CASE WHEN n > 5 THEN 2.0 ELSE 1.0 END AS dur FROM s WINDOW w AS (PARTITION BY subject ORDER BY day)),
b AS (SELECT *, max(dur) OVER (PARTITION BY subject) > min(dur) OVER (PARTITION BY subject) AS mixed FROM a),
c AS (SELECT *, CASE WHEN mixed THEN (score - p) / dur ELSE score - p END AS g FROM b)
SELECT subject, CAST(day AS VARCHAR) AS day, round(score - p, 6) AS absolute_growth, round(CASE WHEN p <> 0 THEN (score - p) / p END, 6) AS relative_growth,
 CASE WHEN p <> 0 THEN 'comparable' WHEN p = 0 AND score > 0 THEN 'newly_observed' WHEN p = 0 THEN 'no_baseline' END AS baseline_status,
 round(g, 6) AS growth_rate, round(g - lag(g) OVER (PARTITION BY subject ORDER BY day), 6) AS acceleration FROM c""")
def win01(spark, d):
    out = ts.growth(daily(spark, d).withColumn("dur", F.when(F.col("n") > 5, 2.0).otherwise(1.0)), "subject", "day", "score", "dur")
    return out.select("subject", _day(), *_r("absolute_growth", "relative_growth"), "baseline_status", *_r("growth_rate", "acceleration"))


@query("win02_volatility", f"WITH {S} SELECT subject, CAST(day AS VARCHAR) AS day, round(stddev_pop(score) OVER w / greatest(abs(avg(score) OVER w), 1e-9), 6) AS volatility FROM s WINDOW w AS (PARTITION BY subject ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def win02(spark, d):
    return ts.volatility(daily(spark, d), "subject", "day", "score").select("subject", _day(), *_r("volatility"))


_STAB = """st AS (SELECT *, score - lag(score) OVER (PARTITION BY subject ORDER BY day) AS step FROM s),
st2 AS (SELECT *, CASE WHEN count(step) OVER w > 0 THEN greatest(sum(CASE WHEN step > 1e-9 THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN step < -1e-9 THEN 1 ELSE 0 END) OVER w, sum(CASE WHEN abs(step) <= 1e-9 THEN 1 ELSE 0 END) OVER w) / count(step) OVER w ELSE 1.0 END AS window_stability
 FROM st WINDOW w AS (PARTITION BY subject ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@query("win03_stability", f"WITH {S}, {_STAB} SELECT subject, CAST(day AS VARCHAR) AS day, round(CAST(window_stability AS DOUBLE), 6) AS window_stability FROM st2")
def win03(spark, d):
    return ts.stability(daily(spark, d), "subject", "day", "score").select("subject", _day(), *_r("window_stability"))


_G = """g AS (SELECT *, score - lag(score) OVER (PARTITION BY subject ORDER BY day) AS g,
 stddev_pop(score) OVER (PARTITION BY subject ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / greatest(abs(avg(score) OVER (PARTITION BY subject ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), 1e-9) AS vol FROM st2),
h AS (SELECT *, g - lag(g) OVER (PARTITION BY subject ORDER BY day) AS a FROM g)"""
_STATE = "CASE WHEN vol > 0.4 THEN 'volatile' WHEN g > 0.04 AND a > 0.02 THEN 'accelerating' WHEN g > 0.04 THEN 'rising' WHEN g < -0.04 THEN 'declining' ELSE 'stable' END"
_CONF = """CASE WHEN st = 'insufficient_evidence' THEN 0.0 ELSE 0.6 * least(CASE st WHEN 'volatile' THEN vol / 0.4
 WHEN 'accelerating' THEN greatest(greatest(coalesce(g, 0), 0) / 0.04, greatest(coalesce(a, 0), 0) / 0.02) WHEN 'rising' THEN greatest(coalesce(g, 0), 0) / 0.04
 WHEN 'declining' THEN -least(coalesce(g, 0), 0) / 0.04 ELSE 1 - least(abs(coalesce(g, 0)) / 0.03, 1) END, 1) + 0.4 * window_stability END"""


@query("win04_trend_state", f"WITH {S}, {_STAB}, {_G}, t AS (SELECT *, {_STATE} AS st FROM h) SELECT subject, CAST(day AS VARCHAR) AS day, st AS trend_state, round(CAST({_CONF} AS DOUBLE), 6) AS state_confidence FROM t")
def win04(spark, d):
    x = ts.stability(ts.volatility(ts.growth(daily(spark, d), "subject", "day", "score"), "subject", "day", "score"), "subject", "day", "score")
    x = x.withColumn("trend_state", ts.state(F.col("growth_rate"), F.col("acceleration"), F.col("volatility")))
    conf = ts.state_confidence(F.col("trend_state"), F.col("growth_rate"), F.col("acceleration"), F.col("volatility"), F.col("window_stability"))
    return x.select("subject", _day(), "trend_state", F.round(conf, 6).alias("state_confidence"))


_CAND = """c AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day) AS i, avg(score) OVER w AS bm, CASE WHEN count(score) OVER w >= 2 THEN (score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-9) END AS z
 FROM st2 WINDOW w AS (PARTITION BY subject ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT *, coalesce(abs(z) >= 2 AND abs(score - bm) >= 0.15, false) AS hit FROM c)"""


@query("win05_change_candidates", f"WITH {S}, {_STAB}, {_CAND} SELECT subject, CAST(day AS VARCHAR) AS day, round(bm, 6) AS baseline_mean, round(z, 4) AS z_score, hit AS is_candidate FROM c2")
def win05(spark, d):
    x = ts.change_candidates(daily(spark, d), "subject", "day", "score")
    return x.select("subject", _day(), *_r("baseline_mean"), F.round("z_score", 4).alias("z_score"), "is_candidate")


_RUNS = """isl AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY day) AS isl, avg(score) OVER (PARTITION BY subject ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS am,
 avg(score) OVER (PARTITION BY subject ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fm FROM c2),
r0 AS (SELECT *, count(*) OVER (PARTITION BY subject, isl) AS rl, row_number() OVER (PARTITION BY subject, isl ORDER BY day) AS k FROM isl WHERE hit),
runs AS (SELECT *, CASE WHEN am >= bm THEN 'rising' ELSE 'declining' END AS dir FROM r0 WHERE k = 1 AND rl >= 2)"""


@query("win06_change_runs", f"WITH {S}, {_STAB}, {_CAND}, {_RUNS} SELECT subject, CAST(day AS VARCHAR) AS day, rl AS run_length, round(bm, 6) AS before_mean, round(am, 6) AS after_mean, round(abs(am - bm), 6) AS magnitude, dir AS direction FROM runs")
def win06(spark, d):
    x = ts.change_runs(ts.change_candidates(daily(spark, d), "subject", "day", "score"), "subject", "day", "score")
    return x.select("subject", _day(), big(F.col("run_length")).alias("run_length"), *_r("before_mean", "after_mean", "magnitude"), "direction")


_PCONF = "0.35 * least(abs({a} - {b}) / greatest(abs({b}), 1e-9), 1) + 0.25 * least({l} / 2.0, 1) + 0.2 * least(sources / 6.0, 1) + 0.2 * window_stability"


@query("win07_change_confidence", f"WITH {S}, {_STAB}, {_CAND}, {_RUNS} SELECT subject, CAST(day AS VARCHAR) AS day, round(CAST({_PCONF.format(a='am', b='bm', l='rl')} AS DOUBLE), 6) AS confidence FROM runs")
def win07(spark, d):
    x = ts.change_runs(ts.change_candidates(ts.stability(daily(spark, d), "subject", "day", "score"), "subject", "day", "score"), "subject", "day", "score")
    conf = ts.change_confidence(F.col("before_mean"), F.col("after_mean"), F.col("run_length"), F.col("sources"), F.col("window_stability"))
    return x.select("subject", _day(), F.round(conf, 6).alias("confidence"))


_TURN = """tp AS (SELECT *, score - lag(score) OVER w AS up, lead(score) OVER w - score AS nx FROM c2 WINDOW w AS (PARTITION BY subject ORDER BY day)),
tq AS (SELECT *, count(nx) OVER f AS m, last_value(score) OVER f AS e, sum(CASE WHEN nx <= 1e-9 THEN 1 ELSE 0 END) OVER f AS fall, sum(CASE WHEN nx >= -1e-9 THEN 1 ELSE 0 END) OVER f AS rise, max(nx) OVER f AS mx, min(nx) OVER f AS mn
 FROM tp WINDOW f AS (PARTITION BY subject ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tr AS (SELECT *, CASE WHEN up > 1e-9 AND nx < -1e-9 AND abs(nx) < {mc} AND m >= 2 AND fall / m >= {cons} AND mx <= {mc} * 0.25 AND score - e >= {mc} THEN 'declining'
 WHEN up < -1e-9 AND nx > 1e-9 AND abs(nx) < {mc} AND m >= 2 AND rise / m >= {cons} AND -mn <= {mc} * 0.25 AND e - score >= {mc} THEN 'rising' END AS dir FROM tq),
turns AS (SELECT * FROM tr WHERE dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject, dir ORDER BY day) = 1)"""
_LOOSE = ts.TrendConfig(min_change=0.4, consistency=0.5)


@query("win08_turning_points", f"WITH {S}, {_STAB}, {_CAND}, {_TURN.format(mc=0.4, cons=0.5)} SELECT subject, CAST(day AS VARCHAR) AS day, dir AS direction FROM turns")
def win08(spark, d):
    return ts.turning_points(daily(spark, d), "subject", "day", "score", _LOOSE).select("subject", _day(), "direction")


_MERGE = """tm AS (SELECT t.* FROM turns t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.subject = t.subject AND abs(r.i - t.i) <= 1)),
tn AS (SELECT *, i - lag(i) OVER (PARTITION BY subject ORDER BY i) AS gap FROM tm), kept AS (SELECT * FROM tn WHERE gap IS NULL OR gap > 1)"""
_ANALYZE = f"""WITH {S}, {_STAB}, {_CAND}, {_RUNS}, {_TURN.format(mc=0.15, cons=0.75)}, {_MERGE}, {_G},
marks AS (SELECT subject, day, bm AS b, am AS a2, rl AS l, dir, 'rolling_baseline' AS method FROM runs
 UNION ALL SELECT k.subject, k.day, i.fm, i.am, (SELECT count(*) FROM s WHERE s.subject = k.subject AND s.day >= k.day), k.dir, 'direction_reversal' FROM kept k JOIN isl i ON i.subject = k.subject AND i.day = k.day),
gate AS (SELECT subject, max(least(ln(1 + n) / ln(11), 1)) AS sup FROM s GROUP BY 1),
t AS (SELECT h.*, m.b, m.a2, m.l, m.dir, m.method, sup >= 0.6 AS ok, CASE WHEN sup >= 0.6 THEN {_STATE} ELSE 'insufficient_evidence' END AS st FROM h JOIN gate USING (subject) LEFT JOIN marks m USING (subject, day))
SELECT subject, CAST(day AS VARCHAR) AS day, round(score, 6) AS score, st AS trend_state, round(g, 6) AS growth_rate, round(a, 6) AS acceleration, round(vol, 6) AS volatility, round(CAST(window_stability AS DOUBLE), 6) AS window_stability,
 round(CAST({_CONF} AS DOUBLE), 6) AS state_confidence, ok AND method IS NOT NULL AS is_change_point, method AS change_method, dir AS change_direction,
 round(CAST(CASE WHEN ok AND method IS NOT NULL THEN {_PCONF.format(a='a2', b='b', l='l')} END AS DOUBLE), 6) AS change_confidence FROM t"""


@query("win_trend_states", _ANALYZE)
def win11(spark, d):
    x = ts.analyze_series(daily(spark, d).withColumn("support", log_support(F.col("n"), 10)), "subject", "day", "score", "support", "sources")
    return x.select("subject", _day(), "trend_state", *_r("score", "growth_rate", "acceleration", "volatility", "window_stability", "state_confidence"), "is_change_point", "change_method", "change_direction", *_r("change_confidence"))


@query("win09_merged_turning_points", f"WITH {S}, {_STAB}, {_CAND}, {_RUNS}, {_TURN.format(mc=0.4, cons=0.5)}, {_MERGE} SELECT subject, CAST(day AS VARCHAR) AS day, dir AS direction FROM kept")
def win09(spark, d):
    from pyspark.sql.window import Window as W

    x = daily(spark, d).withColumn("window_index", big(F.row_number().over(W.partitionBy("subject").orderBy("day"))))
    runs = ts.change_runs(ts.change_candidates(x, "subject", "day", "score"), "subject", "day", "score")
    turns = ts.turning_points(x, "subject", "day", "score", _LOOSE)
    return ts.merge_turning_points(runs, turns, "subject", "window_index").select("subject", _day(), "direction")


@query("win10_support_gate", f"WITH {S} SELECT subject, CAST(day AS VARCHAR) AS day, max(ln(1 + n) / ln(41)) OVER (PARTITION BY subject) >= 0.6 AS sufficient FROM s")
def win10(spark, d):
    return ts.support_gate(daily(spark, d).withColumn("support", F.log1p("n") / F.log1p(F.lit(40.0))), "subject", "support").select("subject", _day(), "sufficient")


_T = "t AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, avg(value) / pi() AS x FROM events GROUP BY 1, 2)"


def by_type(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("i")).agg((F.avg("value") / F.pi()).alias("x"))


@query("win12_lead_lag", f"""WITH {_T}, e AS (SELECT a.event_type AS "leading", b.event_type AS lagging, l.lag, count(*) AS samples,
 round(coalesce(CASE WHEN stddev_pop(a.x) > 1e-12 AND stddev_pop(b.x) > 1e-12 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) END, 0), 6) AS correlation
 FROM t a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS lag) l JOIN t b ON b.i = a.i + l.lag AND a.event_type <> b.event_type AND (l.lag > 0 OR a.event_type < b.event_type) GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT "leading", "lagging", CAST(lag AS BIGINT) AS lag, samples, round(correlation, 5) AS correlation FROM e QUALIFY row_number() OVER (PARTITION BY least("leading", lagging), greatest("leading", lagging) ORDER BY abs(correlation) DESC, lag, "leading") = 1""")
def win12(spark, d):
    return ts.lead_lag(by_type(spark, d), "event_type", "i", "x").select("leading", "lagging", big(F.col("lag")).alias("lag"), "samples", F.round("correlation", 5).alias("correlation"))


_AB = "ab AS (SELECT i, max(x) FILTER (event_type = 'click') AS a, max(x) FILTER (event_type = 'purchase') AS b FROM t GROUP BY 1)"


def two(spark, d):
    return by_type(spark, d).groupBy("i").agg(F.max(F.when(F.col("event_type") == "click", F.col("x"))).alias("a"), F.max(F.when(F.col("event_type") == "purchase", F.col("x"))).alias("b"))


@query("win13_cross_correlation", f"""WITH {_T}, {_AB}, e AS (SELECT l.lag, count(*) AS samples, round(coalesce(CASE WHEN stddev_pop(p.a) > 1e-12 AND stddev_pop(q.b) > 1e-12 THEN covar_pop(p.a, q.b) / (stddev_pop(p.a) * stddev_pop(q.b)) END, 0), 4) AS correlation
 FROM ab p CROSS JOIN (SELECT unnest(range(-4, 5)) AS lag) l JOIN ab q ON q.i = p.i + l.lag GROUP BY 1)
SELECT CAST(lag AS BIGINT) AS lag, samples, correlation, row_number() OVER (ORDER BY abs(correlation) DESC, lag) = 1 AS is_best FROM e""")
def win13(spark, d):
    return ts.cross_correlation(two(spark, d), "i", "a", "b").select(big(F.col("lag")).alias("lag"), "samples", "correlation", "is_best")


@query("win14_rolling_stability", f"""WITH {S}, m AS (SELECT *, count(*) OVER w AS k, round(avg(score) OVER w, 4) AS m FROM s WINDOW w AS (PARTITION BY subject ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
a AS (SELECT subject, count(*) AS n, max(m) FILTER (k = 4) - min(m) FILTER (k = 4) AS mr, max(score) - min(score) AS vr FROM m GROUP BY 1)
SELECT subject, n, round(mr, 4) AS mean_range, round(vr, 6) AS value_range, CASE WHEN n < 4 THEN true ELSE mr < 0.5 * vr END AS is_stationary FROM a""")
def win14(spark, d):
    return ts.rolling_stability(daily(spark, d), "subject", "day", "score").select("subject", "n", F.round("mean_range", 4).alias("mean_range"), *_r("value_range"), "is_stationary")


@query("win15_spurious_warnings")
def win15(spark, d):
    return ts.spurious_warnings(two(spark, d).withColumn("pair", F.lit("click/purchase")), "pair", "i", "a", "b")


_U = "u AS (SELECT user_id % 20 AS subject, event_type AS source, avg(value) / pi() AS x FROM events WHERE user_id % 7 <> length(event_type) GROUP BY 1, 2)"


def by_user(spark, d):
    e = table(spark, d, "events").filter(F.col("user_id") % 7 != F.length("event_type"))
    return e.groupBy((F.col("user_id") % 20).alias("subject"), F.col("event_type").alias("source")).agg((F.avg("value") / F.pi()).alias("x"))


@query("win16_source_ablation", f"""WITH {_U}, b AS (SELECT subject, sum(x) AS s, count(*) AS n, avg(x) AS bs FROM u GROUP BY 1), br AS (SELECT *, row_number() OVER (ORDER BY bs DESC, subject) - 1 AS rk FROM b),
g AS (SELECT br.*, r.source, u.x, CASE WHEN n - CASE WHEN u.x IS NULL THEN 0 ELSE 1 END > 0 THEN (s - coalesce(u.x, 0)) / (n - CASE WHEN u.x IS NULL THEN 0 ELSE 1 END) ELSE bs END AS ab FROM br CROSS JOIN (SELECT DISTINCT source FROM u) r LEFT JOIN u ON u.subject = br.subject AND u.source = r.source),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(ab, 9) DESC, subject) - 1 AS ar FROM g)
SELECT subject, source AS removed, round(bs, 6) AS base_score, rk AS base_rank, round(ab, 6) AS ablated_score, ar AS ablated_rank, rk - ar AS rank_delta, ar - rk AS rank_drop, round(bs - ab, 6) AS score_delta FROM h WHERE x IS NOT NULL AND n > 1""")
def win16(spark, d):
    x = ts.source_ablation(by_user(spark, d), "subject", "source", "x")
    return x.select("subject", "removed", *_r("base_score"), "base_rank", *_r("ablated_score"), "ablated_rank", "rank_delta", "rank_drop", *_r("score_delta"))


@query("win17_enterprise_ablation", f"WITH {_U} SELECT subject, source, round((100 - greatest(0, 100 - x)) / 100, 6) AS delta FROM u")
def win17(spark, d):
    return by_user(spark, d).select("subject", "source", F.round(ts.enterprise_ablation(F.lit(100.0), F.col("x")), 6).alias("delta"))


def series(spark, d):
    return ts.series_array(daily(spark, d), "subject", "day", "score")


@query("win18_moving_average", V + " SELECT subject, round(list_avg(v[-4:]), 6) AS forecast FROM v")
def win18(spark, d):
    return series(spark, d).select("subject", F.round(ts.moving_average_forecast(F.col("values")), 6).alias("forecast"))


@query("win19_ewma", V + " SELECT subject, round(list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a), 6) AS forecast FROM v")
def win19(spark, d):
    return series(spark, d).select("subject", F.round(ts.ewma_forecast(F.col("values")), 6).alias("forecast"))


_RIDGE = f"""WITH {S}, x AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY subject) AS m FROM s),
f AS (SELECT subject, m, avg(score) AS ym, sum(score * (i - (m - 1) / 2)) / (sum((i - (m - 1) / 2) * (i - (m - 1) / 2)) + 0.1) AS slope FROM x GROUP BY 1, 2)"""


@query("win20_ridge_trend", _RIDGE + " SELECT subject, CAST(k AS BIGINT) AS step, round(greatest(0, ym + slope * (m + k - 1 - (m - 1) / 2)), 6) AS forecast FROM f, (SELECT unnest([1, 2, 3]) AS k)")
def win20(spark, d):
    x = series(spark, d).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return x.select("subject", big(F.col("step")).alias("step"), F.round(ts.ridge_forecast(F.col("values"), F.col("step")), 6).alias("forecast"))


@query("win21_backtest", V + """, o AS (SELECT subject, v, n, unnest(range(3, n)) AS origin FROM v), f AS (SELECT subject, origin, v, least(4, n - origin) AS h, list_avg(v[greatest(1, origin - 3):origin]) AS p FROM o),
e AS (SELECT subject, origin, abs(p - v[origin + k]) AS e, abs(v[origin + k]) AS s FROM f, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= h)
SELECT subject, origin, count(*) AS horizon, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e / greatest(s, 1e-6)), 4) AS mape FROM e GROUP BY 1, 2""")
def win21(spark, d):
    x = ts.backtest(series(spark, d), "subject", "moving_average")
    return x.select("subject", big(F.col("origin")).alias("origin"), "horizon", *_r("mae", "rmse"), F.round("mape", 4).alias("mape"))


@query("win22_forecast_rows", _RIDGE + """ SELECT subject, i + 1 AS position, round(score, 6) AS value, true AS is_observed FROM x
UNION ALL SELECT subject, m + k, round(greatest(0, ym + slope * (m + k - 1 - (m - 1) / 2)), 6), false FROM f, (SELECT unnest([1, 2, 3]) AS k)""")
def win22(spark, d):
    return ts.forecast_rows(series(spark, d), "subject", "ridge").select("subject", "position", *_r("value"), "is_observed")


@query("win23_conformal_interval", V + """, o AS (SELECT subject, v, n, unnest(range(2, n)) AS k FROM v), e AS (SELECT subject, list(abs(v[k + 1] - list_reduce(v[1:k], lambda a, x: 0.3 * x + 0.7 * a)) ORDER BY k) AS e FROM o GROUP BY 1),
r AS (SELECT v.subject, v.n, list_reduce(v.v, lambda a, x: 0.3 * x + 0.7 * a) AS f, list_sort(e.e[-4:])[4] AS rad FROM v JOIN e USING (subject))
SELECT subject, round(f, 6) AS forecast, n >= 5 AS is_reliable, round(greatest(0, f - rad), 6) AS lower, round(f + rad, 6) AS upper FROM r""")
def win23(spark, d):
    return ts.conformal_interval(series(spark, d), "subject", "ewma", top=None).select("subject", *_r("forecast"), "is_reliable", *_r("lower", "upper"))


@query("win24_bottom_up", """WITH c AS (SELECT r_name, n_name, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT CAST(0 AS BIGINT) AS level, '' AS node, CAST(sum(k) AS BIGINT) AS value FROM c UNION ALL SELECT 1, r_name, CAST(sum(k) AS BIGINT) FROM c GROUP BY 2 UNION ALL SELECT 2, r_name || '/' || n_name, k FROM c""")
def win24(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ts.bottom_up(c.groupBy("r_name", "n_name").agg(F.count("*").alias("k")), ["r_name", "n_name"], "k")


@query("win24_top_down", """WITH c AS (SELECT n_regionkey, n_name, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT CAST(n_regionkey AS BIGINT) AS parent, n_name AS child, round(1000.0 * k / sum(k) OVER (PARTITION BY n_regionkey), 6) AS reconciled FROM c""")
def win24b(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(big(F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("child")).agg(F.count("*").cast("double").alias("k"))
    return ts.top_down(c.withColumn("total", F.lit(1000.0)), "parent", "child", "k", "total").select("parent", "child", *_r("reconciled"))


@query("win26_damped_holt", V + """ SELECT subject, round(CASE WHEN n = 1 THEN v[1] ELSE greatest(0, z.l + z.b) END, 6) AS forecast FROM (SELECT subject, v, n,
 list_reduce(list_transform(v, lambda x, i: {'l': x, 'b': (v[-1] - v[1]) / greatest(n - 1, 1)}), lambda s, x: {'l': 0.3 * x.l + 0.7 * (s.l + 0.9 * s.b), 'b': 0.1 * ((0.3 * x.l + 0.7 * (s.l + 0.9 * s.b)) - s.l) + 0.9 * 0.9 * s.b}) AS z FROM v)""")
def win26(spark, d):
    return series(spark, d).select("subject", F.round(ts.holt_forecast(F.col("values")), 6).alias("forecast"))


@query("win28_naive", V + " SELECT subject, round(v[-1], 6) AS forecast FROM v")
def win28(spark, d):
    return series(spark, d).select("subject", F.round(ts.naive_forecast(F.col("values")), 6).alias("forecast"))


@query("win30_share_growth", """WITH e AS (SELECT event_type AS c, date_trunc('week', ts) AS w FROM events), t AS (SELECT w, count(*) AS t FROM e GROUP BY 1),
x AS (SELECT min(w) AS w0, max(w) AS w1, arg_min(t, w) AS t0, arg_max(t, w) AS t1, count(*) AS k FROM t), o AS (SELECT c, count(*) FILTER (w = w0) / any_value(t0) AS s0, count(*) FILTER (w = w1) / any_value(t1) AS s1, any_value(t0) AS t0 FROM e, x WHERE k >= 3 GROUP BY 1)
SELECT c AS cluster, round(s0, 6) AS first_share, round(s1, 6) AS last_share, round((s1 - s0) / greatest(s0, 1 / t0), 6) AS relative_change, round(0.5 + 0.5 * tanh((s1 - s0) / greatest(s0, 1 / t0)), 6) AS growth_score FROM o""")
def win30(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("cluster"), F.date_trunc("week", "ts").alias("w"))
    return ts.share_growth(e, "cluster", "w").select("cluster", *_r("first_share", "last_share", "relative_change", "growth_score"))


@query("win31_trajectories", f"""WITH {S}, v AS (SELECT subject, list(score ORDER BY day) AS v, list(n ORDER BY day) AS c, list(sources ORDER BY day) AS u FROM s GROUP BY 1)
SELECT subject, len(v) AS window_count, c[-1] - c[1] AS delta_n, u[-1] - u[1] AS delta_sources, round(v[-1] - v[1], 6) AS delta_score, round(list_reduce(v, lambda a, x: 0.5 * x + 0.5 * a), 6) AS ema_score FROM v""")
def win31(spark, d):
    x = ts.trajectory_signals(daily(spark, d), "subject", "day", ["n", "sources", "score"], "score")
    return x.select("subject", "window_count", "delta_n", "delta_sources", *_r("delta_score", "ema_score"))


@query("win32_survival", """WITH o AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS w, event_type FROM events), e AS (SELECT max(w) AS e FROM o), st AS (SELECT user_id, min(w) AS sw, max(w) AS lw FROM o GROUP BY 1),
k AS (SELECT unnest(['purchase', 'signup']) AS event), h AS (SELECT user_id, event_type AS event, min(w) AS ew FROM o WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2)
SELECT user_id, event, sw AS start_window, lw AS last_observed_window, ew AS event_window, greatest(0, coalesce(ew, e) - sw) AS duration, ew IS NULL AS censored FROM st CROSS JOIN k LEFT JOIN h USING (user_id, event) CROSS JOIN e""")
def win32(spark, d):
    o = table(spark, d, "events").select("user_id", big(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))).alias("w"), F.col("event_type").alias("event"))
    x = ts.survival(o, o.filter(F.col("event").isin("purchase", "signup")), "user_id", "w", "event")
    return x.select("user_id", "event", "start_window", "last_observed_window", "event_window", big(F.col("duration")).alias("duration"), "censored")


@query("win36_experience_months", """WITH i AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 90 AS INTEGER) AS b FROM orders),
g AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w THEN 1 ELSE 0 END AS nw FROM i WINDOW w AS (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS gi FROM g), m AS (SELECT k, gi, min(a) AS a, max(b) AS b FROM h GROUP BY 1, 2)
SELECT k AS custkey, round(sum(date_diff('day', a, b)) / 30.4375, 6) AS months FROM m GROUP BY 1""")
def win36(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (30 + F.col("o_orderkey") % 90).cast("int")).alias("b"))
    return ts.months_of(o, "custkey", "a", "b").select("custkey", *_r("months"))


@query("agg11_weekly_terms", """WITH e AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type || CAST(user_id % 40 AS VARCHAR) AS term FROM events WHERE NOT (user_id % 40 = 7 AND ts < TIMESTAMP '2024-01-27')), c AS (SELECT week, term, count(*) AS n FROM e GROUP BY 1, 2),
w AS (SELECT week, row_number() OVER (ORDER BY week DESC) AS r FROM (SELECT DISTINCT week FROM c)), p AS (SELECT count(*) AS k FROM w WHERE r BETWEEN 2 AND 5),
t AS (SELECT term, sum(n) FILTER (r = 1) AS c, coalesce(sum(n) FILTER (r > 1), 0) AS b FROM c JOIN w USING (week) WHERE r <= 5 GROUP BY 1)
SELECT term, CAST(c AS BIGINT) AS count, round(CASE WHEN k > 0 AND b > 0 THEN c / (b / k) - 1 END, 6) AS growth, CASE WHEN k = 0 THEN 'insufficient_history' WHEN b = 0 THEN 'newly_observed' ELSE 'observed' END AS trend_status FROM t, p WHERE c IS NOT NULL""")
def agg11(spark, d):
    e = table(spark, d, "events").filter(~((F.col("user_id") % 40 == 7) & (F.col("ts") < F.lit("2024-01-27").cast("timestamp"))))
    e = e.select(week_start(F.col("ts")).alias("week"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("term"))
    return ts.weekly_terms(e, "week", "term").select("term", "count", *_r("growth"), "trend_status")
