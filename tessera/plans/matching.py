"""Matching, ranking, forecasting-model and streaming-form queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import big
from tessera.operators import forecasting as fc
from tessera.operators import matching as mt
from tessera.operators import ranking as rk
from tessera.streaming import events as st

from .registry import query, spread, table
from .timeseries import series

#: Candidates are customers, requirements ten per position, items one per pair.
_IT = """it AS (SELECT c_custkey AS cand, p.position, r.req, r.req % 3 AS dim, CASE (c_custkey * 3 + p.position * 5 + r.req * 7) % 7 WHEN 0 THEN 'matched' WHEN 1 THEN 'matched' WHEN 2 THEN 'weak' WHEN 3 THEN 'declared_only' WHEN 4 THEN 'missing' WHEN 5 THEN 'unknown' ELSE 'matched' END AS status,
 CASE (c_custkey + r.req) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'transferable' ELSE 'related' END AS mtype, ((c_custkey * 11 + r.req) % 50 + 50) / 100.0 AS rc FROM customer, (SELECT unnest(range(4)) AS position) p, (SELECT unnest(range(10)) AS req) r),
si AS (SELECT *, CASE WHEN status = 'unknown' THEN NULL WHEN status = 'missing' THEN 0.0 WHEN status = 'weak' THEN 0.5 WHEN status = 'declared_only' THEN 0.3 WHEN mtype = 'exact' THEN 1.0 WHEN mtype = 'equivalent' THEN 0.9 WHEN mtype = 'transferable' THEN 0.6 * rc ELSE 0.0 END::DOUBLE AS score FROM it)"""


def items(spark, d):
    c = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("cand")), "cand", rows=10_000)  # forty items each
    x = c.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>"))).withColumn("req", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")))
    k = (F.col("cand") * 3 + F.col("position") * 5 + F.col("req") * 7) % 7
    s = F.when(k.isin(0, 1, 6), "matched").when(k == 2, "weak").when(k == 3, "declared_only").when(k == 4, "missing").otherwise("unknown")
    m = (F.col("cand") + F.col("req")) % 4
    t = F.when(m == 0, "exact").when(m == 1, "equivalent").when(m == 2, "transferable").otherwise("related")
    x = x.withColumn("dim", (F.col("req") % 3).cast("string")).withColumn("status", s).withColumn("mtype", t).withColumn("rc", ((F.col("cand") * 11 + F.col("req")) % 50 + 50) / 100.0)
    return x.withColumn("score", mt.item_score(F.col("status"), F.col("mtype"), F.col("rc")))


@query("mat24_item_scores", f"WITH {_IT} SELECT cand, position, req, round(score, 6) AS score FROM si")
def mat24(spark, d):
    return items(spark, d).select("cand", "position", "req", F.round("score", 6).alias("score"))


_DIM = "dg AS (SELECT cand, position, dim, avg(score) AS s, avg(rc) FILTER (score IS NOT NULL) AS c, CASE dim WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM si GROUP BY 1, 2, 3), ds AS (SELECT cand, position, 100 * sum(s * w) / sum(w) FILTER (s IS NOT NULL) AS score, sum(c * w) FILTER (s IS NOT NULL) / sum(w) FILTER (s IS NOT NULL) AS confidence, coalesce(sum(w) FILTER (s IS NOT NULL), 0) / sum(w) AS coverage FROM dg GROUP BY 1, 2)"


def scored(spark, d):
    return mt.dimension_score(items(spark, d), ["cand", "position"], "dim", "score", "rc", {"0": 0.5, "1": 0.3, "2": 0.2})


@query("mat25_dimension_scores", f"WITH {_IT}, {_DIM} SELECT cand, position, round(score, 6) AS score, round(confidence, 6) AS confidence, round(coverage, 6) AS coverage FROM ds")
def mat25(spark, d):
    return scored(spark, d).select("cand", "position", *[F.round(c, 6).alias(c) for c in ("score", "confidence", "coverage")])


_GATE = "hc AS (SELECT cand, position, CASE (cand + position + h) % 9 WHEN 0 THEN 'fail' WHEN 1 THEN 'unknown' WHEN 2 THEN 'not_required' ELSE 'pass' END AS st FROM (SELECT DISTINCT cand, position FROM it), (SELECT unnest(range(2)) AS h)), hg AS (SELECT cand, position, CASE WHEN count(*) FILTER (st = 'fail') > 0 THEN 'failed' WHEN count(*) FILTER (st IN ('unknown', 'unresolved')) > 0 THEN 'uncertain' WHEN count(*) FILTER (st = 'pass') > 0 THEN 'passed' ELSE 'not_applicable' END AS gate FROM hc GROUP BY 1, 2)"


def gates(spark, d):
    x = items(spark, d).select("cand", "position").distinct().withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    k = (F.col("cand") + F.col("position") + F.col("h")) % 9
    return mt.hard_gate(x.withColumn("st", F.when(k == 0, "fail").when(k == 1, "unknown").when(k == 2, "not_required").otherwise("pass")), ["cand", "position"], "st")


@query("mat20_hard_gates", f"WITH {_IT}, {_GATE} SELECT cand, position, gate FROM hg")
def mat20(spark, d):
    return gates(spark, d)


@query("mat28_recommendations", f"WITH {_IT}, {_DIM}, {_GATE} SELECT cand, position, CASE WHEN gate = 'failed' THEN 'not_recommended' WHEN score IS NULL OR confidence < 0.4 THEN 'insufficient_information' WHEN score >= 60 AND gate IN ('passed', 'not_applicable') THEN 'strong_match' WHEN score >= 45 THEN 'potential_match' WHEN score >= 30 THEN 'weak_match' ELSE 'not_recommended' END AS recommendation FROM ds JOIN hg USING (cand, position)")
def mat28(spark, d):
    x = scored(spark, d).join(gates(spark, d).hint("merge"), ["cand", "position"])
    return x.select("cand", "position", mt.recommendation(F.col("score"), F.col("confidence"), F.col("gate"), (60.0, 45.0, 30.0)).alias("recommendation"))


@query("mat21_scalar_match", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN list_has_any(['f', 'o'], [lower(o_orderstatus)]) ELSE lower(o_orderstatus) = 'p' END AS matched FROM orders")
def mat21(spark, d):
    one = F.col("o_orderkey") % 2 == 0
    return table(spark, d, "orders").select("o_orderkey", mt.scalar_match(F.when(one, "F | O").otherwise(" p "), F.array("o_orderstatus"), one).alias("matched"))


@query("mat22_experience_bounds", "WITH b AS (SELECT c_custkey, (c_custkey % 40)::DOUBLE AS lo, (c_custkey % 40 + c_custkey % 3 * 6)::DOUBLE AS hi, (c_custkey % 4 * 12)::DOUBLE AS req FROM customer) SELECT c_custkey, CASE WHEN req <= 0 THEN 'pass' WHEN c_custkey % 11 = 0 THEN 'unknown' WHEN lo >= req THEN 'pass' WHEN hi < req THEN 'fail' ELSE 'unknown' END AS status FROM b")
def mat22(spark, d):
    k = F.col("c_custkey")
    lo = F.when(k % 11 != 0, (k % 40).cast("double"))
    return table(spark, d, "customer").select("c_custkey", mt.experience_status((k % 4 * 12).cast("double"), lo, lo + k % 3 * 6).alias("status"))


@query("mat23_skill_status", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 AND l_tax > 0.04 THEN 'declared_only' WHEN l_quantity < 5 THEN 'missing' WHEN l_linenumber % 2 = 0 OR l_quantity >= 20 THEN 'matched' ELSE 'weak' END AS status FROM lineitem")
def mat23(spark, d):
    q = F.col("l_quantity")
    s = mt.skill_status(F.when(q >= 5, F.col("l_partkey")), F.col("l_tax") > 0.04, q, F.when(F.col("l_linenumber") % 2 != 0, 20.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("status"))


@query("win35_ownership", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 >= 2 THEN 1.0 ELSE (o_orderkey % 4 + 1) / 4.0 END, 6)::DOUBLE AS factor FROM orders".replace("o_orderkey % 4 >= 2", "o_orderkey % 4 = 3"))
def win35(spark, d):
    k = F.col("o_orderkey")
    r = F.when(k % 3 == 0, "unknown").otherwise("Owned")
    c = F.when(k % 4 == 0, "declared").when(k % 4 == 1, "used").when(k % 4 == 2, "implemented").otherwise("led")
    return table(spark, d, "orders").select("o_orderkey", F.round(mt.ownership_factor(r, c), 6).alias("factor"))


@query("mat26_expected_dimensions", f"WITH {_IT}, m AS (SELECT cand, position, coalesce(list(DISTINCT dim) FILTER (status = 'matched'), []) AS made FROM si GROUP BY 1, 2) SELECT cand, position, array_to_string(list_filter([0, 1, 2], lambda x: NOT list_contains(made, x)), ',') AS missing FROM m")
def mat26(spark, d):
    g = items(spark, d).groupBy("cand", "position").agg(F.collect_set(F.when(F.col("status") == "matched", F.col("dim"))).alias("made"))
    return g.select("cand", "position", F.array_join(mt.expected_dimensions(F.array(F.lit("0"), F.lit("1"), F.lit("2")), F.col("made")), ",").alias("missing"))


@query("mat27_capped_shares")
def mat27(spark, d):
    x = items(spark, d).filter("position = 1").select("cand", "req", (F.col("rc") * (1 + F.col("req") % 4)).alias("w"))
    return mt.capped_shares(x, "cand", "req", "w", 0.15)


@query("mat29_transferable_coverage", f"WITH {_IT} SELECT cand, position, round(avg(coalesce(score, 0)) FILTER (status NOT IN ('unknown', 'unresolved')), 6) AS transferable_coverage FROM si GROUP BY 1, 2")
def mat29(spark, d):
    x = mt.transferable_coverage(items(spark, d), ["cand", "position"], "status", "score")
    return x.select("cand", "position", F.round("transferable_coverage", 6).alias("transferable_coverage"))


@query("mat31_gaps", f"WITH {_IT}, g AS (SELECT *, (1 - coalesce(score, 0)) * (1 + req % 3) AS loss, 5 + req * 2 AS cost FROM si), r AS (SELECT *, row_number() OVER w AS priority, sum(cost) OVER (PARTITION BY cand, position ORDER BY loss DESC, req ROWS UNBOUNDED PRECEDING) AS run FROM g WHERE loss > 0 WINDOW w AS (PARTITION BY cand, position ORDER BY loss DESC, req)) SELECT cand, position, req, round(loss, 6) AS loss, priority, CAST(run AS BIGINT) AS running_cost, run <= 40 AS within_budget FROM r")
def mat31(spark, d):
    x = items(spark, d).withColumn("imp", (1 + F.col("req") % 3).cast("double")).withColumn("cost", 5 + F.col("req") * 2)
    return mt.gaps(x, ["cand", "position"], "req", "score", "imp", "cost", 40.0).select("cand", "position", "req", F.round("loss", 6).alias("loss"), "priority", "running_cost", "within_budget")


@query("mat32_what_if", f"WITH {_IT}, a(scenario, r, v) AS (VALUES ('s1', 1, 1.0), ('s1', 2, 0.8), ('s2', 7, 1.0)), x AS (SELECT cand, position, s.scenario, coalesce(score, 0) AS b, greatest(coalesce(score, 0), coalesce(a.v, 0)) AS n, 1 + req % 3 AS w FROM si CROSS JOIN (SELECT DISTINCT scenario FROM a) s LEFT JOIN a ON a.scenario = s.scenario AND a.r = req) SELECT cand, position, scenario, round(100 * sum(b * w) / sum(w), 6) AS baseline, round(100 * sum(n * w) / sum(w), 6) AS scenario_score, round(100 * sum(n * w) / sum(w) - 100 * sum(b * w) / sum(w), 6) AS delta FROM x GROUP BY 1, 2, 3")
def mat32(spark, d):
    a = spark.createDataFrame([("s1", 1, 1.0), ("s1", 2, 0.8), ("s2", 7, 1.0)], "scenario string, req bigint, new_score double")
    x = mt.what_if(items(spark, d).withColumn("w", (1 + F.col("req") % 3).cast("double")), a, ["cand", "position"], "req", "score", "w")
    return x.select("cand", "position", "scenario", *[F.round(c, 6).alias(c) for c in ("baseline", "scenario_score", "delta")])


@query("mat33_outcomes", "WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'uncertain' ELSE 'passed' END AS gb, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'uncertain' ELSE 'passed' END AS ga, o_orderkey % 7 = 0 AS reached, o_orderkey % 11 = 0 AS ins, (o_orderkey % 13)::DOUBLE AS delta FROM orders), r AS (SELECT *, CASE gb WHEN 'failed' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END AS rb, CASE ga WHEN 'failed' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END AS ra FROM o) SELECT k, CASE WHEN ra < rb THEN 'no_effect' WHEN ga = 'failed' THEN 'hard_blocked' WHEN reached THEN 'reached' WHEN ins THEN 'insufficient_information' WHEN delta >= 5 THEN 'partial_effective' ELSE 'no_effect' END AS outcome FROM r")
def mat33(spark, d):
    k = F.col("o_orderkey")
    gb = F.when(k % 4 == 1, "failed").when(k % 4 == 2, "uncertain").otherwise("passed")
    ga = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "uncertain").otherwise("passed")
    after = F.when(k % 11 == 0, "insufficient_information").otherwise("weak_match")
    return table(spark, d, "orders").select(k.alias("k"), mt.what_if_outcome(gb, ga, F.lit("weak_match"), after, (k % 13).cast("double"), k % 7 == 0, F.lit(False)).alias("outcome"))


def _actions(spark, d):
    return items(spark, d).filter("position = 0").select("cand", F.col("req").alias("action"), (F.col("req") % 5).alias("target"), F.col("rc").alias("gain"), ((F.col("req") * 3) % 7).cast("double").alias("effort"))


@query("mat34_greedy_actions")
def mat34(spark, d):
    return mt.greedy_actions(_actions(spark, d), "cand", "action", "target", "gain", "effort", 2.0)


@query("mat35_best_subsets", f"WITH {_IT}, v AS (SELECT cand, list(rc ORDER BY req) AS g FROM it WHERE position = 0 GROUP BY 1), m AS (SELECT cand, g, unnest(range(1, 1024)) AS mask FROM v), t AS (SELECT cand, mask, bit_count(mask) AS size, list_sum(list_transform(g, lambda x, i: CASE WHEN mask & (1 << (i - 1)) <> 0 THEN x ELSE 0 END)) AS gain FROM m), f AS (SELECT * FROM t WHERE gain >= 2.0 QUALIFY row_number() OVER (PARTITION BY cand ORDER BY size, round(gain, 9) DESC, mask) = 1) SELECT cand, mask, CAST(size AS BIGINT) AS size, round(CAST(gain AS DOUBLE), 6) AS gain FROM f")
def mat35(spark, d):
    return mt.best_subset(_actions(spark, d), "cand", "action", "gain", 2.0).withColumn("gain", F.round("gain", 6))


@query("mat40_sufficiency", f"WITH {_IT}, g AS (SELECT cand, position, count(*) FILTER (status = 'unknown' AND req < 2) AS b, count(*) FILTER (status = 'unknown') AS m, count(*) FILTER (status = 'weak') AS n, count(*) FILTER (status = 'missing' AND req = 0) AS f FROM it GROUP BY 1, 2) SELECT cand, position, CASE WHEN b > 0 AND f = 0 THEN 'blocking' WHEN m > 0 THEN 'material' WHEN n > 0 THEN 'minor' ELSE 'sufficient' END AS level, concat_ws(',', CASE WHEN b > 0 AND f = 0 THEN 'required_uncertain' END, CASE WHEN m > 0 THEN 'uncertain' END, CASE WHEN n > 0 THEN 'weak' END) AS reasons FROM g")
def mat40(spark, d):
    u = F.col("status") == "unknown"
    g = items(spark, d).groupBy("cand", "position").agg(F.count_if(u & (F.col("req") < 2)).alias("b"), F.count_if(u).alias("m"), F.count_if(F.col("status") == "weak").alias("n"), F.count_if((F.col("status") == "missing") & (F.col("req") == 0)).alias("f"))
    x = mt.sufficiency(g, {"required_uncertain": F.col("b") > 0}, {"uncertain": F.col("m") > 0}, {"weak": F.col("n") > 0}, F.col("f") > 0)
    return x.select("cand", "position", "level", F.array_join("reasons", ",").alias("reasons"))


@query("clu17_requirement_trees", f"WITH {_IT}, l AS (SELECT cand, req, CASE WHEN status = 'unknown' THEN NULL WHEN status = 'missing' THEN 0 ELSE 1 END AS v FROM it WHERE position = 2), g AS (SELECT cand, CASE WHEN count(*) FILTER (v = 1 AND req < 4) >= 4 THEN 1 WHEN count(*) FILTER (v = 0 AND req < 4) > 0 THEN 0 END AS a, CASE WHEN count(*) FILTER (v = 1 AND req >= 4) >= 3 THEN 1 WHEN 6 - count(*) FILTER (v = 0 AND req >= 4) < 3 THEN 0 END AS b FROM l GROUP BY 1) SELECT cand, CAST(CASE WHEN a = 1 OR b = 1 THEN 1 WHEN a = 0 AND b = 0 THEN 0 END AS BIGINT) AS value FROM g")
def clu17(spark, d):
    v = F.when(F.col("status") == "missing", 0).when(F.col("status") != "unknown", 1)
    leaves = items(spark, d).filter("position = 2").select("cand", F.concat(F.lit("r"), F.col("req").cast("string")).alias("node"), v.alias("value"))
    rows = [("all", f"r{i}", "and", 0) for i in range(4)] + [("some", f"r{i}", "min", 3) for i in range(4, 10)] + [("root", "all", "or", 0), ("root", "some", "or", 0)]
    groups = spark.createDataFrame(rows, "parent string, child string, op string, need int")
    return mt.requirement_tree(leaves, groups, "cand", 2).filter("node = 'root'").select("cand", big(F.col("value")).alias("value"))


_TASK = "tk AS (SELECT o_orderkey AS task, o_custkey AS queue, o_orderstatus = 'O' AS blocking, o_orderkey % 7 AS unc, o_orderkey % 13 AS imp, o_orderkey % 12 AS reuse, (o_orderkey % 40)::DOUBLE AS wait FROM orders)"


def tasks(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(k.alias("task"), F.col("o_custkey").alias("queue"), (F.col("o_orderstatus") == "O").alias("blocking"), (k % 7).alias("unc"), (k % 13).alias("imp"), (k % 12).alias("reuse"), (k % 40).cast("double").alias("wait"), (k % 9).alias("object"), F.col("o_orderstatus").alias("type"), (k % 5).alias("subject"), (1 + k % 3).cast("double").alias("cost"))
    return t.withColumn("value", rk.value(F.col("blocking"), F.col("unc"), F.col("imp"), F.col("reuse"), F.col("wait")))


@query("srt04_review_values", f"WITH {_TASK}, v AS (SELECT *, 0.4 * CASE WHEN blocking THEN 1 ELSE 0 END + 0.25 * least(unc, 5) / 5.0 + 0.2 * least(imp, 10) / 10.0 + 0.13 * least(reuse, 10) / 10.0 + 0.02 * least(wait, 30) / 30.0 AS v FROM tk) SELECT task, queue, round(v, 6) AS value, row_number() OVER (PARTITION BY queue ORDER BY round(v, 9) DESC, task) AS rank FROM v")
def srt04(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("queue").orderBy(F.desc(F.round("value", 9)), "task")
    return tasks(spark, d).select("task", "queue", F.round("value", 6).alias("value"), big(F.row_number().over(w)).alias("rank"))


@query("srt05_mmr_queue")
def srt05(spark, d):
    return rk.greedy_queue(tasks(spark, d), "queue", "task", "value", ["object", "type", "subject"], cost="cost", mode="mmr")


@query("srt06_coverage_queue")
def srt06(spark, d):
    return rk.greedy_queue(tasks(spark, d), "queue", "task", "value", ["object", "type", "subject"])


@query("srt08_blocking_queue")
def srt08(spark, d):
    return rk.greedy_queue(tasks(spark, d), "queue", "task", "value", ["object", "type", "subject"], group="object", blocking="blocking", penalty=0.05)


@query("srt07_review_values", f"WITH {_TASK}, v AS (SELECT task, CASE WHEN reuse % 4 > 0 THEN round((unc % 3 + 0.62) / (reuse % 4 + 2.0), 6) ELSE 0.31 END AS p, CASE WHEN reuse > 0 THEN ln(1 + greatest(reuse - reuse % 4, 0)) / ln(1 + reuse) ELSE 0 END AS spread, blocking, imp, wait, 1 + task % 3 AS cost, 0.4 * CASE WHEN blocking THEN 1 ELSE 0 END + 0.25 * least(unc, 5) / 5.0 + 0.2 * least(imp, 10) / 10.0 + 0.13 * least(reuse, 10) / 10.0 + 0.02 * least(wait, 30) / 30.0 AS base FROM tk) SELECT task, round(CAST(p * (0.4 * CASE WHEN blocking THEN 1 ELSE 0 END + 0.3 * least(imp / 10.0, 1) + 0.3 * spread) / cost + 0.02 * least(wait, 30) / 30.0 AS DOUBLE), 6) AS expected, round(CAST(0.6 * least(base, 1) + 0.4 AS DOUBLE), 6) AS normalized FROM v")
def srt07(spark, d):
    t = tasks(spark, d)
    x = rk.expected_review_value(F.col("blocking"), F.col("imp"), F.col("reuse"), F.col("reuse") % 4, F.col("unc") % 3, F.col("cost"), F.col("wait"))
    return t.select("task", F.round(x, 6).alias("expected"), F.round(rk.normalized_value(F.col("value"), F.lit(0.0)), 6).alias("normalized"))


@query("srt11_mapping_priority", f"WITH {_TASK} SELECT task, round(0.4 * unc / 7.0 + 0.3 * imp / 13.0 + 0.3 * reuse / 12.0, 6) AS priority FROM tk")
def srt11(spark, d):
    t = tasks(spark, d).withColumn("a", F.col("unc") / 7.0).withColumn("b", F.col("imp") / 13.0).withColumn("c", F.col("reuse") / 12.0)
    return t.select("task", F.round(rk.priority({"a": 0.4, "b": 0.3, "c": 0.3}), 6).alias("priority"))


@query("win25_fourier_trend")
def win25(spark, d):
    return fc.model_forecast(series(spark, d), "subject", "fourier_trend")


@query("win27_arima")
def win27(spark, d):
    return fc.model_forecast(series(spark, d), "subject", "arima")


@query("win29_model_competition")
def win29(spark, d):
    return fc.competition(series(spark, d), "subject", ["ridge", "moving_average", "ewma", "holt", "naive", "fourier_trend", "arima"])


@query("stm06_weekly_counts", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm06(spark, d):
    return st.weekly_counts(table(spark, d, "events"), "ts", "1 day", "event_type")


@query("stm07_sliding_counts", "WITH w AS (SELECT e.event_type, CAST(epoch(ts) AS BIGINT) // 259200 - k AS b FROM events e, (SELECT unnest([0, 1, 2]) AS k)) SELECT strftime(make_timestamp(b * 259200 * 1000000), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2".replace("CAST(epoch(ts) AS BIGINT)", "CAST(floor(epoch(ts)) AS BIGINT)"))
def stm07(spark, d):
    return st.sliding_counts(table(spark, d, "events"), "ts", "1 day", "event_type")


@query("stm08_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s")
def stm08(spark, d):
    return st.session_groups(table(spark, d, "events"), "ts", "12 hours", "1 day", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stm09_late_rows", "SELECT event_id, ts < TIMESTAMP '2024-01-10' AS is_late FROM events")
def stm09(spark, d):
    return st.late_split(table(spark, d, "events"), "ts", "2024-01-10").select("event_id", "is_late")


@query("stm11_change_detection", "WITH k AS (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) % 3 AS v FROM events WHERE ts < TIMESTAMP '2024-01-03'), t AS (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) % 3 AS v FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06') SELECT user_id, event_type, v, CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = t.user_id AND k.event_type = t.event_type) THEN 'new' WHEN EXISTS (SELECT 1 FROM k WHERE k.user_id = t.user_id AND k.event_type = t.event_type AND k.v = t.v) THEN 'repeated' ELSE 'updated' END AS change FROM t")
def stm11(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", (F.floor("value") % 3).alias("v"), "ts")
    t0, t1 = (F.lit(x).cast("timestamp") for x in ("2024-01-03", "2024-01-06"))
    return st.changes(e.filter((F.col("ts") >= t0) & (F.col("ts") < t1)).select("user_id", "event_type", "v").distinct(), e.filter(F.col("ts") < t0), ["user_id", "event_type"], "v")
