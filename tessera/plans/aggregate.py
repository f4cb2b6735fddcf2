"""Aggregate queries on order lines, labels, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import big, freshness, log_support
from tessera.operators import aggregate as ag

from .registry import query, spread, table
from .relational import FACTS, facts

_BEST = "b AS (SELECT position, skill, doc, arg_max(modality, CASE modality WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 ELSE 1 END) AS modality, max(w) AS w, min(ent) AS ent, min(source) AS source, max(day) AS day FROM f GROUP BY 1, 2, 3)"


def best(spark, d):
    extra = [F.max("w").alias("w"), F.min("ent").alias("ent"), F.min("source").alias("source"), F.max("day").alias("day")]
    return ag.best_modality(facts(spark, d), ["position", "skill", "doc"], "modality", extra)


def _r(*names, k=6):
    return [F.round(n, k).alias(n) for n in names]


@query("agg05_best_modality", f"WITH {FACTS}, {_BEST} SELECT position, skill, doc, modality FROM b")
def agg05(spark, d):
    return best(spark, d).select("position", "skill", "doc", "modality")


_MET = """m AS (SELECT position, skill, count(*) AS support_documents, count(DISTINCT source) AS sources, count(DISTINCT ent) AS enterprises, count(*) / any_value(nd) AS support_ratio, least(1.0, greatest(sum(w), 0.0001) / any_value(nd)) AS weighted_frequency,
 coalesce(sum(w) FILTER (modality = 'required'), 0) / greatest(sum(w), 0.0001) AS required_ratio, coalesce(sum(w) FILTER (modality = 'preferred'), 0) / greatest(sum(w), 0.0001) AS preferred_ratio, coalesce(sum(w) FILTER (modality = 'bonus'), 0) / greatest(sum(w), 0.0001) AS bonus_ratio,
 avg(exp(-greatest(0, date_diff('day', day, DATE '2002-01-01')) / 365.0)) AS freshness, avg(CASE WHEN ent % 3 = 0 THEN 1.0 ELSE 0.0 END) AS trusted_ratio FROM b, (SELECT count(DISTINCT doc) / 20 AS nd FROM f) GROUP BY 1, 2)"""


def metrics(spark, d):
    b = best(spark, d).withColumn("fresh", freshness(F.lit("2002-01-01").cast("date"), F.col("day"), 365.0)).withColumn("trusted", F.col("ent") % 3 == 0)
    n = facts(spark, d).agg((F.countDistinct("doc") / 20).alias("nd"))
    return ag.relation_metrics(b.crossJoin(F.broadcast(n)), ["position", "skill"], F.col("nd"), "w", "source", "ent", "fresh", "trusted")


@query("agg06_relation_metrics", f"WITH {FACTS}, {_BEST}, {_MET} SELECT position, skill, support_documents, sources, enterprises, round(support_ratio, 6) AS support_ratio, round(weighted_frequency, 6) AS weighted_frequency, round(required_ratio, 6) AS required_ratio, round(preferred_ratio, 6) AS preferred_ratio, round(bonus_ratio, 6) AS bonus_ratio, round(freshness, 6) AS freshness, round(trusted_ratio, 6) AS trusted_ratio FROM m")
def agg06(spark, d):
    return metrics(spark, d).select("position", "skill", "support_documents", "sources", "enterprises", *_r("support_ratio", "weighted_frequency", "required_ratio", "preferred_ratio", "bonus_ratio", "freshness", "trusted_ratio"))


_SCORE = """sc AS (SELECT *, required_ratio + 0.7 * preferred_ratio + 0.4 * bonus_ratio AS ms, least(1.0, sources / 3.0) AS sd, least(1.0, enterprises / 5.0) AS ec, least(1.0, support_documents / 10.0) AS ss FROM m),
sw AS (SELECT *, greatest(0.0, least(1.0, 0.25 * weighted_frequency + 0.2 * support_ratio + 0.2 * ms + 0.1 * sd + 0.1 * ec + 0.1 * freshness + 0.05 * trusted_ratio)) AS weight, greatest(0.0, least(1.0, 0.3 * weighted_frequency + 0.4 * ss + 0.15 * trusted_ratio + 0.15 * sd)) AS confidence FROM sc)"""


@query("agg07_relation_scores", f"""WITH {FACTS}, {_BEST}, {_MET}, {_SCORE} SELECT position, skill, round(weight, 6) AS weight, round(confidence, 6) AS confidence, CASE WHEN weight >= 0.7 THEN 'core' WHEN weight >= 0.4 THEN 'important' ELSE 'supplementary' END AS importance,
 concat_ws(',', CASE WHEN confidence < 0.7 THEN 'medium_or_low_confidence' END, CASE WHEN support_documents < 2 THEN 'insufficient_evidence' END) AS review_reasons FROM sw""")
def agg07(spark, d):
    return ag.score_relation(metrics(spark, d)).select("position", "skill", *_r("weight", "confidence"), "importance", "review_reasons")


@query("agg09_aggregate_groups", "WITH x AS (SELECT CASE p_size % 4 WHEN 0 THEN 'education' WHEN 1 THEN 'experience' WHEN 2 THEN 'responsibility' ELSE 'certificate' END AS kind, p_brand AS text, p_partkey AS doc FROM part WHERE p_size % 4 <> 3 OR p_brand = 'Brand#2'), g AS (SELECT kind, text, array_to_string(list_sort(list(DISTINCT doc)), ',') AS documents, count(*) AS rows FROM x GROUP BY 1, 2) SELECT kind, text, documents, rows, kind IN ('education', 'experience', 'certificate') AND count(*) OVER (PARTITION BY kind) > 1 AS conflict, rows < 2 AS low_confidence FROM g")
def agg09(spark, d):
    k = F.col("p_size") % 4
    x = table(spark, d, "part").filter("p_size % 4 <> 3 or p_brand = 'Brand#2'").select(F.when(k == 0, "education").when(k == 1, "experience").when(k == 2, "responsibility").otherwise("certificate").alias("kind"), F.col("p_brand").alias("text"), F.col("p_partkey").alias("doc"))
    return ag.aggregate_groups(x, "kind", "text", "doc").withColumn("documents", F.array_join("documents", ","))


@query("agg10_reason_histogram", "SELECT reason, count(*) AS count FROM (SELECT unnest([CASE WHEN l_quantity < 10 THEN 'light' END, CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END]) AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY 1")
def agg10(spark, d):
    r = F.array_compact(F.array(F.when(F.col("l_quantity") < 10, F.lit("light")), F.when(F.col("l_discount") > 0.05, F.lit("discounted")), F.when(F.col("l_tax") == 0, F.lit("untaxed"))))
    return ag.reason_histogram(table(spark, d, "lineitem").select(r.alias("r")), "r")


@query("agg12_signals", """WITH a AS (SELECT event_type AS source, user_id % 6 AS domain, sum(value / pi()) AS raw, count(*) AS n FROM events GROUP BY 1, 2)
SELECT source, domain, round(raw, 6) AS raw_value, round(least(raw / max(raw) OVER (PARTITION BY source), 1) * least(ln(1 + n) / ln(501), 1), 6) AS signal_strength FROM a""")
def agg12(spark, d):
    from pyspark.sql.window import Window as W

    a = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 6).alias("domain")).agg(F.sum(F.col("value") / F.pi()).alias("raw_value"), F.count("*").alias("n"))
    rel = F.least(F.col("raw_value") / F.max("raw_value").over(W.partitionBy("source")), F.lit(1.0))
    return a.withColumn("signal_strength", rel * log_support(F.col("n"), 500)).select("source", "domain", *_r("raw_value", "signal_strength"))


@query("agg13_predictions", """WITH a AS (SELECT user_id % 6 AS domain, event_type AS source, least(ln(1 + count(*)) / ln(501), 1) AS s FROM events GROUP BY 1, 2),
p AS (SELECT domain, max(s) FILTER (source = 'click') AS c, max(s) FILTER (source = 'view') AS v, max(s) FILTER (source = 'purchase') AS u FROM a GROUP BY 1), w AS (SELECT *, least(((coalesce(c, 0) * 1 + coalesce(v, 0) * 2 + coalesce(u, 0) * 3) / 6) * 0.9, 1) AS e FROM p)
SELECT domain, round(e, 6) AS emergence_score, row_number() OVER (ORDER BY e DESC, domain) AS rank FROM w""")
def agg13(spark, d):
    from pyspark.sql.window import Window as W

    a = table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("domain"), F.col("event_type").alias("source")).agg(log_support(F.count("*"), 500).alias("s"))
    p = a.groupBy("domain").pivot("source", ["click", "view", "purchase"]).agg(F.max("s")).na.fill(0.0)
    e = F.least((F.col("click") + 2 * F.col("view") + 3 * F.col("purchase")) / 6 * 0.9, F.lit(1.0))
    p = p.withColumn("e", e)
    return p.select("domain", F.round("e", 6).alias("emergence_score"), big(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("e"), "domain"))).alias("rank"))


@query("agg14_skill_contributions", "WITH m AS (SELECT user_id % 10 AS skill, event_type AS cluster, CAST(ts AS DATE) AS win, max(value / pi()) AS v FROM events GROUP BY 1, 2, 3) SELECT skill, round(sum(v), 6) AS score, count(DISTINCT cluster) AS clusters FROM m GROUP BY 1")
def agg14(spark, d):
    m = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("skill"), F.col("event_type").alias("cluster"), F.to_date("ts").alias("win")).agg(F.max(F.col("value") / F.pi()).alias("v"))
    return m.groupBy("skill").agg(F.round(F.sum("v"), 6).alias("score"), F.countDistinct("cluster").alias("clusters"))


_DIM = """dd AS (SELECT event_type AS source, CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (value > 5) AS c, count(*) FILTER (user_id % 9 <> 0) AS p FROM events WHERE NOT (event_type = 'error' AND day(ts) > 12) GROUP BY 1, 2),
dm AS (SELECT source, CAST(sum(n) AS BIGINT) AS samples, least(100.0, 100.0 * count(*) / 30) AS cov, least(100.0, 100.0 * sum(n) / 2100.0) AS suf, 100.0 * sum(c) / sum(n) AS com, 100.0 * sum(p) / sum(n) AS par, 100.0 * greatest(0, 1 - stddev_pop(n) / avg(n)) AS tem FROM dd GROUP BY 1)"""


def dims(spark, d):
    e = table(spark, d, "events").filter(~((F.col("event_type") == "error") & (F.dayofmonth("ts") > 12))).withColumnRenamed("event_type", "source")
    return ag.source_dimensions(e, "source", "ts", F.col("value") > 5, F.col("user_id") % 9 != 0, 30, 2100.0)


@query("agg16_source_dimensions", f"WITH {_DIM} SELECT source, samples, round(cov, 4) AS time_window_coverage, round(suf, 4) AS sample_sufficiency, round(com, 4) AS field_completeness, round(par, 4) AS parse_success_rate, round(tem, 4) AS temporal_distribution FROM dm")
def agg16(spark, d):
    return dims(spark, d).select("source", "samples", *_r("time_window_coverage", "sample_sufficiency", "field_completeness", "parse_success_rate", "temporal_distribution", k=4))


@query("agg17_source_grades", f"WITH {_DIM}, s AS (SELECT *, least(0.2 * cov + 0.2 * suf + 0.15 * com + 0.15 * par + 0.1 * tem, 100) AS sc FROM dm) SELECT source, round(sc, 4) AS score, CASE WHEN sc >= 75 THEN 'good' WHEN sc >= 45 THEN 'degraded' ELSE 'poor' END AS grade, concat_ws(',', CASE WHEN cov < 50 THEN 'partial_time_coverage' END, CASE WHEN suf < 50 THEN 'low_sample' END, CASE WHEN com < 70 THEN 'incomplete_fields' END, CASE WHEN par < 80 THEN 'high_parse_failure' END, CASE WHEN tem < 50 THEN 'clustered_distribution' END) AS flags FROM s")
def agg17(spark, d):
    return ag.grade(dims(spark, d)).select("source", *_r("score", k=4), "grade", "flags")


@query("agg18_run_summary", "SELECT count(*) AS documents, round(count(*) FILTER (quality = 1) / count(quality), 6) AS good_share, round(count(quality) / count(*), 6) AS labelled_share, count(DISTINCT coalesce(text, CAST(doc_id AS VARCHAR))) AS distinct_events FROM documents LEFT JOIN labels USING (doc_id)")
def agg18(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("documents"), F.round(F.count_if(F.col("quality") == 1) / F.count("quality"), 6).alias("good_share"), F.round(F.count("quality") / F.count("*"), 6).alias("labelled_share"), F.countDistinct(F.coalesce(F.sha2("text", 256), F.col("doc_id").cast("string"))).alias("distinct_events"))


@query("agg19_modality_shares", f"WITH {FACTS} SELECT position, skill, round(least(1, count(*) FILTER (modality = 'required' OR (modality = 'x' AND w >= 0.5)) / 400.0), 6) AS required_share, round(least(1, count(*) FILTER (modality IN ('bonus', 'preferred')) / 400.0), 6) AS bonus_share, round(least(1, count(*) / 400.0), 6) AS total_coverage FROM f GROUP BY 1, 2")
def agg19(spark, d):
    x = ag.modality_shares(facts(spark, d), ["position", "skill"], "modality", "w", F.lit(400))
    return x.select("position", "skill", *_r("required_share", "bonus_share", "total_coverage"))


@query("agg20_coverage_state", f"WITH {FACTS}, g AS (SELECT skill, version, ent % 5 AS e5, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT ent) AS e FROM f GROUP BY 1, 2, 3) SELECT skill, version, e5, CASE WHEN n < 3 THEN 'insufficient_evidence' WHEN s <= 1 OR e <= 1 THEN 'source_concentrated' ELSE 'unresolved' END AS state FROM g")
def agg20(spark, d):
    g = facts(spark, d).groupBy("skill", "version", (F.col("ent") % 5).alias("e5")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"), F.countDistinct("ent").alias("e"))
    return g.select("skill", "version", "e5", ag.coverage_state(F.col("n"), F.col("s"), F.col("e")).alias("state"))


@query("agg21_profile_thresholds", f"""WITH {FACTS}, {_BEST}, g AS (SELECT position, skill, max(modality) AS modality, count(*) AS s, count(*) FILTER (modality = 'required') AS r, count(DISTINCT ent) AS e FROM b GROUP BY 1, 2), n AS (SELECT position, count(DISTINCT doc) AS n FROM b GROUP BY 1)
SELECT position, skill, round(s / n, 6) AS support_ratio, round(r / n, 6) AS required_prevalence, round(r / s, 6) AS required_purity, CASE WHEN modality <> 'required' THEN 'not_applicable' WHEN NOT (r / n < 0.02 OR r < 2 OR r / s < 0.5) THEN 'market_supported' WHEN e >= 2 OR s >= 3 THEN 'enterprise_specific' ELSE 'inflation_risk' END AS status FROM g JOIN n USING (position)""")
def agg21(spark, d):
    b = best(spark, d)
    g = b.groupBy("position", "skill").agg(F.max("modality").alias("modality"), F.count("*").alias("s"), F.count_if(F.col("modality") == "required").alias("r"), F.countDistinct("ent").alias("e"))
    g = g.join(b.groupBy("position").agg(F.countDistinct("doc").alias("n")), "position")
    p, q = F.col("r") / F.col("n"), F.col("r") / F.col("s")
    return g.select("position", "skill", F.round(F.col("s") / F.col("n"), 6).alias("support_ratio"), F.round(p, 6).alias("required_prevalence"), F.round(q, 6).alias("required_purity"), ag.inflation_status(F.col("modality"), F.col("s"), F.col("r"), p, q, F.col("e"), (0.02, 2, 0.5)).alias("status"))


_BASKET = "bk AS (SELECT DISTINCT l_orderkey AS ctx, CASE WHEN l_partkey % 50 > 20 THEN 3 ELSE l_partkey % 50 END AS item FROM lineitem)"


def baskets(spark, d):
    k = F.col("l_partkey") % 50
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ctx"), F.when(k > 20, F.lit(3).cast("bigint")).otherwise(k).alias("item"))
    return spread(x, "ctx", rows=500_000).distinct()  # what follows groups by context, within these tasks


@query("agg22_dependencies", f"""WITH {_BASKET}, n AS (SELECT item, count(*) AS n FROM bk GROUP BY 1), j AS (SELECT a.item AS p, b.item AS a, count(*) AS joint FROM bk a JOIN bk b ON a.ctx = b.ctx AND a.item <> b.item GROUP BY 1, 2)
SELECT p AS prerequisite, a AS advanced, joint, round(joint / na.n, 6) AS p_pre_given_adv, round(joint / np.n, 6) AS p_adv_given_pre, round(joint / na.n - joint / np.n, 6) AS dependency FROM j JOIN n np ON np.item = p JOIN n na ON na.item = a WHERE joint / na.n - joint / np.n > 0""")
def agg22(spark, d):
    return ag.dependency_pairs(baskets(spark, d), "ctx", "item").select("prerequisite", "advanced", "joint", *_r("p_pre_given_adv", "p_adv_given_pre", "dependency"))


@query("agg23_bootstrap_intervals")
def agg23(spark, d):
    b = baskets(spark, d)
    return ag.bootstrap_interval(ag.dependency_pairs(b, "ctx", "item").filter("advanced = 7"), b, "ctx", "item", 40)


@query("agg24_context_dedup", "WITH c AS (SELECT l_orderkey AS ctx, min(l_suppkey) % 5 AS ent, array_to_string(list_sort(list(DISTINCT l_partkey % 3)), ',') AS items FROM lineitem GROUP BY 1) SELECT ctx, ent, items FROM c QUALIFY row_number() OVER (PARTITION BY ent, items ORDER BY ctx) = 1")
def agg24(spark, d):
    from tessera.operators.relational import first_wins

    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ctx")).agg((F.min("l_suppkey") % 5).alias("ent"), F.array_join(F.array_sort(F.collect_set(F.col("l_partkey") % 3)), ",").alias("items"))
    return first_wins(c, ["ent", "items"], [F.asc("ctx")])


@query("agg26_kish", "SELECT event_type, round(sum(value) * sum(value) / sum(value * value), 4) AS effective_size FROM events GROUP BY 1")
def agg26(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(ag.kish("value"), 4).alias("effective_size"))


@query("agg27_entropy_size", "WITH p AS (SELECT event_type, value / sum(value) OVER (PARTITION BY event_type) AS p FROM events WHERE value > 0) SELECT event_type, round(exp(-sum(p * ln(p))), 4) AS entropy_size FROM p GROUP BY 1")
def agg27(spark, d):
    return ag.entropy_size(table(spark, d, "events"), ["event_type"], "value").select("event_type", *_r("entropy_size", k=4))


_CW = "cw AS (SELECT user_id AS cluster, max(value) / 1000 AS q, max(CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END) AS c FROM events GROUP BY 1), w1 AS (SELECT cluster, (0.5 + 0.5 * q) * CASE WHEN c = 1 THEN 1.0 ELSE 0.5 END AS weight FROM cw)"


def cw(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("cluster"), (F.col("value") / 1000).alias("q"), ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("c"))
    return ag.cluster_weights(e, "cluster", "q", "c")


@query("agg28_cluster_weights", f"WITH {_CW} SELECT cluster, round(weight, 6) AS weight, round(weight * least(1.0, 5.0 / count(*) OVER (PARTITION BY cluster % 7)) * least(1.0, 8.0 / count(*) OVER (PARTITION BY cluster % 11)), 6) AS diverse_weight FROM w1")
def agg28(spark, d):
    w = cw(spark, d).withColumn("src", F.col("cluster") % 7).withColumn("ent", F.col("cluster") % 11)
    return ag.diversity_weights(w, "weight", {"src": 5.0, "ent": 8.0}).select("cluster", *_r("weight", "diverse_weight"))


@query("agg29_mass_capped_weights")
def agg29(spark, d):
    w = cw(spark, d).withColumn("src", (F.col("cluster") % 3).cast("string")).withColumn("ent", (F.col("cluster") % 13).cast("string")).withColumn("conclusion", F.col("cluster") % 2)
    return ag.capped_weights(w, "conclusion", "cluster", "weight", {"src": 0.35, "ent": 0.1})


@query("agg30_projected_weights")
def agg30(spark, d):
    w = cw(spark, d).withColumn("src", (F.col("cluster") % 3).cast("string")).withColumn("ent", (F.col("cluster") % 13).cast("string")).withColumn("conclusion", F.col("cluster") % 2)
    return ag.capped_weights(w, "conclusion", "cluster", "weight", {"src": 0.35, "ent": 0.1}, dual=True)


@query("agg31_lag_profile", "WITH l AS (SELECT l_returnflag AS src, date_diff('day', o_orderdate, l_shipdate) AS lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey), v AS (SELECT src, CASE WHEN lag BETWEEN 0 AND 400 THEN lag END AS v FROM l) SELECT src AS source, count(v) AS valid, count(*) - count(v) AS invalid, round(quantile_cont(v, 0.5), 4) AS median, list_sort(list(v) FILTER (v IS NOT NULL))[CAST(ceil(count(v) * 0.9) AS BIGINT)] AS p90, max(v) AS longest FROM v GROUP BY 1")
def agg31(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = ag.lag_profile(j.withColumnRenamed("l_returnflag", "source"), "source", big(F.datediff("l_shipdate", "o_orderdate")), 400)
    return x.select("source", "valid", "invalid", F.round("median", 4).alias("median"), "p90", "longest")


@query("agg33_cluster_core_items", "WITH m AS (SELECT DISTINCT event_type AS cluster, user_id AS member, CAST(value AS INTEGER) // 20 AS item FROM events), s AS (SELECT cluster, count(DISTINCT member) AS m FROM m GROUP BY 1), n AS (SELECT cluster, item, count(*) AS support FROM m GROUP BY 1, 2) SELECT cluster, CAST(item AS BIGINT) AS item, support, row_number() OVER (PARTITION BY cluster ORDER BY support DESC, item) AS rank FROM n JOIN s USING (cluster) WHERE support >= ceil(m / 2)".replace("CAST(value AS INTEGER) // 20", "CAST(floor(value / 20) AS BIGINT)"))
def agg33(spark, d):
    m = table(spark, d, "events").select(F.col("event_type").alias("cluster"), F.col("user_id").alias("member"), F.floor(F.col("value") / 20).alias("item"))
    return ag.cluster_summary(m, "cluster", "member", "item").select("cluster", "item", "support", "rank")


@query("agg35_concentration", "WITH c AS (SELECT l_partkey % 50 AS skill, l_suppkey AS ent, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY skill) AS s FROM c) SELECT skill, round(sum(s * s), 6) AS hhi, round(max(s), 6) AS max_share, count(*) AS members FROM s GROUP BY 1")
def agg35(spark, d):
    return ag.concentration(facts(spark, d), "skill", "ent").select("skill", *_r("hhi", "max_share"), "members")


@query("agg38_candidate_match", f"WITH {FACTS}, w AS (SELECT position, skill, count(*) / 1000.0 AS w FROM f GROUP BY 1, 2), c AS (SELECT DISTINCT o_custkey AS cand, o_orderkey % 50 AS skill FROM orders) SELECT cand, position, round(sum(CASE WHEN c.skill IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) AS score, round(count(c.skill) / count(*), 6) AS coverage FROM (SELECT DISTINCT cand FROM c) x CROSS JOIN w LEFT JOIN c USING (cand, skill) GROUP BY 1, 2".replace("SELECT cand, position", "SELECT x.cand, position"))
def agg38(spark, d):
    w = facts(spark, d).groupBy("position", "skill").agg((F.count("*") / 1000.0).alias("w"))
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("cand"), (F.col("o_orderkey") % 50).alias("skill")).distinct().withColumn("hit", F.lit(1))
    j = c.select("cand").distinct().crossJoin(w).join(c, ["cand", "skill"], "left")
    return j.groupBy("cand", "position").agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("score"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


_LAB = "lb AS (SELECT doc_id, toxic = 1 AS actual, text LIKE '%idiot%' OR text LIKE '%clown%' AS predicted, least(1.0, (length(text) - length(replace(text, 'o', ''))) / (length(text) / 12.0)) AS score FROM documents JOIN labels USING (doc_id))"


def labelled(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    o = F.length("text") - F.length(F.replace("text", F.lit("o"), F.lit("")))
    return t.select("doc_id", (F.col("toxic") == 1).alias("actual"), (F.col("text").like("%idiot%") | F.col("text").like("%clown%")).alias("predicted"), F.least(F.lit(1.0), o / (F.length("text") / 12.0)).alias("score"))


_BM = "count(*) FILTER (actual AND {p}) AS tp, count(*) FILTER (NOT actual AND {p}) AS fp, count(*) FILTER (actual AND NOT {p}) AS fn"


@query("agg39_binary_metrics", f"WITH {_LAB}, c AS (SELECT {_BM.format(p='predicted')} FROM lb) SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c")
def agg39(spark, d):
    return labelled(spark, d).agg(*ag.binary_metrics(F.col("actual"), F.col("predicted"))).select("tp", "fp", "fn", *_r("precision", "recall", "f1"))


@query("agg39_confusion", f"WITH {_LAB}, g AS (SELECT a, p FROM (SELECT unnest([true, false]) AS a), (SELECT unnest([true, false]) AS p)) SELECT a AS actual, p AS predicted, count(doc_id) AS count FROM g LEFT JOIN lb ON actual = a AND predicted = p GROUP BY 1, 2")
def agg39b(spark, d):
    return ag.confusion(labelled(spark, d), "actual", "predicted", [True, False])


@query("agg40_recall_and_mrr", "WITH r AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus = 'P' AS hit FROM orders), f AS (SELECT q, min(rank) AS rank FROM r WHERE hit GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(1.0 / rank), 6) AS mrr FROM f")
def agg40(spark, d):
    from tessera.operators.relational import top_k

    r = top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10**9)
    f = r.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("rank").alias("rank"))
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6)
    return f.agg(F.count("*").alias("queries"), hit(1).alias("recall_at_1"), hit(3).alias("recall_at_3"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


@query("agg41_threshold_calibration", f"WITH {_LAB}, t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold), c AS (SELECT threshold::DOUBLE AS threshold, {_BM.format(p='score >= threshold')} FROM lb, t GROUP BY 1), m AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM c) SELECT threshold, tp, fp, fn, round(f1, 6) AS f1, row_number() OVER (ORDER BY coalesce(round(f1, 12), -1) DESC, coalesce(p, -1) DESC, coalesce(r, -1) DESC, threshold DESC) = 1 AS recommended FROM m")
def agg41(spark, d):
    return ag.calibrate(labelled(spark, d), "score", "actual", [0.2, 0.4, 0.6, 0.8]).select("threshold", "tp", "fp", "fn", *_r("f1"), "recommended")


@query("agg42_cluster_purity", "WITH c AS (SELECT vec_id % 7 AS cluster, label, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT cluster, max(n) AS majority, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY 1")
def agg42(spark, d):
    return ag.purity(table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("cluster"), "label"), "cluster", "label").select("cluster", "majority", "size", *_r("purity"))


@query("agg43_case_accuracy", "SELECT event_type, count(*) FILTER (user_id % 10 <> 0) AS evaluated, count(*) FILTER (user_id % 10 = 0) AS skipped, round(count(*) FILTER (user_id % 10 <> 0 AND abs(value - 50) <= 20) / count(*) FILTER (user_id % 10 <> 0), 6) AS accuracy FROM events GROUP BY 1")
def agg43(spark, d):
    ok = F.col("user_id") % 10 != 0
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(ok).alias("evaluated"), F.count_if(~ok).alias("skipped"), F.round(F.count_if(ok & (F.abs(F.col("value") - 50) <= 20)) / F.count_if(ok), 6).alias("accuracy"))


@query("agg45_quality_flags", "WITH s AS (SELECT user_id, count(*) AS n, max(ts) AS t, sum(value) AS v, max(x) AS mx FROM (SELECT *, sum(value) OVER (PARTITION BY user_id, event_type) AS x FROM events) GROUP BY 1) SELECT user_id, concat_ws(',', CASE WHEN n < 60 THEN 'low_sample' END, CASE WHEN mx / v >= 0.3 THEN 'single_source_dominance' END, CASE WHEN date_diff('day', CAST(t AS DATE), DATE '2024-02-10') > 11 THEN 'stale_evidence' END) AS flags FROM s")
def agg45(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("t"), F.sum("value").alias("x")).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("t").alias("t"), F.sum("x").alias("v"), F.max("x").alias("mx"))
    f = F.concat_ws(",", F.when(F.col("n") < 60, "low_sample"), F.when(F.col("mx") / F.col("v") >= 0.3, "single_source_dominance"), F.when(F.datediff(F.lit("2024-02-10").cast("date"), F.to_date("t")) > 11, "stale_evidence"))
    return s.select("user_id", f.alias("flags"))


@query("agg46_laplace", "SELECT o_custkey % 40 AS grp, count(*) AS size, round((count(*) FILTER (o_orderstatus = 'P') + 1.0) / (count(*) + 3.0), 6) AS p_change FROM orders GROUP BY 1")
def agg46(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("grp")).agg(F.count("*").alias("size"), F.round((F.count_if(F.col("o_orderstatus") == "P") + 1.0) / (F.count("*") + 3.0), 6).alias("p_change"))


_COAL = "co AS (SELECT m, sqrt(count(*)) AS v FROM (SELECT unnest(range(16)) AS m) LEFT JOIN events ON (user_id % 16) & m = user_id % 16 GROUP BY 1)"


def coalitions(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("u")).agg(F.count("*").alias("n"))
    g = spark.range(16).withColumnRenamed("id", "m").join(e, F.col("u").bitwiseAND(F.col("m")) == F.col("u"), "left")
    return g.groupBy("m").agg(F.sqrt(F.sum("n").cast("double")).alias("v"))


@query("agg47_shapley", f"WITH {_COAL} SELECT f AS factor, round(sum((b.v - a.v) * CASE bit_count(a.m) WHEN 0 THEN 6 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 6 END / 24.0), 6) AS shapley FROM co a, (SELECT unnest(range(4)) AS f) JOIN co b ON true WHERE a.m & (1 << f) = 0 AND b.m = a.m + (1 << f) GROUP BY 1")
def agg47(spark, d):
    return ag.shapley(coalitions(spark, d), "m", "v", 4).select(big(F.col("factor")).alias("factor"), *_r("shapley"))


@query("agg47_interactions", f"WITH {_COAL}, f AS (SELECT unnest(range(4)) AS f) SELECT x.f AS factor_a, y.f AS factor_b, round((SELECT v FROM co WHERE m = (1 << x.f) + (1 << y.f)) - (SELECT v FROM co WHERE m = 1 << x.f) - (SELECT v FROM co WHERE m = 1 << y.f) + (SELECT v FROM co WHERE m = 0), 6) AS interaction FROM f x JOIN f y ON x.f < y.f")
def agg47b(spark, d):
    return ag.factor_interactions(coalitions(spark, d), "m", "v", 4).select(big(F.col("factor_a")).alias("factor_a"), big(F.col("factor_b")).alias("factor_b"), *_r("interaction"))


@query("agg48_factor_importance", f"WITH {_COAL}, e AS (SELECT f, (SELECT v FROM co WHERE m = 1 << f) - (SELECT v FROM co WHERE m = 0) AS e FROM (SELECT unnest(range(4)) AS f)) SELECT f AS factor, round(e, 6) AS effect, round(100 * abs(e) / sum(abs(e)) OVER (), 4) AS effect_pct, row_number() OVER (ORDER BY abs(e) DESC, f) AS rank FROM e")
def agg48(spark, d):
    from pyspark.sql.window import Window as W

    c = coalitions(spark, d)
    f = spark.range(4).withColumnRenamed("id", "factor").withColumn("m", F.expr("shiftleft(1L, int(factor))")).join(c, "m")
    f = f.crossJoin(F.broadcast(c.filter("m = 0").select(F.col("v").alias("v0")))).withColumn("e", F.col("v") - F.col("v0"))
    w = W.partitionBy(F.lit(1))
    return f.select("factor", F.round("e", 6).alias("effect"), F.round(100 * F.abs("e") / F.sum(F.abs("e")).over(w), 4).alias("effect_pct"), big(F.row_number().over(w.orderBy(F.desc(F.abs("e")), "factor"))).alias("rank"))
