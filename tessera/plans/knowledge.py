"""Novelty, admission, projection and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import knowledge as kn
from tessera.operators import novelty as nv

from .registry import query, spread, table
from .relational import FACTS, facts


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


_P = "p AS (SELECT p_partkey, lower(p_name) AS a, lag(lower(p_name)) OVER (ORDER BY p_partkey) AS b, lag(lower(p_name), 2) OVER (ORDER BY p_partkey) AS c FROM part), e AS (SELECT p_partkey, least(levenshtein(a, b) / greatest(length(a), length(b)), levenshtein(a, c) / greatest(length(a), length(c))) AS d FROM p WHERE c IS NOT NULL)"
_SC = "least(1, greatest(0, CASE WHEN {d} >= 0.6 THEN 0.7 + 0.3 * ({d} - 0.6) / 0.4 WHEN {d} >= 0.3 THEN 0.4 + 0.3 * ({d} - 0.3) / 0.3 ELSE 0.4 * {d} / 0.3 END))"


@query("mat06_name_novelty", f"WITH {_P} SELECT p_partkey, round(CAST({_SC.format(d='d')} AS DOUBLE), 6) AS novelty FROM e")
def mat06(spark, d):
    w = W.partitionBy(F.lit(1)).orderBy("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lag(F.lower("p_name")).over(w).alias("b"), F.lag(F.lower("p_name"), 2).over(w).alias("c")).filter("c is not null")
    return p.select("p_partkey", F.round(nv.name_novelty(F.col("a"), F.array("b", "c")), 6).alias("novelty"))


_E = "s AS (SELECT ent, list(DISTINCT skill) FILTER (version = 1998) AS a, list(DISTINCT skill) FILTER (version = 1997) AS b FROM f GROUP BY 1), j AS (SELECT *, 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS d FROM s WHERE a IS NOT NULL AND b IS NOT NULL)"


def ents(spark, d):
    g = facts(spark, d).groupBy("ent").agg(F.collect_set(F.when(F.col("version") == 1998, F.col("skill"))).alias("a"), F.collect_set(F.when(F.col("version") == 1997, F.col("skill"))).alias("b"), F.count_if(F.col("version") == 1998).alias("n1"), F.count_if(F.col("version") == 1997).alias("n0"), F.countDistinct("position").alias("places"), F.countDistinct("source").alias("sources"), F.countDistinct("doc").alias("docs"))
    return g.filter((F.size("a") > 0) & (F.size("b") > 0))


@query("mat07_skill_novelty", f"WITH {FACTS}, {_E} SELECT ent, round(CAST({_SC.format(d='d')} AS DOUBLE), 6) AS skill, round(CAST(least(1, d / 0.6) AS DOUBLE), 6) AS responsibility, round(CAST(least(1, len(list_filter(a, lambda x: NOT list_contains(b, x))) / len(a) / 0.3) AS DOUBLE), 6) AS industry FROM j")
def mat07(spark, d):
    none = F.array().cast("array<array<bigint>>")
    a, b = F.col("a"), F.col("b")
    return ents(spark, d).select("ent", F.round(nv.skill_novelty(a, b, none), 6).alias("skill"), F.round(nv.responsibility_novelty(a, b, none), 6).alias("responsibility"), F.round(nv.industry_novelty(a, b), 6).alias("industry"))


@query("mat09_market_novelty", f"WITH {FACTS}, s AS (SELECT ent, count(*) FILTER (version = 1998) AS n1, count(*) FILTER (version = 1997) AS n0, count(DISTINCT position) AS pl, count(DISTINCT source) AS so, count(DISTINCT doc) AS dc FROM f GROUP BY 1 HAVING n1 > 0 AND n0 > 0), x AS (SELECT *, ln(1 + n1) - ln(1 + n0) AS dl FROM s), y AS (SELECT *, least(1, 0.4 * CASE WHEN dl >= 0 THEN least(1, dl / ln(2)) ELSE 0.1 END + 0.35 * least(1, dc / 10.0) + 0.25 * least(1, pl / 5.0)) AS m FROM x) SELECT ent, round(CAST(CASE WHEN dc < 2 THEN 0.1 WHEN so < 2 THEN least(m * 0.5, 0.4) ELSE m END AS DOUBLE), 6) AS market FROM y")
def mat09(spark, d):
    m = nv.market_novelty(F.col("n1"), F.col("n0"), F.lit(None).cast("double"), F.col("docs"), F.col("places"), F.col("sources") < 2)
    return ents(spark, d).select("ent", F.round(m, 6).alias("market"))


@query("mat10_novelty_events")
def mat10(spark, d):
    none = F.array().cast("array<array<bigint>>")
    a, b = F.col("a"), F.col("b")
    x = ents(spark, d).withColumn("skill", nv.skill_novelty(a, b, none)).withColumn("resp", nv.responsibility_novelty(a, b, none)).withColumn("market", nv.market_novelty(F.col("n1"), F.col("n0"), F.lit(None).cast("double"), F.col("docs"), F.col("places"), F.col("sources") < 2)).withColumn("name", F.lit(None).cast("double"))
    x = nv.novelty_profile(x, {"name": 0.2, "skill": 0.4, "resp": 0.2, "market": 0.2})
    return x.select("ent", *_r("novelty"), "dimensions", nv.novelty_event(F.col("name"), F.col("skill"), F.col("resp"), F.col("market"), a, b).alias("event"))


_ADM = "c AS (SELECT p_partkey AS k, q.profile, ((p_partkey * 7 + q.profile * 3) % 11) / 10.0 AS t, ((p_partkey * 5 + q.profile) % 9) / 8.0 AS r, ((p_partkey + q.profile * 5) % 7) / 6.0 AS s, p_partkey % 4 = 0 AS sig FROM part, (SELECT unnest([0, 1, 2]) AS profile) q)"


def adm(spark, d):
    k, q = F.col("k"), F.col("profile")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumn("profile", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))
    return x.select("k", "profile", ((k * 7 + q * 3) % 11 / 10.0).alias("t"), ((k * 5 + q) % 9 / 8.0).alias("r"), ((k + q * 5) % 7 / 6.0).alias("s"), (k % 4 == 0).alias("sig"))


@query("emg05_admission", f"WITH {_ADM}, b AS (SELECT *, round(t * 0.4 + r * 0.35 + s * 0.25, 6) AS combined FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(t * 0.4 + r * 0.35 + s * 0.25, 6) DESC, profile DESC) = 1) SELECT k, CAST(profile AS BIGINT) AS profile, CAST(combined AS DOUBLE) AS combined, CASE WHEN sig AND t < 0.3 AND r < 0.3 THEN CASE WHEN combined >= 0.6 THEN 'review_required' WHEN t = 0 AND r = 0 THEN 'off_target' ELSE 'weak_evidence' END WHEN combined >= 0.6 THEN 'admit' WHEN combined >= 0.4 THEN 'review_required' ELSE 'off_target' END AS decision FROM b")
def emg05(spark, d):
    return nv.admission(adm(spark, d), "k", "profile", "t", "r", "s", signal="sig").select("k", "profile", "combined", "decision")


@query("emg07_identity_match", f"WITH {_ADM}, z AS (SELECT k, profile, round(t * 0.5 + r * 0.3 + s * 0.2, 9) AS sc FROM c), y AS (SELECT *, row_number() OVER w AS n, sc - coalesce(lead(sc) OVER w, 0) AS m FROM z WINDOW w AS (PARTITION BY k ORDER BY sc DESC, profile)) SELECT k, CAST(profile AS BIGINT) AS profile, round(CAST(sc AS DOUBLE), 6) AS score, CASE WHEN sc < 0.6 THEN 'new' WHEN round(m, 9) < 0.1 THEN 'review_required' ELSE 'same' END AS decision FROM y WHERE n = 1")
def emg07(spark, d):
    return nv.identity_match(adm(spark, d), "k", "profile", {"t": 0.5, "r": 0.3, "s": 0.2}, margin=0.1 - 1e-10).select("k", "profile", *_r("score"), "decision")


@query("emg03_relation_classes", f"WITH {_ADM} SELECT k, CAST(profile AS BIGINT) AS profile, CASE WHEN NOT sig THEN 'no_reference' WHEN t < 0.3 AND greatest(r, s) < 0.3 THEN 'same_occupation' WHEN greatest(r, s) < 0.4 THEN 'variant' WHEN greatest(r, s) < 0.6 THEN 'adjacent' ELSE 'structurally_new' END AS relation FROM c")
def emg03(spark, d):
    return nv.relation_class(adm(spark, d), F.col("t"), F.col("s"), F.col("r"), F.col("sig")).select("k", "profile", "relation")


@query("emg12_definitions", f"WITH {FACTS}, c AS (SELECT position, skill, count(*) AS n FROM f WHERE version = 1998 GROUP BY 1, 2), r AS (SELECT DISTINCT skill FROM f WHERE version = 1997 AND modality = 'required'), k AS (SELECT c.*, r.skill IS NULL AS new, row_number() OVER (PARTITION BY position ORDER BY n DESC, c.skill) AS k FROM c LEFT JOIN r ON r.skill = c.skill) SELECT position, string_agg(CAST(skill AS VARCHAR), ',' ORDER BY skill) AS core_skills, coalesce(string_agg(CAST(skill AS VARCHAR), ',' ORDER BY skill) FILTER (new), '') AS new_skills FROM k WHERE k <= 5 GROUP BY 1")
def emg12(spark, d):
    f = facts(spark, d)
    x = nv.definition(f.filter("version = 1998"), "position", "skill", f.filter("version = 1997 and modality = 'required'"))
    return x.select("position", F.array_join("core_skills", ",").alias("core_skills"), F.array_join("new_skills", ",").alias("new_skills"))


@query("emg13_leakage", "WITH e AS (SELECT event_id, user_id % 5 AS s, user_id % 7 AS t, event_id % 9 AS u FROM events) SELECT event_id, concat_ws(',', CASE WHEN u > t THEN 'future_evidence' END, CASE WHEN s >= t THEN 'not_forward' END) AS violations FROM e WHERE u > t OR s >= t")
def emg13(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("s"), (F.col("user_id") % 7).alias("t"), (F.col("event_id") % 9).alias("u"))
    return nv.leakage(e, "s", "t", "u").select("event_id", F.array_join("violations", ",").alias("violations"))


_CL = "cl AS (SELECT o_orderkey AS claim, o_custkey % 50 AS subject, 'REQUIRES' AS predicate, o_orderkey % 40 AS object, o_orderkey % 6 AS e, o_orderstatus = 'F' AS published FROM orders)"


def claims(spark, d):
    k = F.col("o_orderkey")
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", rows=100_000)
    return o.select(k.alias("claim"), (F.col("o_custkey") % 50).alias("subject"), F.lit("REQUIRES").alias("predicate"), (k % 40).alias("object"), F.array(k * 10 + k % 6).alias("evidence"), (F.col("o_orderstatus") == "F").alias("published"))


@query("clu14_projection_edges", f"WITH {_CL} SELECT 'position:' || subject AS source, 'claim:' || claim AS target, 'HAS_CLAIM' AS kind, CASE WHEN published THEN 'authoritative' ELSE 'observed' END AS plane FROM cl UNION ALL SELECT 'claim:' || claim, 'skill:' || object, predicate, CASE WHEN published THEN 'authoritative' ELSE 'observed' END FROM cl UNION ALL SELECT 'claim:' || claim, 'evidence:' || (claim * 10 + e), 'SUPPORTED_BY', CASE WHEN published THEN 'authoritative' ELSE 'observed' END FROM cl")
def clu14(spark, d):
    return kn.project_graph(claims(spark, d))[1].select("source", "target", "kind", "plane")


@query("clu15_projection_counts", f"WITH {_CL} SELECT (SELECT count(DISTINCT subject) + count(DISTINCT object) + 2 * count(*) FROM cl) AS nodes, 3 * count(*) AS edges, CAST(0 AS BIGINT) AS node_collisions, CAST(0 AS BIGINT) AS edge_collisions, CAST(0 AS BIGINT) AS dangling FROM cl")
def clu15(spark, d):
    tasks = table(spark, d, "orders").count() // 100_000 + 1
    return kn.verify_projection(*kn.project_graph(claims(spark, d), tasks), tasks)


@query("clu16_diffusion_graph", "WITH o AS (SELECT DISTINCT user_id % 30 AS c, CAST(ts AS DATE) AS w, event_type AS co, CAST(user_id % 4 AS VARCHAR) AS so FROM events), x AS (SELECT *, c || ':' || w AS obs FROM o), n AS (SELECT DISTINCT c, w, obs FROM x), l AS (SELECT obs, lead(obs) OVER (PARTITION BY c ORDER BY w) AS nx FROM n) SELECT DISTINCT CAST(c AS VARCHAR) AS source, obs AS target, 'OBSERVED' AS kind FROM x UNION ALL SELECT DISTINCT obs, co, 'COMPANY' FROM x UNION ALL SELECT DISTINCT obs, so, 'SOURCE' FROM x UNION ALL SELECT obs, nx, 'NEXT' FROM l WHERE nx IS NOT NULL")
def clu16(spark, d):
    o = table(spark, d, "events").select((F.col("user_id") % 30).alias("c"), F.to_date("ts").alias("w"), F.col("event_type").alias("co"), (F.col("user_id") % 4).cast("string").alias("so")).distinct()
    return kn.diffusion_graph(o, "c", "w", "co", "so")


@query("clu19_routes", f"WITH {_ADM}, g AS (SELECT k, profile, sum(CASE WHEN r > 0.9 THEN 0 ELSE r END) / count(*) AS s, count(*) FILTER (t > 0.5) AS e, count(*) FILTER (r <= 0.9) AS n FROM c GROUP BY 1, 2) SELECT k, CAST(profile AS BIGINT) AS route, round(CAST(s AS DOUBLE), 6) AS route_score, e AS exact_matches FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(s, 9) DESC, e DESC, n DESC, profile) = 1")
def clu19(spark, d):
    x = adm(spark, d).withColumn("score", F.when(F.col("r") <= 0.9, F.col("r"))).withColumn("hit", F.col("t") > 0.5)
    return kn.select_route(x, "k", "profile", "score", "hit").select("k", F.col("profile").alias("route"), *_r("route_score"), "exact_matches")


@query("clu13_lineage_resolution", f"WITH {_ADM}, x AS (SELECT k % 50 AS cl, profile * 100 + k // 50 % 3 AS ca, max(t * 0.6 + r * 0.4 + k / 1e6) AS s FROM c GROUP BY 1, 2), y AS (SELECT *, row_number() OVER a AS ra, row_number() OVER (PARTITION BY ca ORDER BY s DESC, cl) AS rb, s - coalesce(lead(s) OVER a, 0) AS m FROM x WINDOW a AS (PARTITION BY cl ORDER BY s DESC, ca)) SELECT cl, CASE WHEN s >= 0.6 THEN ca END AS ca, round(CAST(s AS DOUBLE), 6) AS s, CASE WHEN s < 0.6 THEN 'new' WHEN rb = 1 AND m >= 0.05 THEN 'resolved' ELSE 'review' END AS resolution FROM y WHERE ra = 1")
def clu13(spark, d):
    x = adm(spark, d).groupBy((F.col("k") % 50).alias("cl"), (F.col("profile") * 100 + F.floor(F.col("k") / 50) % 3).alias("ca")).agg(F.max(F.col("t") * 0.6 + F.col("r") * 0.4 + F.col("k") / 1e6).alias("s"))
    return kn.resolve_lineage(x, "ca", "cl", "s").select("cl", "ca", *_r("s"), "resolution")


@query("clu07_cluster_splits")
def clu07(spark, d):
    return kn.split_cluster(table(spark, d, "embeddings").select((F.col("label") % 3).alias("cluster"), "vec_id", "embedding"), "cluster", "vec_id", "embedding", 0.9)


@query("str14_keywords", "WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-zà-ÿ0-9]+'), lambda x: x <> '')) AS term FROM benchmark), f AS (SELECT item_id, term, count(*) AS f FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS d FROM f GROUP BY 1), s AS (SELECT item_id, term, f * ln((1 + (SELECT count(*) FROM benchmark)) / (1 + d)) AS score FROM f JOIN d USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, term COLLATE \"C\") AS rank FROM s) SELECT item_id, term, round(score, 6) AS score, rank FROM r WHERE rank <= 8".replace(' COLLATE \"C\"', ""))
def str14(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.filter(F.split(F.lower("text"), "[^a-zà-ÿ0-9]+"), lambda x: x != "").alias("t"))
    return kn.keywords(b, "item_id", "t").select("item_id", "term", *_r("score"), "rank")


@query("str18_marks", "SELECT p_partkey, replace(regexp_replace(replace(p_name || ' red', 'small red', '#'), 'red', '', 'g'), '#', 'small red') AS name FROM part")
def str18(spark, d):
    return table(spark, d, "part").select("p_partkey", kn.strip_marks(F.concat(F.col("p_name"), F.lit(" red")), ["red"], ["small red"]).alias("name"))


@query("srt03_suggestions")
def srt03(spark, d):
    p = table(spark, d, "part")
    return kn.suggestions(p.select("p_partkey", F.regexp_replace("p_name", "e", "ee").alias("raw")), p.select("p_brand", "p_name"), "p_partkey", "raw", "p_brand", "p_name")


@query("agg37_topic_representatives")
def agg37(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("topic"), F.col("p_name").alias("text")).agg((F.count("*") % 3).alias("support"))
    return kn.topic_representatives(p, "topic", "text", "support")


@query("agg15_skill_trends", "WITH a AS (SELECT user_id AS k, coalesce(sum(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 0) / pi() AS n, coalesce(sum(value) FILTER (ts < TIMESTAMP '2024-01-16' AND user_id % 9 <> 0), 0) / pi() AS b FROM events GROUP BY 1) SELECT k, round(CASE WHEN n + b > 0 THEN n / (n + b) ELSE 0 END, 6) AS trend_score, round(CASE WHEN b > 0 THEN (n - b) / b END, 6) AS growth, CASE WHEN b > 0 THEN CASE WHEN (n - b) / b >= 0.2 THEN 'rising' WHEN (n - b) / b <= -0.2 THEN 'declining' ELSE 'stable' END WHEN n > 0 THEN 'new' ELSE 'stable' END AS direction FROM a")
def agg15(spark, d):
    t = F.lit("2024-01-16").cast("timestamp")
    v = F.col("value") / F.pi()
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.sum(F.when(F.col("ts") >= t, v).otherwise(0.0)).alias("n"), F.sum(F.when((F.col("ts") < t) & (F.col("user_id") % 9 != 0), v).otherwise(0.0)).alias("b"))
    return kn.skill_trends(a, "k", "n", "b").select("k", *_r("trend_score", "growth"), "direction")


@query("agg32_input_quality", "WITH s AS (SELECT source, lang, CASE WHEN source = 'src3' AND doc_id % 2 = 0 THEN NULL ELSE lang END AS l2 FROM documents) SELECT source, count(DISTINCT lang) AS languages, CASE WHEN count(l2) = count(*) THEN count(DISTINCT l2) END AS enterprises FROM s GROUP BY 1")
def agg32(spark, d):
    s = table(spark, d, "documents").withColumn("l2", F.when(~((F.col("source") == "src3") & (F.col("doc_id") % 2 == 0)), F.col("lang")))
    return s.groupBy("source").agg(kn.all_or_unavailable("lang", F.countDistinct("lang")).alias("languages"), kn.all_or_unavailable("l2", F.countDistinct("l2")).alias("enterprises"))


@query("agg44_ranking_metrics", f"WITH {FACTS}, a AS (SELECT skill, row_number() OVER (ORDER BY count(*) DESC, skill) AS r FROM f WHERE version = 1997 GROUP BY 1), b AS (SELECT skill, row_number() OVER (ORDER BY count(*) DESC, skill) AS t FROM f WHERE version = 1998 GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 20), j AS (SELECT * FROM a LEFT JOIN b USING (skill)), c AS (SELECT row_number() OVER (ORDER BY r) AS x, t FROM j WHERE r <= 10 AND t IS NOT NULL) SELECT round((SELECT count(*) FROM c) / 10, 6) AS precision, round((SELECT count(*) FROM c) / 20, 6) AS recall, round((SELECT covar_pop(x, t) / (stddev_pop(x) * stddev_pop(t)) FROM c), 6) AS ranking_correlation, round((SELECT count(*) FILTER (skill % 3 = skill % 2) / count(t) FROM j WHERE t IS NOT NULL), 6) AS direction_accuracy")
def agg44(spark, d):
    f = facts(spark, d)
    rank = lambda v: f.filter(F.col("version") == v).groupBy("skill").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("n"), "skill")))
    x = kn.ranking_metrics(rank(1997).select("skill", "rank", (F.col("skill") % 3).alias("dir")), rank(1998).filter("rank <= 20").select("skill", "rank", (F.col("skill") % 2).alias("dir")), "skill", "rank", "dir", 10)
    return x.select(*_r("precision", "recall", "ranking_correlation", "direction_accuracy"))


@query("agg51_pair_summary", f"WITH {FACTS}, r AS (SELECT position, skill, count(*) FILTER (version = 1998) - count(*) FILTER (version = 1997) AS dl FROM f GROUP BY 1, 2) SELECT position, count(*) AS skills, count(*) FILTER (dl > 0) AS grown, count(*) FILTER (dl < 0) AS shrunk, CAST(max(abs(dl)) AS BIGINT) AS largest FROM r GROUP BY 1")
def agg51(spark, d):
    c = lambda v: F.count_if(F.col("version") == v)
    r = facts(spark, d).groupBy("position", "skill").agg((c(1998) - c(1997)).alias("dl"))
    return r.groupBy("position").agg(F.count("*").alias("skills"), F.count_if(F.col("dl") > 0).alias("grown"), F.count_if(F.col("dl") < 0).alias("shrunk"), F.max(F.abs("dl")).alias("largest"))


@query("evo09_requirement_drops", f"WITH {FACTS}, b AS (SELECT ent, skill, max(doc % 9) AS y FROM f WHERE version = 1997 GROUP BY 1, 2), a AS (SELECT ent, skill, max(doc % 9) AS y FROM f WHERE version = 1998 GROUP BY 1, 2) SELECT ent, skill, b.y AS before, a.y AS after, round(least(1, (b.y - a.y) / 5.0), 6)::DOUBLE AS magnitude FROM b JOIN a USING (ent, skill) WHERE b.y - a.y >= 1")
def evo09(spark, d):
    f = facts(spark, d).withColumn("y", F.col("doc") % 9)
    return kn.requirement_drops(f.filter("version = 1997"), f.filter("version = 1998"), ["ent", "skill"], "y").withColumn("magnitude", F.round("magnitude", 6))


@query("evo13_controlled_replay", f"WITH {FACTS}, c AS (SELECT version, ent, count(*) AS n, avg(count(*)) OVER (PARTITION BY version) AS mean FROM f GROUP BY 1, 2), p AS (SELECT unnest(range(4)) AS mask) SELECT mask, CAST(sum(a.n) AS BIGINT) AS n FROM p JOIN c a ON a.version = CASE WHEN mask & 1 <> 0 THEN 1998 ELSE 1997 END JOIN c b ON b.ent = a.ent AND b.n > b.mean AND b.version = CASE WHEN mask & 2 <> 0 THEN 1998 ELSE 1997 END GROUP BY 1")
def evo13(spark, d):
    f = facts(spark, d)

    def inputs(v):
        """The facts of a version, and its sources with more facts than the mean of all."""
        a = f.filter(F.col("version") == v)
        n = a.groupBy("ent").agg(F.count("*").alias("n"))
        return {"a_facts": a, "b_sources": n.filter(F.col("n") > n.agg(F.avg("n")).first()[0]).select("ent")}

    return kn.replay(lambda x: x["a_facts"].join(x["b_sources"], "ent", "left_semi").agg(F.count("*").alias("n")), inputs(1997), inputs(1998)).select("mask", "n")


@query("mat36_contributions", f"WITH {_ADM}, x AS (SELECT k, profile, t AS s, 1 + profile AS w FROM c) SELECT k, CAST(profile AS BIGINT) AS profile, round(CAST(s * w / sum(w) OVER p AS DOUBLE), 6) AS contribution, round(CAST(CASE WHEN sum(s * w) OVER p > 0 THEN s * w / sum(s * w) OVER p ELSE 0 END AS DOUBLE), 6) AS share, round(CAST((sum(s * w) OVER p - s * w) / (sum(w) OVER p - w) AS DOUBLE), 6) AS without FROM x WINDOW p AS (PARTITION BY k)")
def mat36(spark, d):
    x = adm(spark, d).withColumn("w", (1 + F.col("profile")).cast("double"))
    return kn.contributions(x, ["k"], "profile", "t", "w").select("k", "profile", *_r("contribution", "share", "without"))


@query("mat39_learning_steps", "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey % 60 AS skill, p_partkey % 60 - 1 - p_size % 7 AS needs FROM part WHERE p_partkey % 60 - 1 - p_size % 7 >= 0), s AS (SELECT c_custkey AS holder, c_custkey % 60 AS skill, 0 AS depth FROM customer UNION SELECT holder, e.needs, depth + 1 FROM s JOIN e USING (skill) WHERE depth < 5) SELECT holder, skill, CAST(max(depth) AS BIGINT) AS depth FROM s GROUP BY 1, 2")
def mat39(spark, d):
    s, n = F.col("p_partkey") % 60, F.col("p_partkey") % 60 - 1 - F.col("p_size") % 7
    e = table(spark, d, "part").select(s.alias("skill"), n.alias("needs")).filter("needs >= 0").distinct()
    return kn.learning_steps(e, table(spark, d, "customer").select(F.col("c_custkey").alias("holder"), (F.col("c_custkey") % 60).alias("skill")))


@query("mat38_routes")
def mat38(spark, d):
    costs = spark.range(60).select(F.col("id").alias("skill"), (1 + F.col("id") % 5).cast("double").alias("cost"))
    return kn.plan_route(mat39(spark, d), costs, 20.0)


@query("mat30_context_coverage", "WITH r AS (SELECT o_custkey AS holder, o_orderkey AS req, unnest([o_orderkey % 9, o_orderkey % 7, o_orderkey % 5]) AS w FROM orders), q AS (SELECT DISTINCT * FROM r), h AS (SELECT DISTINCT c_custkey AS holder, unnest([c_custkey % 9, c_custkey % 4, 3]) AS w FROM customer), g AS (SELECT holder, req, count(h.w) / count(*) AS c FROM q LEFT JOIN h USING (holder, w) GROUP BY 1, 2) SELECT holder, req, round(c, 6) AS coverage, CASE WHEN c >= 0.7 THEN 'matched' WHEN c >= 0.3 THEN 'partial' ELSE 'missing' END AS status FROM g")
def mat30(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("holder"), k.alias("req"), F.array(k % 9, k % 7, k % 5).alias("w"))
    c = F.col("c_custkey")
    h = table(spark, d, "customer").select(c.alias("holder"), F.array(c % 9, c % 4, F.lit(3).cast("bigint")).alias("w"))
    return kn.context_coverage(r, h, ["holder", "req"], "w").select("holder", "req", *_r("coverage"), "status")


@query("ret11_fragments", "SELECT p_partkey AS owner, x.type, x.text, p_partkey || ':' || x.type AS fragment_id, sha256(x.text) AS hash FROM (SELECT p_partkey, unnest([{'type': 'name', 'text': p_name}, {'type': 'kind', 'text': CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_type END}]) AS x FROM part) WHERE trim(x.text) <> ''")
def ret11(spark, d):
    p = table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_type")))
    return kn.fragments(p, "p_partkey", {"name": "p_name", "kind": "kind"})


@query("ret09_metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def ret09(spark, d):
    return kn.metadata_filter(table(spark, d, "documents"), {"lang": "fr", "source": "src3", "text": None}).select("doc_id")


@query("mat04_weights", "SELECT p_partkey, round(CAST(greatest(0.05, least(1, (p_size / 50.0) * (1 - 0.6 * (p_partkey % 3) / 2.0) * (1 - 0.4 * (p_partkey % 2)) * (1 - 0.5 * (p_partkey % 4) / 3.0))) AS DOUBLE), 6) AS weight, round(CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.75 END * CASE WHEN p_partkey % 5 = 0 THEN 0.5 WHEN p_partkey % 5 = 1 THEN 0.6 ELSE 1.0 END, 6)::DOUBLE AS record_weight FROM part")
def mat04(spark, d):
    k = F.col("p_partkey")
    content = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.col("p_name")).otherwise("long text")
    return table(spark, d, "part").select("p_partkey", F.round(kn.effective_weight(F.col("p_size") / 50.0, k % 3 / 2.0, k % 2, k % 4 / 3.0), 6).alias("weight"), F.round(kn.record_weight(k % 2 == 0, F.col("p_name"), content), 6).alias("record_weight"))


@query("dat04_temporal_profiles", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN CAST(o_orderdate AS DATE) > DATE '2001-06-01' OR CAST(o_orderdate AS DATE) > DATE '2001-01-01' + CAST(o_orderkey % 900 - 300 AS INTEGER) THEN 'anomalous' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') <= 30 THEN 'fresh' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') <= 180 THEN 'aging' ELSE 'stale' END AS state FROM orders")
def dat04(spark, d):
    k = F.col("o_orderkey")
    seen = F.when(k % 10 != 0, F.to_date("o_orderdate"))
    s = kn.temporal_profile(seen, F.date_add(F.lit("2001-01-01").cast("date"), (k % 900 - 300).cast("int")), F.lit("2001-06-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", s.alias("state"))


@query("mat16_canonical_json", "SELECT r_regionkey, '{\"a\":' || r_regionkey || ',\"b\":\"' || r_name || '\"}' AS json FROM region")
def mat16(spark, d):
    r = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("b"), F.col("r_regionkey").alias("a"))
    return r.select("r_regionkey", kn.canonical_json("b", "a").alias("json"))


@query("udf04_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def udf04(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(kn.weighted_mean("l_discount", "l_quantity"), 6).alias("mean"))


