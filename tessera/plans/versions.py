"""Version and profile comparison queries on order lines, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import versions as vs

from .registry import query, table
from .relational import FACTS, facts

_SK = "sk AS (SELECT DISTINCT ent AS scope, version, skill, skill % 4 AS cat FROM f WHERE w >= 0.9), tk AS (SELECT DISTINCT ent AS scope, version, position FROM f WHERE w >= 0.95), sm AS (SELECT ent AS scope, count(DISTINCT doc) FILTER (version = 1997) AS b, count(DISTINCT doc) FILTER (version = 1998) AS a FROM f GROUP BY 1)"


def _side(event, own, other):
    had = f"AND coalesce((SELECT count(*) FROM sk o WHERE o.version = {other} AND o.scope = m.scope AND o.cat = m.cat), 0) <= 1" if event == "position_merge" else ""
    return f"""SELECT scope, '{event}' AS event, cat AS category, n AS cluster_skills, tot AS changed_skills, t AS changed_tasks, round(tot / al, 6) AS share FROM (
 SELECT c.scope, c.cat, c.n, sum(c.n) OVER (PARTITION BY c.scope)::BIGINT AS tot, row_number() OVER (PARTITION BY c.scope ORDER BY c.n DESC, c.cat) AS k, tt.t, al.al FROM (SELECT scope, cat, count(*) AS n FROM sk x WHERE version = {own} AND NOT EXISTS (SELECT 1 FROM sk y WHERE y.version = {other} AND y.scope = x.scope AND y.skill = x.skill) GROUP BY 1, 2) c
 JOIN (SELECT scope, count(*) AS t FROM tk x WHERE version = {own} AND NOT EXISTS (SELECT 1 FROM tk y WHERE y.version = {other} AND y.scope = x.scope AND y.position = x.position) GROUP BY 1) tt USING (scope) JOIN (SELECT scope, count(*) AS al FROM sk WHERE version = {own} GROUP BY 1) al USING (scope)) m
 WHERE k = 1 AND n >= 3 AND t >= 2 AND tot / al >= 0.25 AND scope IN (SELECT scope FROM sm WHERE b >= 3 AND a >= 3) {had}"""


@query("evo08_split_merge", f"WITH {FACTS}, {_SK} {_side('position_split', 1997, 1998)} UNION ALL {_side('position_merge', 1998, 1997)}")
def evo08(spark, d):
    f = facts(spark, d).withColumn("scope", F.col("ent"))
    s = f.filter("w >= 0.9").select("scope", "version", "skill", (F.col("skill") % 4).alias("category")).distinct()
    t = f.filter("w >= 0.95").select("scope", "version", "position").distinct()
    n = f.groupBy("scope").agg(F.countDistinct(F.when(F.col("version") == 1997, F.col("doc"))).alias("before"), F.countDistinct(F.when(F.col("version") == 1998, F.col("doc"))).alias("after"))
    b, a = (x.filter("version = 1997").drop("version") for x in (s, t)), (x.filter("version = 1998").drop("version") for x in (s, t))
    (sb, tb), (sa, ta) = b, a
    return vs.split_merge(sb, sa, tb, ta, "scope", "skill", "category", "position", n).withColumn("share", F.round("share", 6))


_DI = "di AS (SELECT ent, skill, version, count(*) AS n, max(modality) AS modality, list_sort(list(DISTINCT doc)) AS ev FROM f WHERE version IN (1997, 1998) GROUP BY 1, 2, 3), b AS (SELECT * FROM di WHERE version = 1997), a AS (SELECT * FROM di WHERE version = 1998)"


@query("joi09_full_diff", f"WITH {FACTS}, {_DI}, j AS (SELECT coalesce(a.ent, b.ent) AS ent, coalesce(a.skill, b.skill) AS skill, b.n AS bn, a.n AS an, b.modality AS bm, a.modality AS am, coalesce(b.ev, []) AS be, coalesce(a.ev, []) AS ae FROM b FULL JOIN a ON a.ent = b.ent AND a.skill = b.skill) SELECT ent, skill, CASE WHEN bn IS NULL THEN 'added' WHEN an IS NULL THEN 'removed' WHEN bn <> an OR bm <> am THEN 'changed' ELSE 'evidence' END AS change, CASE WHEN bn IS NULL OR an IS NULL THEN '' ELSE concat_ws(',', CASE WHEN bm <> am THEN 'modality' END, CASE WHEN bn <> an THEN 'n' END) END AS fields, len(list_filter(ae, lambda x: NOT list_contains(be, x))) AS evidence_added, len(list_filter(be, lambda x: NOT list_contains(ae, x))) AS evidence_removed FROM j WHERE bn IS NULL OR an IS NULL OR bn <> an OR bm <> am OR be <> ae")
def joi09(spark, d):
    g = facts(spark, d).filter("version in (1997, 1998)").groupBy("ent", "skill", "version").agg(F.count("*").alias("n"), F.max("modality").alias("modality"), F.collect_set("doc").alias("ev"))
    x = vs.full_diff(g.filter("version = 1997"), g.filter("version = 1998"), ["ent", "skill"], ["n", "modality"], "ev")
    return x.select("ent", "skill", "change", F.array_join("changed_fields", ",").alias("fields"), F.size("evidence_added").cast("bigint").alias("evidence_added"), F.size("evidence_removed").cast("bigint").alias("evidence_removed"))


@query("evo14_profile_comparison", "WITH e AS (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) % 5 AS skill FROM events), p AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END AS catalog, CASE WHEN count(*) < 60 THEN 'insufficient_evidence' ELSE 'available' END AS state FROM events GROUP BY 1), q AS (SELECT x.user_id AS a, y.user_id AS b, x.catalog AS ca, y.catalog AS cb, x.state AS sa, y.state AS sb FROM p x JOIN p y ON y.user_id = x.user_id + 1), c AS (SELECT q.a, q.b, (SELECT count(*) FROM e x JOIN e y ON x.event_type = y.event_type AND x.skill = y.skill WHERE x.user_id = q.a AND y.user_id = q.b) AS shared, (SELECT count(*) FROM e WHERE user_id = q.a) AS na, (SELECT count(*) FROM e WHERE user_id = q.b) AS nb, * EXCLUDE (a, b) FROM q) SELECT a, b, CASE WHEN coalesce(ca <> cb, false) THEN 'blocked' WHEN sa = 'insufficient_evidence' OR sb = 'insufficient_evidence' THEN 'insufficient_evidence' ELSE 'complete' END AS status, shared, na - shared AS only_a, nb - shared AS only_b FROM c")
def evo14(spark, d):
    e = table(spark, d, "events")
    p = e.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 3).alias("catalog"), F.lit("a").alias("window_start"), F.lit("b").alias("window_end"), F.when(F.col("n") < 60, "insufficient_evidence").otherwise("available").alias("state"))
    ids = p.select(F.col("user_id").alias("a"))
    pairs = ids.withColumn("b", F.col("a") + 1).join(ids.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
    return vs.compare_profiles(e.select("user_id", "event_type", (F.floor("value") % 5).alias("skill")), p, "user_id", ["event_type", "skill"], pairs)


@query("mat17_relation_statistics", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, p_size * 2, 0)::BIGINT AS supporting_jd_count, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END, 0)::BIGINT AS deduplicated_jd_count, 0::BIGINT AS enterprise_count, 0::BIGINT AS source_count, (p_size * 2)::BIGINT AS evidence_count, (p_size / 50.0)::DOUBLE AS raw_frequency, 0::DOUBLE AS quality_adjusted_frequency FROM part")
def mat17(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("s"), (F.col("p_size") * 2).alias("m"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("k"), (F.col("p_size") / 50.0).alias("q"))
    return p.select("p_partkey", *vs.relation_statistics({"supporting_jd_count": "s"}, {"support_count": "m", "support_document_count": "k", "support_ratio": "q"}))


@query("emg04_candidate_layers", "WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, CAST(floor(value) AS BIGINT) % 3 AS region, event_id % 4 AS source FROM events), g AS (SELECT user_id, count(*) AS observations, count(DISTINCT day) AS dates, max(day) AS latest, count(DISTINCT event_type) <= 1 AS same_content FROM o GROUP BY 1) SELECT g.user_id, any_value(observations) AS observations, any_value(dates) AS dates, CAST(any_value(latest) AS VARCHAR) AS latest, any_value(same_content) AS same_content, CAST(1 AS BIGINT) AS independent_postings, false AS growth_available, count(DISTINCT o.event_type) AS enterprises, count(DISTINCT region) AS regions, count(DISTINCT source) AS sources FROM g JOIN o ON o.user_id = g.user_id AND o.day = g.latest GROUP BY 1")
def emg04(spark, d):
    o = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", (F.floor("value") % 3).alias("region"), (F.col("event_id") % 4).alias("source"))
    return vs.candidate_layers(o, "user_id", "day", "event_type", "event_type", "region", "source").withColumn("latest", F.col("latest").cast("string"))


@query("snk06_job_counters", "WITH f AS (SELECT o_custkey % 20 AS job, o_orderdate AS k FROM orders WHERE o_orderstatus <> 'F'), n AS (SELECT k, min(job) AS job FROM f WHERE k NOT IN (SELECT o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000) GROUP BY 1), c AS (SELECT job, count(*) AS new FROM n GROUP BY 1) SELECT job, count(*) AS fetched, coalesce(any_value(c.new), 0) AS new, count(*) - coalesce(any_value(c.new), 0) AS duplicate FROM f LEFT JOIN c USING (job) GROUP BY 1")
def snk06(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("job"), F.col("o_orderdate").alias("k"), "o_orderstatus", "o_totalprice")
    return vs.job_counters(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus = 'F' and o_totalprice > 300000"), "job", "k")


@query("flt10_required_fields", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 OR trim(lang) = '' THEN 'lang' END, CASE WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN 'note' END, CASE WHEN trim(source) = '' THEN 'source' END) AS missing FROM documents")
def flt10(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", F.when(k % 3 != 0, F.col("lang")).alias("lang"), "source", F.when(k % 2 == 1, F.col("lang")).alias("extra"), F.when(k % 5 != 0, F.lit("n")).otherwise(" ").alias("note"))
    return x.select("doc_id", F.array_join(vs.required_fields(["lang", "source", "note"], {"note": "extra"}), ",").alias("missing"))


@query("dat03_half_life", "SELECT o_orderkey, round(least(power(2, -greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')) / 180.0), CASE WHEN CAST(o_orderdate AS DATE) > DATE '1998-01-01' THEN 0.5 ELSE 1.0 END), 6) AS decay FROM orders")
def dat03(spark, d):
    """A date in the future is an anomaly, whose decay is capped."""
    from tessera.functions.scalars import half_life

    age = F.datediff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.round(F.least(half_life(age, 180.0), F.when(age < 0, 0.5).otherwise(1.0)), 6).alias("decay"))


@query("dat06_causal_windows", "WITH s AS (SELECT min(CAST(ts AS DATE)) AS d0 FROM events) SELECT date_diff('day', d0, CAST(ts AS DATE)) // 3 AS window, count(*) AS events, count(DISTINCT user_id) AS users FROM events, s GROUP BY 1")
def dat06(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id")
    first = e.agg(F.min("day").alias("d0"))
    return e.crossJoin(F.broadcast(first)).groupBy(F.floor(F.datediff("day", "d0") / 3).alias("window")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
