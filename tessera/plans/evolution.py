"""Version evolution, emergence and lifecycle queries on order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.scalars import big
from tessera.operators import evolution as ev
from tessera.operators import lifecycle as lc

from .registry import query, table
from .relational import FACTS, facts
from .timeseries import S, daily

#: Versions of positions (here suppliers): all that was bought of them in 1997 and in 1998, with illustrative weights.
_V = """v AS (SELECT ent AS position, version, skill, least(1.0, sum(w) / 7) AS weight, least(1.0, count(*) / 10.0) AS confidence, count(*) AS support, count(DISTINCT source) AS sources, count(DISTINCT doc % 4) AS enterprises, (skill // 5) % 3 AS category FROM f WHERE version IN (1997, 1998) GROUP BY 1, 2, 3),
vs AS (SELECT *, count(*) OVER (PARTITION BY position, version) AS samples FROM v), b AS (SELECT * FROM vs WHERE version = 1997), a AS (SELECT * FROM vs WHERE version = 1998)"""


def versions(spark, d):
    v = facts(spark, d).filter(F.col("version").isin(1997, 1998)).drop("position").withColumnRenamed("ent", "position")
    quarters = big(F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(pmod(doc, 4) AS int))"))))  # a second distinct count would take every row several times
    v = v.groupBy("position", "version", "skill").agg(F.least(F.lit(1.0), F.sum("w") / 7).alias("weight"), F.least(F.lit(1.0), F.count("*") / 10.0).alias("confidence"), F.count("*").alias("support"), F.countDistinct("source").alias("sources"), quarters.alias("enterprises"))
    v = v.withColumn("category", F.floor(F.col("skill") / 5) % 3).withColumn("samples", F.count("*").over(W.partitionBy("position", "version")))
    return v.filter("version = 1997").drop("version"), v.filter("version = 1998").drop("version")


_Q = "(0.3 + 0.7 * (least(1.0, {p}.support / 5.0) + least(1.0, {p}.sources / 3.0) + least(1.0, {p}.enterprises / 3.0)) / 3.0)"
_SIG = f"""j AS (SELECT coalesce(a.position, b.position) AS position, coalesce(a.skill, b.skill) AS skill, b.weight AS wb, a.weight AS wa, b.confidence AS cb, a.confidence AS ca, b.support AS sb, a.support AS sa, b.sources AS ob, a.sources AS oa, b.enterprises AS eb, a.enterprises AS ea, coalesce(a.category, b.category) AS category,
 CASE WHEN a.skill IS NOT NULL THEN {_Q.format(p='a')} ELSE {_Q.format(p='b')} END AS quality FROM b FULL JOIN a ON a.position = b.position AND a.skill = b.skill),
k AS (SELECT *, coalesce(wa, 0) - coalesce(wb, 0) AS delta, CASE WHEN wb IS NULL THEN CASE WHEN wa >= 0.3 THEN 'skill_emergence' END WHEN wa IS NULL THEN CASE WHEN wb >= 0.2 THEN 'skill_decline' END WHEN wa - wb >= 0.15 AND wa >= 0.2 THEN 'skill_emergence' WHEN wa - wb <= -0.15 AND wb >= 0.2 THEN 'skill_decline' END AS kind FROM j),
sg AS (SELECT *, coalesce(ca, cb) AS rc, least(1, greatest(0, least(1, greatest(0, CASE WHEN wb IS NULL THEN wa / 0.3 WHEN wa IS NULL THEN wb / 0.2 WHEN delta > 0 THEN delta / 0.15 ELSE -delta / 0.15 END)) * 0.4 + CASE WHEN wb IS NULL OR wa IS NULL THEN 0.8 WHEN (CASE WHEN delta > 0 THEN ca ELSE cb END) >= 0.6 THEN 0.9 ELSE 0.7 END * 0.2 + quality * 0.2 + 0.2)) AS conf,
 coalesce(CASE WHEN wb IS NULL THEN sa < 3 OR oa < 2 WHEN wa IS NULL THEN sb < 3 OR ob < 2 ELSE sb < 3 OR sa < 3 OR (ob < 2 AND oa < 2) OR (abs(delta) >= 0.05 AND (CASE WHEN abs(oa - ob) >= 1 THEN 1 ELSE 0 END + CASE WHEN abs(ea - eb) >= 1 THEN 1 ELSE 0 END + CASE WHEN abs(sa - sb) >= 3 THEN 1 ELSE 0 END) >= 2) END, false) AS driven FROM k WHERE kind IS NOT NULL)"""


def signals(spark, d):
    b, a = versions(spark, d)
    return ev.atomic_signals(b, a, ["position", "skill"])


@query("evo01_atomic_signals", f"WITH {FACTS}, {_V}, {_SIG} SELECT position, skill, kind, round(wb, 6) AS before_weight, round(wa, 6) AS after_weight, round(delta, 6) AS delta, round(conf, 6) AS signal_confidence, round(quality, 6) AS quality, driven AS coverage_driven FROM sg")
def evo01(spark, d):
    return signals(spark, d).select("position", "skill", "kind", *[F.round(c, 6).alias(c) for c in ("before_weight", "after_weight", "delta", "signal_confidence", "quality")], "coverage_driven")


_REP = """dr AS (SELECT * FROM sg WHERE NOT driven), rp AS (SELECT o.position, o.category, o.skill AS old, n.skill AS new, least(1, greatest(0, least(1, greatest(0, (abs(o.delta) + abs(n.delta)) / 0.3 * 0.5)) * 0.4 + CASE WHEN o.rc >= 0.6 AND n.rc >= 0.6 THEN 0.9 ELSE 0.7 END * 0.2 + least(o.quality, n.quality) * 0.2 + 0.2)) AS confidence, least(1.0, (abs(o.delta) + abs(n.delta)) / 2) AS magnitude
 FROM dr o JOIN dr n ON o.position = n.position AND o.category = n.category AND o.skill <> n.skill WHERE o.kind = 'skill_decline' AND n.kind = 'skill_emergence'), rq AS (SELECT * FROM rp WHERE confidence >= 0.5)"""


@query("joi18_replacements", f"WITH {FACTS}, {_V}, {_SIG}, {_REP} SELECT position, category, old, new, round(confidence, 6) AS confidence, round(magnitude, 6) AS magnitude FROM rq")
def joi18(spark, d):
    return ev.replacements(signals(spark, d), ["position"], "skill").select("position", "category", "old", "new", F.round("confidence", 6).alias("confidence"), F.round("magnitude", 6).alias("magnitude"))


@query("evo06_stack_migrations", f"WITH {FACTS}, {_V}, {_SIG}, {_REP} SELECT position, category, count(*) AS replacements, array_to_string(list_sort(list(DISTINCT old)), ',') AS sources, array_to_string(list_sort(list(DISTINCT new)), ',') AS targets, round(avg(confidence) * 0.9, 6) AS confidence, round(avg(magnitude), 6) AS magnitude FROM rq GROUP BY 1, 2 HAVING count(*) >= 2")
def evo06(spark, d):
    x = ev.stack_migrations(ev.replacements(signals(spark, d), ["position"], "skill"), ["position"])
    return x.select("position", "category", "replacements", F.array_join("sources", ",").alias("sources"), F.array_join("targets", ",").alias("targets"), F.round("confidence", 6).alias("confidence"), F.round("magnitude", 6).alias("magnitude"))


@query("evo03_evidence_quality", f"WITH {FACTS}, {_V} SELECT position, skill, round({_Q.format(p='a')}, 6) AS quality FROM a")
def evo03(spark, d):
    return versions(spark, d)[1].select("position", "skill", F.round(ev.evidence_quality(F.col("support"), F.col("sources"), F.col("enterprises")), 6).alias("quality"))


@query("evo04_event_ids", f"WITH {FACTS}, {_V}, {_SIG} SELECT position, skill, kind, row_number() OVER (ORDER BY kind, position, skill) AS event_id FROM sg WHERE NOT driven")
def evo04(spark, d):
    from tessera.operators.relational import total

    return signals(spark, d).filter("not coverage_driven").select("position", "skill", "kind", big(F.row_number().over(total().orderBy("kind", "position", "skill"))).alias("event_id"))


@query("evo05_coverage_artifacts", f"WITH {FACTS}, {_V}, {_SIG} SELECT position, skill, kind FROM sg WHERE driven")
def evo05(spark, d):
    return signals(spark, d).filter("coverage_driven").select("position", "skill", "kind")


@query("evo07_role_breadth", f"WITH {FACTS}, g AS (SELECT position, version, count(DISTINCT skill) AS s, count(DISTINCT ent) AS e, count(DISTINCT doc % 37) AS c FROM f GROUP BY 1, 2) SELECT position, version, round(0.35 * (s - lag(s) OVER w) / greatest(lag(s) OVER w, 1) + 0.25 * (e - lag(e) OVER w) / greatest(lag(e) OVER w, 1) + 0.2 * (c - lag(c) OVER w) / greatest(lag(c) OVER w, 1), 6) AS breadth_change FROM g WINDOW w AS (PARTITION BY position ORDER BY version)")
def evo07(spark, d):
    g = facts(spark, d).groupBy("position", "version").agg(F.countDistinct("skill").alias("s"), F.countDistinct("ent").alias("e"), F.countDistinct(F.col("doc") % 37).alias("c"))
    return ev.role_breadth(g, "position", "version", {"s": 0.35, "e": 0.25, "c": 0.2}).select("position", "version", F.round("breadth_change", 6).alias("breadth_change"))


@query("evo10_renames", "WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_custkey, o_orderkey, p AS previous_name, o_orderstatus AS name FROM o WHERE p <> o_orderstatus")
def evo10(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("name"))
    return ev.renames(o, "o_custkey", "o_orderkey", "name").select("o_custkey", "o_orderkey", "previous_name", "name")


@query("evo11_watermarks", "SELECT a.o_orderkey, concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus_differs' END, CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'o_orderpriority_differs' END) AS reasons FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def evo11(spark, d):
    o = table(spark, d, "orders")
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.struct("o_orderstatus", "o_orderpriority").alias("r"))
    x = o.select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("l")).join(b, "o_orderkey")
    return x.select("o_orderkey", F.array_join(ev.watermark_reasons(F.col("l"), F.col("r"), ["o_orderstatus", "o_orderpriority"]), ",").alias("reasons"))


@query("evo12_build_inputs", "SELECT l_suppkey, count(DISTINCT l_orderkey) = count(*) AS unique_facts, sha256(string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey)) AS watermark FROM lineitem GROUP BY 1")
def evo12(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.countDistinct("l_orderkey") == F.count("*")).alias("unique_facts"), F.sha2(F.array_join(F.array_sort(F.collect_list("l_orderkey")), ","), 256).alias("watermark"))
    return g


@query("evo15_publish_gate", f"WITH {FACTS}, {_V}, g AS (SELECT position, count(*) AS n, min(confidence) AS c, count(*) FILTER (sources < 2) AS s FROM a GROUP BY 1) SELECT position, concat_ws(',', CASE WHEN n < 50 THEN 'too_few_relations' END, CASE WHEN c < 0.1 THEN 'low_confidence' END, CASE WHEN s > 0 THEN 'single_source_relation' END) AS reasons, NOT (n < 50 OR c < 0.1 OR s > 0) AS publishable FROM g")
def evo15(spark, d):
    from tessera.functions.scalars import reasons

    g = versions(spark, d)[1].groupBy("position").agg(F.count("*").alias("n"), F.min("confidence").alias("c"), F.count_if(F.col("sources") < 2).alias("s"))
    r = reasons([("too_few_relations", F.col("n") < 50), ("low_confidence", F.col("c") < 0.1), ("single_source_relation", F.col("s") > 0)])
    return g.select("position", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("publishable"))


@query("set04_responsibility_shift", f"WITH {FACTS}, r AS (SELECT ent, version, list(DISTINCT skill) AS s FROM f WHERE w >= 0.9 AND version IN (1997, 1998) GROUP BY 1, 2), p AS (SELECT a.ent, b.s AS b, a.s AS a FROM r a JOIN r b ON a.ent = b.ent AND a.version = 1998 AND b.version = 1997), x AS (SELECT ent, len(list_filter(b, lambda v: NOT list_contains(a, v))) AS gone, len(list_filter(a, lambda v: NOT list_contains(b, v))) AS new, len(list_intersect(a, b)) AS k FROM p) SELECT ent, gone AS removed, new AS added, round(k / (gone + new + k), 6) AS similarity FROM x WHERE gone + new >= 2 AND k / (gone + new + k) < 0.5 AND k > 0 AND gone > 0 AND new > 0")
def set04(spark, d):
    r = facts(spark, d).filter("w >= 0.9 and version in (1997, 1998)").groupBy("ent").pivot("version", [1997, 1998]).agg(F.collect_set("skill"))
    x = r.filter((F.size("1997") > 0) & (F.size("1998") > 0)).select("ent", ev.responsibility_shift(F.col("1997"), F.col("1998")).alias("s")).filter("s is not null")
    return x.select("ent", big(F.size("s.removed")).alias("removed"), big(F.size("s.added")).alias("added"), F.round("s.similarity", 6).alias("similarity"))


_DEC = "x AS (SELECT b.position, b.skill, a.weight - b.weight AS delta, CASE WHEN b.skill % 5 = 0 THEN 0.6 ELSE 0.1 END AS drift, (b.skill % 10) / 10.0 AS jac, least(1.0, abs(a.support - b.support) / 20.0) AS evi, b.skill % 5 = 0 AS cc, b.skill % 7 = 0 AS nc FROM b JOIN a ON a.position = b.position AND a.skill = b.skill), y AS (SELECT *, greatest(abs(delta), 0.001) AS d FROM x), z AS (SELECT *, drift * d + CASE WHEN cc THEN 0.15 * d ELSE 0 END + CASE WHEN nc THEN 0.08 * d ELSE 0 END AS sem, (1 - jac) * d * 0.8 AS top, evi * d AS ev FROM y)"


@query("agg50_change_decomposition", f"WITH {FACTS}, {_V}, {_DEC} SELECT position, skill, round(sem / (sem + top + ev) * least((sem + top + ev) / d, 0.95), 6) AS semantic, round(top / (sem + top + ev) * least((sem + top + ev) / d, 0.95), 6) AS topological, round(ev / (sem + top + ev) * least((sem + top + ev) / d, 0.95), 6) AS evidence, round(1 - least((sem + top + ev) / d, 0.95), 6) AS residual FROM z")
def agg50(spark, d):
    b, a = versions(spark, d)
    x = b.alias("b").join(a.alias("a"), ["position", "skill"]).select("position", "skill", (F.col("a.weight") - F.col("b.weight")).alias("delta"), F.least(F.lit(1.0), F.abs(F.col("a.support") - F.col("b.support")) / 20.0).alias("evi"))
    five = F.col("skill") % 5 == 0
    y = ev.decompose(x, "delta", F.when(five, 0.6).otherwise(0.1), (F.col("skill") % 10) / 10.0, F.col("evi"), five, F.col("skill") % 7 == 0)
    return y.select("position", "skill", *[F.round(c, 6).alias(c) for c in ("semantic", "topological", "evidence", "residual")])


@query("agg49_attribution", f"WITH {FACTS}, {_V} SELECT b.position, b.skill, round((a.weight - b.weight) - (a.support - b.support) / 100.0 - (a.sources - b.sources) / 50.0, 6) AS residual FROM b JOIN a ON a.position = b.position AND a.skill = b.skill")
def agg49(spark, d):
    b, a = versions(spark, d)
    x = b.alias("b").join(a.alias("a"), ["position", "skill"])
    res = ev.attribution(F.col("a.weight") - F.col("b.weight"), (F.col("a.support") - F.col("b.support")) / 100.0, (F.col("a.sources") - F.col("b.sources")) / 50.0)
    return x.select("position", "skill", F.round(res, 6).alias("residual"))


def candidates(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("user_id", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 6).alias("win"))
    return g.agg(F.count("*").cast("double").alias("support"), F.countDistinct("event_type").cast("double").alias("companies"), (F.avg("value") / 80).alias("emergence"), F.countDistinct(F.to_date("ts")).cast("double").alias("stability"))


@query("emg09_lifecycle")
def emg09(spark, d):
    return lc.lifecycle(candidates(spark, d), "user_id", "win", "support", "companies", "emergence", "stability", window="win")


@query("emg11_promotion_gaps", "WITH c AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6 AS win, count(*) AS s, count(DISTINCT event_type) AS c FROM events GROUP BY 1, 2), t AS (SELECT user_id, count(*)::DOUBLE AS windows, max(s)::DOUBLE AS support, max(c)::DOUBLE AS companies FROM c GROUP BY 1) SELECT user_id, greatest(0.0, 5.0 - windows) AS missing_windows, greatest(0.0, 10.0 - support) AS missing_support, greatest(0.0, 5.0 - companies) AS missing_companies, windows >= 5 AND support >= 10 AND companies >= 5 AS satisfied FROM t")
def emg11(spark, d):
    t = candidates(spark, d).groupBy("user_id").agg(F.count("*").cast("double").alias("windows"), F.max("support").alias("support"), F.max("companies").alias("companies"))
    x = lc.promotion_gap(t, "stable_emerging_role", {"windows": "windows", "support": "support", "companies": "companies"})
    return x.select("user_id", "missing_windows", "missing_support", "missing_companies", "satisfied")


@query("emg01_stage2", f"WITH {FACTS}, g AS (SELECT skill, count(*) AS p, count(DISTINCT ent) AS e, count(DISTINCT source) AS s, count(DISTINCT version) AS w FROM f GROUP BY 1), a AS (SELECT *, unnest(['none', 'structural', 'diffusion', 'persistence']) AS ablation FROM g) SELECT skill, ablation, CASE WHEN p < 3 THEN 'insufficient' WHEN (skill % 3 = 0 OR ablation = 'structural') AND (e >= 2 AND s >= 2 OR ablation = 'diffusion') AND (w >= 2 OR ablation = 'persistence') THEN 'emerging' WHEN skill % 3 = 0 THEN 'weak_signal' ELSE 'not_emerging' END AS decision FROM a")
def emg01(spark, d):
    g = facts(spark, d).groupBy("skill").agg(F.count("*").alias("p"), F.countDistinct("ent").alias("e"), F.countDistinct("source").alias("s"), F.countDistinct("version").alias("w"))
    return lc.stage2(g, F.col("skill") % 3 == 0, F.col("p"), F.col("e"), F.col("s"), F.col("w")).select("skill", "ablation", "decision")


@query("emg06_identity_reasons", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'membership_overlap' END, CASE WHEN p_size / 50.0 >= 0.7 THEN 'title' END, CASE WHEN p_partkey % 10 >= 5 AND p_partkey % 4 >= 2 THEN 'skills_and_responsibilities' END) AS reasons FROM part")
def emg06(spark, d):
    k = F.col("p_partkey")
    r = lc.identity_reasons(F.col("p_size") / 50.0, (k % 10) / 10.0, (k % 4) / 4.0, (k % 5 == 0).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(r, ",").alias("reasons"))


@query("mat11_germination", f"WITH {S}, g AS (SELECT subject, avg(score) / 3 AS a, CASE WHEN subject LIKE 'view%' THEN NULL ELSE stddev_pop(score) END AS b, count(*) / 30.0 AS c FROM s GROUP BY 1) SELECT subject, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + c * 0.2) / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END), 6) AS germination FROM g")
def mat11(spark, d):
    g = daily(spark, d).groupBy("subject").agg((F.avg("score") / 3).alias("a"), F.stddev_pop("score").alias("b"), (F.count("*") / 30.0).alias("c"))
    g = g.withColumn("b", F.when(~F.col("subject").startswith("view"), F.col("b")))
    return lc.germination(g, {"a": 0.5, "b": 0.3, "c": 0.2}).select("subject", F.round("germination", 6).alias("germination"))


def role_input(spark, d):
    f = facts(spark, d)
    n = f.groupBy("position", "version").agg(F.countDistinct("doc").alias("docs"))
    g = f.groupBy("position", "skill", "version").agg(F.count_if(F.col("modality") == "required").alias("r"), F.count("*").alias("n"), F.countDistinct("ent").alias("e"))
    x = g.join(n, ["position", "version"])
    return x.select("position", "skill", "version", F.least(F.lit(1.0), 8.0 * F.col("r") / F.col("docs")).alias("share"), (F.col("n") / F.col("docs")).alias("total"), ((F.col("n") < 2) | (F.col("e") <= 1)).alias("weak"))


@query("win33_role_states")
def win33(spark, d):
    return lc.role_states(role_input(spark, d), ["position", "skill"], "version", "share", "total", "weak")


@query("win34_role_transitions")
def win34(spark, d):
    s = lc.role_states(role_input(spark, d), ["position", "skill"], "version", "share", "total", "weak")
    return lc.role_transitions(s, ["position", "skill"], "version", "state", "share")


@query("agg36_temporal_layers", f"WITH {FACTS} SELECT skill, count(*) AS postings, count(DISTINCT ent) AS enterprises, count(DISTINCT source) AS sources, count(DISTINCT version) AS windows, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen FROM f GROUP BY 1")
def agg36(spark, d):
    return facts(spark, d).groupBy("skill").agg(F.count("*").alias("postings"), F.countDistinct("ent").alias("enterprises"), F.countDistinct("source").alias("sources"), F.countDistinct("version").alias("windows"), F.min("day").cast("string").alias("first_seen"), F.max("day").cast("string").alias("last_seen"))


@query("agg34_mature_bank", f"WITH {FACTS}, z AS (SELECT position, count(DISTINCT doc) AS n FROM f GROUP BY 1), c AS (SELECT position, skill, count(DISTINCT doc) AS s FROM f GROUP BY 1, 2), r AS (SELECT c.*, row_number() OVER (PARTITION BY position ORDER BY s DESC, skill) AS rank FROM c JOIN z USING (position) WHERE n >= 50 AND s >= 0.01 * n) SELECT position, skill, s AS support, rank FROM r WHERE rank <= 15")
def agg34(spark, d):
    from tessera.operators.relational import top_k

    f = facts(spark, d)
    c = f.groupBy("position", "skill").agg(F.countDistinct("doc").alias("support")).join(f.groupBy("position").agg(F.countDistinct("doc").alias("n")), "position").filter((F.col("n") >= 50) & (F.col("support") >= 0.01 * F.col("n")))
    return top_k(c, ["position"], [F.desc("support"), F.asc("skill")], 15).select("position", "skill", "support", "rank")


@query("mat12_reference_distance", f"WITH {FACTS}, c AS (SELECT ent, list(DISTINCT skill) AS s FROM f WHERE version = 1998 GROUP BY 1), r AS (SELECT position, list(DISTINCT skill) AS s FROM f WHERE version = 1997 AND modality = 'required' GROUP BY 1) SELECT ent, round(1 - max(len(list_intersect(c.s, r.s)) / len(list_distinct(list_concat(c.s, r.s)))), 6) AS distance FROM c, r GROUP BY 1")
def mat12(spark, d):
    f = facts(spark, d)
    return lc.reference_distance(f.filter("version = 1998"), f.filter("version = 1997 and modality = 'required'"), "ent", "position", "skill").select("ent", F.round("distance", 6).alias("distance"))


