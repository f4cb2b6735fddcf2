"""Relational queries: filters, joins, set operations, sorts and plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import scalars as sc
from tessera.functions.scalars import big
from tessera.operators import relational as rel

from .registry import query, table

#: Order lines as support facts: document, skill, enterprise, modality, day of observation.
FACTS = """f AS (SELECT l_orderkey AS doc, l_partkey % 50 AS skill, l_suppkey AS ent, l_partkey % 5 AS position, CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' ELSE 'bonus' END AS modality,
 CAST(l_shipdate AS DATE) AS day, year(l_shipdate) AS version, l_linestatus AS source, l_quantity / (16 * pi()) AS w FROM lineitem)"""


def facts(spark, d):
    m = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "preferred").otherwise("bonus")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50).alias("skill"), F.col("l_suppkey").alias("ent"), (F.col("l_partkey") % 5).alias("position"), m.alias("modality"),
        F.to_date("l_shipdate").alias("day"), big(F.year("l_shipdate")).alias("version"), F.col("l_linestatus").alias("source"), (F.col("l_quantity") / (16 * F.pi())).alias("w"),
    )


@query("flt01_relation_page", f"WITH {FACTS}, g AS (SELECT position, skill, count(*) AS n, count(DISTINCT ent) AS ents FROM f WHERE modality = 'required' AND version >= 1996 GROUP BY 1, 2) SELECT position, skill, n, ents FROM g WHERE n >= 5 AND ents >= 3 ORDER BY n DESC, position, skill LIMIT 20 OFFSET 20")
def flt01(spark, d):
    g = facts(spark, d).filter((F.col("modality") == "required") & (F.col("version") >= 1996)).groupBy("position", "skill").agg(F.count("*").alias("n"), F.countDistinct("ent").alias("ents"))
    return rel.page(g.filter((F.col("n") >= 5) & (F.col("ents") >= 3)), [F.desc("n"), F.asc("position"), F.asc("skill")], 2, 20)


@query("flt02_search_page", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size IN (5, 10, 15, 20) AND (p_name ILIKE '%ring%' OR p_brand ILIKE '%#1%') ORDER BY p_name DESC, p_partkey LIMIT 25 OFFSET 25")
def flt02(spark, d):
    p = table(spark, d, "part").filter(F.col("p_size").isin(5, 10, 15, 20) & (F.col("p_name").ilike("%ring%") | F.col("p_brand").ilike("%#1%")))
    return rel.page(p, [F.desc("p_name"), F.asc("p_partkey")], 2, 25).select("p_partkey", "p_name", "p_brand")


@query("flt04_review_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC LIMIT 50")
def flt04(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return rel.page(table(spark, d, "orders").filter("o_totalprice > 100000"), [rank, F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 50).select("o_orderkey", "o_orderstatus")


#: Orders are tasks, customers the builds they come from.
_TASKS = """t AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE o_orderkey % 5 WHEN 0 THEN 'skill_normalization' WHEN 1 THEN 'graph_version' ELSE 'relation' END AS kind, substr(o_orderpriority, 1, 1) AS risk, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS build FROM orders),
b AS (SELECT c_custkey AS build, c_mktsegment <> 'BUILDING' AS current, c_custkey % 4 AS relations FROM customer), s AS (SELECT t.* FROM t LEFT JOIN b USING (build) WHERE kind <> 'skill_normalization' AND status IN ('O', 'P') AND risk = '2' AND (t.build IS NULL OR coalesce(current, false)) AND NOT coalesce(kind = 'graph_version' AND relations = 0, false))"""


@query("flt03_review_tasks", f"WITH {_TASKS} SELECT id, kind, (SELECT count(*) FROM s) AS total FROM s ORDER BY id LIMIT 25 OFFSET 25")
def flt03(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "skill_normalization").when(k % 5 == 1, "graph_version").otherwise("relation")
    t = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), kind.alias("kind"), F.substring("o_orderpriority", 1, 1).alias("risk_level"), F.when(k % 11 != 0, F.col("o_custkey")).alias("build_run_id"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("build_run_id"), (F.col("c_mktsegment") != "BUILDING").alias("current"), (F.col("c_custkey") % 4).alias("relations"))
    rows, total = rel.review_tasks(t, b, 2, 25, statuses=("O", "P"), risk="2")
    return rows.join(F.broadcast(total)).select("id", "kind", "total")


@query("mat15_json_path", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def mat15(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("flt05_exclusion_reasons", """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_quantity < 10 THEN 'weight_below_threshold' END, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate >= TIMESTAMP '2000-01-01' THEN 'outside_window' END,
 CASE WHEN l_returnflag = 'N' THEN 'not_confirmed' END) AS reasons, NOT (l_quantity < 10 OR l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate >= TIMESTAMP '2000-01-01' OR l_returnflag = 'N') AS included FROM lineitem""")
def flt05(spark, d):
    day = F.col("l_shipdate")
    r = sc.reasons([("weight_below_threshold", F.col("l_quantity") < 10), ("outside_window", (day < F.lit("1996-01-01").cast("timestamp")) | (day >= F.lit("2000-01-01").cast("timestamp"))), ("not_confirmed", F.col("l_returnflag") == "N")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("included"))


@query("flt06_precheck", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, concat_ws(',', CASE WHEN k > 1 THEN 'duplicate_id' END, CASE WHEN NOT (CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') THEN 'outside_window' END) AS reasons FROM r""")
def flt06(spark, d):
    e = table(spark, d, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    inside = F.to_date("ts").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))
    return e.select("event_id", F.array_join(sc.reasons([("duplicate_id", F.col("k") > 1), ("outside_window", ~inside)]), ",").alias("reasons"))


@query("flt07_validation_findings", """WITH v AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 0 THEN 'price_not_positive' END, CASE WHEN trim(o_orderpriority) = '' THEN 'blank_priority' END, CASE WHEN o_custkey % 10 = 0 THEN 'dangling_customer' END, CASE WHEN o_orderpriority NOT LIKE '_-%' THEN 'malformed_priority' END) AS f FROM orders)
SELECT o_orderkey, f AS findings, CASE WHEN f LIKE '%dangling%' THEN 'error' WHEN f <> '' THEN 'warning' ELSE 'valid' END AS conclusion FROM v""")
def flt07(spark, d):
    r = F.array_join(sc.reasons([("price_not_positive", F.col("o_totalprice") <= 0), ("blank_priority", F.trim("o_orderpriority") == ""), ("dangling_customer", F.col("o_custkey") % 10 == 0), ("malformed_priority", ~F.col("o_orderpriority").like("_-%"))]), ",")
    return table(spark, d, "orders").select("o_orderkey", r.alias("findings")).withColumn("conclusion", F.when(F.col("findings").contains("dangling"), "error").when(F.col("findings") != "", "warning").otherwise("valid"))


@query("flt08_identity_rules", "SELECT c_custkey, c_name IS NOT NULL AND trim(c_name) <> '' AND regexp_matches(c_name, '^Customer#[0-9]{9}$') AS valid FROM customer")
def flt08(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_name").isNotNull() & (F.trim("c_name") != "") & F.col("c_name").rlike("^Customer#[0-9]{9}$")).alias("valid"))


@query("flt09_quote_alignment", "SELECT doc_id, substr(text, 11, 20) AS quote, instr(text, substr(text, 11, 20)) - 1 AS start, substr(text, instr(text, substr(text, 11, 20)), length(substr(text, 11, 20))) = substr(text, 11, 20) AS aligned FROM documents")
def flt09(spark, d):
    q = F.substring("text", 11, 20)
    at = F.expr("instr(text, substring(text, 11, 20))")
    return table(spark, d, "documents").select("doc_id", q.alias("quote"), big(at - 1).alias("start"), F.expr("substring(text, instr(text, substring(text, 11, 20)), length(substring(text, 11, 20))) = substring(text, 11, 20)").alias("aligned"))


@query("flt11_dangling_references", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY')")
def flt11(spark, d):
    known = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("flt12_exact_duplicates", "SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY copies > 1")
def flt12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return docs.withColumn("copies", F.count("*").over(W.partitionBy("key"))).filter("copies > 1").select("doc_id", "copies")


@query("flt14_alias_matching", r"""WITH a(alias, term) AS (VALUES ('ring', 'ring'), ('red ring', 'ring'), ('widget', 'widget'), ('bolt', 'bolt'), ('small bolt', 'bolt'))
SELECT p_partkey, arg_max(alias, length(alias)) AS alias, arg_max(term, length(alias)) AS term FROM part, a WHERE regexp_matches(p_name, '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])') GROUP BY 1""")
def flt14(spark, d):
    a = spark.createDataFrame([("ring", "ring"), ("red ring", "ring"), ("widget", "widget"), ("bolt", "bolt"), ("small bolt", "bolt")], "alias string, term string")
    hit = table(spark, d, "part").join(F.broadcast(a), F.expr("p_name rlike concat('(^|[^a-z0-9])', alias, '($|[^a-z0-9])')"))
    return hit.groupBy("p_partkey").agg(F.max_by("alias", F.length("alias")).alias("alias"), F.max_by("term", F.length("alias")).alias("term"))


@query("joi01_run_history", "SELECT r_name, n_name, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def joi01(spark, d):
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-04-01").cast("timestamp")))
    out = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("r_name", "n_name", "c_custkey", "o_orderkey")


@query("joi02_json_history", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 AND event_type = 'click'")
def joi02(spark, d):
    return table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).filter("k >= 90")


@query("joi03_left_summary", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
def joi03(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    out = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"))


@query("joi04_latest_per_group", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def joi04(spark, d):
    return rel.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


_DAYS = "e AS (SELECT DISTINCT user_id, event_type, CAST(value AS BIGINT) % 3 AS version, CAST(ts AS DATE) AS day FROM events)"


def _days(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", (F.round("value").cast("bigint") % 3).alias("version"), F.to_date("ts").alias("day")).distinct()


@query("joi05_new_and_repeated", f"WITH {_DAYS} SELECT user_id, event_type, version, CASE WHEN (user_id, event_type, version) IN (SELECT user_id, event_type, version FROM e WHERE day < DATE '2024-01-20') THEN 'repeated' ELSE 'new' END AS status FROM e WHERE day = DATE '2024-01-20'".replace("CAST(value AS BIGINT)", "CAST(round(value) AS BIGINT)"))
def joi05(spark, d):
    e = _days(spark, d)
    key = ["user_id", "event_type", "version"]
    today, before = e.filter("day = '2024-01-20'").select(*key), e.filter("day < '2024-01-20'")
    return rel.new_rows(today, before, key).withColumn("status", F.lit("new")).unionByName(rel.repeated_rows(today, before, key).withColumn("status", F.lit("repeated")))


@query("joi06_updated_records", f"WITH {_DAYS} SELECT DISTINCT user_id, event_type, version, CAST(day AS VARCHAR) AS day FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.day < a.day AND b.version <> a.version)".replace("CAST(value AS BIGINT)", "CAST(round(value) AS BIGINT)"))
def joi06(spark, d):
    e = _days(spark, d).withColumn("k", F.concat_ws("/", "user_id", "event_type")).withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    return rel.changed_since(e, "k", "n", "version").select("user_id", "event_type", "version", F.col("day").cast("string").alias("day"))


@query("joi07_pending_counts", "SELECT p_brand, count(*) AS parts, CAST(sum(CASE WHEN x.l_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unsold FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 45) x ON x.l_partkey = p_partkey GROUP BY 1")
def joi07(spark, d):
    sold = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("k")).distinct()
    out = table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("k"), "left")
    return out.groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("k").isNull(), 1).otherwise(0)).alias("unsold"))


_REL = "r AS (SELECT position, version, skill, count(*) AS n, count(DISTINCT ent) AS ents, max(modality) AS modality, sum(w) AS w FROM f GROUP BY 1, 2, 3)"


def relations(spark, d):
    return facts(spark, d).groupBy("position", "version", "skill").agg(F.count("*").alias("n"), F.countDistinct("ent").alias("ents"), F.max("modality").alias("modality"), F.sum("w").alias("w"))


@query("joi08_version_diff", f"""WITH {FACTS}, {_REL}, b AS (SELECT * FROM r WHERE version = 1997 AND skill % 9 <> 0), a AS (SELECT * FROM r WHERE version = 1998 AND skill % 11 <> 0),
j AS (SELECT coalesce(b.position, a.position) AS position, coalesce(b.skill, a.skill) AS skill, b.n AS bn, a.n AS an, b.ents AS be, a.ents AS ae, b.modality AS bm, a.modality AS am FROM b FULL JOIN a ON a.position = b.position AND a.skill = b.skill)
SELECT position, skill, CASE WHEN bn IS NULL THEN 'added' WHEN an IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN bn IS NULL OR an IS NULL THEN '' ELSE concat_ws(',', CASE WHEN bn <> an THEN 'n' END, CASE WHEN be <> ae THEN 'ents' END, CASE WHEN bm <> am THEN 'modality' END) END AS changed_fields,
 bn AS before_n, be AS before_ents, bm AS before_modality, an AS after_n, ae AS after_ents, am AS after_modality FROM j WHERE bn IS NULL OR an IS NULL OR bn <> an OR be <> ae OR bm <> am""")
def joi08(spark, d):
    r = relations(spark, d)
    return rel.snapshot_diff(r.filter("version = 1997 and skill % 9 <> 0"), r.filter("version = 1998 and skill % 11 <> 0"), ["position", "skill"], ["n", "ents", "modality"])


@query("joi10_trend_score", f"""WITH {FACTS}, {_REL}, p AS (SELECT *, lag(w) OVER k AS pw, lag(n) OVER k AS pn FROM r WINDOW k AS (PARTITION BY position, skill ORDER BY version))
SELECT position, skill, version, round(CASE WHEN n < 5 THEN NULL WHEN pw IS NULL THEN w WHEN pn < 5 THEN NULL ELSE w - pw END, 6) AS trend FROM p""")
def joi10(spark, d):
    return rel.previous_value(relations(spark, d), ["position", "skill"], "version", "w", "n", 5).select("position", "skill", "version", F.round("trend", 6).alias("trend"))


@query("joi11_rolling_windows", "WITH e AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS w, user_id FROM events) SELECT a.as_of, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM e JOIN (SELECT unnest(range(0, 10)) AS as_of) a ON w BETWEEN as_of - 2 AND as_of GROUP BY 1, 2")
def joi11(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3).alias("w"), "user_id")
    return rel.rolling_windows(e, "w", 2, 9).groupBy("as_of", "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


_EDGES = "g AS (SELECT DISTINCT l_partkey % 40 AS source, l_suppkey % 40 AS target FROM lineitem), ed AS (SELECT source, target, 1 + (source * 7 + target * 3) % 5 AS cost, 0.4 + ((source * 13 + target * 29) % 60) / 100 AS confidence FROM g WHERE source <> target)"


def edges(spark, d):
    g = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("source"), (F.col("l_suppkey") % 40).alias("target")).distinct().filter("source <> target")
    return g.withColumn("cost", 1 + (F.col("source") * 7 + F.col("target") * 3) % 5).withColumn("confidence", 0.4 + ((F.col("source") * 13 + F.col("target") * 29) % 60) / 100.0)


_TYPE = "CASE (source + target) % 5 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'transferable' WHEN 2 THEN 'parent_child' WHEN 3 THEN 'related' ELSE 'prerequisite' END"


@query("joi12_best_relation", f"""WITH {_EDGES}, rl AS (SELECT source * 100 + target AS relation_id, source, target, {_TYPE} AS type, confidence FROM ed WHERE confidence >= 0.5),
ev AS (SELECT * FROM rl UNION ALL SELECT relation_id, target, source, type, confidence FROM rl WHERE type IN ('equivalent', 'related', 'transferable')),
m AS (SELECT c_custkey AS holder, c_custkey % 40 AS required FROM customer), v AS (SELECT DISTINCT o_custkey AS holder, o_orderkey % 40 AS skill, 0.5 + (o_orderkey % 4) / 10 AS support FROM orders),
v1 AS (SELECT holder, skill, max(support) AS support FROM v GROUP BY 1, 2)
SELECT m.holder, m.required, skill AS candidate, relation_id, type, round(confidence * support, 6) AS match_confidence FROM m JOIN ev ON ev.target = m.required JOIN v1 ON v1.holder = m.holder AND v1.skill = ev.source
QUALIFY row_number() OVER (PARTITION BY m.holder, m.required ORDER BY CASE type WHEN 'equivalent' THEN 5 WHEN 'transferable' THEN 4 WHEN 'parent_child' THEN 3 WHEN 'related' THEN 2 ELSE 1 END DESC, confidence DESC, skill DESC, relation_id DESC) = 1""")
def joi12(spark, d):
    s = F.col("source") + F.col("target")
    kind = F.when(s % 5 == 0, "equivalent").when(s % 5 == 1, "transferable").when(s % 5 == 2, "parent_child").when(s % 5 == 3, "related").otherwise("prerequisite")
    r = edges(spark, d).select((F.col("source") * 100 + F.col("target")).alias("relation_id"), "source", "target", kind.alias("type"), "confidence")
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("holder"), (F.col("c_custkey") % 40).alias("required"))
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("holder"), (F.col("o_orderkey") % 40).alias("skill"), (0.5 + (F.col("o_orderkey") % 4) / 10.0).alias("support")).groupBy("holder", "skill").agg(F.max("support").alias("support"))
    return rel.best_relation(m, r, v).withColumn("match_confidence", F.round("match_confidence", 6))


@query("joi13_bounded_paths", f"""WITH {_EDGES}, e AS (SELECT source, target, cost FROM ed WHERE confidence >= 0.5), p AS (SELECT source, target, '' AS via, 1 AS hops, cost FROM e UNION ALL SELECT a.source, b.target, CAST(a.target AS VARCHAR), 2, a.cost + b.cost FROM e a JOIN e b ON a.target = b.source AND a.source <> b.target)
SELECT source, target, via, CAST(hops AS BIGINT) AS hops, cost FROM p WHERE cost <= 6 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY cost, hops, via) = 1""")
def joi13(spark, d):
    return rel.bounded_paths(edges(spark, d), 6, 0.5).select("source", "target", "via", big(F.col("hops")).alias("hops"), "cost")


@query("joi15_related_within_days", """WITH o AS (SELECT o_orderkey AS id, o_custkey % 50 AS ent, o_orderstatus AS pos, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT a.id AS "left", b.id AS "right" FROM o a JOIN o b ON a.ent = b.ent AND a.pos = b.pos AND a.id < b.id AND abs(date_diff('day', a.day, b.day)) <= 7""")
def joi15(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("ent"), F.col("o_orderstatus").alias("pos"), F.to_date("o_orderdate").alias("day"))
    return rel.within_days(o, "id", ["ent", "pos"], "day", 7)


@query("joi19_batch_lookup", f"WITH {_EDGES} SELECT source, target, round(confidence, 6) AS confidence FROM ed WHERE source IN (SELECT c_custkey FROM customer WHERE c_custkey < 10)")
def joi19(spark, d):
    ids = table(spark, d, "customer").filter("c_custkey < 10").select(F.col("c_custkey").alias("source"))
    return edges(spark, d).join(ids, "source", "left_semi").select("source", "target", F.round("confidence", 6).alias("confidence"))


@query("joi20_dangling_children", f"WITH {_EDGES} SELECT source, target FROM ed WHERE target NOT IN (SELECT source FROM ed WHERE confidence >= 0.99)")
def joi20(spark, d):
    e = edges(spark, d)
    return e.select("source", "target").join(e.filter("confidence >= 0.99").select(F.col("source").alias("target")).distinct(), "target", "left_anti")


@query("agg01_status_counts", "SELECT s AS status, count(o_orderkey) AS count FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def agg01(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("count"))
    return rel.zero_filled(c, "status", "count", ["F", "O", "P", "X"])


@query("agg02_json_path_counts", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS count FROM events GROUP BY 1")
def agg02(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("count"))


@query("agg03_top_companies", "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def agg03(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "l_suppkey").limit(20)


@query("agg04_distinct_tuples", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT (user_id, event_type, props)) AS records FROM events GROUP BY 1")
def agg04(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("user_id", "event_type", "props").alias("records"))


@query("agg25_distribution", "SELECT coalesce(nullif(trim(CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN ' ' ELSE source END), ''), 'unknown') AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def agg25(spark, d):
    s = table(spark, d, "documents").select(F.when(F.col("doc_id") % 17 == 0, None).when(F.col("doc_id") % 19 == 0, " ").otherwise(F.col("source")).alias("s"))
    return rel.distribution(s, "s").withColumn("share", F.round("share", 6))


@query("agg52_cube", "SELECT coalesce(c_mktsegment, '*') AS segment, coalesce(CAST(c_nationkey AS VARCHAR), '*') AS nation, count(*) AS customers, CAST(grouping(c_mktsegment, c_nationkey) AS BIGINT) AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def agg52(spark, d):
    c = table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("customers"), F.grouping_id().alias("level"))
    return c.select(F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("*")).alias("nation"), "customers", "level")


@query("agg53_having_duplicates", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS count FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def agg53(spark, d):
    return rel.duplicates(table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day")), ["user_id", "day"])


@query("snk03_incremental_listing", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY') ORDER BY o_orderdate, o_custkey, o_orderstatus, o_orderkey LIMIT 100")
def snk03(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    task = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    out = table(spark, d, "orders").join(done, "o_orderkey", "left_anti").join(task, "o_custkey", "left_semi")
    return out.orderBy("o_orderdate", "o_custkey", "o_orderstatus", "o_orderkey").limit(100).select("o_orderkey")


@query("snk04_latest_batch", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC LIMIT 1")
def snk04(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return o.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("snk05_upsert_counters", f"WITH {_DAYS}, t AS (SELECT DISTINCT user_id, event_type FROM e WHERE day >= DATE '2024-01-28'), b AS (SELECT DISTINCT user_id, event_type FROM e WHERE day < DATE '2024-01-28' AND user_id % 3 <> 0) SELECT count(*) AS fetched, count(*) FILTER (b.user_id IS NULL) AS new, count(*) FILTER (b.user_id IS NOT NULL) AS duplicate FROM t LEFT JOIN b USING (user_id, event_type)")
def snk05(spark, d):
    e = _days(spark, d).select("user_id", "event_type", "day")
    t = e.filter("day >= '2024-01-28'").select("user_id", "event_type").distinct()
    b = e.filter("day < '2024-01-28' and user_id % 3 <> 0").select("user_id", "event_type")
    fresh = rel.new_rows(t, b, ["user_id", "event_type"]).withColumn("_new", F.lit(1))
    out = t.join(fresh, ["user_id", "event_type"], "left")
    return out.agg(F.count("*").alias("fetched"), F.count_if(F.col("_new").isNotNull()).alias("new"), F.count_if(F.col("_new").isNull()).alias("duplicate"))


@query("snk08_gap_matrix", "WITH c(c_mktsegment) AS (VALUES ('MACHINERY'), ('HOUSEHOLD'), ('NONE')), x AS (SELECT c_mktsegment, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT c.c_mktsegment, count(*) FILTER (r = 0) AS r0, count(*) FILTER (r = 1) AS r1, count(*) FILTER (r = 2) AS r2, count(*) FILTER (r IN (0, 1, 2)) AS total FROM c LEFT JOIN x USING (c_mktsegment) GROUP BY 1")
def snk08(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"))
    return rel.pivot_gap(x, "c_mktsegment", "r", ["r0", "r1", "r2"], ["MACHINERY", "HOUSEHOLD", "NONE"])


@query("srt01_null_last_sort", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 450")
def srt01(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality").orderBy(F.desc_nulls_last("quality"), "doc_id").limit(450)


@query("srt09_balanced_merge", "WITH r AS (SELECT s_nationkey AS g, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank_in_group FROM supplier) SELECT g, id, rank_in_group, row_number() OVER (ORDER BY rank_in_group, g) AS position FROM r ORDER BY rank_in_group, g LIMIT 40")
def srt09(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return rel.balanced_merge(s, "g", [F.desc("s_acctbal"), F.asc("id")], 40).select("g", "id", "rank_in_group", "position")


@query("srt10_decay_trim", """WITH h AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice / 500000 AS s FROM orders WHERE o_totalprice / 500000 >= 0.1), r AS (SELECT *, row_number() OVER w AS rank, lag(s) OVER w AS p FROM h WINDOW w AS (PARTITION BY k ORDER BY s DESC, id)),
t AS (SELECT *, max(CASE WHEN rank > 2 AND (s < p * 0.6 OR p - s > 0.25) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s DESC, id) AS stop FROM r) SELECT k, id, rank FROM t WHERE stop = 0""")
def srt10(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("s"))
    return rel.decay_trim(h, "k", "s", "id", 0.1).select("k", "id", "rank")


@query("srt12_rank_metrics", f"""WITH {FACTS}, a AS (SELECT skill, row_number() OVER (ORDER BY count(*) DESC, skill) AS ra FROM f WHERE version = 1997 GROUP BY 1), b AS (SELECT skill, row_number() OVER (ORDER BY count(*) DESC, skill) AS rb FROM f WHERE version = 1998 GROUP BY 1)
SELECT round(1 - 6.0 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 6) AS spearman, round(count(*) FILTER (ra <= 10 AND rb <= 10) / 10, 6) AS precision_at_10 FROM a JOIN b USING (skill)""")
def srt12(spark, d):
    f = facts(spark, d)
    rk = lambda v, n: f.filter(F.col("version") == v).groupBy("skill").agg(F.count("*").alias("n")).select("skill", F.row_number().over(rel.total().orderBy(F.desc("n"), "skill")).alias(n))
    j = rk(1997, "ra").join(rk(1998, "rb"), "skill")
    n = F.count("*")
    return j.agg(F.round(1 - 6.0 * F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb"))) / (n * (n * n - 1)), 6).alias("spearman"), F.round(F.count_if((F.col("ra") <= 10) & (F.col("rb") <= 10)) / 10, 6).alias("precision_at_10"))


@query("set05_published_and_legacy", "SELECT o_orderkey, 'published' AS origin FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 'legacy' FROM lineitem WHERE l_quantity >= 49 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def set05(spark, d):
    pub = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("published").alias("origin"))
    old = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return pub.unionByName(rel.new_rows(old, pub, ["o_orderkey"]).withColumn("origin", F.lit("legacy")))


@query("set06_intersect_except", f"WITH {FACTS}, a AS (SELECT DISTINCT position, skill, ent FROM f WHERE version = 1997), b AS (SELECT DISTINCT position, skill, ent FROM f WHERE version = 1998) SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'before' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set06(spark, d):
    f = facts(spark, d)
    a, b = (f.filter(F.col("version") == v).select("position", "skill", "ent").distinct() for v in (1997, 1998))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("before")))


@query("set07_combination_shift", f"WITH {FACTS}, a AS (SELECT ent, version, array_to_string(list_sort(list(DISTINCT skill)), ',') AS c FROM f GROUP BY 1, 2) SELECT ent, version, c AS combination, coalesce(lag(c) OVER (PARTITION BY ent ORDER BY version) <> c, false) AS shifted FROM a")
def set07(spark, d):
    a = facts(spark, d).groupBy("ent", "version").agg(F.array_join(F.array_sort(F.collect_set("skill")), ",").alias("combination"))
    return a.withColumn("shifted", F.coalesce(F.lag("combination").over(W.partitionBy("ent").orderBy("version")) != F.col("combination"), F.lit(False)))


@query("set08_ordered_distinct", "WITH m AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS k FROM m) SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS types FROM r WHERE k <= 3 GROUP BY 1")
def set08(spark, d):
    return rel.ordered_distinct(table(spark, d, "events"), ["user_id"], "event_type", "event_id", 3).select("user_id", F.array_join("values", ",").alias("types"))
