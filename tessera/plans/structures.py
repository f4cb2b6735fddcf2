"""Queries of taxonomies, requirement graphs and cluster diagnosis, over parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import big
from tessera.operators import diagnosis as dg
from tessera.operators import requirements as rq
from tessera.operators import taxonomy as tax
from tessera.operators.similarity import settled

from .registry import query, spread, table

_SHIFT = 1_000_000_000
#: Orders are bundles; some are of another schema or version, lose a skill, name one that is unknown, or tell its name or classes wrongly.
_TAXONOMY = f"""WITH b AS (SELECT o_orderkey AS bundle, CASE WHEN o_custkey % 10 = 0 THEN 'v1' ELSE 'v2' END AS s, CASE WHEN o_custkey % 10 = 1 THEN 'old' ELSE 'now' END AS v FROM orders),
n AS (SELECT DISTINCT l_orderkey AS bundle, l_partkey AS part, l_partkey + CASE WHEN (l_orderkey * 7 + l_partkey) % 23 = 0 THEN {_SHIFT} ELSE 0 END AS skill FROM lineitem WHERE l_linenumber <> 7),
p AS (SELECT *, (bundle + part) % 17 = 0 AS misnamed, (bundle + part) % 19 = 0 AS misclassed FROM n WHERE NOT (bundle % 10 = 2 AND part % 3 = 0)),
c AS (SELECT bundle, list_sort(list(skill)) AS h FROM n GROUP BY 1), d AS (SELECT bundle, list_sort(list(skill)) AS h FROM p GROUP BY 1),
f AS (SELECT bundle, min_by(CASE WHEN skill >= {_SHIFT} THEN '{tax.UNKNOWN_SKILL}' ELSE '{tax.CONTENT}' END, part) AS code, CAST(min_by(skill, part) AS VARCHAR) AS skill FROM p WHERE skill >= {_SHIFT} OR misnamed OR misclassed GROUP BY 1),
r AS (SELECT b.bundle, CASE WHEN v <> 'now' THEN '{tax.OTHER_VERSION}' WHEN c.h IS DISTINCT FROM d.h THEN '{tax.COVERAGE}' ELSE f.code END AS code, f.skill FROM b LEFT JOIN c USING (bundle) LEFT JOIN d USING (bundle) LEFT JOIN f USING (bundle) WHERE s = 'v2')
SELECT bundle, code, CASE WHEN code IN ('{tax.UNKNOWN_SKILL}', '{tax.CONTENT}') THEN skill END AS skill_id FROM r WHERE code IS NOT NULL"""


@query("flt13_taxonomy_projection", _TAXONOMY)
def flt13(spark, d):
    o, part = table(spark, d, "orders"), table(spark, d, "part")
    b = o.select(F.col("o_orderkey").alias("bundle"), F.when(F.col("o_custkey") % 10 == 0, "v1").otherwise("v2").alias("schema_version"), F.when(F.col("o_custkey") % 10 == 1, "old").otherwise("now").alias("taxonomy_version"))
    far = F.when((F.col("bundle") * 7 + F.col("pos")) % 23 == 0, _SHIFT).otherwise(0)
    n = table(spark, d, "lineitem").filter("l_linenumber <> 7").select(F.col("l_orderkey").alias("bundle"), F.col("l_partkey").alias("pos")).distinct().withColumn("skill_id", F.col("pos") + far)
    p = n.filter(~((F.col("bundle") % 10 == 2) & (F.col("pos") % 3 == 0))).join(part, F.col("p_partkey") == F.col("pos"))
    relations = lambda flag: F.array(*(F.struct(F.lit(f).alias("facet"), F.col(c).alias("code"), x.alias("is_primary")) for f, c, x in (("brand", "p_brand", F.lit(True)), ("type", "p_type", flag))))
    odd = (F.col("bundle") + F.col("pos")) % 17 == 0
    shown = p.select("bundle", "pos", "skill_id", F.when(odd, "x").otherwise(F.col("p_name")).alias("canonical_name"), relations((F.col("bundle") + F.col("pos")) % 19 == 0).alias("classifications"))
    skills = part.select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("canonical_name"))
    own = part.select(F.col("p_partkey").alias("skill_id"), F.explode(relations(F.lit(False))).alias("_r")).select("skill_id", "_r.*")
    return tax.projection_findings(b, n.select("bundle", "skill_id"), shown, skills, own, "now", "v2")


#: Parts hang below the part of a third of their number.
_CLOSURE = "WITH RECURSIVE e AS (SELECT p_partkey AS n, p_partkey // 3 AS p FROM part WHERE p_partkey > 0), c AS (SELECT n, p AS a, 1 AS d FROM e UNION ALL SELECT c.n, e.p, d + 1 FROM c JOIN e ON e.n = c.a) SELECT n AS node, count(*) AS above, CAST(max(d) AS BIGINT) AS depth, CAST(sum(a) AS BIGINT) AS total FROM c GROUP BY 1"


@query("flt13_closure", _CLOSURE)
def flt13_closure(spark, d):
    e = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("n"), F.floor(F.col("p_partkey") / 3).alias("p"))
    return tax.closure(e, "n", "p").groupBy("node").agg(F.count("*").alias("above"), F.max("depth").alias("depth"), F.sum("ancestor").alias("total"))


#: A part's posting asks for one of its name's words, and for its size and brand.
_GRAPH = """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, 't' || p_size AS t, lower(p_brand) AS b FROM part), q AS (SELECT *, w[1] || ' or ' || w[2] || '，' || t || '/' || b || ' at least 2' AS quote FROM p WHERE w[1] <> w[2]),
g AS (SELECT p_partkey, quote, 1 AS segment, 'or' AS op, 1 AS need, 'required' AS priority, 'w1|w2' AS ids, w[1] || ',' || w[2] AS aspects FROM q UNION ALL SELECT p_partkey, quote, 2, 'min_count', 2, 'unknown', 't|b', t || ',' || b FROM q)
SELECT p_partkey, 'derived-or:' || substr(sha256(quote || '|' || segment || '|' || ids), 1, 16) AS group_id, op, CAST(need AS INTEGER) AS need, priority, ids, aspects FROM g"""


def _graph(spark, d):
    w = F.split("p_name", " ")
    p = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand"), "p_partkey", rows=5000).select("p_partkey", w[0].alias("w1"), w[1].alias("w2"), F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("t"), F.lower("p_brand").alias("b")).filter("w1 <> w2")
    quote = F.array(F.concat("w1", F.lit(" or "), "w2", F.lit("，"), "t", F.lit("/"), "b", F.lit(" at least 2")))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("requirement_id"), F.col(c).alias("name"), F.lit(k).alias("priority")) for i, (c, k) in enumerate((("w1", "required"), ("w2", "required"), ("t", "required"), ("b", "preferred")))))
    return p.select("p_partkey", quote.alias("quotes"), F.explode(rows).alias("_r")).select("p_partkey", "quotes", "_r.*")


@query("clu18_requirement_groups", _GRAPH)
def clu18(spark, d):
    g = rq.derived_groups(_graph(spark, d), "p_partkey")
    return g.select("p_partkey", "group_id", "op", "need", "priority", F.array_join(F.transform("children", lambda c: c["ref"]), "|").alias("ids"), F.array_join(F.transform("children", lambda c: c["aspect"]), ",").alias("aspects"))


#: Suppliers have a word of a part's name or its class; the tree says whether they meet the posting.
@query("clu18_graph_values", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_size FROM part) SELECT p_partkey, s AS person, CASE WHEN (p_partkey + s) % 2 = 0 OR (p_partkey + s) % 3 = 0 THEN CASE WHEN (p_partkey + s) % 5 = 0 THEN NULL WHEN (p_partkey + s) % 7 = 0 THEN 1 ELSE 0 END ELSE 0 END AS value FROM p, range(0, 4) t(s) WHERE w[1] <> w[2]")
def clu18_values(spark, d):
    r = _graph(spark, d)
    found = settled(rq.graph_edges(rq.derived_groups(r, "p_partkey"), "p_partkey"))  # read three times; the texts are searched once
    edges = rq.with_root(found, r, "p_partkey")
    k = F.col("p_partkey") + F.col("person")
    value = lambda n: {"w1": (k % 2 == 0).cast("int"), "w2": (k % 3 == 0).cast("int"), "t": F.when(k % 5 == 0, F.lit(None)).otherwise((k % 7 == 0).cast("int")), "b": F.lit(1)}[n]
    people = r.select("p_partkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("person")).distinct()
    v = people.select("p_partkey", "person", F.explode(F.array(*(F.struct(F.lit(n).alias("node"), value(n).alias("value")) for n in ("w1", "w2", "t", "b")))).alias("_v")).select("p_partkey", "person", "_v.*")
    return rq.evaluate(edges, v, "p_partkey", "person", 2).filter("node = 'root'").select("p_partkey", "person", "value")


#: Brands are clusters of parts.
_DIAGNOSIS = """WITH m AS (SELECT p_brand AS c, p_partkey AS m, string_split(lower(p_name || ' ' || p_type), ' ') AS t, list_distinct(string_split(p_name, ' ')) AS ti, p_type AS co, p_size // 10 AS w, p_size FROM part),
s AS (SELECT l_partkey AS m, list_distinct(list(CAST(l_suppkey % 7 AS VARCHAR))) AS s FROM lineitem GROUP BY 1), x AS (SELECT m.*, coalesce(s, []) AS s FROM m LEFT JOIN s USING (m)), n AS (SELECT c, count(*) AS n FROM x GROUP BY 1),
e AS (SELECT c, m, len(t) AS l, unnest(t) AS t FROM x), f AS (SELECT c, m, l, t, count(*) AS k FROM e GROUP BY ALL), df AS (SELECT c, t, count(*) AS df FROM f GROUP BY 1, 2), v AS (SELECT c, m, t, k / l * (ln((1 + n) / (1 + df)) + 1) AS v FROM f JOIN df USING (c, t) JOIN n USING (c)),
u AS (SELECT c, m, t, v / sqrt(sum(v * v) OVER (PARTITION BY c, m)) AS u FROM v), dots AS (SELECT a.c, sum(a.u * b.u) AS d FROM u a JOIN u b ON a.c = b.c AND a.t = b.t AND a.m < b.m GROUP BY 1),
pr AS (SELECT a.c, avg(len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1)) AS sk, avg(len(list_intersect(a.ti, b.ti)) / len(list_distinct(list_concat(a.ti, b.ti)))) AS ti FROM x a JOIN x b ON a.c = b.c AND a.m < b.m GROUP BY 1),
h AS (SELECT c, sum(k * k) / (sum(k) * sum(k)) AS hhi, count(*) AS cc FROM (SELECT c, co, count(*) AS k FROM x GROUP BY 1, 2) GROUP BY 1),
fam AS (SELECT c, count(*) FILTER (k >= 2 AND k <= n - 2) AS contra FROM (SELECT c, unnest(ti) AS f, count(*) AS k FROM x GROUP BY 1, 2) JOIN n USING (c) GROUP BY 1)
SELECT n.c AS cluster, n AS member_count, round(coalesce(d, 0) / (n * (n - 1) / 2), 5) AS text_coherence, round(sk, 5) AS skill_coherence, round(ti, 5) AS title_coherence, round(0.6 * coalesce(d, 0) / (n * (n - 1) / 2) + 0.4 * sk, 5) AS combined_coherence, round(hhi, 6) AS company_hhi, cc AS company_count, contra AS contradictions,
(SELECT count(DISTINCT w) FROM x WHERE x.c = n.c) AS window_count, (SELECT min(p_size) FROM x WHERE x.c = n.c) AS first_date FROM n LEFT JOIN dots USING (c) JOIN pr USING (c) JOIN h USING (c) JOIN fam USING (c)"""


@query("clu06_cluster_diagnosis", _DIAGNOSIS)
def clu06(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("skills"))
    words = F.array_distinct(F.split("p_name", " "))
    x = table(spark, d, "part").join(s, "p_partkey", "left").select(
        F.col("p_brand").alias("cluster"), "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("text"), "skills", words.alias("title"), words.alias("families"), F.col("p_type").alias("company"), F.floor(F.col("p_size") / 10).alias("w"), F.col("p_size").alias("date"), F.lit("s").alias("source")
    )
    out = dg.diagnose(x, "cluster", "p_partkey", "text", "skills", "title", "families", "company", "w", "date", "source")
    r = [F.round(c, 5).alias(c) for c in ("text_coherence", "skill_coherence", "title_coherence", "combined_coherence")]
    return out.select("cluster", "member_count", *r, F.round("company_hhi", 6).alias("company_hhi"), big(F.col("company_count")).alias("company_count"), "contradictions", "window_count", F.col("first_date"))
