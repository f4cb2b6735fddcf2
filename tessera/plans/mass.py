"""Queries of capped masses: line items as evidence of parts; line numbers and discounts as the groups that may not dominate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import mass

from .registry import query, table


def _evidence(spark, d):
    """Conclusions are return flags, clusters are parts, members are line items."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("conclusion"), F.col("l_partkey").alias("cluster"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("discount"), "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("o"))


def _masses(x):
    return x.groupBy("conclusion", "cluster").agg(F.sum("l_quantity").alias("w"))


@query("agg30_fractional_projection")
def agg30_fractional(spark, d):
    x = _evidence(spark, d)
    m = mass.memberships(x, "conclusion", "cluster", ["line", "discount"])
    return mass.project(_masses(x), m, "conclusion", "cluster", "w", {"line": 0.143, "discount": 0.095})


@query("agg29_fractional_rescaling")
def agg29_fractional(spark, d):
    x = _evidence(spark, d)
    m = mass.memberships(x, "conclusion", "cluster", ["line", "discount"])
    return mass.project(_masses(x), m, "conclusion", "cluster", "w", {"line": 0.143, "discount": 0.095}, "rescale")


#: With one dimension of whole memberships the projection has a closed form: the k largest groups are held at the cap,
#: the others share the rest in proportion, for the least k at which they fit.
_FILL = """WITH c AS (SELECT l_returnflag AS conclusion, l_partkey AS cluster, sum(l_quantity) AS w, CAST(min_by(l_linenumber, (l_orderkey, l_linenumber)) AS VARCHAR) AS g FROM lineitem GROUP BY 1, 2),
m AS (SELECT conclusion, g, sum(w) / sum(sum(w)) OVER (PARTITION BY conclusion) AS m FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER o AS k, sum(m) OVER o AS top, count(*) OVER (PARTITION BY conclusion) AS n FROM m WINDOW o AS (PARTITION BY conclusion ORDER BY m DESC, g)),
t AS (SELECT conclusion, k, (1 - k * 0.143) / (1 - top) AS up, lead(m) OVER (PARTITION BY conclusion ORDER BY k) AS next FROM r UNION ALL SELECT conclusion, 0, 1.0, max(m) FROM r GROUP BY 1),
f AS (SELECT conclusion, min(k) AS held, min_by(up, k) AS up FROM t WHERE next * up <= 0.143 AND k < 7 GROUP BY 1)
SELECT r.conclusion, r.g AS "group", round(m, 6) AS before, round(CASE WHEN r.k <= held THEN 0.143 ELSE m * up END, 6) AS mass, false AS infeasible FROM r JOIN f USING (conclusion)"""


@query("agg30_projection_of_one_dimension", _FILL)
def agg30_one(spark, d):
    x = _evidence(spark, d)
    m = mass.memberships(x, "conclusion", "cluster", ["line"], False, "o")
    w = _masses(x)
    p = mass.project(w, m, "conclusion", "cluster", "w", {"line": 0.143}, rounds=4000, tolerance=1e-12, still=1e-13, decay=0.0)
    g = p.join(w, ["conclusion", "cluster"]).join(m.select("conclusion", "cluster", "group"), ["conclusion", "cluster"]).groupBy("conclusion", "group").agg(F.sum("w").alias("_w"), F.sum("mass").alias("mass"), F.first("infeasible").alias("infeasible"))
    total = w.groupBy("conclusion").agg(F.sum("w").alias("_t"))
    return g.join(total, "conclusion").select("conclusion", "group", F.round(F.col("_w") / F.col("_t"), 6).alias("before"), F.round("mass", 6).alias("mass"), "infeasible")
