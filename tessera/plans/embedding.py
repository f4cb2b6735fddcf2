"""Queries of fused embeddings of parts: words of name and type as text, the brand as skill."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embedding as em

from .registry import query, table


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("w"), F.array("p_brand").alias("s"))


@query("clu20_fused_embedding")
def clu20(spark, d):
    out = em.fused_embedding(_parts(spark, d), "p_partkey", "w", "s")
    return out.select("p_partkey", F.transform("text", lambda x: F.round(x, 6)).alias("text"), F.map_keys("skills").alias("skills"), F.map_values("skills").alias("values"))


#: With as many components as the rank, products of the features are those of the TF-IDF rows.
_COSINE = """WITH t AS (SELECT p_partkey, p_brand, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part), n AS (SELECT count(*) AS n FROM part),
c AS (SELECT p_partkey, p_brand, len(w) AS l, unnest(w) AS t FROM t), f AS (SELECT p_partkey, p_brand, l, t, count(*) AS c FROM c GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM f GROUP BY 1),
x AS (SELECT p_partkey, p_brand, t, c / l * (ln((1 + n) / (1 + df)) + 1) AS x FROM f JOIN df USING (t), n), u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)) AS v FROM x),
o AS (SELECT * FROM u WHERE p_partkey = (SELECT min(p_partkey) FROM part)), s AS (SELECT u.p_partkey, sum(u.v * o.v) AS s FROM u JOIN o USING (t) GROUP BY 1)
SELECT p.p_partkey, round((0.49 * coalesce(s, 0) + CASE WHEN p.p_brand = (SELECT any_value(p_brand) FROM o) THEN 0.09 ELSE 0 END) / 0.58, 5) AS cosine FROM part p LEFT JOIN s USING (p_partkey)"""


@query("clu20_fused_cosine", _COSINE)
def clu20_cosine(spark, d):
    e = em.settled(em.fused_embedding(_parts(spark, d), "p_partkey", "w", "s", components=60, spare=4))
    first = e.agg(F.min_by(F.struct("text", "skills"), "p_partkey").alias("o")).first().o  # one row
    text, skills = F.array(*map(F.lit, first.text)), F.create_map(*(F.lit(x) for kv in first.skills.items() for x in kv))
    return e.select("p_partkey", F.round(em.fused_cosine(F.col("text"), F.col("skills"), text, skills), 5).alias("cosine"))
