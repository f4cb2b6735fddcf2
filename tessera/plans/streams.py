"""Queries of stateful operators over whole tables: orders as an outbox, users of the event stream as candidates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.scalars import big
from tessera.streaming import outbox as ob
from tessera.streaming import profiles as pf

from .registry import query, table

_NOW = dt.datetime(1998, 1, 1)
_BOX = """x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'processed' END AS status, o_orderdate AS created_at, o_custkey % 5 AS retry_count,
CASE WHEN o_orderstatus = 'O' THEN 'w' || (o_custkey % 3) END AS lease_owner, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 400 DAY END AS lease_expires_at FROM orders)"""


def _outbox(spark, d):
    o = table(spark, d, "orders")
    held = F.col("o_orderstatus") == "O"
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").when(held, "processing").otherwise("processed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_custkey") % 5).alias("retry_count"),
        F.when(held, F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string"))).alias("lease_owner"), F.when(held, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 400 DAYS")).alias("lease_expires_at"), F.lit(None).cast("string").alias("error_message"),
    )


@query("stm03_outbox_claim", f"WITH {_BOX}, t AS (SELECT id FROM x WHERE status = 'pending' ORDER BY created_at, id LIMIT 20) SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'processing' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM t) THEN 'me' ELSE lease_owner END AS lease_owner FROM x")
def stm03(spark, d):
    return ob.claim(_outbox(spark, d), "me", _NOW, dt.timedelta(minutes=5)).select("id", "status", "lease_owner")


@query("stm02_lease_recovery", f"WITH {_BOX}, e AS (SELECT *, coalesce(status = 'processing' AND lease_expires_at < TIMESTAMP '1998-01-01', false) AS gone FROM x) SELECT id, CASE WHEN gone THEN CASE WHEN retry_count < 3 THEN 'pending' ELSE 'failed' END ELSE status END AS status, retry_count + gone::BIGINT AS retry_count, CASE WHEN NOT gone THEN lease_owner END AS lease_owner, CASE WHEN gone THEN '{ob.EXPIRED}' END AS error_message FROM e")
def stm02(spark, d):
    return ob.recover(_outbox(spark, d), _NOW).select("id", "status", big(F.col("retry_count")).alias("retry_count"), "lease_owner", "error_message")


_PROFILES = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS candidate, time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01') AS w, event_type AS title, 'k' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) // 10) AS skill, value FROM events),
o AS (SELECT candidate, w, max(value) AS emergence FROM e GROUP BY 1, 2), n AS (SELECT candidate, count(*) AS windows FROM o GROUP BY 1),
s AS (SELECT candidate, skill, count(DISTINCT w) AS n FROM e GROUP BY 1, 2), t AS (SELECT candidate, title, count(DISTINCT w) AS n FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY w DESC) AS back, row_number() OVER (PARTITION BY candidate ORDER BY w) AS k, count(*) OVER (PARTITION BY candidate) AS m FROM o),
tr AS (SELECT candidate, sum(emergence * CASE WHEN k = 1 THEN pow(0.6, m - 1) ELSE 0.4 * pow(0.6, m - k) END) AS trend FROM r GROUP BY 1),
rs AS (SELECT e.candidate, string_agg(DISTINCT skill, ',' ORDER BY skill) AS recent FROM e JOIN r ON r.candidate = e.candidate AND r.w = e.w WHERE back <= 3 GROUP BY 1),
ss AS (SELECT candidate, string_agg(skill || ':' || CAST(round(n / windows, 4) AS DECIMAL(9, 4)), ',' ORDER BY skill) AS support FROM s JOIN n USING (candidate) GROUP BY 1),
ct AS (SELECT candidate, string_agg(title, ',' ORDER BY title) FILTER (t.n >= least(2, windows)) AS core FROM t JOIN n USING (candidate) GROUP BY 1)
SELECT candidate, windows, support, coalesce(core, '') AS core, recent, round(trend, 4) AS trend FROM n JOIN ss USING (candidate) JOIN ct USING (candidate) JOIN rs USING (candidate) JOIN tr USING (candidate)"""


@query("emg08_profiles", _PROFILES)
def emg08(spark, d):
    e = table(spark, d, "events")
    skill = F.concat(F.lit("k"), F.floor(F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 10).cast("string"))
    zero = F.lit(0.0)
    x = e.select(F.col("user_id").cast("string").alias("candidate"), F.window(F.col("ts").cast("timestamp"), "3 days")["start"].alias("window_start"), F.array("event_type").alias("titles"), F.array(skill).alias("skills"), zero.alias("support"), zero.alias("companies"), F.col("value").alias("emergence"), zero.alias("stability"))
    p = pf.profiles(x)
    each = F.transform(F.map_entries("skill_support"), lambda v: F.concat(v["key"], F.lit(":"), F.round(v["value"], 4).cast("decimal(9,4)").cast("string")))
    return p.select("candidate", big(F.col("windows")).alias("windows"), F.array_join(F.array_sort(each), ",").alias("support"), F.array_join("core_titles", ",").alias("core"), F.array_join("recent_skills", ",").alias("recent"), F.round("emergence_trend", 4).alias("trend"))
