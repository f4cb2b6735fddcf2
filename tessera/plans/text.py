"""Text queries on pages, documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions import text as tx
from tessera.functions.scalars import big

from .registry import query, table


@query("str01_canonical_urls")
def str01(spark, d):
    return table(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("str02_identity_urls", r"""WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), p AS (SELECT *, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS s, regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS r FROM u),
q AS (SELECT *, lower(regexp_extract(r, '^([^/?]*)', 1)) AS h, regexp_extract(r, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(r, '(\?.*)$', 1) AS qs FROM p)
SELECT page_id, CASE WHEN s = '' THEN 'https' ELSE s END || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') ELSE regexp_replace(h, ':443$', '') END || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || qs AS url FROM q""")
def str02(spark, d):
    return table(spark, d, "pages").select("page_id", tx.identity_url(F.col("url")).alias("url"))


@query("str03_fingerprints", r"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS fingerprint FROM conversations")
def str03(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.fingerprint(F.col("text")).alias("fingerprint"))


@query("str04_content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def str04(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query("str05_normal_keys")
def str05(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.normalize_key("text")).alias("key"))


@query("str06_alnum_keys", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9_]+', '', 'g') AS key FROM part")
def str06(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.alnum_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key"))


_PAIR = "x AS (SELECT p_partkey, lower(p_name) AS a, lag(lower(p_name)) OVER (ORDER BY p_partkey) AS b FROM part)"


def pairs(spark, d):
    from pyspark.sql.window import Window as W

    return table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lag(F.lower("p_name")).over(W.partitionBy(F.lit(1)).orderBy("p_partkey")).alias("b")).filter("b is not null")


def _g(c, n):
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - {n - 1}, 0) + 1), lambda i: substr({c}, i, {n})))"


@query("str07_trigram_similarity", f"WITH {_PAIR}, g AS (SELECT p_partkey, {_g('a', 3)} AS a, {_g('b', 3)} AS b FROM x WHERE b IS NOT NULL) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g")
def str07(spark, d):
    return pairs(spark, d).select("p_partkey", F.round(tx.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("str08_shingles", "WITH t AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS t FROM part) SELECT p_partkey, len(list_distinct(list_concat(" + _g("t", 3) + ", " + _g("t", 4) + "))) AS shingles FROM t")
def str08(spark, d):
    return table(spark, d, "part").select("p_partkey", big(F.size(tx.shingles(F.lower("p_name")))).alias("shingles"))


@query("str09_edit_ratio", f"WITH {_PAIR} SELECT p_partkey, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) AS distance FROM x WHERE b IS NOT NULL")
def str09(spark, d):
    return pairs(spark, d).select("p_partkey", F.round(tx.edit_ratio(F.col("a"), F.col("b")), 6).alias("distance"))


@query("str10_mixed_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+'))) AS tokens FROM documents WHERE lang = 'en'")
def str10(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", big(F.size(tx.mixed_tokens(F.col("text")))).alias("tokens"))


@query("str11_bigrams", "WITH t AS (SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[0-9a-z]+'), '') AS t FROM part) SELECT p_partkey, array_to_string(list_sort(" + _g("t", 2) + "), ',') AS bigrams FROM t")
def str11(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tx.bigrams(F.col("p_name"))), ",").alias("bigrams"))


@query("str12_lexical_similarity", f"WITH {_PAIR}, t AS (SELECT p_partkey, list_distinct(regexp_extract_all(a, '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(b, '[a-z0-9]+')) AS b FROM x WHERE b IS NOT NULL) SELECT p_partkey, round(0.35 * 2 * len(list_intersect(a, b)) / (len(a) + len(b)) + 0.65, 6) AS similarity FROM t")
def str12(spark, d):
    return pairs(spark, d).select("p_partkey", F.round(tx.lexical_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("str13_sequence_ratio")
def str13(spark, d):
    return pairs(spark, d).select("p_partkey", F.round(tx.sequence_ratio("a", "b"), 6).alias("ratio"))


_SAL = "s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '薪资可谈' WHEN 1 THEN (o_orderkey % 20 + 5) || '-' || (o_orderkey % 20 + 15) || 'K' WHEN 2 THEN '月薪' || (o_orderkey % 3 + 1) || '-' || (o_orderkey % 3 + 4) || '万' WHEN 3 THEN '8000-' || (o_orderkey % 9000 + 4000) || '元/月' WHEN 4 THEN '20-30万' ELSE 'none' END AS t FROM orders)"


@query("str15_salaries", f"""WITH {_SAL} SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'negotiable' WHEN 1 THEN 'specified' WHEN 2 THEN 'specified' WHEN 3 THEN CASE WHEN o_orderkey % 9000 + 4000 < 8000 THEN 'invalid' ELSE 'specified' END WHEN 4 THEN 'invalid' END AS status,
 CASE o_orderkey % 6 WHEN 1 THEN 1000.0 * (o_orderkey % 20 + 5) WHEN 2 THEN 10000.0 * (o_orderkey % 3 + 1) WHEN 3 THEN CASE WHEN o_orderkey % 9000 + 4000 >= 8000 THEN 8000.0 END END::DOUBLE AS minimum, CASE o_orderkey % 6 WHEN 1 THEN 1000.0 * (o_orderkey % 20 + 15) WHEN 2 THEN 10000.0 * (o_orderkey % 3 + 4) WHEN 3 THEN CASE WHEN o_orderkey % 9000 + 4000 >= 8000 THEN (o_orderkey % 9000 + 4000) END END::DOUBLE AS maximum,
 CASE WHEN o_orderkey % 6 IN (1, 2) OR (o_orderkey % 6 = 3 AND o_orderkey % 9000 + 4000 >= 8000) THEN '月' END AS period FROM s""")
def str15(spark, d):
    k = F.col("o_orderkey")
    t = (
        F.when(k % 6 == 0, "薪资可谈").when(k % 6 == 1, F.concat((k % 20 + 5).cast("string"), F.lit("-"), (k % 20 + 15).cast("string"), F.lit("K"))).when(k % 6 == 2, F.concat(F.lit("月薪"), (k % 3 + 1).cast("string"), F.lit("-"), (k % 3 + 4).cast("string"), F.lit("万")))
        .when(k % 6 == 3, F.concat(F.lit("8000-"), (k % 9000 + 4000).cast("string"), F.lit("元/月"))).when(k % 6 == 4, "20-30万").otherwise("none")
    )
    return table(spark, d, "orders").select("o_orderkey", tx.salary(t).alias("s")).select("o_orderkey", "s.*")


@query("str16_experience_months", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 12.0 * (o_orderkey % 9 + 1) WHEN 1 THEN 6.0 WHEN 2 THEN 36.0 END::DOUBLE AS months FROM orders")
def str16(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat((k % 9 + 1).cast("string"), F.lit(" years or more"))).when(k % 4 == 1, "6个月以上").when(k % 4 == 2, "3-5年").otherwise("some time")
    return table(spark, d, "orders").select("o_orderkey", tx.years_months(t).alias("months"))


@query("str17_degrees", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'bachelor' WHEN 1 THEN 'master' WHEN 2 THEN 'doctor' WHEN 3 THEN 'associate' END AS degree, CAST(CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 END AS BIGINT) AS rank FROM customer")
def str17(spark, d):
    k = F.col("c_custkey") % 5
    t = F.when(k == 0, "本科及以上").when(k == 1, "Master of Science").when(k == 2, "PhD preferred, master ok").when(k == 3, "大专").otherwise("any")
    return table(spark, d, "customer").select("c_custkey", tx.degree(t).alias("degree")).withColumn("rank", tx.degree_rank(F.col("degree")))


@query("str19_occurrences", "WITH p AS (SELECT doc_id, list_filter(range(1, length(text)), lambda i: substr(text, i, 3) = 'the') AS pos FROM documents) SELECT doc_id, pos[1] - 1 AS first, pos[2] - 1 AS second FROM p")
def str19(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", big(tx.occurrence(t, F.lit("the"), 0)).alias("first"), big(tx.occurrence(t, F.lit("the"), 1)).alias("second"))


@query("str20_personal_data", r"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+') THEN 'email' END, CASE WHEN regexp_matches(text, '(^|[^\d])\d{16}($|[^\d])') THEN 'card' END, CASE WHEN regexp_matches(text, '(^|[^\d.])\d{1,3}(\.\d{1,3}){3}($|[^\d.])') THEN 'ip' END, CASE WHEN regexp_matches(text, '(?i)(token|api_key|password)\s*=\s*\S+') THEN 'secret' END) AS kinds FROM documents")
def str20(spark, d):
    k = tx.pii_kinds(F.col("text"), ("email", "card", "ip", "secret"))
    return table(spark, d, "documents").select("doc_id", F.array_join(k, ",").alias("kinds"))


@query("str21_redaction")
def str21(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tx.redact(F.col("text")).alias("text"))
    return t.select("conv_id", "turn", (F.col("text") == "[redacted]").alias("redacted"))


@query("str22_identifiers", r"SELECT c_custkey, NOT (c_custkey % 7 = 0) AS valid FROM customer")
def str22(spark, d):
    k = F.col("c_custkey")
    t = F.when(k % 7 == 0, F.concat(F.lit("phone_"), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("cv:"), k.cast("string"))).otherwise(F.concat(F.lit("doc-"), k.cast("string")))
    return table(spark, d, "customer").select("c_custkey", tx.structured_id(t).alias("valid"))


TOPICS = {"metal": ("bolt", "nut", "gear"), "round": ("ring", "wheel", "red"), "small": ("small", "tiny")}


@query("str23_topics", "WITH s AS (SELECT p_partkey, (CASE WHEN p_name LIKE '%bolt%' THEN 4 ELSE 0 END + CASE WHEN p_name LIKE '%nut%' THEN 3 ELSE 0 END + CASE WHEN p_name LIKE '%gear%' THEN 4 ELSE 0 END) AS m, (CASE WHEN p_name LIKE '%ring%' THEN 4 ELSE 0 END + CASE WHEN p_name LIKE '%wheel%' THEN 5 ELSE 0 END + CASE WHEN p_name LIKE '%red%' THEN 3 ELSE 0 END) AS r, (CASE WHEN p_name LIKE '%small%' THEN 5 ELSE 0 END + CASE WHEN p_name LIKE '%tiny%' THEN 4 ELSE 0 END) AS s FROM part) SELECT p_partkey, CASE WHEN greatest(m, r, s) = 0 THEN 'other' WHEN m >= r AND m >= s THEN 'metal' WHEN r >= s THEN 'round' ELSE 'small' END AS topic FROM s")
def str23(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.keyword_topic(F.col("p_name"), TOPICS).alias("topic"))


@query("str24_tags", "WITH t AS (SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_name, 'bolt|nut|gear') THEN 'metal' END, CASE WHEN regexp_matches(p_name, 'ring|wheel|red') THEN 'round' END, CASE WHEN regexp_matches(p_name, 'small|tiny') THEN 'small' END) AS t FROM part) SELECT p_partkey, CASE WHEN t = '' THEN 'other' ELSE t END AS tags FROM t")
def str24(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.keyword_tags(F.col("p_name"), TOPICS), ",").alias("tags"))


@query("str25_title_keywords", "SELECT p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9])ring($|[^a-z0-9])') AS hit FROM part")
def str25(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.keyword_hit(F.col("p_name"), "ring").alias("hit"))


@query("str26_skill_lookup", "WITH m AS (SELECT DISTINCT p_name AS raw, p_brand AS id FROM part WHERE p_size < 20), e AS (SELECT raw, min(id) AS id FROM m GROUP BY 1), f AS (SELECT lower(raw) AS k, min(id) AS id, count(DISTINCT id) AS n FROM m GROUP BY 1), q AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS raw FROM part) SELECT p_partkey, coalesce(e.id, CASE WHEN f.n = 1 THEN f.id END) AS id FROM q LEFT JOIN e USING (raw) LEFT JOIN f ON f.k = lower(q.raw)")
def str26(spark, d):
    p = table(spark, d, "part")
    m = p.filter("p_size < 20").select(F.col("p_name").alias("raw"), F.col("p_brand").alias("id")).distinct()
    e = m.groupBy("raw").agg(F.min("id").alias("exact"))
    f = m.groupBy(F.lower("raw").alias("k")).agg(F.min("id").alias("folded"), F.countDistinct("id").alias("n")).filter("n = 1").drop("n")
    q = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("raw")).withColumn("k", F.lower("raw"))
    return q.join(e, "raw", "left").join(f, "k", "left").select("p_partkey", F.coalesce("exact", "folded").alias("id"))


@query("str28_token_f1", f"WITH {_PAIR}, t AS (SELECT p_partkey, list_distinct(regexp_extract_all(a, '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(b, '[a-z0-9]+')) AS b FROM x WHERE b IS NOT NULL) SELECT p_partkey, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1 FROM t")
def str28(spark, d):
    return pairs(spark, d).select("p_partkey", F.round(tx.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("str29_hallucinations", "SELECT doc_id, len(list_filter([substr(text, 5, 10), 'no such words here'], lambda q: NOT contains(text, q))) AS missing FROM documents")
def str29(spark, d):
    q = F.array(F.substring("text", 5, 10), F.lit("no such words here"))
    return table(spark, d, "documents").select("doc_id", big(F.size(tx.hallucinations(q, F.col("text")))).alias("missing"))


@query("str30_query_depth", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'compare|versus|difference|区别|对比') THEN 'compare' WHEN regexp_matches(lower(text), 'overview|summary|整体|概述') THEN 'overview' ELSE 'fact' END AS depth FROM conversations WHERE role = 'user'")
def str30(spark, d):
    from tessera.operators.retrieval import query_depth

    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", query_depth(F.col("text")).alias("depth"))


@query("str31_split_skills", "SELECT p_partkey, len(list_filter(list_transform(regexp_split_to_array(p_name || '/' || p_brand || ', ' || p_type, '[/,]'), lambda x: trim(x)), lambda x: x <> '')) AS parts FROM part")
def str31(spark, d):
    return table(spark, d, "part").select("p_partkey", big(F.size(tx.split_skills(F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit(", "), F.col("p_type"))))).alias("parts"))


@query("str33_quality_scores", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the|and')) AS BIGINT) AS markers, round(greatest(0, least(1, (len(regexp_extract_all(lower(text), 'the|and')) - 8) / 12.0)), 6)::DOUBLE AS inflation_score FROM documents WHERE lang = 'en'")
def str33(spark, d):
    s = tx.quality_scores(F.lit(0.5), F.col("text"), "the|and")
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", big(F.regexp_count("text", F.lit("(?i)the|and"))).alias("markers"), s[2]).withColumn("inflation_score", F.round("inflation_score", 6))


@query("set02_weighted_jaccard", "WITH e AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), k AS (SELECT a.user_id, t.event_type, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM (SELECT DISTINCT user_id FROM e) a CROSS JOIN (SELECT DISTINCT event_type FROM e) t LEFT JOIN e x ON x.user_id = a.user_id AND x.event_type = t.event_type LEFT JOIN e y ON y.user_id = a.user_id + 1 AND y.event_type = t.event_type WHERE EXISTS (SELECT 1 FROM e z WHERE z.user_id = a.user_id + 1)) SELECT user_id, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS similarity FROM k GROUP BY 1")
def set02(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    nxt = e.select((F.col("user_id") - 1).alias("user_id"), F.col("m").alias("k"))
    return e.join(nxt, "user_id").select("user_id", F.round(tx.weighted_jaccard(F.col("m"), F.col("k")), 6).alias("similarity"))


@query("set03_dice", f"WITH {_PAIR}, g AS (SELECT p_partkey, {_g('a', 2)} AS a, {_g('b', 2)} AS b FROM x WHERE b IS NOT NULL) SELECT p_partkey, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard_distance FROM g")
def set03(spark, d):
    a, b = tx.char_grams(F.col("a"), 2), tx.char_grams(F.col("b"), 2)
    return pairs(spark, d).select("p_partkey", F.round(tx.dice(a, b), 6).alias("dice"), F.round(1 - tx.jaccard(a, b, 1.0), 6).alias("jaccard_distance"))


@query("dat01_weeks_and_months", "SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS BIGINT) AS causal_window FROM events")
def dat01(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, d, "events").select("event_id", sc.week_start(F.col("ts")).alias("week"), sc.month_bucket(F.col("ts")).alias("month"), F.floor(day / 3).alias("causal_window"))


@query("dat02_decay", "SELECT o_orderkey, round(exp(-greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')) / 365.0), 6) AS freshness, round(pow(2, -greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')) / 180.0), 6) AS half_life FROM orders")
def dat02(spark, d):
    now = F.lit("2000-01-01").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.round(sc.freshness(now, F.to_date("o_orderdate"), 365), 6).alias("freshness"), F.round(sc.half_life(F.datediff(now, F.to_date("o_orderdate")), 180), 6).alias("half_life"))


@query("dat05_cluster_freshness", "WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) >= DATE '1999-06-01' END AS fresh FROM orders) SELECT o_custkey, CASE WHEN bool_or(fresh) THEN 'fresh' WHEN count(fresh) = count(*) THEN 'stale' ELSE 'unknown' END AS state FROM f GROUP BY 1")
def dat05(spark, d):
    f = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.to_date("o_orderdate") >= F.lit("1999-06-01").cast("date"))
    g = table(spark, d, "orders").select("o_custkey", f.alias("fresh")).groupBy("o_custkey").agg(F.max("fresh").alias("a"), F.count("fresh").alias("k"), F.count("*").alias("n"))
    return g.select("o_custkey", F.when(F.col("a"), "fresh").when(F.col("k") == F.col("n"), "stale").otherwise("unknown").alias("state"))


@query("dat07_strict_utc", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc FROM orders")
def dat07(spark, d):
    k = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    t = F.when(k == 0, F.concat(day, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("+08:00"))).when(k == 2, day).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(sc.strict_utc(t), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("dat08_wait_days", "SELECT event_id, round(greatest(0, (epoch_ms(TIMESTAMP '2024-01-20') - epoch_ms(date_trunc('second', ts))) / 86400000.0), 6) AS wait_days FROM events")
def dat08(spark, d):
    w = (F.unix_timestamp(F.lit("2024-01-20 00:00:00")) - F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))) / 86400
    return table(spark, d, "events").select("event_id", F.round(F.greatest(F.lit(0.0), w), 6).alias("wait_days"))


@query("src06_archive_signals", "WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'WatchEvent' WHEN 'view' THEN 'ForkEvent' ELSE 'Other' END AS type, CASE user_id % 3 WHEN 0 THEN 'org/llm_agent' WHEN 1 THEN 'org/vector-db' ELSE 'org/misc' END || CAST(user_id AS VARCHAR) AS repo FROM events) SELECT CASE WHEN contains(repo, 'llm') THEN 'llm' ELSE 'vector' END AS topic, CASE WHEN contains(repo, 'llm') THEN 'ai' ELSE 'data' END AS domain, count(*) FILTER (type = 'WatchEvent') AS stars, count(*) FILTER (type = 'ForkEvent') AS forks, count(DISTINCT repo) AS repositories FROM e WHERE type <> 'Other' AND (contains(repo, 'llm') OR contains(repo, 'vector')) GROUP BY 1, 2")
def src06(spark, d):
    from tessera.sources import archive_signals

    t = F.when(F.col("event_type") == "click", "WatchEvent").when(F.col("event_type") == "view", "ForkEvent").otherwise("Other")
    r = F.when(F.col("user_id") % 3 == 0, "org/llm_agent").when(F.col("user_id") % 3 == 1, "org/vector-db").otherwise("org/misc")
    return archive_signals(table(spark, d, "events").select(t.alias("type"), F.concat(r, F.col("user_id").cast("string")).alias("repo")), {"llm": "ai", "vector": "data"})


@query("src14_released_facts", "SELECT o_orderkey, n_name, count(l_linenumber) AS lines, 'released' AS origin FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30 WHERE o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL SELECT o_orderkey, NULL, 0, 'legacy' FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def src14(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    x = o.filter("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(li.filter("l_quantity > 30"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rel = x.groupBy("o_orderkey", "n_name").agg(F.count("l_linenumber").alias("lines")).withColumn("origin", F.lit("released"))
    old = o.filter("o_orderstatus = 'O'").join(li.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return rel.unionByName(old.select("o_orderkey", F.lit(None).cast("string").alias("n_name"), F.lit(0).cast("bigint").alias("lines"), F.lit("legacy").alias("origin")))


@query("src15_window_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def src15(spark, d):
    return table(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp"))).select("event_id")
