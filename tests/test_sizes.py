"""What must not grow with the tables: what is sent to all tasks, what one task holds."""

import math
import re

from pyspark.sql import functions as F

from tessera.operators import agglomerate as ag
from tessera.operators import independence as ind
from tessera.operators import knowledge as kn
from tessera.operators import matching as mt
from tessera.operators import relational as rel
from tessera.operators import requirements as rq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins(df):
    return re.findall(r"(\w+Join) ", plan(df))


def test_what_if_sends_scenarios_not_items(spark):
    items = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("req"), F.lit(0.5).alias("s"), F.lit(1.0).alias("w"))
    actions = spark.createDataFrame([("a", 3, 1.0), ("b", 4, 0.9)], "scenario string, req bigint, new_score double")
    out = mt.what_if(items, actions, ["k"], "req", "s", "w")
    assert "BroadcastNestedLoopJoin BuildRight" in plan(out) and "BuildLeft" not in plan(out)
    assert {(r.k, r.scenario): round(r.scenario_score, 6) for r in out.collect()} == {(k, s): {(3, "a"): 55.0, (0, "b"): 54.0}.get((k, s), 50.0) for k in range(4) for s in "ab"}


def test_requirement_tree_sends_the_tree_not_the_leaves(spark):
    leaves = spark.range(30).select(F.floor(F.col("id") / 3).alias("k"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("node"), F.when(F.col("id") % 5 != 0, 1).otherwise(0).alias("value"))
    groups = spark.createDataFrame([("g", "r0", "and", 0), ("g", "r1", "and", 0), ("root", "g", "or", 0), ("root", "r2", "or", 0)], "parent string, child string, op string, need int")
    out = mt.requirement_tree(leaves, groups, "k", 2)
    assert "BroadcastHashJoin" in joins(out) and not re.search(r"BroadcastHashJoin [^\n]*(LeftAnti|BuildLeft)", plan(out))
    value = lambda i: i % 5 != 0
    assert {r.k: bool(r.value) for r in out.filter("node = 'root'").collect()} == {k: (value(3 * k) and value(3 * k + 1)) or value(3 * k + 2) for k in range(10)}


def test_graph_values_send_nothing_whole(spark):
    pair = spark.range(10).select(F.floor(F.col("id") / 2).alias("p"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    edges = pair.select("p", F.lit("root").alias("parent"), F.col("c").alias("child"), F.lit("and").alias("op"), F.lit(None).cast("int").alias("need"))
    values = pair.filter("p <> 3 or c <> 'b'").select("p", F.lit(0).cast("bigint").alias("k"), F.col("c").alias("node"), F.lit(1).alias("value"))
    seen = []
    settle, rq.settled = rq.settled, lambda df: seen.append(joins(df)) or settle(df)
    try:
        out = rq.evaluate(edges, values, "p", "k", 1)
    finally:
        rq.settled = settle
    assert seen and all(set(j) <= {"SortMergeJoin"} for j in seen)
    assert {r.p: r.value for r in out.filter("node = 'root'").collect()} == {p: None if p == 3 else 1 for p in range(5)}


def test_keys_go_through_in_batches(spark):
    x = spark.range(60).select(F.floor(F.col("id") / 6).alias("k"), (F.col("id") % 6).alias("a"), (F.col("id") % 2).alias("r"), ((F.col("id") * 7 % 10 + 1) / 10).alias("g"), F.lit(1.0).alias("e"))
    out = mt.greedy_actions(x, "k", "a", "r", "g", "e", 1.5)
    assert "FlatMapGroups" not in plan(out) and "FlatMapGroups" not in plan(mt.capped_shares(x, "k", "a", "g", 0.2))
    # Key 0 has gains 0.1, 0.8, 0.5, 0.2, 0.9, 0.6 of requirements 0, 1, 0, 1, 0, 1.
    assert [(r.a, r.step, round(r.marginal, 6), round(r.cumulative, 6)) for r in out.filter("k = 0").orderBy("step").collect()] == [(4, 1, 0.9, 0.9), (1, 2, 0.8, 1.7)]
    w = {r.a: round(r.weight, 6) for r in mt.capped_shares(x.filter("k = 0"), "k", "a", "g", 0.2).collect()}
    assert len(w) == 6 and max(w.values()) <= 0.2 and abs(sum(w.values()) - 1) < 1e-5


def test_suggestions_score_different_names_once(spark):
    raw = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, "red ring").otherwise("Blue Rings").alias("n"))
    catalog = spark.createDataFrame([("s3", "Red Ring"), ("s1", "red ring"), ("s2", "blue rings"), ("s4", "ring"), ("s5", "stone")], "s string, l string")
    out = kn.suggestions(raw, catalog, "id", "n", "s", "l")
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append((r["rank"], r.s))
    assert len(got) == 500 and sorted(got[0]) == [(1, "s1"), (2, "s3"), (3, "s4")] and [s for _, s in sorted(got[1])] == ["s2", "s1", "s3"]
    assert plan(out).count("Window") and not any("id#" in l.split("[")[1] for l in plan(out).split("\n") if " Window [" in l)


def test_within_days_does_not_shuffle_pairs(spark):
    o = spark.range(90).select("id", (F.col("id") % 3).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("d"))
    out = rel.within_days(o, "id", ["k"], "d", 7)
    assert "HashAggregate" not in plan(out)
    rows = [(i, i % 3, i % 30) for i in range(90)]
    assert sorted((r.left, r.right) for r in out.collect()) == [(a, b) for a, k, x in rows for b, j, y in rows if a < b and k == j and abs(x - y) <= 7]


def test_split_cluster_works_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(40, 6))
    df = spark.createDataFrame([(i % 2, i, [float(y) for y in x]) for i, x in enumerate(v)] + [(2, 100, [1.0] * 6), (3, 101, [1.0] * 6), (3, 102, [1.0] * 6)], "c int, i long, v array<double>")
    want = {100: 0, 101: 0, 102: 0}
    for c in (0, 1):
        ids = [i for i in range(40) if i % 2 == c]
        u = v[ids] / np.linalg.norm(v[ids], axis=1, keepdims=True)
        s = (u @ u.T).round(12)
        a, b = divmod(int(s.argmin()), len(ids))
        want |= {i: int(s[k, b] > s[k, a]) for k, i in enumerate(ids)}
    for rows in (3, 1000):
        assert {r.i: r.part for r in kn.split_cluster(df, "c", "i", "v", 0.9, rows=rows).collect()} == want


def test_duplicate_scores_follow_from_classes(spark):
    texts = ["red steel ring", "red steel rings", "red steel ring", "blue stone", "Red Steel Ring", "ab", "ab"]
    df = spark.createDataFrame([(i, "b", texts[i % 7], [texts[i % 7]] if i % 3 else ["x"]) for i in range(35)], "i long, b string, t string, k array<string>")
    assert "SortMergeJoin" in plan(out := ind.duplicate_scores(df, "i", "b", "t", "k", 0.5)) and "BroadcastHashJoin" not in plan(out)
    grams = lambda t: {t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)}
    want = {}
    rows = [(r.i, r.t.lower().replace(" ", ""), set(r.k)) for r in df.collect()]
    for i, a, k in rows:
        for j, b, m in rows:
            if i < j and grams(a) & grams(b):
                s = round(0.65 * len(grams(a) & grams(b)) / len(grams(a) | grams(b)) + 0.2 * len(k & m) / len(k | m) + 0.15 * (1 - abs(len(a) - len(b)) / max(len(a), len(b))), 6)
                if s >= 0.5:
                    want[i, j] = s
    assert {(r.left, r.right): r.score for r in out.collect()} == want and out.count() == len(want) > 50


def test_rounds_of_average_link_send_nothing_whole(spark):
    x = spark.range(30).select((F.col("id") % 2).alias("k"), "id", F.array(F.cos(F.col("id") % 7), F.sin(F.col("id") % 7)).alias("v"))
    seen = []
    settle, ag.settled = ag.settled, lambda df: seen.append(plan(df)) or settle(df)
    try:
        ag.average_link_rounds(x, "k", "id", "v", 0.9)
    finally:
        ag.settled = settle
    # The number of a block's parts may be sent: a row a block.
    assert len(seen) > 4 and not any(re.search(r"BroadcastHashJoin \[[^\]]*,", p) for p in seen)


def test_items_are_dealt_over_tasks_by_customer(spark, tmp_path):
    from tessera.plans import matching as pm

    spark.range(25_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    x = pm.items(spark, str(tmp_path))
    assert x.rdd.getNumPartitions() == 3 and x.count() == 1_000_000
    assert "BroadcastHashJoin" not in plan(pm.mat28(spark, str(tmp_path)))


def test_set_join_asks_only_pairs_that_can_reach_the_threshold(spark):
    from tessera.operators import similarity as sim

    # Any two of 41 sets of 40 elements share one; besides, sets 100 and 101 share 30 of 40.
    rows = [(i, [min(i, j) * 1000 + max(i, j) for j in range(41) if j != i]) for i in range(41)]
    rows += [(100, list(range(90_000, 90_040))), (101, list(range(90_010, 90_050))), (102, list(range(90_010, 90_050)))]
    near, left, member = sim.candidates(spark.createDataFrame(rows, "id long, s array<long>"), "id", "s", 0.5)
    assert near.count() < 820 / 4 and (100, 101) in {(r.left, r.right) for r in near.collect()}  # the prefixes alone meet in 232
    assert left.filter("_id >= 100").count() == 60  # what one set alone holds is counted, not kept
    got = {(r.left, r.right, round(r.similarity, 9)) for r in sim.set_join(spark.createDataFrame(rows, "id long, s array<long>"), "id", "s", 0.5).collect()}
    assert got == {(100, 101, 0.6), (101, 102, 1.0)}


def test_bm25_shuffles_no_words(spark):
    from tessera.operators import retrieval as ret

    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b"]), (3, []), (4, None), (5, ["z", "c"])], "d long, w array<string>")
    asked = spark.createDataFrame([(7, ["b", "b", "c"]), (8, ["y"])], "q long, w array<string>")
    x = ret.bm25(docs, asked, "d", "q", "w")
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    n, mean, df = 5, 6 / 5, {"b": 2, "c": 1}
    part = lambda t, m, f, size: m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / mean))
    want = {(7, 1): part("b", 2, 2, 3), (7, 2): part("b", 2, 1, 1), (7, 5): part("c", 1, 1, 2)}
    got = {(r.q, r.d): r.score for r in x.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_steps_are_found_once_a_skill_and_dealt_over_tasks(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (3, 1), (1, 0)], "skill long, needs long")
    goals = spark.range(200).select(F.col("id").alias("holder"), (F.col("id") % 5).alias("skill")).unionByName(spark.createDataFrame([(0, 3), (500, None)], "holder long, skill long"))
    x = kn.learning_steps(edges, goals, rows=20)
    assert x.rdd.getNumPartitions() == 11
    got = {(r.holder, r.skill): r.depth for r in x.collect()}
    want = {0: {0: 0}, 1: {1: 0, 0: 1}, 2: {2: 0, 1: 1, 0: 2}, 3: {3: 0, 2: 1, 1: 2, 0: 3}, 4: {4: 0}}
    assert got == {(h, s): n for h in range(1, 200) for s, n in want[h % 5].items()} | {(0, s): n for s, n in want[3].items()} | {(500, None): 0}


def test_parts_are_scored_in_tasks_of_bounded_rows(spark, tmp_path):
    from tessera import plans

    spark.range(45_000).selectExpr("id AS p_partkey", "concat('red', id) AS p_name", "'ring' AS p_type").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    x = plans.QUERIES["ret08_dense_proxy"](spark, str(tmp_path))
    assert x.rdd.getNumPartitions() == 3 and x.count() == 45_000


def test_pairs_of_a_label_come_from_blocks(spark, sf):
    from tessera import plans
    from tessera.operators import pairs

    rows = [(i, i % 2, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(30)] + [(30, 0, [0.0] * 4), (31, 0, [1.0]), (32, 0, None), (33, None, [1.0] * 4), (34, 1, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "i long, c int, v array<float>")
    good = lambda v: v is not None and None not in v and any(v)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))) if good(a) and good(b) and len(a) == len(b) else 0.0
    want = {(i, j): cos(v, w) for i, c, v in rows for j, k, w in rows if i < j and c == k and c is not None}
    for size, step in ((7, 10), (1000, 1 << 20)):
        got = {(r.left, r.right): r.cosine for r in pairs.cosine_pairs(df, "c", "i", "v", size, step).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "FlatMapGroupsInArrow" in plan(plans.QUERIES["clu02_multi_view"](spark, sf))


def test_sets_of_common_elements_are_compared_in_blocks(spark):
    from tessera.operators import pairs
    from tessera.operators import similarity as sim

    rows = [(i, [f"e{(i * i + k * (i % 7 + 1)) % 23}" for k in range(9)]) for i in range(80)] + [(80, []), (81, ["x"]), (82, ["x", "y"])]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    sets = {i: frozenset(s) for i, s in rows if s}
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    reps = sorted(set(first.values()))
    want = {(i, j, round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 9)) for i in reps for j in reps if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.2} | {(first[i], i, 1.0) for i in sets if first[i] != i}
    out = sim.set_join(df, "id", "s", 0.2)
    assert "FlatMapGroupsInArrow" in plan(out) and {(r.left, r.right, round(r.similarity, 9)) for r in out.collect()} == want
    one = spark.createDataFrame([(i, len(sets[i]), [hash(e) for e in sets[i]]) for i in reps], "i long, n int, e array<long>")
    assert {(r.left, r.right, round(r.similarity, 9)) for r in pairs.overlap_pairs(one, "i", "n", "e", 0.2, 9, 20).collect()} == {x for x in want if x[0] in reps and x[1] in reps}


def test_dependencies_join_no_contexts(spark):
    from tessera.operators import aggregate as agg

    rows = [(i % 40, (i * i) % 9) for i in range(200)] + [(None, 1), (None, 2), (3, None)]
    out = agg.dependency_pairs(spark.createDataFrame(rows, "c long, i long").repartition(3), "c", "i")
    assert "c#" not in "".join(x for x in plan(out).split("\n") if "Join" in x)
    have = {k: {c for c, i in rows if i == k} for k in range(9)}
    joint = {(p, a): len({c for c in have[p] & have[a] if c is not None}) for p in have for a in have if p != a}
    want = {k: (n, n / len(have[k[1]]) - n / len(have[k[0]])) for k, n in joint.items() if n and n / len(have[k[1]]) - n / len(have[k[0]]) > 0}
    got = {(r.prerequisite, r.advanced): (r.joint, r.dependency) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_versions_take_each_line_item_once(spark, sf):
    from tessera.plans import evolution as pe

    before, after = pe.versions(spark, sf)
    assert "Expand" not in plan(before) and "Expand" not in plan(after)
    v = pe.facts(spark, sf).filter("version = 1998").groupBy(F.col("ent").alias("position"), "skill").agg(F.countDistinct(F.col("doc") % 4).alias("n"))
    assert {(r.position, r.skill): r.enterprises for r in after.collect()} == {(r.position, r.skill): r.n for r in v.collect()}


def test_projection_is_verified_without_joins(spark):
    from tessera.operators import knowledge as kn

    nodes = spark.createDataFrame([("a", 1), ("b", 2), (None, 1)], "node_id string, collisions long")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "x", 2), ("y", "x", 1), (None, "b", 1)], "source string, target string, collisions long")
    for tasks in (None, 3):
        out = kn.verify_projection(nodes, edges, tasks)
        assert out.first().asDict() == {"nodes": 3, "node_collisions": 1, "edges": 4, "edge_collisions": 1, "dangling": 4}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert kn.verify_projection(nodes.limit(0), edges.limit(0)).first().asDict() == {"nodes": 0, "node_collisions": 0, "edges": 0, "edge_collisions": 0, "dangling": 0}
