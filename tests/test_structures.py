"""Closures, taxonomy findings and requirement graphs against plain versions and hand-made cases."""

import hashlib
import random
import re

import pytest

from tessera.operators import requirements as rq
from tessera.operators import taxonomy as tax


def above(edges):
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    out = {}
    for n in up:
        level, depth, seen = up[n], 1, {}
        while level:
            fresh = {x for x in level if x not in seen}
            seen |= {x: depth for x in fresh}
            level, depth = {p for x in fresh for p in up.get(x, ())}, depth + 1
        out |= {(n, a): k for a, k in seen.items()}
    return out


def test_closure_needs_no_round_to_see_that_it_is_whole(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "c long, p long")
    assert tax.closure(chain, "c", "p", rounds=6).count() == 40 * 41 // 2  # 6 rounds reach 64 levels


def test_closure_with_cycles_and_shortcuts(spark):
    rng = random.Random(1)
    edges = [(i, rng.randrange(i)) for i in range(1, 60)] + [(i, i - 1) for i in range(61, 90)] + [(3, 50), (70, 80), (7, 7), (None, 1), (1, None), (5, 2), (5, 2)]
    got = {(r.node, r.ancestor): r.depth for r in tax.closure(spark.createDataFrame(edges, "c long, p long"), "c", "p").collect()}
    assert got == above(edges)
    assert tax.closure(spark.createDataFrame([], "c long, p long"), "c", "p").count() == 0
    with pytest.raises(RuntimeError):
        tax.closure(spark.createDataFrame([(i, i + 1) for i in range(40)], "c long, p long"), "c", "p", rounds=3)


def test_catalog_findings(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "n long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 9), (4, 5), (4, 0)], "c long, p long")
    got = sorted(map(tuple, tax.catalog_findings(nodes, edges, "n", "c", "p").collect()))
    assert got == [(0, "parent_cycle"), (1, "parent_cycle"), (2, "parent_cycle"), (3, "parent_missing"), (4, "several_parents")]


BUNDLE = "bundle string, schema_version string, taxonomy_version string"
SHOWN = "bundle string, pos int, skill_id string, canonical_name string, classifications array<struct<facet:string,code:string,is_primary:boolean>>"


def test_projection_findings_in_order(spark):
    v2, a, b = "extracted-jd-bundle-v2", [("f", "A", True)], [("f", "B", True), ("f", "A", False)]
    names = ["ok", "old", "v1", "few", "twice", "null", "unknown", "name", "class", "repeat", "empty", "order", "open"]
    bundles = spark.createDataFrame([(n, "v1" if n == "v1" else v2, None if n == "old" else "t1") for n in names], BUNDLE)
    have = {n: ["s1"] for n in names} | {"few": ["s1", "s2"], "empty": [], "unknown": ["s9"], "order": ["s1", "s9"], "open": ["s3"]}
    resolved = spark.createDataFrame([(n, s) for n, v in have.items() for s in v] + [("ok", None)], "bundle string, skill_id string")
    rows = [(n, 0, "s1", "one", a) for n in ("ok", "old", "v1", "few", "twice")] + [("twice", 1, "s1", "one", a), ("null", 0, "s1", "one", a), ("null", 1, None, "x", a)]
    rows += [("unknown", 0, "s9", "x", a), ("name", 0, "s1", "two", a), ("class", 0, "s1", "one", b), ("repeat", 0, "s1", "one", a + a), ("order", 1, "s9", "x", a), ("order", 0, "s1", None, a), ("open", 0, "s3", "three", [("f", "B", True)])]
    shown = spark.createDataFrame(rows, SHOWN)
    skills = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s3", "three")], "skill_id string, canonical_name string")
    relations = spark.createDataFrame([("s1", "f", "A", True), ("s3", "f", "B", True)], "skill_id string, facet string, code string, is_primary boolean")
    over = tax.closure(spark.createDataFrame([("B", "A")], "c string, p string"), "c", "p")
    got = {r.bundle: (r.code, r.skill_id) for r in tax.projection_findings(bundles, resolved, shown, skills, relations, "t1", above=over).collect()}
    assert got == {
        "old": (tax.OTHER_VERSION, None), "few": (tax.COVERAGE, None), "twice": (tax.COVERAGE, None), "null": (tax.COVERAGE, None), "unknown": (tax.UNKNOWN_SKILL, "s9"),
        "name": (tax.CONTENT, "s1"), "class": (tax.CONTENT, "s1"), "repeat": (tax.CONTENT, "s1"), "order": (tax.CONTENT, "s1"), "open": (tax.OPEN, None),
    }
    none = tax.projection_findings(bundles, resolved, shown, None, None, None).collect()
    assert len(none) == len(names) - 1 and {r.code for r in none} == {tax.MISSING_CATALOG}


REQUIREMENT = "p long, ord int, requirement_id string, name string, priority string, quotes array<string>"


def plain_groups(rows):
    """Separators join what the pieces beside them name, clause by clause."""
    out = set()
    quotes = {}
    for p, o, i, name, priority, qs in sorted(rows, key=lambda r: r[1]):
        for q in dict.fromkeys(qs or []):
            if i is not None and q is not None and all(x[0] != i for x in quotes.setdefault((p, q), [])):
                quotes[p, q].append((i, name, priority))
    sep = r"/|或|或者|(?<!\w)or(?!\w)|至少一种|至少一门|至少一个|任选|其中一种|one[- ]?of|any[- ]?of|either"

    def named(piece, name):
        t, n = piece.lower(), (name or "").lower()
        head = re.match("[a-z0-9+#]*", n)[0]
        return bool(n) and (n in t or (n == "coze" and "扣子" in t) or (len(head) >= 2 and re.search(f"(?<![a-z0-9]){re.escape(head)}(?![a-z0-9])", t) is not None))

    for (p, q), skills in quotes.items():
        for k, clause in enumerate([c for c in re.split("[，。；;,]", q) if c.strip()] or [q], 1):
            pieces, found = re.split(sep, clause), []
            for left, right in zip(pieces, pieces[1:]):
                a, b = [s for s in skills if named(left, s[1])], [s for s in skills if named(right, s[1])]
                if a and b:
                    found += [s for s in (*a, *b) if s not in found]
            if len(skills) > 1 and len(found) > 1:
                name = f"{q}|{k}|" + "|".join(s[0] for s in found)
                kinds = {s[2] for s in found}
                out.add((p, "derived-or:" + hashlib.sha256(name.encode()).hexdigest()[:16], kinds.pop() if len(kinds) == 1 else "unknown", tuple(s[0] for s in found)))
    return out


def test_derived_groups(spark):
    q1, q2, q3 = "熟练掌握 Python，熟悉 C++ 或 Java；Vue/React", "扣子 or Dify, for Python.", "either Go or Rust"
    rows = [
        (1, 1, "a", "Python", "required", [q1, q2]), (1, 2, "b", "C++", "required", [q1]), (1, 3, "c", "Java", "preferred", [q1, q1]), (1, 4, "d", "Vue.js", "preferred", [q1]), (1, 5, "e", "React", "preferred", [q1, None]),
        (1, 6, "f", "coze", "required", [q2]), (1, 7, "g", "Dify", "required", [q2]), (1, 8, None, "Java", "required", [q1]), (1, 9, "h", None, "required", [q1]), (2, 1, "x", "Go", "required", [q3]), (2, 2, "y", "Rust", "required", [q3]), (3, 1, "z", "Go", "required", ["Go or Rust"]), (4, 1, "k", "Go", "required", None),
    ]
    got = rq.derived_groups(spark.createDataFrame(rows, REQUIREMENT), "p").collect()
    assert {(r.p, r.group_id, r.priority, tuple(c.ref for c in r.children)) for r in got} == plain_groups(rows)
    assert {tuple(c.ref for c in r.children): r.priority for r in got} == {("b", "c"): "unknown", ("d", "e"): "preferred", ("f", "g"): "required", ("x", "y"): "required"}
    assert {r.op for r in got} == {"or"}
    some = [(1, k, n, n, "required", ["at least 2: sql / java / go"]) for k, n in enumerate(["sql", "java", "go"])]
    r = rq.derived_groups(spark.createDataFrame(some, REQUIREMENT), "p").first()
    assert (r.op, r.need, len(r.children)) == ("min_count", 2, 3)


def test_nested_graph(spark):
    child = "array<struct<ref:string,aspect:string>>"
    groups = spark.createDataFrame([
        (1, "top", "and", None, [("any", ""), ("two", ""), ("s", "")]), (1, "any", "or", None, [("a", ""), ("deep", "")]), (1, "deep", "and", None, [("b", ""), ("c", "")]), (1, "two", "min_count", 2, [("a", ""), ("b", ""), ("d", "")]),
        (2, "u", "or", None, [("v", "")]), (2, "v", "or", None, [("u", "")]),
    ], f"p long, group_id string, op string, need int, children {child}")
    edges = rq.graph_edges(groups, "p")
    assert {r.p: (r.depth, r.cyclic) for r in rq.depths(edges, "p").collect()} == {"1": (3, False), "2": (2, True)}

    def plain(v):
        both = lambda xs, need: 1 if sum(x == 1 for x in xs) >= need else 0 if sum(x != 0 for x in xs) < need else None
        deep = both([v["b"], v["c"]], 2)
        return {"deep": deep, "any": both([v["a"], deep], 1), "two": both([v["a"], v["b"], v["d"]], 2), "top": both([both([v["a"], deep], 1), both([v["a"], v["b"], v["d"]], 2), v["s"]], 3)}

    rng = random.Random(2)
    people = {k: {n: rng.choice([0, 1, None]) for n in "abcds"} for k in range(40)}
    values = spark.createDataFrame([(1, k, n, x) for k, v in people.items() for n, x in v.items() if not (x is None and k % 2)], "p long, k long, node string, value int")
    got = {}
    for r in rq.evaluate(edges.filter("p = 1"), values, "p", "k", 3).collect():
        got.setdefault(r.k, {})[r.node] = r.value
    assert len(got) > 30
    for k, v in ((k, v) for k, v in people.items() if k in got):
        assert {n: got[k][n] for n in ("deep", "any", "two", "top")} == plain(v)
    rooted = rq.with_root(edges.filter("p = 1"), spark.createDataFrame([(1, "z"), (1, "a")], "p long, requirement_id string"), "p").filter("parent = 'root'").collect()
    assert {r.child for r in rooted} == {"top", "z"} and {r.op for r in rooted} == {"and"}
