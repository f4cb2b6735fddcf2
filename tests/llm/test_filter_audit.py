import re
from itertools import permutations

from tessera.llm.filter_audit import audit


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    texts = [(i, t or "", p or "") for i, t, p in docs]
    fails = []
    for i, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        fails.append(f)
    out = {}
    for part in {p for _, _, p in texts}:
        own = [(f, i in good and i is not None, i in toxic and i is not None) for f, (i, _, p) in zip(fails, texts) if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                hit = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                out[part, order, k + 1] = [len(left), len(hit), sum(r[0][x] for r in own) - len(hit), sum(r[0][x] and sum(r[0].values()) == 1 for r in own), sum(r[1] for r in hit), sum(r[2] for r in hit)]
        for x in "ABCDE":
            total = sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(x) + 1].append(total)
    return out


def rows():
    long = " ".join(f"w{k}" for k in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long + " #", "de"), (4, "AB c", None), (5, None, ""), (6, "", "en"), (None, long, "en"), (None, "A", "de"), (7, "x y " * 200, "en"), (8, "É" + " über" * 220 + " z ", "de")]
    docs += [(9, "Ab " * 400, "en"), (10, "|" + "q " * 30_000, "de"), (3, long, "de"), (0, "x y " * 200, "de")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, None, 1), (9, 1, None), (None, 1, 1), (10, 0, 1), (99, 1, 1)]
    return docs, labels


def test_matches_brute_force(spark):
    docs, labels = rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "2 as `N`", "3 as part", "4 as `a.b`").repartition(4)
    got = audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == brute(docs, labels)
    assert len(got) == 600 * 3


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = audit(one, labels).collect()
    assert len(got) == 600 and {(r.part, r.kept + r.removed + r.redundant) for r in got} <= {("", 1), ("", 0)}
