"""CLU-09 over whole tables: clusters are those of all pairs, copies among each other included."""

import random

import pytest

from tessera import plans


def plain(docs, threshold=0.5, strong=0.95):
    """Every pair of documents, in falling order of score."""
    sets = {}
    for i, text, _, _ in docs:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    kind = {i: (lang, source) for i, _, lang, source in docs}
    like = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) or 1)
    fits = lambda a, b: like(a, b) >= strong or any(x is not None and x == y for x, y in zip(kind[a], kind[b]))
    pairs = sorted((-round(like(a, b), 9), a, b) for a in sets for b in sets if a < b and like(a, b) >= threshold)
    group = {i: {i} for i in sets}
    for _, a, b in pairs:
        if group[a] is not group[b] and all(fits(x, y) for x in group[a] for y in group[b]):
            both = group[a] | group[b]
            group.update({x: both for x in both})
    return {i: min(group[i]) for i in group}


def clusters(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return {r.id: r.cluster for r in plans.QUERIES["clu09_constrained_clusters"](spark, str(folder)).collect()}


def test_copies_of_other_companies_and_sources_are_one_cluster(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    docs = [(i, text, f"l{i}", f"s{i}") for i in range(4)]
    assert clusters(spark, tmp_path, docs) == {0: 0, 1: 0, 2: 0, 3: 0} == plain(docs)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_are_those_of_all_pairs(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = [[f"{t}w{k}" for k in range(60)] for t in range(5)]
    texts = []
    for t in range(5):
        for _ in range(5):
            w, at = list(base[t]), rng.randrange(60)
            w[at : at + rng.choice([0, 1, 3, 6])] = [f"x{rng.random()}"]
            texts.append(" ".join(w[rng.choice([0, 0, 4]) :]))
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None]), rng.choice(["u", "v", "w", None])) for i in range(70)] + [(90, "too short", "a", "u")]
    want = plain(docs)
    assert len(set(want.values())) > 6 and clusters(spark, tmp_path, docs) == want
