import re

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import cluster, simhash


def brute_fp(t, k=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    texts = ["A b c D e", "a b", "", None, " \n", "é È x y", "x " * 300]
    got = simhash.text_fingerprints(pa.array(texts, pa.string())).tolist()
    assert got == [brute_fp(t) for t in texts]


def components(fp, r):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fp, np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= r):
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(fp))]


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fp = list(base)
    for b in base:
        x = b
        for _ in range(8):  # chains of up to three flips
            for bit in rng.choice(64, 3, replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            fp.append(x)
    fp = sorted({int(x) for x in fp} | {0, 2**64 - 1})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "fp long")
    want = components(fp, 3)
    for crowd, tile in ((4096, 8192), (3, 8192), (3, 2)):
        edges = [(r.a, r.b) for r in simhash.links(df, crowd=crowd, tile=tile).collect()]
        at = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fp)}
        root = list(range(len(fp)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(at[a])] = find(at[b])
        got = [find(i) for i in range(len(fp))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_groups_and_dedup(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, t), (3, t.upper()), (9, "other words here entirely"), (7, None), (8, ""), (None, "alone"), (3, t.upper())]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, fp int")
    got = {(r.id, r.component_id) for r in simhash.groups(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 9), (7, 7), (8, 7), (None, None)}
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    assert simhash.groups(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in cluster.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
