import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessera.llm import gru, language_model, license_texts, licenses, quality, toxicity
from tessera.llm.labelled import fit_logistic


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_conv_gradient_learns_a_pattern():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for i in range(120):
        x = rng.integers(97, 120, (1 + i % 3, quality.CHUNK)).astype(np.uint8)
        if i % 2:
            x[0, 100:104] = np.frombuffer(b"####", np.uint8)
        docs.append(x)
        y.append(i % 2)
    steps, quality.STEPS = quality.STEPS, 150
    try:
        m = quality.train(docs, np.array(y))
    finally:
        quality.STEPS = steps
    buf = np.concatenate([d.ravel() for d in docs])
    offs = np.concatenate([[0], np.cumsum([d.size for d in docs])])
    p = quality.score_texts(buf, offs, m)
    assert ((p >= 0.5) == np.array(y)).mean() > 0.95


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 5000):
        s = quality.chunk_starts(n)
        assert s[-1] + quality.CHUNK >= n and all(b - a == quality.CHUNK - quality.OVERLAP for a, b in zip(s, s[1:]))


def test_quality_edges(spark):
    rows = [(i, "good words here " * 20 if i % 3 else "##$$%% " * 30) for i in range(60)] + [(60, None), (61, ""), (None, "good words"), (3, "good")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    good = {r.doc_id: r.predicted for r in got if r.doc_id is not None and 50 <= r.doc_id < 60}
    assert all(p == int(i % 3 > 0) for i, p in good.items())
    assert quality.classify(docs, labels.limit(0)).count() == len(rows)
    clash = docs.selectExpr("*", "1 as _score", "'x' as y", "text as i", "3 as held_out", "4 as __a")
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and 0 < kept.count() < len(rows)
    twice = quality.classify(clash.union(clash), labels.union(labels)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.predicted) for r in twice) == sorted([(str(r.doc_id), r.held_out, r.predicted) for r in got] * 2)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_scores_are_those_of_a_plain_network():
    rng = np.random.default_rng(6)
    m = quality.train([rng.integers(97, 123, (k % 3 + 1, quality.CHUNK)).astype(np.uint8) for k in range(12)], np.arange(12) % 2)
    texts = [b"", b"a", b"abc def " * 64, bytes(rng.integers(32, 127, 5000).astype(np.uint8)), b"x" * 100_000]
    got = quality.score_texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), m)
    for t, p in zip(texts, got):
        pooled = []
        for s in quality.chunk_starts(len(t)):
            c = t[s : s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            every = [sum(m["table"][k, c[at + k]] for k in range(quality.WIDTH)) for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            pooled.append(np.maximum(np.max(every, axis=0) + m["bias"], 0))
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ m["out"] + m["last"][0]
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def plain_reading(symbols, i):
    """Which reading an insult or threat has, by looking around."""
    before = symbols[:i]
    negated = toxicity.NEGATION in before[-toxicity.NEGATED_FOR :]
    if symbols[i] == toxicity.INSULT:
        return 3 if toxicity.REPORT in before else 2 if negated else 1 if toxicity.TARGET in symbols else 0
    near = toxicity.TARGET in symbols[max(0, i - toxicity.THREAT_REACH) : i + toxicity.THREAT_REACH + 1]
    return 4 if near and not negated and toxicity.REPORT not in before else -1


@given(st.lists(st.integers(0, 5), max_size=14))
@settings(max_examples=400, deadline=None)
def test_composed_machines_read_as_looking_around_does(symbols):
    weights = [0.5 + i if s == toxicity.INSULT else 0.0 for i, s in enumerate(symbols)]
    want = [0.0] * 5
    for i, s in enumerate(symbols):
        if s in (toxicity.INSULT, toxicity.THREAT) and (k := plain_reading(symbols, i)) >= 0:
            want[k] += weights[i] if s == toxicity.INSULT else 1
    assert toxicity.read_clause(symbols, weights) == pytest.approx(want)


def test_toxicity_scores_are_those_of_a_plain_scorer():
    lex = {"idiot": 5.0, "schu*": 3.0}
    texts = ["", "you are an idiot. he said: idiot! not an idiot\nidiot idiot", "kill you; kill the time", "du bist nicht idiot", "tu es pas idiot", "ein schuft ist ein schuft " * 50, "x " * 40_000 + "you idiot"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = toxicity.Grammar(lex).describe(buf, offs)
    for t, x in zip(texts, got):
        sums, dense, n, most = np.zeros(5), 0.0, 0, 0.0
        for clause in re.split("(?<=[.,;:!?])\\s+|\n", t):
            made = [toxicity.symbol(toxicity.normal(w.encode()), lex) for w in clause.split()]
            if not any(s in (toxicity.INSULT, toxicity.THREAT) for s, _ in made):
                continue
            own = np.zeros(5)
            for i, (s, w) in enumerate(made):
                if s in (toxicity.INSULT, toxicity.THREAT) and (k := plain_reading([m[0] for m in made], i)) >= 0:
                    own[k] += w if s == toxicity.INSULT else 1
            meant = own[0] + own[1] + own[4]
            sums, dense, n = sums + own, max(dense, meant / len(made) ** 0.5), n + (meant > 0)
            most = max(most, meant)
        assert x == pytest.approx([*np.log1p(sums), dense, np.log1p(n), most])
    assert got[3][1] == got[4][1] == 0 < got[3][2]


def test_toxicity_edges(spark):
    lex = {"schu*": 3.0}
    assert toxicity.symbol("schuft", lex) == (toxicity.INSULT, 3.0)
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(40)) + (" grunk! " if i % 4 == 0 else "")) for i in range(400)] + [(400, None), (401, ""), (None, "grunk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert all(r.predicted == 0 for r in got if r.doc_id in (400, 401))
    assert toxicity.classify(docs, labels.limit(0)).count() == len(rows) and toxicity.classify(docs.limit(0), labels).count() == 0
    clash = docs.selectExpr("*", "1 as _score", "'x' as y", "2 as score", "text as i", "3 as held_out")
    twice = toxicity.classify(clash.union(clash), labels.union(labels)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.predicted) for r in twice) == sorted([(str(r.doc_id), r.held_out, r.predicted) for r in got] * 2)


def test_logistic():
    x = np.random.default_rng(3).normal(size=(500, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = fit_logistic(x, y)
    assert w[0] > 1 > -1 > w[1]


@pytest.mark.parametrize("lexicon", [200_000, 20])
def test_language_model_base_scores(spark, lexicon):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words[:20] if i % 2 else words[10:]) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (None, "w1 w2"), (5, "w1 W1 é")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in language_model.score(docs, lexicon=lexicon).collect()))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tok = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = collections.Counter(x for i, w in tok if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tok)
    assert got == want


def small_network(seed=0):
    rng = np.random.default_rng(seed)
    return gru.start(np.full(40, 10), np.where(np.arange(gru.TAILS) % 3, 5, 0), 30), rng


def test_language_model_is_a_distribution():
    m, rng = small_network()
    docs = [np.append(rng.integers(0, 30, 20), gru.END) for _ in range(30)]
    m = gru.train(m, docs * 3, 8e-3, 2000)
    total = 0.0  # over all first symbols, of P(symbol) before anything is read
    for s in range(gru.SYMBOLS):
        first = gru.log10_probability(m, np.array([s]), np.array([0, 1]))[0]
        assert gru.log10_probability(m, np.array([s, gru.END]), np.array([0, 2]))[0] <= first + 1e-9
        total += 10**first
    assert abs(total - 1) < 1e-3
    seqs = np.concatenate(docs)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    whole = gru.log10_probability(m, seqs, first)
    window, gru.WINDOW = gru.WINDOW, 5
    try:
        assert np.allclose(whole, gru.log10_probability(m, seqs, first), atol=1e-4)
    finally:
        gru.WINDOW = window


def plain_log10(m, text):
    """The network, one symbol and one state at a time."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    H, h, prev, out = gru.HIDDEN, np.zeros(gru.HIDDEN), gru.END, 0.0
    for y in text:
        gx = m["x"][prev].astype(float)
        z, r = sig(gx[:H] + h @ m["u"][:, :H]), sig(gx[H : 2 * H] + h @ m["u"][:, H : 2 * H])
        h = (1 - z) * h + z * np.tanh(gx[2 * H :] + (r * h) @ m["u"][:, 2 * H :])
        p = np.exp(h @ m["wc"] + m["bc"])
        k = y // gru.GROUP if y < gru.HEAD else y - gru.HEAD + gru.GROUPS
        out += np.log10(p[k] / p.sum())
        if y < gru.HEAD:
            q = np.exp(h @ m["ww"][k] + m["bw"][k])
            out += np.log10(q[y % gru.GROUP] / q.sum())
        prev = y
    return out


def test_scores_are_those_of_a_plain_network():
    m, rng = small_network(4)
    m["wc"] += rng.normal(0, 0.3, m["wc"].shape).astype(np.float32)
    texts = [np.append(rng.choice([*range(40), *range(gru.HEAD, gru.END)], n), gru.END) for n in (0, 1, 5, 300, 70)]
    got = gru.log10_probability(m, np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.allclose(got, [plain_log10(m, t) for t in texts], rtol=1e-4)


def test_gru_gradient_is_right():
    m, rng = small_network(1)
    m = {k: v.astype(np.float64) for k, v in m.items()}
    seq = np.array([[3, 30, gru.END - 2, gru.END, 7], [5, 5, gru.END, 9, -1]])  # the state starts anew behind an end
    b = np.array([gru.END, gru.END])
    g, _, _ = gru.gradient(m, seq, np.zeros((2, gru.HIDDEN)), b)

    def loss():
        flat = np.concatenate([seq[0], seq[1][:4]])
        return -gru.log10_probability(m, flat, np.array([0, 4, 5, 8, 9])).sum() * np.log(10) / 9

    for key in ("u", "wc", "ww", "x"):
        for at in np.argsort(-np.abs(g[key]).ravel())[:3]:
            at = np.unravel_index(at, g[key].shape)
            keep, eps = m[key][at], 1e-3
            m[key][at] = keep + eps
            up = loss()
            m[key][at] = keep - eps
            down = loss()
            m[key][at] = keep
            assert abs((up - down) / (2 * eps) - g[key][at]) < 2e-3 + 0.03 * abs(g[key][at])


@pytest.fixture(scope="module")
def speech(spark):
    """A language of two kinds of clauses, a null, an empty, a very long and a repeated text."""
    rng = random.Random(9)
    clause = lambda: rng.choice([f"the {rng.choice('abc')}x runs .", f"a {rng.choice('def')}y sleeps and dreams ."])
    rows = [(i, " ".join(clause() for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "the ax runs ."), (302, " ".join(clause() for _ in range(6000))), (5, rows[5][1]), (5, "another text of the same id")]
    return spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")


def test_language_model_learns_and_does_not_depend_on_the_layout(spark, speech):
    want = None
    for parts, coalesce in ((1, "true"), (7, "false"), (50, "true"), (50, "false")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            got = sorted(map(tuple, language_model.score(speech.repartition(parts), shard=8000, warm=8000).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = want or got
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-5)
    held = [r for r in want if r[1] and r[2] > 20]
    assert held and sum(r[6] for r in held) > 0.75 * sum(r[5] for r in held)  # log probabilities: nearer to zero
    assert language_model.score(speech.limit(0)).count() == 0
    assert language_model.score(speech.filter("doc_id in (0, 1)").withColumn("doc_id", F.lit(1))).count() == 2


def test_language_model_learns_to_the_end_of_a_text():
    m, rng = small_network(2)
    text = np.append(rng.integers(0, 40, 5000), gru.END)
    other = text.copy()
    other[-3:-1] = (other[-3:-1] + 1) % 40
    a, b = (gru.flat(gru.train(m, [t], 8e-3, 5000)) for t in (text, other))
    assert not np.allclose(a, b, atol=1e-9)


@pytest.fixture
def real_license():
    holder = "The MIT License (MIT)\n\nCopyright (c) 2019 Jane Doe\n\n"
    return holder + license_texts.MIT


def scan(spark, rows):
    df = spark.createDataFrame([(p, i, t, "zz", 1) for p, i, t in rows], "path string, doc_id long, text string, license string, _k1 int")
    return sorted(((r.doc_id, r.license, r.how, r.from_dir) for r in licenses.license_scan(df, "doc_id", "text", F.col("path")).collect()), key=str)


def test_licenses(spark, real_license):
    wrapped = "/*\n * This library is free software: you can redistribute it and/or modify it\n * under the terms of the GNU Lesser General Public License as published by the\n * Free Software Foundation, either version 3 of the License, or (at your\n * option) any later version.\n */\n" + "int f();\n" * 50
    rows = [
        ("p/LICENSE", 1, "Licensed under the Apache License, Version 2.0."), ("p/q/a.txt", 2, "nothing to see"), ("p/q/r/b.txt", 3, "x y z. " * 30 + "\nReleased under the MIT License.\nmore"),
        ("p/q/COPYING.md", 4, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + license_texts.GPL_PREAMBLE + " and so on for many pages. " * 300), ("other/c.txt", 5, None), ("d.txt", 6, ""), (None, 7, "plain"), ("p/q/a.txt", 2, "nothing to see"),
        ("src/stub.c", 8, "// Licensed under the Apache License, Version 2.0"), ("src/main.c", 9, "int main();"), ("src/wrapped.c", 10, wrapped), ("m/terms.txt", 11, real_license), ("m/n/o/x.c", 12, "int x;"), ("p/x/y/z.c", 13, ""), (None, None, None),
    ]
    want = [
        (1, "Apache-2.0", "file", None), (2, "GPL-3.0", "inherited", "p/q"), (2, "GPL-3.0", "inherited", "p/q"), (3, "MIT", "header", None), (4, "GPL-3.0", "file", None), (5, None, None, None), (6, None, None, None), (7, None, None, None),
        (8, "Apache-2.0", "header", None), (9, None, None, None), (10, "LGPL-3.0", "header", None), (11, "MIT", "file", None), (12, "MIT", "inherited", "m"), (13, "Apache-2.0", "inherited", "p"), (None, None, None, None),
    ]
    assert scan(spark, rows) == sorted(want, key=str)
    assert scan(spark, []) == []


def test_license_ties_and_copies(spark):
    rows = [("a/LICENSE", 1, "Released under the MIT License."), ("a/COPYING", 2, "Released under the BSD 3-Clause License."), ("a/x", 3, "x"), ("a/LICENSE", 1, "Released under the MIT License.")]
    assert scan(spark, rows) == [(1, "MIT", "file", None), (1, "MIT", "file", None), (2, "BSD-3-Clause", "file", None), (3, "MIT", "inherited", "a")]


@pytest.mark.parametrize("name,text", [(n, t) for n, k, t in license_texts.TEMPLATES if k == "text"])
def test_license_texts_are_found(spark, name, text):
    df = spark.createDataFrame([("l/any", 1, f"Copyright 2020 Somebody\n\n{text}"), ("l/z", 2, "z")], "path string, doc_id long, text string")
    assert {(r.license, r.how) for r in licenses.license_scan(df, "doc_id", "text", F.col("path")).collect()} == {(name, "file"), (name, "inherited")}


def test_licenses_native():
    import inspect

    source = inspect.getsource(licenses)
    assert not any(w in source for w in ("pandas", "mapInArrow", "mapInPandas", ".rdd", "udf("))
