import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm.alignment import Chunks, Pair, align, default_paths


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = default_paths()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


def brute(rows, models):
    """Whole texts, token by token."""
    a, b = models
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    docs, count = [], collections.Counter()
    for _, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb = [bytes(char[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                ends = set(np.cumsum([len(z) for z in yb]).tolist()) & set(np.cumsum([len(z) for z in xb]).tolist())
                at, group = 0, 0
                side = []
                for ids, raw in ((x, xb), (y, yb)):
                    at, group, parts = 0, [], []
                    for i, z in zip(ids, raw):
                        at += len(z)
                        group.append(i)
                        if at in ends:
                            parts.append(group)
                            group = []
                    side.append(parts)
                groups = list(zip(*side))
        docs.append(groups)
        count.update({(i, j) for x, y in groups for i in x for j in y})
    best = collections.Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (i, _), groups in zip(rows, docs):
        links = [(p, q) for x, y in groups for p in x for q in y]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    bits = ["the", "naïve", "日本語", "don't", "x1y22", " ", "　", " ", "\n", "\t", "\r\n", " ", "  ", "   ", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "<unk>", "🙂🙂", "É", "—", "”", "£", "\x1d", "\x7f", "\x85", "a" * 30, "0" * 9, "\0"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n", "  "]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "  "), (204, "a literal ▁ sign"), (205, "word "), (206, " word"), (207, "word  "), (208, "the cat the cat the"), (209, "🙂" * 40), (209, "the cat"), (209, "the cat"), (None, "the naïve cat"), (210, "é" * 300)]
    return rows


def rows_of(df):
    return sorted([(r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize(("run", "row", "share", "stripes"), [(4 << 20, 512, 256, 256), (300, 3, 2, 7)])
def test_matches_whole_texts_token_by_token(spark, models, run, row, share, stripes):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as stripe", "3 as n_a").repartition(3)
    assert rows_of(align(df, stripes=stripes, run=run, row=row, share=share)) == brute(rows, models)


def test_real_texts(spark, sf, models):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert rows_of(align(df)) == brute(rows, models)


def test_forgetting_chunks_changes_nothing(spark, models):
    rows = corpus()
    small = Pair(*default_paths(), most=5)
    for t in (t or "" for _, t in rows):
        raw = np.frombuffer(t.encode(), np.uint8)
        c = Chunks(raw, np.array([0, len(raw)]))
        ids = small.chunk_ids(c, raw)
        sums = small.sums[ids].sum(axis=0)
        if t and not sums[4]:
            assert sums[0] == len(models[0].encode(" " + t, add_special_tokens=False).ids) and sums[1] == len(models[1].encode(t))


def test_long_text_other_ids_and_empty_table(spark, models):
    rows = [("x", "the quick brown fox " * 20_000), (None, "the quick")]
    df = spark.createDataFrame(rows, "n_a string, text string")
    out = align(df, id_col="n_a")
    assert out.columns[:2] == ["n_a", "_n_a"] and sorted(((r.n_a, r._n_groups > 0) for r in out.collect()), key=str) == [("x", True), (None, True)]
    assert align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
