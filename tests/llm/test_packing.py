import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, tokens

TEXTS = ["don't WE'LL I'D 'S x's it's.", "a <|startoftext|>B <|ENDOFTEXT|> c", "Ça é  x y €, 5,6 ÀÉ's İI ΑΣ ΑΣ,b", None, "", "a̸b ,́ a,́ b", "12ab_c--d!!! ### a|b", "word " * 3000]


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_path())
    got = [ids.tolist() for _, ids in tokens.encode_column(pa.array(TEXTS, pa.string()), tokens.default_path())]
    assert got == [model.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def solve(sizes, capacity, effort=packing.EFFORT):
    """(sequence, offset) of each size."""
    sizes = np.asarray(sizes)
    order = np.argsort(sizes, kind="stable")
    number = np.empty(len(sizes), np.int64)
    number[order] = np.arange(len(sizes)) - np.searchsorted(sizes[order], sizes[order])
    return packing.place(packing.slots(packing.complete(np.bincount(sizes, minlength=capacity + 1), capacity, effort)), sizes, number)


def fits(seq, off, length, capacity):
    for s in set(seq):
        own = sorted((o, n) for q, o, n in zip(seq, off, length) if q == s)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_instances_are_optimal(sizes):
    seq, off = solve(sizes, 20)
    fits(seq.tolist(), off.tolist(), sizes, 20)

    def possible(k):
        def go(i, room):
            return i == len(order) or any(go(i + 1, room[:b] + [room[b] - order[i]] + room[b + 1 :]) for b in range(k) if room[b] >= order[i])

        order = sorted(sizes, reverse=True)
        return go(0, [20] * k)

    assert len(set(seq.tolist())) == next(k for k in itertools.count(1) if possible(k))


def test_dominance():
    assert packing.dominates((10, 5), (6, 4, 5)) and not packing.dominates((6, 4, 5), (10, 5))


def test_pieces_and_pack(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1)], "doc_id long, text string, piece int")
    rows = packing.pack(packing.pieces(df)).collect()
    ids = {i: np.append(x, np.uint32(0)).astype("<u4") for i, x in tokens.encode_column(pa.array(TEXTS, pa.string()), tokens.default_path())}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.start == r.piece * 2048
    fits([r.sequence_id for r in rows], [r.offset for r in rows], [r.length for r in rows], 2048)
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[0])
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_bound_is_reached_on_many(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(1, 2049, n)
    seq, off = solve(sizes, 2048)
    fits(seq.tolist(), off.tolist(), sizes.tolist(), 2048)
    assert len(set(seq.tolist())) <= sum(k for _, k in packing.best_fit_decreasing(np.bincount(sizes, minlength=2049), 2048))


def test_bin_completion_beats_best_fit():
    sizes = [9, 8, 7, 6, 5, 3, 2]  # 40
    seq, off = solve(sizes, 20)
    fits(seq.tolist(), off.tolist(), sizes, 20)
    assert len(set(seq.tolist())) == 2
    hard = np.bincount([7, 7, 5, 5, 4, 4, 4, 4], minlength=21)
    assert sum(n for _, n in packing.best_fit_decreasing(hard, 20)) == 3
    assert sum(n for _, n in packing.complete(hard, 20)) == 2


def test_many_tiny_pieces_do_not_recurse():
    seq, off = solve([1] * 5000 + [2047] * 3, 2048)
    fits(seq.tolist(), off.tolist(), [1] * 5000 + [2047] * 3, 2048)


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_partitions_and_slices_change_nothing(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(n), "x", 1) for i, n in enumerate(rng.integers(1, 700, 900))] + [(5, 2048, "y", 2)] * 300
    df = spark.createDataFrame(rows, "doc_id long, length long, _d string, sequence_id int").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in (100, 1_000_000):
            got = packing.pack(df, slice_rows=size).collect()
            fits([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got], 2048)
            assert sorted((r.doc_id, r.length, r._d) for r in got) == sorted(r[:3] for r in rows)
            assert len({r.sequence_id for r in got}) == -(-sum(r[1] for r in rows) // 2048)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
