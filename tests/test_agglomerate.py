"""Agglomeration in rounds equals the sequential version, and one block spreads over tasks."""

import numpy as np

from tessera.operators import agglomerate as ag
from tessera.operators import similarity as sim


def vectors(n=45, blocks=2):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 4))
    rows = [(i % blocks, i, (centre[i % 6] + rng.normal(size=4) * 0.6).tolist()) for i in range(n)]
    return rows + [(0, 500 + i, rows[2][2]) for i in range(5)] + [(1, 600, [0.0] * 4), (1, 601, [0.0] * 4), (9, 700, [1.0, 0.0, 0.0, 0.0])]


def test_rounds_equal_the_sequential_merges(spark):
    df = spark.createDataFrame(vectors(), "k long, i long, v array<double>").repartition(4)
    want = {(r.k, r.i): r.cluster for r in sim.average_link(df, "k", "i", "v", 0.75).collect()}
    # Blocks of seven rows meet each other in tasks of their own.
    got = {(r.k, r.i): r.cluster for r in ag.average_link_rounds(df, "k", "i", "v", 0.75, rows=7).collect()}
    assert got == want and len(set(want.values())) > 4
    # Only the two large blocks go through rounds here.
    assert {(r.k, r.i): r.cluster for r in sim.average_link(df, "k", "i", "v", 0.75, most=3).collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, i long, v array<double>")
    assert ag.average_link_rounds(df, "k", "i", "v", 0.5).count() == 0 and sim.average_link(df, "k", "i", "v", 0.5).count() == 0


def plain(v, threshold):
    """One pair after the other over all mean cosines of members."""
    u = v / np.where(np.linalg.norm(v, axis=1) == 0, 1, np.linalg.norm(v, axis=1))[:, None]
    sim = u @ u.T
    groups = [[i] for i in range(len(v))]
    while True:
        s = [(-round(sim[np.ix_(a, b)].mean(), 12), a[0], b[0], x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        if not s or -min(s)[0] < threshold:
            return {i: g[0] for g in groups for i in g}
        _, _, _, x, y = min(s)
        groups[x] = sorted(groups[x] + groups.pop(y))


def test_a_block_in_memory_equals_the_plain_merges():
    rng = np.random.default_rng(11)
    for threshold in (0.2, 0.5, 0.9):
        centre = rng.normal(size=(5, 6))
        v = np.concatenate([centre[rng.integers(0, 5, 60)] + rng.normal(size=(60, 6)) * 0.5, np.repeat(centre[:1], 8, axis=0), np.zeros((2, 6))])
        ids = rng.permutation(len(v)) * 3
        order, at = ag.average_link_block(ids, v, threshold, step=100)
        assert (ids[order] == np.sort(ids)).all() and dict(enumerate(at)) == plain(v[order], threshold)


def test_large_blocks_need_no_rounds(spark):
    # A block of 6000: one job and one task's work, where rounds sent a dozen jobs each to the driver.
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(700, 64))
    df = spark.createDataFrame([(0, i, (centre[i % 700] + 0.1 * rng.normal(size=64)).tolist()) for i in range(6000)], "k long, i long, v array<double>").cache()
    df.count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("average-link", "")
    try:
        got = {r.i: r.cluster for r in sim.average_link(df, "k", "i", "v", 0.8).collect()}
        assert len(tracker.getJobIdsForGroup("average-link")) < 12
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        df.unpersist()
    assert got == {i: i % 700 for i in range(6000)}
