"""Hard negatives against brute force, and the tree's bounds on clustered and tied vectors."""

import numpy as np
import pytest

from carrylens.llm import op11_hard_negatives as H
from carrylens.llm.op11_hard_negatives import Block, CoverTree, Space, hard_negatives, op11_cover_tree_negatives, prepared

SF = "/root/testdata/sf0.01"


def by_hand(rows, every=100):
    """rows: [(id, label, vector of ints)]"""
    rows = sorted(rows)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    width = max((len(r[2]) for r in rows), default=0)
    vectors = np.array([list(r[2]) + [0] * (width - len(r[2])) for r in rows], dtype=object)
    out = []
    for a in np.flatnonzero(ids % every == 0):
        scores = [int(x) for x in vectors @ vectors[a]]
        order = sorted(range(len(rows)), key=lambda k: (-scores[k], ids[k]))
        for p in [k for k in order if labels[k] == labels[a] and k != a][:5]:
            hard = [k for k in order if labels[k] != labels[a] and 80 * scores[p] <= 100 * scores[k] <= 100 * scores[p]][:5]
            out += [(int(ids[a]), int(ids[p]), rank, int(ids[k]), scores[p], scores[k]) for rank, k in enumerate(hard, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_query_is_brute_force_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = by_hand([(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, dtype=float)).astype(int).tolist()) for r in rows])
    assert got(op11_cover_tree_negatives(spark, SF)) == want
    assert len(want) > 50


def clustered(seed, n=300, hot=90):
    draw = np.random.default_rng(seed)
    centres = draw.integers(-300, 300, (6, 5))
    rows = [(int(i), int(draw.integers(0, 4)), (centres[draw.integers(0, 6)] + draw.integers(-9, 9, 5)).tolist()) for i in draw.choice(10_000, n, replace=False)]
    same = centres[0].tolist()
    return rows + [(20_000 + 10 * i, i % 2, same) for i in range(hot)] + [(30_000, 1, [0] * 5), (30_100, 2, [0, 0]), (30_200, 9, [-v for v in same])]


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_blocks_pivots_copies_and_zeros(spark, monkeypatch, block):
    """Tied scores, a vector that many rows share, null vectors' scores, salted blocks, portions of queries."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "PORTION", 10)
    rows = clustered(block)
    table = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>")
    assert got(hard_negatives(table, 10)) == by_hand(rows, 10)


@pytest.mark.parametrize("seed", range(4))
def test_descent_is_exact_and_prunes(seed):
    rows = clustered(seed, 600, 0)
    vectors = np.array([list(r[2]) + [0] * (5 - len(r[2])) for r in rows])
    labels, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    space = Space(5, int((vectors**2).sum(axis=1).max()))
    block = Block(space, labels, vectors, [[i] for i in ids.tolist()])
    for q in range(0, 600, 37):
        scores = vectors @ vectors[q]
        top = int(scores.max())
        for same in (True, False):
            windows = [(-H._FAR, H._FAR), (int(0.8 * top), top), (top // 3, top // 2), (5, 4)]
            found = block.search(space, vectors[q], int(labels[q]), same, windows, 6)
            for (lo, hi), best in zip(windows, found):
                fit = np.flatnonzero(((labels == labels[q]) == same) & (scores >= lo) & (scores <= hi))
                assert best == sorted((-int(scores[k]), int(ids[k])) for k in fit)[:6]


def test_radii_cover_and_members_are_whole():
    points = np.random.default_rng(5).normal(size=(400, 4)) * np.repeat([1, 20], 200)[:, None]
    tree = CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(400))
    for c, r, lo, hi, first, end in zip(tree.centre, tree.radius, tree.lo, tree.hi, tree.first, tree.end):
        assert np.linalg.norm(points[tree.order[lo:hi]] - points[c], axis=1).max() <= r + 1e-9
        if end > first:
            assert tree.lo[first] == lo and tree.hi[end - 1] == hi
            assert all(tree.radius[k] <= r / 2 + 1e-9 for k in range(first, end))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [0.25], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (None, [1.0, 0.5], 2), (3, None, 2), (4, [1.0, None], 2),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (8, [1.0, 0.5], None), (9, [1e30, 0.0], 2), (10, [], 2), (11, [1e6, 0.0], 3), (200, [-0.001, 0.3], 7)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, id string, distance int")
    have = prepared(table)
    ints = sorted((r.id, r.label, list(r.v)) for r in have.collect())
    assert [r[0] for r in ints] == [0, 1, 2, 10, 11, 100, 200] and ints[-1][2][0] == -1
    assert got(hard_negatives(have)) == by_hand(ints)


def test_wide_numbers_are_exact(spark):
    rows = [(i * 50, i % 3, [(1 << 26) + i * 7919, -(1 << 25) + i, i]) for i in range(40)]
    assert got(hard_negatives(spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>"))) == by_hand(rows)


def test_empty_table(spark):
    assert hard_negatives(prepared(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"))).collect() == []
