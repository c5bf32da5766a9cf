"""Operator 12 against brute force in Python's integers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velora.llm import ball_tree
from velora.llm.ball_tree import BallTree, hard_negatives

LEAST, MOST = -(1 << 63), (1 << 63) - 1
SHAPE = "vec_id long, label int, embedding array<double>, score double, `rank` string, `key` int"


def table(spark, rows):
    """With extra columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SHAPE)


def by_force(rows, anchor, positives=5, negatives=10, low=30, high=90):
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v)
    rows = sorted({(i, c, tuple(int(np.floor(256 * x)) for x in v), tuple(v)) for i, c, v in rows if i is not None and c is not None and fine(v)})
    out = []
    for i, label, v, _ in rows:
        if not anchor(i):
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), LEAST), MOST), j, c) for j, c, w, _ in rows if j != i and len(w) == len(v)]
        for s, j, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            fit = sorted(r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s)[:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def found(df, anchor, **how):
    return sorted(tuple(r) for r in hard_negatives(df, anchor, F.col("label"), **how).collect())


def made(seed, n=400, scale=1.0, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 2
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in (centres[rng.integers(8)] + rng.normal(size=dim) * 0.4) * scale]) for i in rng.permutation(n)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(60)]  # ties
    return rows


EDGES = [(20, 1, None), (30, None, [1.0] * 6), (40, 1, []), (50, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (60, 2, [float("nan")] * 6), (70, 2, [float("inf")] * 6), (None, 1, [1.0] * 6), (80, 1, [0.5, 0.5]), (90, 1, [0.5, 0.25]), (100, 3, [0.5, 0.5]), (110, 1, [0.0] * 6), (120, 1, [-1.0] * 6)]


@pytest.mark.parametrize(("shard", "block", "leaf"), [(2 << 20, 1 << 20, 64), (2000, 500, 4), (200, 100, 1)])
def test_hard_negatives_by_force(spark, monkeypatch, shard, block, leaf):
    for name, value in (("SHARD_BYTES", shard), ("BLOCK_BYTES", block), ("LEAF", leaf)):
        monkeypatch.setattr(ball_tree, name, value)
    rows = made(1, 150 if leaf == 1 else 400) + EDGES
    want = by_force(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and {r[2] for r in want} == set(range(1, 11))
    assert found(table(spark, rows), F.col("vec_id") % 10 == 0) == want


def test_hard_negatives_with_repeated_ids(spark):
    """Rows alike count once; different rows of an id are rows of their own, and none of them serves its own id."""
    rng = random.Random(2)
    base = made(2, 60)
    rows = base + base[:30] + [(i, rng.randrange(4), [x + rng.gauss(0, 0.1) for x in v]) for i, _, v in base[:40]] + [(0, 1, base[0][2])] * 12
    assert found(table(spark, rows), F.col("vec_id") % 5 == 0, positives=3) == by_force(rows, lambda i: i % 5 == 0, positives=3)


def test_hard_negatives_of_huge_numbers(spark):
    """Beyond what doubles hold exactly, and beyond 64 bits."""
    for scale in (1e6, 1e15):
        rows = made(3, 40, scale)[:60] + made(4, 20)[:20]
        assert found(table(spark, rows), F.col("vec_id") % 10 == 0) == by_force(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_few(spark):
    assert found(table(spark, []).limit(0), F.col("vec_id") % 10 == 0) == []
    assert found(table(spark, EDGES), F.col("vec_id") % 10 == 0) == by_force(EDGES, lambda i: i % 10 == 0)
    rows = made(5, 30)
    assert found(table(spark, rows), F.lit(None).cast("boolean")) == []
    assert found(table(spark, rows), F.col("vec_id") % 3 == 0, positives=2, negatives=4, low=-50, high=100) == by_force(rows, lambda i: i % 3 == 0, 2, 4, -50, 100)


def test_balls_hold_their_rows(monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", 3)
    x = np.floor(np.random.default_rng(6).normal(size=(200, 5)) * 256)
    x[50:90] = x[50]
    tree = BallTree(x, np.arange(200), np.arange(200) % 7)
    assert sorted(tree.ids) == list(range(200)) and (tree.x == x[tree.ids]).all() and (tree.labels == tree.ids % 7).all()
    leaves = [(n[0], n[1]) for n in tree.nodes if n[2] < 0]
    assert sorted(i for lo, hi in leaves for i in range(lo, hi)) == list(range(200)) and max(hi - lo for lo, hi in leaves) <= 3
    q = np.random.default_rng(7).normal(size=5)
    for (lo, hi, left, right, least, most), c, r in zip(tree.nodes, tree.centre, tree.radius):
        s = tree.x[lo:hi] @ q
        assert (s <= q @ c + np.linalg.norm(q) * r + 1e-6).all() and (s >= q @ c - np.linalg.norm(q) * r - 1e-6).all()
        assert (tree.labels[lo:hi].min(), tree.labels[lo:hi].max()) == (least, most)
        if left >= 0:
            assert (tree.nodes[left][0], tree.nodes[left][1], tree.nodes[right][0], tree.nodes[right][1]) == (lo, tree.nodes[left][1], tree.nodes[left][1], hi)


def test_search_leaves_balls_out():
    """Of clustered rows a query looks at few."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 5
    x = np.floor((centres[np.arange(4000) % 40] + rng.normal(size=(4000, 8)) * 0.05) * 256)
    seen = []

    class Watched(ball_tree.Search):
        def _leaf(self, tree, lo, hi, alive):
            seen.append((hi - lo) * len(alive))
            super()._leaf(tree, lo, hi, alive)

    search = Watched(x[:40], np.arange(40), np.arange(40) % 2, [LEAST] * 40, [MOST] * 40, 5, True)
    search.add(x, np.arange(4000), np.arange(4000) % 2)
    assert sum(seen) < 0.3 * 40 * 4000
    exact = x[:40] @ x.T
    for i in range(40):
        best = sorted((-exact[i, j], j) for j in range(4000) if j != i and j % 2 == i % 2)[:5]
        assert [(-s, j) for s, j in zip(search.score[i], search.found[i])] == best
