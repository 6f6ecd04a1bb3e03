"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooklog.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, shard int, kind string, v string, lows int, near string, window int, score int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "?", "?", 2, "?", 3, 4, 5) for r in rows], SCHEMA)


def plain(rows, anchors, positives=5, negatives=3):
    """The contract, pair by pair; of rows with one id the smallest label, then vector."""
    usable = {}
    for k, v, label in rows:
        if k is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        usable[k] = min(usable.get(k, row), row)
    out = []
    for a in sorted(anchors & set(usable)):
        label, v = usable[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), k, other) for k, (other, w) in usable.items() if k != a and len(w) == len(v))
        for p_score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, k) for s, k, other in scored if other != label and 50 * -p_score <= 100 * -s <= 95 * -p_score]
            out += [(a, p, i, k, -p_score, -s) for i, (s, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def found(spark, rows, anchors, **options):
    vectors = frame(spark, rows)
    got = hn.mine(vectors, vectors.filter(F.col("vec_id").isin(sorted(anchors))), **options)
    return sorted(tuple(r) for r in got.collect())


def clusters(n, dims, seed, labels=4):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(labels, dims))
    label = pick.integers(0, labels, n)
    v = centres[label] + 0.7 * pick.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, v[i].tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rows = clusters(1500, 8, seed)
    anchors = set(range(0, 1500, 50))
    assert found(spark, rows, anchors) == plain(rows, anchors)
    assert plain(rows, anchors)


def test_odd_rows(spark):
    """Nulls, non-finite numbers, unequal lengths, zero and empty vectors, repeated ids, ties, very large numbers."""
    pick = random.Random(3)
    rows = [(i, [pick.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], pick.randint(0, 2)) for i in range(300)]
    rows += [(400, None, 1), (401, [1.0, None, 0.0], 1), (402, [1.0, math.nan, 0.0], 1), (403, [math.inf, 0.0, 0.0], 0), (404, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 1.0], 1), (408, [1.5, 1.0], 0), (409, [0.0, 0.0, 0.0], 2)]
    rows += [(5, [1.0, 1.0, 1.0], 0), (5, [1.0, 1.0, 1.0], 0), (410, [3e6, 2e6, 1.0], 1), (411, [3e6, 1e6, 1.0], 1), (412, [2e6, 2e6, 2.0], 0)]
    anchors = {0, 5, 50, 100, 401, 405, 406, 407, 409, 410, 411}
    got = found(spark, rows, anchors)
    assert got == plain(rows, anchors) and {406, 410} <= {r[0] for r in got}
    assert found(spark, [], set()) == [] and found(spark, rows, {999}) == []


def test_one_vector_holds_most_rows(spark):
    """Copies tie by their ids, and are kept apart by label."""
    rows = [(i, [0.5, 0.5], i % 3) for i in range(900)] + [(1000 + i, [0.5 + i / 1000, 0.25], i % 2) for i in range(100)]
    anchors = {0, 1, 450, 1000, 1003}
    assert found(spark, rows, anchors) == plain(rows, anchors)
    assert found(spark, rows, anchors, positives=2, negatives=7) == plain(rows, anchors, 2, 7)


def test_beyond_64_bits(spark):
    """Scores stop at the bounds of a long; nothing fails."""
    rows = [(i, [3e18 * (i + 1), 1.0], 0) for i in range(4)] + [(10, [1.0, 0.5], 1), (11, [-1.0, 0.5], 1), (12, [2e8, 0.0], 1)]
    vectors = frame(spark, rows)
    near = hn.mine(vectors, vectors.filter("vec_id = 0"), highest=100).collect()
    assert {r.positive_id for r in near} == {1, 2, 3} and {r.positive_score for r in near} == {2**63 - 1}
    assert {r.negative_id for r in near} == {10, 12}


@pytest.mark.parametrize("dims", [1, 2, 16])
def test_tree_covers_all_points(dims):
    pick = np.random.default_rng(dims)
    v = pick.integers(-100, 100, (3000, dims))
    tree = hn.CoverTree(v, np.zeros(3000, np.int64), np.arange(3000), 3000)
    leaves = np.flatnonzero(tree.leaf_to > tree.leaf_at)
    assert sorted(tree.order.tolist()) == list(range(len(tree.x))) and sorted(tree.ids.tolist()) == list(range(3000))

    def points(node):
        if node in leaves:
            return tree.order[tree.leaf_at[node] : tree.leaf_to[node]]
        return np.concatenate([points(c) for c in range(tree.child_at[node], tree.child_to[node])])

    for node in range(0, len(tree.centre), 7):
        assert tree._away(points(node), tree.centre[node]).max() <= tree.radius[node] + 1e-9


def test_descent_skips_nodes():
    """With clusters far apart, an anchor verifies few of the leaves."""
    pick = np.random.default_rng(5)
    centres = 1000 * pick.normal(size=(40, 6))
    v = np.floor(centres[np.arange(4000) % 40] + pick.normal(size=(4000, 6))).astype(np.int64)
    tree = hn.CoverTree(v, np.arange(4000) % 40, np.arange(4000), 6)
    seen = []

    class Counting(hn.Descent):
        def _verify(self, q, leaves):
            seen.append(len(leaves))
            super()._verify(q, leaves)

    queries = v[:40]
    down = Counting(tree, queries, np.arange(40), np.arange(40), np.full(40, hn.NO_LOW), np.full(40, hn.NO_HIGH), 5, True)
    leaves = int((tree.leaf_to > tree.leaf_at).sum())
    assert sum(seen) < 0.3 * 40 * leaves
    exact = queries @ v.T
    for i in range(40):
        mine = sorted((-exact[i, j], j) for j in range(i % 40, 4000, 40) if j != i)[:5]
        assert [(-s, k) for s, k in zip(down.found[1][down.found[0] == i], down.found[2][down.found[0] == i])] == mine or len(mine) < 5
