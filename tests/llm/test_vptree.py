"""Vantage-point trees against brute force."""

import numpy as np
import pytest

from quotecurve.llm import vptree

_SCHEMA = "vec_id long, embedding array<double>, label int, row long, query long, id string"


def _rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 6))
    rows = [(k, (centres[k % 9] * (1 + k % 3) + rng.normal(size=6) * 0.3).tolist()) for k in range(900)]
    rows += [(900 + k, rows[40][1]) for k in range(45)] + [(60, rows[40][1]), (None, rows[40][1]), (None, rows[3][1])]
    rows += [(980, None), (1000, []), (1020, [0.0] * 6), (1040, [float("nan")] * 6), (1060, [None] * 6), (1080, [float("inf")] + [1.0] * 5)]
    return rows + [(1100, [1.0, 2.0]), (1120, [2.0, 1.0]), (1121, [0.5, 0.5])]


def _plain(rows):
    used = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for at, (i, v) in enumerate(used):
        if i is None or i % 20:
            continue
        near = []
        for other, (j, w) in enumerate(used):
            if other != at and len(w) == len(v):
                score = 0.0
                for x, y in zip(v, w):
                    score += x * y
                near.append((-score, j is None, j or 0))
        for rank, (score, none, j) in enumerate(sorted(near)[:20], 1):
            want.append((i, rank, None if none else j, -score))
    return want


@pytest.mark.parametrize(("shard", "block"), [(16384, 8192), (130, 7)])
def test_factor_one_is_exact(spark, shard, block):
    rows = _rows()
    frame = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], _SCHEMA)
    got = [tuple(r) for r in vptree.nearest(frame, factor=1.0, shard=shard, block=block).collect()]
    assert sorted(got, key=str) == sorted(_plain(rows), key=str)
    assert vptree.nearest(frame.limit(0)).count() == 0


def _recall(tree, vectors, queries, factor):
    best, _, visited = tree.search(queries, 20, factor, np.arange(len(vectors)), np.full(len(queries), -1))
    truth = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    return np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, truth)]), visited


def test_the_factor_trades_recall_for_leaves():
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(60, 24)), 100, axis=0) + rng.normal(size=(6000, 24)) * 0.4
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    tree = vptree.Tree(vectors)
    queries = vectors[::50]
    seen = [_recall(tree, vectors, queries, f) for f in (1.0, vptree.FACTOR, 4.0)]
    assert seen[0][0] == 1 and seen[1][0] >= 0.99
    assert seen[0][1] > seen[1][1] > seen[2][1]
    assert seen[1][1] < 0.9 * len(queries) * (len(tree.starts) - 1)


def test_vectors_of_one_place():
    vectors = np.ones((3000, 4))
    tree = vptree.Tree(vectors)
    best, score, _ = tree.search(vectors[:5], 20, 1.0, np.arange(3000)[::-1].copy(), np.arange(5))
    assert (best == np.arange(2999, 2979, -1)).all() and (score == 4).all()
