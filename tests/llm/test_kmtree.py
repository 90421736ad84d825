"""Nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import kmtree

SCHEMA = "vec_id long, embedding array<float>"
ASKS = "pmod(vec_id, 20) = 0"


def brute(rows, k=20):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in zip(ids.tolist(), m):
        if i % 20 == 0:
            s = m @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i]
            out[i] = [(int(ids[j]), float(s[j])) for j in order[:k]]
    return out


def found(df, **how):
    out = {}
    for r in sorted(kmtree.search(df, F.expr(ASKS), **how).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def vectors(n, d=16, seed=1):
    """Clusters of vectors of different lengths, many copies of one, and some others twice."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    m = (centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, d))) * rng.uniform(0.5, 2, (n, 1))
    m[: n // 3] = m[0]
    m[n // 2 : n // 2 + 20] = m[n // 2 + 20 : n // 2 + 40]
    return [(i, v.tolist()) for i, v in enumerate(m.astype(np.float32))]


def test_recall_and_ties(spark):
    rows = vectors(6000)
    want, got = brute(rows), found(spark.createDataFrame(rows, SCHEMA), leaf_rows=64, branch=6, shard_cells=16 * 300)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.93 * 20 * len(want)
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        true = dict((i, float(np.dot(np.array(rows[i][1]), np.array(rows[q][1])))) for i, _ in hits)
        assert all(math.isclose(s, true[i], rel_tol=1e-12, abs_tol=1e-12) for i, s in hits)
    assert got[0] == [(i, got[0][0][1]) for i in range(1, 21)] or got[0][0][1] > got[0][-1][1]


def test_all_leaves_give_brute_force(spark):
    rows = vectors(900)
    got, want = found(spark.createDataFrame(rows, SCHEMA), leaf_rows=32, branch=4, target=1.0, shard_cells=16 * 100), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    good = [(i, [float(i % 3), 1.0]) for i in range(0, 50, 5)]
    odd = [(100, None), (101, []), (120, [0.0, 0.0]), (140, [math.nan, 1.0]), (160, [math.inf, 1.0]), (180, [None, 1.0]), (200, [1.0]), (None, [1.0, 1.0]), good[0], good[1]]
    df = spark.createDataFrame(good + odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "a", "b", "ids", "leaf", "hits", "shard", "asks")})
    got, want = found(df), brute(good)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(len(v) == 9 for v in got.values())


def test_tables_without_answers(spark):
    for rows in ([], [(20, None)], [(20, [1.0])], [(1, [1.0]), (2, [2.0])]):
        assert found(spark.createDataFrame(rows, SCHEMA)) == {}


def test_best_bin_first_visits_each_leaf_once():
    points = np.random.default_rng(2).normal(size=(500, 4))
    tree = kmtree.Tree(points, 4, 10, 5, 1)
    order = tree.visit(points[3], tree.n_leaves)
    assert sorted(order) == list(range(tree.n_leaves)) and order[0] == tree.assign(points[3:4])[0]
    assert order[:5] == tree.visit(points[3], 5)
