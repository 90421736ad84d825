"""Whitening against a dense eigensolver, and its results for odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize(("d", "seed"), [(64, 1), (200, 2), (5, 3), (40, 4)])
def test_lobpcg_finds_leading_eigenvectors(d, seed):
    a = np.random.default_rng(seed).normal(size=(3000, d))
    if d == 200:
        a *= np.linspace(1, 1.5, d)
    if d == 40:
        a[:, 5:] = np.tile(a[:, :5], 7)  # rank 5
    v, calls = a.T @ a / len(a), []
    values, vectors = whitening.lobpcg(lambda b: calls.append(b.shape[1]) or v @ b, d, min(16, d))
    want = np.linalg.eigh(v)[0][::-1][: len(values)]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 2e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert max(calls) <= 24  # never more columns than a block has


def test_lobpcg_does_not_return_uncertified():
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: np.diag(np.arange(300.0)) @ b, 300, 16, most=3)


def rows():
    rng = np.random.default_rng(8)
    m = (rng.normal(size=(400, 24)) * np.linspace(1, 3, 24)).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[7].tolist()) for i in range(200)] + [(None, m[8].tolist()), (3, m[3].tolist())]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 23), (2003, [math.nan] + [0.0] * 23), (2004, [math.inf] + [0.0] * 23), (2005, [None] + [0.0] * 23), (2006, [1e30] + [0.0] * 23)]
    return good, odd


def test_equals_a_dense_solver(spark):
    good, odd = rows()
    df = spark.createDataFrame(good + odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "key", "vector", "d", "component", "n", "cell")})
    out = whitening.whiten(df)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    x = np.floor(64 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    z = ((x * n - sums) / n) @ vectors / np.sqrt(values)
    sign = np.zeros(16)
    for (i, _), row, ints in zip(good, z, x):
        deviation = sum((n * int(c) - int(s)) ** 2 for c, s in zip(ints, sums))
        for r in by[i]:
            k = r.component - 1
            sign[k] = sign[k] or np.sign(r.whitened * row[k])
            assert r.deviation == deviation and math.isclose(r.explained, values[k] / np.trace(centred.T @ centred / n), rel_tol=1e-9)
            assert abs(r.whitened - sign[k] * row[k]) < 1e-7 and r.identity_error < 1e-9


def test_tables_without_directions(spark):
    for some in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(some, SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and all(math.isclose(r.explained, 1) for r in line)


def test_deviations_beyond_64_bits():
    x = np.array([[2**44, 0], [5, 7]], np.int64)
    n, sums = 10**6, np.array([10**6, 3 * 10**6])
    assert whitening.deviations(x, n, sums) == [None, (n * 5 - 10**6) ** 2 + (n * 7 - 3 * 10**6) ** 2]
