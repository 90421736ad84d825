"""Embedding whitening: leading eigenvectors of the covariance by LOBPCG, whose products with the covariance are Spark jobs over centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.base import prepare, scratch

#: Entries are quantised: x = floor(64 * c) + 1,000,000.
STEPS, SHIFT = 64, 1_000_000
#: Larger entries have no exact deviation in 64 bits.
_MOST = float(2**45)
FOUND = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitener:
    """n distinct rows with sums per dimension; eigenvectors as columns, their eigenvalues, the trace, and how white the fit list gets."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def quantised(df: DataFrame, vector: str) -> DataFrame:
    """df with a column `x` (array<bigint>) in place of the vector, without rows that take no part."""
    usable = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(STEPS * c.cast("double")) < _MOST, F.lit(False)))
    x = F.transform(F.col(vector), lambda c: F.floor(STEPS * c.cast("double")) + SHIFT)
    return df.where(F.col(vector).isNotNull() & usable).withColumn("x", x)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: as 64-bit integers around each dimension's own mean, or as Python's where those may not hold it."""
    base = sums // n
    x, rest = x - base, sums - n * base
    if not x.size or n * (int(np.abs(x).max()) + 1) < 2**62:
        return n * x - rest
    return n * x.astype(object) - rest.astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (scaled(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares of n * x - sums; None where 64 bits don't hold one."""
    y = scaled(x, n, sums)
    if y.dtype == object or (y.size and int(np.abs(y).max()) ** 2 * y.shape[1] >= 2**63):
        return [v if v < 2**63 else None for v in (sum(int(c) ** 2 for c in row) for row in y)]
    return (y * y).sum(1).tolist()


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum over all rows of part(x), an array of fixed length: added up inside each task, then by cell."""
    made, ddl = (pa.int64(), "long") if kind is int else (pa.float64(), "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                new = part(_matrix(b.column(0)))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, made)], ["cell", "v"])

    found = rows.mapInArrow(run, f"cell int, v {ddl}").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    return np.array([r.v for r in found], np.int64 if kind is int else np.float64)


def _orthonormal(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Directions of w outside the span of x, without those that are only rounding."""
    u, s, _ = np.linalg.svd(w - x @ (x.T @ w), full_matrices=False)
    return u[:, s > 1e-12 * s[:1].max(initial=0)]


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], d: int, count: int, tolerance: float = 1e-12, most: int = 500, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors (columns).

    multiply(block) is the matrix times a block of columns, the only way the matrix is met: once a step, for the residuals. Each step
    takes Ritz vectors from the span of the iterates, their residuals and the previous directions. Half as many guard columns
    (8 at least) hold the eigenvalues that come next. It ends when the residuals, from a fresh product of the iterates themselves,
    are under `tolerance` times the largest eigenvalue; if that never comes, it raises.
    """
    width = min(d, count + max(8, count // 2))
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    vx, fresh = multiply(x), True
    p = vp = np.zeros((d, 0))
    for _ in range(most):
        values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        r = vx - x * values
        size = np.linalg.norm(r, axis=0)
        if size[:count].max() <= tolerance * max(values[0], 0):
            if fresh:
                return values[:count], x[:, :count]
            x = np.linalg.qr(x)[0]
            vx, fresh, p, vp = multiply(x), True, np.zeros((d, 0)), np.zeros((d, 0))
            continue
        w = _orthonormal(_orthonormal(r, x), x)[:, : d - width]
        if not w.shape[1]:
            raise ArithmeticError("residuals that no direction lowers")
        vw = multiply(w)
        if p.shape[1]:
            back = np.hstack([x, w])
            along = back.T @ p
            p, vp = p - back @ along, vp - np.hstack([vx, vw]) @ along
            _, s, v = np.linalg.svd(p, full_matrices=False)
            keep = s > 1e-7 * max(s[0], 1e-300)
            turn = v[keep].T / s[keep]
            p, vp = p @ turn, vp @ turn
        basis, images = np.hstack([x, w, p]), np.hstack([vx, vw, vp])
        _, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        turn = turn[:, ::-1][:, :width]
        moved = turn.copy()
        moved[:width] = 0
        x, vx, p, vp, fresh = basis @ turn, images @ turn, basis @ moved, images @ moved, False
        x, fix = np.linalg.qr(x)
        vx = np.linalg.solve(fix.T, vx.T).T
    raise ArithmeticError(f"residuals of {size[:count].max() / values[0]:.1e} after {most} steps")


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16, least: float = 1e-11) -> tuple[DataFrame, Whitener | None]:
    """The usable rows of `vectors` with their quantised `x`, and the whitener of the distinct x (None where no row is usable).

    Directions whose eigenvalue is under `least` times the largest have no whitened value and are left out. The distinct rows are
    written once; each product with the covariance reads them and brings one number for each cell of a block to the driver.
    """
    prepare(vectors.sparkSession)
    rows = quantised(vectors, vector)
    size = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return rows.where("false"), None
    d, rows = size.d, rows.where(F.size("x") == size.d)
    distinct = scratch(rows.select("x").distinct())
    found = _summed(distinct, lambda x: np.append(x.sum(0), len(x)), int)
    n, sums = int(found[-1]), found[:-1]
    trace = float(_summed(distinct, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), float)[0]) / n
    if not trace:
        return rows, Whitener(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return (y.T @ (y @ block)).ravel()

        return _summed(distinct, part, float).reshape(block.shape) / n

    values, vectors_ = lobpcg(multiply, d, min(components, d))
    real = values > least * values[0]
    values, vectors_ = values[real], vectors_[:, real]
    k = len(values)

    def second(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ vectors_ / np.sqrt(values)
        return np.append((z.T @ z).ravel(), z.sum(0))

    moments = _summed(distinct, second, float) / n
    error = np.abs(moments[: k * k].reshape(k, k) - np.outer(moments[k * k :], moments[k * k :]) - np.eye(k)).max()
    return rows, Whitener(n, sums, vectors_, values, trace, float(error))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Rows whose vector is null, empty, or holds nulls, NaN, infinities or entries of 2^45 / 64 and more are dropped, and those whose
    length is not the commonest (the larger of two as common). Equal vectors count once in the fit and each have rows in the result, as
    have repeated rows and null keys. A deviation over 64 bits is null. Components without variance are left out, so a table with one distinct
    vector, or none, gives no rows. Other columns aren't read. Ties of eigenvalues are ordered as the solver finds them.
    """
    rows, w = fit(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", components)
    kind = vectors.schema[key].dataType.simpleString()
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, {FOUND}")
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, m = _matrix(b.column(1)), b.num_rows
            z = centred(x, w.n, w.sums) @ w.vectors / np.sqrt(w.values)
            at = pa.array(np.repeat(np.arange(m), k))
            arrays = [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(deviations(x, w.n, w.sums), pa.int64()).take(at)]
            arrays += [pa.array(z.ravel()), pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error))]
            yield pa.RecordBatch.from_arrays(arrays, [key, *(c.split(" ")[0] for c in FOUND.split(", "))])

    return rows.select("key", "x").mapInArrow(run, f"`{key}` {kind}, {FOUND}")
