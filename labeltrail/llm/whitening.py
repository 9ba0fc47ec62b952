"""Embedding whitening: exact moments from the executors, pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors become whole numbers x = floor(scale * c) + shift first.  Sums and centred products of whole numbers are added exactly, so
the model does not depend on how the rows are dealt out.  The driver holds the scatter, d x d for vectors of d entries, and
never a row of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of 2**40 and more count as non-finite: their products would leave the range of exact sums.
LARGEST = float(2**40)
#: Rows taken at once in a task.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n vectors of `sums` per dimension; `components` (columns) and `eigenvalues` of their covariance, of trace `trace`."""

    n: int
    sums: np.ndarray  # Python integers
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float
    shift: int

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L @ L.T, L lower trapezoidal; as many columns as the rank of a.

    The largest remaining diagonal entry is the pivot of each step.  A column ends the factor when its pivot is not above the
    rounding error of the first.
    """
    d = len(a)
    a, order, factor = a.astype(np.float64).copy(), np.arange(d), np.zeros((d, d))
    first = max(float(a.diagonal().max()), 0.0) if d else 0.0
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= d * np.finfo(float).eps * first:
            return factor[:, :k], order
        if p != k:
            for m in (a, factor):
                m[[k, p]] = m[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            order[[k, p]] = order[[p, k]]
        factor[k, k] = math.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms, columns): the factor's columns rotated in pairs until all are orthogonal, by falling norm; columns normalised.

    If a = L @ L.T, the squared norms are eigenvalues of a and the normalised columns its eigenvectors.  A sweep meets every
    pair once in rounds of disjoint pairs, so a round is a few array operations.
    """
    g = factor.copy()
    d, r = g.shape
    if r == 0:
        return np.zeros(0), np.zeros((d, 0))
    seats = np.arange(r + r % 2)
    enough = np.finfo(float).eps * math.sqrt(d)
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(seats) - 1):
            i, j = seats[:len(seats) // 2], seats[::-1][:len(seats) // 2]
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            x, y = g[:, i], g[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > enough * size
            if not turn.any():
                continue
            largest = max(largest, float((np.abs(xy[turn]) / size[turn]).max()))
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s, x, y = c * t, x[:, turn], y[:, turn]
            g[:, i[turn]], g[:, j[turn]] = c * x - s * y, s * x + c * y
        if largest == 0.0:
            break
    norms = np.sqrt((g * g).sum(0))
    by = np.argsort(-norms, kind="stable")
    norms = norms[by]
    return norms, g[:, by] / np.where(norms > 0, norms, 1.0)


def _numbers(column: pa.Array, scale: float, shift: int) -> np.ndarray:
    """rows x d of x as long."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(flat.reshape(len(column), -1) * scale) + shift).astype(np.int64)


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there, holds entries, and holds neither nulls nor NaN, infinite or immense entries."""
    v = F.col(vector_col)
    return rows.where(F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False)))


def _pieces(batches: Iterator[pa.RecordBatch], scale: float, shift: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _numbers(batch.column(0).slice(at, ROWS), scale, shift)


def _moments(vectors: DataFrame, d: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """(n, sums per dimension), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for x in _pieces(batches, scale, shift):
            n += len(x)
            total = [t + int(hi) * 2**20 + int(lo) for t, hi, lo in zip(total, (x >> 20).sum(0), (x & (2**20 - 1)).sum(0))]
        if n:
            yield pa.record_batch([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["at", "v"])

    parts = vectors.mapInArrow(run, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r.at: int(r.v) for r in parts.collect()}  # d + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _scatter(vectors: DataFrame, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """Centred scatter.  Rows are centred at the whole number next to the mean, whose products add up exactly; the
    rest of the mean, at most a half, is taken off at the end."""
    d = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre)])

    def products(x: np.ndarray) -> list[int]:
        """Upper triangle of x.T @ x; sums of products below 2**53 are exact as doubles, larger ones take Python integers."""
        top = int(np.abs(x).max()) if x.size else 0
        if top * top * len(x) < 2**53:
            y = x.astype(np.float64)
            return [int(v) for v in (y.T @ y)[upper]]
        whole = x.astype(object)
        return list((whole.T @ whole)[upper])

    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(upper[0])
        some = False
        for x in _pieces(batches, scale, shift):
            total, some = [t + v for t, v in zip(total, products(x - centre))], True
        if some:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total])], ["at", "v"])

    parts = vectors.mapInArrow(run, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = np.zeros((d, d))
    for r in parts.collect():  # d * (d + 1) / 2 rows
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[i, j] = out[j, i] = float(int(r.v) - n * rest[i] * rest[j]) if rest[i] * rest[j] else float(int(r.v))
    return out


def fit_whitening(rows: DataFrame, vector_col: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> Whitening:
    """Model of all usable vectors.

    If vectors differ in length, those of the most frequent length count, the longer of two.  No usable vector: a model of no dimensions.
    Dimensions without variance, or whose variance follows from others', give no component.
    """
    v = usable(rows, vector_col).select(F.col(vector_col).alias("v"))
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    if not lengths:
        return Whitening(0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), 0.0, scale, shift)
    d = lengths[0].d
    v = v.where(F.size("v") == d)
    n, sums = _moments(v, d, scale, shift)
    scatter = _scatter(v, n, sums, scale, shift)
    factor, order = pivoted_cholesky(scatter)
    norms, columns = one_sided_jacobi(factor)
    components = np.zeros_like(columns)
    components[order] = columns
    return Whitening(n, np.array(sums, dtype=object), components, norms**2 / n, float(np.trace(scatter)) / n, scale, shift)


def whiten(rows: DataFrame, model: Whitening, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) for every usable vector of the model's length, whitened an array of up to k entries.

    deviation: decimal, the exact sum over dimensions of (n * x - S)**2.  whitened: the centred vector projected on the
    components of largest eigenvalues, each over the root of its eigenvalue.  Rows with null ids or equal ids are rows like any other.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    source = usable(rows, vector_col).where(F.size(vector_col) == model.dimensions).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n, sums, scale, shift = model.n, model.sums, model.scale, model.shift
    k = min(k, len(model.eigenvalues))
    turned = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _numbers(part.column(1), scale, shift)
                apart = _apart(x, n, sums)
                if apart.dtype != object and len(x) and float(np.abs(apart).max()) ** 2 * apart.shape[1] < 2**62:
                    deviation = (apart * apart).sum(1)
                else:
                    deviation = (apart.astype(object) ** 2).sum(1)
                white = (apart / n).astype(np.float64) @ turned
                yield pa.record_batch([part.column(0), pa.array([str(v) for v in deviation]),
                                       pa.array(list(white), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    out = source.mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, as long where that is exact."""
    bound = n * (int(np.abs(x).max()) if x.size else 0) + max((abs(int(s)) for s in sums), default=0)
    if bound < 2**63:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def identity_error(white: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of the column `whitened` less the identity; None without components or rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows and len(batch.column(0)[0]):
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                w = np.c_[np.ones(len(w)), w]
                n, total = n + len(w), w.T @ w + (0 if total is None else total)
        if n:
            yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    parts = white.select("whitened").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # (k + 1)**2 rows
    if not parts:
        return None
    m = np.array([r.v for r in parts])
    m = m.reshape(math.isqrt(len(m)), -1)
    mean = m[0, 1:] / m[0, 0]  # zero but for rounding, as whitened vectors are centred before they are multiplied
    return float(np.abs(m[1:, 1:] / m[0, 0] - np.outer(mean, mean) - np.eye(len(mean))).max())


def whitened_components(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, at most k.

    explained: the component's share of the variance.  Null vectors, vectors with null or non-finite entries (or such
    of 2**40 and more), empty vectors and vectors of another length than the usual one have no row.  One vector alone, or
    equal vectors, have no variance and no row.  Empty table: no rows.  Other columns are not read.
    """
    model = fit_whitening(rows, vector_col)
    white = whiten(rows, model, k, id_col, vector_col)
    error = identity_error(white)
    share = [float(e) / model.trace for e in model.eigenvalues[:k]]
    return white.select(
        id_col, F.posexplode("whitened").alias("at", "value"), "deviation").select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.get(F.array(*[F.lit(s) for s in share]).cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
