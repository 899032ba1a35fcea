"""Whitening of embeddings by mixed-precision refinement (operator 11).

Vectors are fixed to a grid: an entry c becomes the whole number floor(scale * c). The model is fitted on
each distinct grid vector once. Sums and the covariance are integers: vectors are centred on the rounded
mean, multiplied in exact arithmetic in the tasks, and what rounding the mean left is taken off exactly,
so the covariance does not depend on the order or the place of rows.

Components: float32 eigenvectors of the covariance start the Ogita-Aishima iteration, a few matrix
multiplications in extended precision that each square the error. Eigenvalues that lie too close together
for single precision form a cluster, of which the iteration finds the subspace only; the covariance is then
restricted to that subspace, shifted by the cluster's mean value, and solved again in the same way.
Components are numbered by falling eigenvalue; of the two signs, the one with the largest entry positive
(the first of equals) is taken.

Plan: one shuffle of the vectors (distinct, hot vectors combine map-side); the sums and the products are
one row per (task, dimension pair), added up by Spark; only d sums and d x d products reach the driver.
Projection is a map over all rows. The identity error is measured on the whitened fit list itself.

Rows whose vector is null, or has a null, infinite or NaN entry, are dropped. The dimension is that of
most rows (the larger on ties); rows of another length are dropped too. Repeated rows come out alike and
count once in the fit. Components without variance (constant or repeated dimensions, fewer distinct
vectors than dimensions) cannot be whitened and are left out, so an empty or constant table gives an
empty result. Grid entries beyond 2^62 in magnitude raise an error; a deviation beyond 64 bits is null.
Carried columns that are named like a result column are refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, refuse_clash, stored

SCALE = 256.0
SAFE = 1 << 20            # grid entries up to here are multiplied as doubles, 8,192 rows at a time: exact
ROWS = 8192
CLUSTER = 1e-5            # eigenvalues closer than this, relative to the largest, are one cluster
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass(frozen=True)
class Whitening:
    """A fitted model. ``centre`` and ``rest``: the mean is centre + rest / n, all whole numbers.
    ``components``: unit eigenvectors as rows; ``values``: their eigenvalues."""
    scale: float
    n: int
    sums: list[int]
    centre: list[int]
    rest: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def grid(vector: Column, scale: float = SCALE) -> Column:
    """The vector on the grid (array of long); null where the vector is null or not finite."""
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, entries)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list array of ``d`` longs each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact(x: np.ndarray) -> np.ndarray:
    """As numbers that sums and products of ``ROWS`` rows cannot overflow."""
    if x.size and max(abs(int(x.max())), abs(int(x.min()))) > SAFE:
        return x.astype(object)
    return x.astype(np.float64)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            for at in range(0, len(x), ROWS):
                total = [t + int(s) for t, s in zip(total, _exact(x[at:at + ROWS]).sum(axis=0))]
        yield _cells(range(d + 1), [0] * (d + 1), [n, *total])
    return run


def _cells(i, j, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                       pa.array([str(x) for x in v], pa.string())], names=["i", "j", "v"])


def _products(d: int, centre: list[int]):
    """Sums of products of the centred vectors, by dimension pair."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, parts = np.zeros((d, d), dtype=object), np.zeros((d, d), dtype=np.int64), 0
        mid = np.array(centre, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            for at in range(0, len(x), ROWS):
                part = x[at:at + ROWS]
                wide = part.size and max(abs(int(part.max())), abs(int(part.min()))) > SAFE
                y = _exact(part.astype(object) - mid.astype(object) if wide else part - mid)
                g = y.T @ y                          # below 2^53 as doubles
                if g.dtype == object:
                    total = total + g
                    continue
                held, parts = held + g.astype(np.int64), parts + 1
                if parts % 512 == 0:                 # below 2^62
                    total, held = total + held, np.zeros((d, d), dtype=np.int64)
        total = total + held
        yield _cells(upper[0], upper[1], total[upper])
    return run


def _added(cells: DataFrame) -> dict[tuple[int, int], int]:
    """Cells added up over all tasks, exactly (as many rows as the dimensions have pairs)."""
    wide = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
    return {(r.i, r.j): int(r.v) for r in wide.collect()}


def extended(v: int) -> np.longdouble:
    """A whole number in extended precision."""
    high = float(v)
    return np.longdouble(high) + np.longdouble(float(v - int(high)))


def covariance(products: dict[tuple[int, int], int], rest: list[int], n: int) -> np.ndarray:
    """The covariance (divisor n): products of vectors centred on whole numbers, less what is left of the mean."""
    d = len(rest)
    out = np.zeros((d, d), dtype=np.longdouble)
    for (i, j), p in products.items():
        out[i, j] = out[j, i] = extended(n * p - rest[i] * rest[j]) / extended(n) / extended(n)
    return out


def eigen(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix in extended precision.
    Entries up to ``floor`` are rounding errors: a matrix of nothing else is left as it is."""
    d = len(a)
    eps = float(np.finfo(np.longdouble).eps)
    size = float(np.abs(a).max()) if d else 0.0
    floor = d * eps * size if floor is None else floor
    if d <= 1 or size <= floor:
        return np.diag(a).copy(), np.eye(d, dtype=np.longdouble)
    low, x = np.linalg.eigh((a / np.longdouble(size)).astype(np.float32))
    low, x = low[::-1].astype(np.float64) * size, x[:, ::-1].astype(np.longdouble)
    # single precision parts neighbours that lie this far apart; what lies closer is one cluster
    cluster = np.concatenate([[0], np.cumsum(-np.diff(low) > CLUSTER * np.abs(low).max())])
    before = np.inf
    for _ in range(12):                                   # 1e-7 -> 1e-14 -> 1e-19, as a rule
        x, step = refine(a, x, cluster)
        if step < 4 * d * eps or before / 2 <= step < 1e-15:
            break
        before = step
    for c in np.unique(cluster[1:][np.diff(cluster) == 0]):
        at = np.flatnonzero(cluster == c)
        x[:, at] = x[:, at] @ _sub_solve(a, x[:, at], floor)
    x = x / np.sqrt(np.einsum("ij,ij->j", x, x))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def refine(a: np.ndarray, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, float]:
    """One Ogita-Aishima step: better vectors and the largest correction. Vectors of one cluster are
    only made orthonormal to each other."""
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    same = cluster[:, None] == cluster[None, :]
    gap = np.where(same, 1, values[None, :] - values[:, None])
    e = np.where(same, r / 2, (s + values[None, :] * r) / gap)
    return x + x @ e, float(np.abs(e).max())


def _sub_solve(a: np.ndarray, part: np.ndarray, floor: float) -> np.ndarray:
    """How to turn the vectors of a cluster inside their subspace: ``a`` restricted to it and shifted by
    the cluster's mean value is small, so single precision parts what it could not in the whole matrix."""
    inner = part.T @ (a @ part)
    inner = (inner + inner.T) / 2
    return eigen(inner - np.diag(inner).mean() * (part.T @ part), floor)[1]


def fit(rows: DataFrame, components: int | None, scale: float, d: int) -> Whitening:
    """Fit on the distinct vectors ``x`` of ``rows`` (a stored table of them)."""
    cells = "i int, j int, v string"
    sums = _added(rows.select("x").mapInArrow(lean(_sums(d)), cells))
    n = sums.pop((0, 0), 0)
    s = [sums.get((i, 0), 0) for i in range(1, d + 1)]
    centre = [(2 * t + n) // (2 * n) if n else 0 for t in s]
    rest = [t - n * c for t, c in zip(s, centre)]
    products = _added(rows.select("x").mapInArrow(lean(_products(d, centre)), cells)) if n else {}
    v = covariance(products, rest, n)
    values, vectors = eigen(v)
    trace = float(np.trace(v)) if d else 0.0
    # a value that rounding alone can give is no variance
    real = [i for i in range(d) if values[i] > d * np.finfo(np.float64).eps * values[0]][:components]
    columns = vectors[:, real] if real else np.zeros((d, 0), dtype=np.longdouble)
    peak = np.abs(columns.astype(np.float64)).argmax(axis=0) if real else np.zeros(0, dtype=int)
    columns = columns * np.where(columns[peak, range(len(real))] < 0, -1, 1)
    return Whitening(scale, n, s, centre, rest, columns.T, values[real], trace)


def _project(x: np.ndarray, m: Whitening) -> np.ndarray:
    """Whitened coordinates of grid vectors, one column per component."""
    y = x - np.array(m.centre, dtype=np.int64) if x.dtype != object else (x - np.array(m.centre, dtype=object)).astype(np.float64)
    y = y - np.array([float(r) / m.n for r in m.rest])
    return y @ (m.components.T / np.sqrt(m.values)).astype(np.float64)


def _deviations(x: np.ndarray, m: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact."""
    most = max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0
    bound = m.n * most + max(map(abs, m.sums), default=0)
    if len(m.sums) * bound * bound < 1 << 63:
        return (np.square(m.n * x - np.array(m.sums, dtype=np.int64)).sum(axis=1)).tolist()
    exact = np.square(m.n * x.astype(object) - np.array(m.sums, dtype=object)).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def identity_error(rows: DataFrame, m: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, d = len(m.values), len(m.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = _project(_matrix(b.column(0), d), m)
            total, products = total + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()),
            pa.array(np.vstack([total, products]).ravel())], names=["i", "j", "v"])

    cells = rows.select("x").mapInArrow(lean(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = np.zeros((k + 1, k))
    for r in cells.collect():
        got[r.i, r.j] = r.v
    # the rows are centred before they are multiplied; what rounding left of their mean is taken off
    mean = got[0] / m.n
    return float(np.abs(got[1:] / m.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", carry: Sequence[str] = ("vec_id",), components: int | None = 4,
           scale: float = SCALE) -> DataFrame:
    """One row per remaining row and component: the ``carry`` columns, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``. ``components=None``: all."""
    refuse_clash(carry, RESULT)
    spark = df.sparkSession
    clean = df.select(F.struct(*carry).alias("own"), grid(F.col(vector), scale).alias("x")).filter(F.size("x") > 0)
    sizes = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    rows = stored(clean.filter(F.size("x") == d), "whiten-rows")
    wide = F.exists("x", lambda c: (c > 1 << 62) | (c < -(1 << 62)))
    if rows.filter(wide).limit(1).count():
        raise ValueError("grid entries beyond 2^62")
    distinct = stored(rows.select("x").distinct(), "whiten-fit")
    m = fit(distinct, components, scale, d)
    k = len(m.values)
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["own"].dataType)
    shape = f"own struct<{fields}>, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], shape).select("own.*", *RESULT)
    error = identity_error(distinct, m)
    share = [float(v) / m.trace for v in m.values.astype(np.float64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            if not len(x):
                continue
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), m.n)), pa.array(_deviations(x, m), pa.int64()).take(pa.array(each)),
                pa.array(_project(x, m).ravel()), pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(each), error))], names=["own", *RESULT])

    return rows.select("own", "x").mapInArrow(lean(run), shape).select("own.*", *RESULT)
