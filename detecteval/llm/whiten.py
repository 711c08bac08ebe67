"""Embedding whitening (operator 13): distributed covariance, mixed-precision eigenvectors.

An entry c becomes the integer x = floor(``scale`` * c) + ``shift``. Two passes
over the table give the exact sums S and, centred at the rounded mean, the exact
products of all rows; only d sums and d(d+1)/2 products per dimension pair reach
the driver, whatever the number of rows. The remainder S/n - round(S/n) is taken
off in exact rationals, so V is the covariance rounded once.

Eigenvectors come from LAPACK in float32 and are then corrected by
*Ogita-Aishima iterations* (matrix products only) in extended precision: with
R = I - X'X and S = X'VX the correction X E, E_ij = (S_ij + e_j R_ij) / (e_j - e_i),
converges quadratically for eigenvalues further apart than the current error.
Nearer ones form a cluster; inside it the iteration only restores orthogonality
(R/2), and a *sub-solve* of X_J'(V - mu I)X_J, shifted by the cluster's mean,
turns the basis before the next iteration.

Defined cases: rows whose vector is null or empty, holds null or non-finite
entries, has an entry whose x is no 64-bit integer, or is of another length than
most (ties: the longer) take no part and are not returned. Rows are not merged:
a repeated row counts and is returned as often as it stands there, null ids
included. An empty table gives no rows. Components whose eigenvalue is 0 up to
rounding have ``whitened`` null and do not count for ``identity_error`` (null if
none is left); with no variance at all ``explained`` is null too. A ``deviation``
beyond 64 bits is null. Extra columns are ignored. Each component's sign makes
its largest entry positive.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .arrays import map_batches

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
EXACT = 1 << 25  # products of smaller numbers are summed exactly by float64 matrix products
ROWS = 4096
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


class Model(NamedTuple):
    """n rows, sums of each dimension, their covariance, the leading
    eigenvalues and (as columns) eigenvectors, and the trace."""
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# -- eigenvectors ---------------------------------------------------------------

def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of the values, grouped where neighbours lie within ``gap``."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)


def eigenvectors(a: np.ndarray, rounds: int = 30, kind=np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix."""
    d = len(a)
    size = float(np.abs(a).max()) if d else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    _, start = np.linalg.eigh((a / size).astype(np.float32))
    a, x, eye = (a / size).astype(kind), start.astype(kind), np.eye(d, dtype=kind)
    small = np.finfo(kind).eps * 16
    norm = np.sqrt((a * a).sum())
    values = np.diagonal(a)
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else a small gap turns rounding into lost orthogonality
        values = np.diagonal(s) / (1 - np.diagonal(r))
        off = s - np.diag(np.diagonal(s))
        error = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        groups = clusters(values, max(error, norm * small))
        label = np.empty(d, np.int64)
        for g, at in enumerate(groups):
            label[at] = g
        apart = label[:, None] != label[None, :]
        gaps = np.where(apart, values[None, :] - values[:, None], 1)
        step = np.where(apart, (s + values[None, :] * r) / gaps, r / 2)
        x = x + x @ step
        for at in groups:
            if len(at) > 1:
                mean = values[at].mean()
                part = x[:, at].T @ (a @ x[:, at] - mean * x[:, at])
                part = ((part + part.T) / 2).astype(np.float64)
                x[:, at] = x[:, at] @ np.linalg.eigh(part)[1].astype(kind)
        if np.abs(step).max() < small:
            break
    for _ in range(3):
        x = x + x @ (eye - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return (values * size).astype(np.float64), x.astype(np.float64)


# -- rows -------------------------------------------------------------------------

def integers(column: pa.Array, scale: int, shift: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch that take part and their x, one pair for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum()))
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        c = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, c)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(c * scale) + shift
        fits = np.abs(x) < 2.0 ** 62
    there = column.is_valid().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = []
    for d in np.unique(sizes[there & (sizes > 0)]).tolist():
        rows = np.flatnonzero(there & (sizes == d))
        at = starts[rows][:, None] + np.arange(d)
        rows, at = rows[fits[at].all(axis=1)], at[fits[at].all(axis=1)]
        if len(rows):
            small = x[at]
            whole = np.floor(c[at] * scale).astype(np.int64) + shift if np.abs(small).max() >= 2.0 ** 52 \
                else small.astype(np.int64)
            out.append((rows, whole))
    return out


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(rows[key].cast("long").alias("vec_id"), rows[vector].cast("array<double>").alias("vector"))


def _task_sums(vectors: DataFrame, fold, schema: str) -> DataFrame:
    """One set of partial sums for each task: ``fold(state, batch)`` grows the
    state, ``fold(state, None)`` gives its record batch."""
    def run(batches):
        state: dict = {}
        for b in batches:
            if b.num_rows:
                fold(state, b)
        if state:
            yield fold(state, None)
    return vectors.mapInArrow(run, schema)


def sums(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension, of the most common length."""
    def fold(state, batch):
        if batch is None:
            flat = [(d, j, str(v)) for d, total in state.items() for j, v in enumerate(total)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()),
                                               pa.array([r[1] for r in flat], pa.int32()),
                                               pa.array([r[2] for r in flat], pa.string())], names=["d", "j", "v"])
        for rows, x in integers(batch.column(1), scale, shift):
            d = x.shape[1]
            total = state.setdefault(d, [0] * (d + 1))
            total[d] += len(rows)  # place d holds the count
            high, low = x >> 20, x & ((1 << 20) - 1)
            for j, (h, l) in enumerate(zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())):
                total[j] += (h << 20) + l
    parts = _task_sums(vectors, fold, "d int, j int, v string")
    totals = checkpoint(parts.groupBy("d", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
    most = totals.where("j = d").orderBy(F.desc("v"), F.desc("d")).limit(1).collect()
    if not most:
        return 0, []
    d = most[0].d
    own = {r.j: int(r.v) for r in totals.where(F.col("d") == d).collect()}
    return own[d], [own[j] for j in range(d)]


def covariance(vectors: DataFrame, n: int, total: list[int], scale: int, shift: int) -> np.ndarray:
    """The covariance (divisor n) of the integer vectors, rounded once."""
    d = len(total)
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    middle = np.array(centre, np.int64)
    upper = np.triu_indices(d)

    def fold(state, batch):
        if batch is None:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(upper[0]))), pa.array(state["exact"]), pa.array(state["rough"])],
                names=["cell", "exact", "rough"])
        if not state:
            state |= {"exact": np.zeros(len(upper[0]), np.int64), "rough": np.zeros(len(upper[0]))}
        for _, x in integers(batch.column(1), scale, shift):
            if x.shape[1] != d:
                continue
            y = x - middle
            most = np.abs(y).max(axis=1)
            for lo in range(0, len(y), ROWS):
                part = y[lo:lo + ROWS].astype(np.float64)
                near = most[lo:lo + ROWS] < EXACT
                fine, step = part[near], max(1, int(2 ** 53 // max(1, int(most[lo:lo + ROWS][near].max(initial=1)) ** 2)))
                for k in range(0, len(fine), step):
                    block = (fine[k:k + step].T @ fine[k:k + step])[upper].astype(np.int64)
                    grown = state["exact"] + block
                    if (np.abs(grown) > 2 ** 62).any():  # hand over to the double before it overflows
                        state["rough"] += state["exact"]
                        grown = block
                    state["exact"] = grown
                far = part[~near]
                state["rough"] += (far.T @ far)[upper]

    parts = _task_sums(vectors, fold, "cell long, exact long, rough double")
    cells = parts.groupBy("cell").agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("exact"),
                                      F.sum("rough").alias("rough")).collect()
    out = np.zeros((d, d))
    for r in cells:
        i, j = int(upper[0][r.cell]), int(upper[1][r.cell])
        out[i, j] = out[j, i] = (n * int(r.exact) - rest[i] * rest[j]) / (n * n) + r.rough / n
    return out


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT,
        components: int = COMPONENTS) -> Model | None:
    """The whitening of all rows that take part; None if there are none."""
    vectors = _vectors(rows, key, vector)
    n, total = sums(vectors, scale, shift)
    if not n:
        return None
    v = covariance(vectors, n, total, scale, shift)
    values, x = eigenvectors(v)
    k = min(components, len(total))
    return Model(n, total, v, values[:k], x[:, :k], float(np.trace(v)))


def _projection(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Which components have variance; the matrix from centred rows to whitened ones."""
    full = model.values > max(float(model.values.max(initial=0)) * len(model.sums) * 4 * np.finfo(float).eps, 0)
    return full, model.vectors / np.sqrt(np.where(full, model.values, 1))


def _centred(x: np.ndarray, model: Model) -> np.ndarray:
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = np.array([(s - model.n * c) / model.n for s, c in zip(model.sums, centre)])
    return (x - np.array(centre, np.int64)) - rest


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    n, total = model.n, model.sums
    most = max(abs(n * int(e) - s) for col, s in zip((x.min(axis=0), x.max(axis=0)), (total, total))
               for e, s in zip(col, s))
    if max(most ** 2 * len(total), n * int(np.abs(x).max())) < 2 ** 63:
        y = n * x - np.array(total, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = (sum((n * e - s) ** 2 for e, s in zip(row, total)) for row in x.tolist())
    return [v if v < 2 ** 63 else None for v in exact]


def identity_error(vectors: DataFrame, model: Model, scale: int, shift: int) -> float | None:
    """Largest entry of |covariance of the whitened rows - identity|, measured on all rows."""
    full, project = _projection(model)
    k = int(full.sum())
    if not k:
        return None
    project = project[:, full]

    def fold(state, batch):
        if batch is None:
            flat = np.concatenate((state["sum"], state["product"].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "v"])
        if not state:
            state |= {"sum": np.zeros(k), "product": np.zeros((k, k))}
        for _, x in integers(batch.column(1), scale, shift):
            if x.shape[1] == len(model.sums):
                z = _centred(x, model) @ project
                state["sum"] += z.sum(axis=0)
                state["product"] += z.T @ z

    parts = _task_sums(vectors, fold, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k + k * k)
    for r in parts:
        flat[r.cell] = r.v
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT,
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component: vec_id, component, n,
    deviation, whitened, explained, identity_error."""
    model = fit(rows, key, vector, scale, shift, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    vectors = _vectors(rows, key, vector)
    error = identity_error(vectors, model, scale, shift)
    full, project = _projection(model)
    k = len(full)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]

    def run(batch):
        for at, x in integers(batch.column(1), scale, shift):
            if x.shape[1] != len(model.sums):
                continue
            for lo in range(0, len(at), ROWS):
                part = x[lo:lo + ROWS]
                z = _centred(part, model) @ project
                ids = batch.column(0).take(pa.array(at[lo:lo + ROWS]))
                each = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.full(len(part) * k, model.n)),
                     pa.array(deviations(part, model), pa.int64()).take(each),
                     pa.array(z.ravel(), mask=~np.tile(full, len(part))),
                     pa.array(explained * len(part), pa.float64()),
                     pa.array([error] * (len(part) * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return map_batches(vectors, run, OUT)
