"""PCA whitening of embeddings by shifted CholeskyQR.

Entries are put on an integer grid, ``x = floor(scale * c) + offset``, so that
counts and sums are exact.  The centred rows A (n x d) are never gathered:

1. One pass counts the rows and sums every dimension.
2. A Gram pass gives G = A'A (every task sums its rows, the sums are added in
   two levels).  Its Cholesky factor, with a shift that keeps it positive, is the
   first triangular factor R1.
3. Further Gram passes orthogonalise: each task solves its centred rows through
   the factors so far (A R1^-1 R2^-1 ...), the Gram matrix of the result gives the
   next factor, until it is the identity to rounding.  Only a factor that would
   break down (dependent dimensions) is shifted again.
4. R = Rk ... R1 has the singular values and right singular vectors of A, to
   the accuracy of a QR decomposition, not of A'A.  Its SVD gives the components.
5. One more pass measures the covariance of the whitened rows.

The driver holds d x d matrices, whatever the number of rows.

A row takes part unless its vector is null, holds null or non-finite entries or
has another length than most vectors (ties: the greater length).  Entries
beyond 2^62 on the grid count as that.  A null id is an id like others, repeated
rows count each.  Directions without variance (under ``RANK`` of the greatest
singular value) are no components, so a table of equal vectors, like an empty
one, has none, and no result rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .cluster import ready

SCALE, OFFSET = 1024, 100_000
PASSES = 6        # Gram passes at most
RANK = 1e-10      # singular values under this share of the greatest are no components
ADDERS = 256      # slots in which the tasks' Gram matrices are added first (few matrices: fewer tasks)
BLOCK = 1 << 21   # entries that a task handles at once
_U = np.finfo(float).eps / 2


@dataclass
class Whitening:
    dims: int                # length of the vectors
    n: int                   # fitted rows
    sums: list[int]          # of the grid values, by dimension
    safe: bool               # deviations fit in 64 bits
    components: np.ndarray   # dims x k, unit columns
    eigenvalues: np.ndarray  # of the covariance, falling
    trace: float             # of the covariance
    passes: int              # Gram passes run
    identity_error: float    # of the covariance of the whitened rows

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _usable(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.expr(f"`{vector}` is not null and forall(`{vector}`, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"))


def _grid(col: pa.Array, dims: int) -> np.ndarray:
    """Grid values of a list column, rows x dims."""
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dims)
    return np.clip(np.floor(v * SCALE), -(2.0 ** 62), 2.0 ** 62).astype(np.int64) + OFFSET


def _blocks(batches, col: int, dims: int):
    step = max(1, BLOCK // max(dims, 1))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, _grid(part.column(col), dims)


def _sums(dims: int):
    def run(batches):
        n, total, low, high = 0, [0] * dims, None, None
        for _, x in _blocks(batches, 0, dims):
            n += len(x)
            wide = np.abs(x).max() >= 1 << 40
            total = [t + int(s) for t, s in zip(total, x.astype(object).sum(axis=0) if wide else x.sum(axis=0))]
            lo, hi = x.min(axis=0), x.max(axis=0)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(t) for t in total]),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["dim", "n", "total", "low", "high"])
    return run


def solve_rows(b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """B R^-1 for an upper triangular R, by substitution."""
    out = np.empty_like(b)
    for j in range(r.shape[0]):
        out[:, j] = (b[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(dims: int, mean: np.ndarray, project: np.ndarray | None, factors: list[np.ndarray]):
    """A task's Gram matrix of its centred rows, projected and solved through the factors."""
    def run(batches):
        g = None
        for _, x in _blocks(batches, 0, dims):
            q = x - mean
            if project is not None:
                q = q @ project
            for r in factors:
                q = solve_rows(q, r)
            g = q.T @ q if g is None else g + q.T @ q
        if g is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % ADDERS], pa.int32()), pa.array([g.ravel()], pa.list_(pa.float64()))], ["slot", "g"])
    return run


def _add(batches):
    total = None
    for batch in batches:
        for row in batch.column(1):
            g = row.values.to_numpy()
            total = g.copy() if total is None else total + g
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "g"])


_GRAM = "slot int, g array<double>"


def gram(vectors: DataFrame, dims: int, mean: np.ndarray, project: np.ndarray | None = None, factors=()) -> np.ndarray:
    rows = (vectors.mapInArrow(_gram(dims, mean, project, list(factors)), _GRAM).repartition("slot")
            .mapInArrow(_add, _GRAM).repartition(1).mapInArrow(_add, _GRAM).collect())  # one matrix
    k = int(round(len(rows[0].g) ** 0.5))
    return np.array(rows[0].g).reshape(k, k)


def _factor(g: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
    """Upper triangular Cholesky factor of G + shift I; the shift grows until there is one."""
    norm = np.linalg.norm(g, 2)
    while True:
        try:
            r = np.linalg.cholesky(g + shift * np.eye(len(g))).T
            if np.isfinite(r).all() and r.diagonal().min() > 0:
                return r, shift
        except np.linalg.LinAlgError:
            pass
        shift = max(10 * shift, 1e-14 * norm)


def fit(table: DataFrame, vector: str = "embedding", components: int = 8) -> tuple[Whitening | None, DataFrame]:
    """The whitening of a table's vectors and the rows that take part."""
    ready(table)
    usable = _usable(table, vector)
    length = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None or length.d == 0:
        return None, usable.limit(0)
    dims = length.d
    usable = usable.filter(F.size(vector) == dims)
    vectors = usable.select(vector)
    stats = (vectors.mapInArrow(_sums(dims), "dim int, n long, total string, low long, high long").groupBy("dim")
             .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
             .orderBy("dim").collect())  # a row per dimension
    n, sums = stats[0].n, [int(r.total) for r in stats]
    widest = max(max(abs(n * r.high - s), abs(n * r.low - s)) for r, s in zip(stats, sums))
    safe = dims * widest ** 2 < 2 ** 63 and n * max(max(abs(r.low), abs(r.high)) for r in stats) < 2 ** 63
    mean = np.array([s / n for s in sums])
    active = [j for j, r in enumerate(stats) if r.low < r.high]
    model = Whitening(dims, n, sums, safe, np.zeros((dims, 0)), np.zeros(0), 0.0, 0, 0.0)
    if not active:
        return model, usable
    pick = np.eye(dims)[:, active] if len(active) < dims else None
    g = gram(vectors, dims, mean, pick)
    d = len(active)
    trace = float(np.trace(g))
    r, _ = _factor(g, 11 * (n * d + d * (d + 1)) * _U * np.linalg.norm(g, 2))
    factors, whole, passes = [r], r, 1
    while passes < PASSES:
        g = gram(vectors, dims, mean, pick, factors)
        passes += 1
        r, shift = _factor(g, 0.0)
        factors.append(r)
        whole = r @ whole
        if shift == 0.0 and np.abs(g - np.eye(d)).max() < 1e-10:
            break
    _, s, vt = np.linalg.svd(whole)
    k = min(components, int((s > RANK * s[0]).sum()))
    v = np.zeros((dims, k))
    v[active] = vt[:k].T
    model.components, model.eigenvalues, model.trace, model.passes = v, s[:k] ** 2 / n, trace / n, passes
    if k:
        cov = gram(vectors, dims, mean, _scaled(model)) / n
        model.identity_error = float(np.abs(cov - np.eye(k)).max())
    return model, usable


def _scaled(model: Whitening) -> np.ndarray:
    return model.components / np.sqrt(model.eigenvalues)


def _whiten(model: Whitening, out_type: pa.DataType):
    mean, w, k = model.mean, _scaled(model), len(model.eigenvalues)
    sums = np.array(model.sums, dtype=np.int64 if model.safe else object)
    share = model.eigenvalues / model.trace

    def run(batches):
        for part, x in _blocks(batches, 1, model.dims):
            y = (x if model.safe else x.astype(object)) * model.n - sums
            deviation = (y * y).sum(axis=1).tolist()
            z = (x - mean) @ w
            m = len(x)
            row = pa.array(np.repeat(np.arange(m), k))
            # exact integers of any size travel as text
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row).cast(out_type), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array([str(v) for v in deviation]).take(row), pa.array(z.ravel()), pa.array(np.tile(share, m))],
                ["id", "component", "deviation", "whitened", "explained"])
    return run


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """``(<key>, component, n, deviation, whitened, explained, identity_error)`` for every
    row that takes part and every component, the greatest variance first.

    ``deviation`` (decimal; null if over 38 digits) is the exact sum over the dimensions
    of (n x - S)^2, ``explained`` the component's share of the variance and
    ``identity_error`` the greatest entry of the whitened covariance minus the identity.
    """
    model, rows = fit(table, vector, components)
    kind = table.schema[key].dataType
    head = f"id {kind.simpleString()}, component int, deviation string, whitened double, explained double"
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    if model is None or not len(model.eigenvalues):
        out = table.sparkSession.createDataFrame([], head)
        model = model or Whitening(0, 0, [], True, np.zeros((0, 0)), np.zeros(0), 0.0, 0, 0.0)
    else:
        out = rows.mapInArrow(_whiten(model, to_arrow_type(kind)), head)
    return out.select(F.col("id").alias(key), "component", F.lit(model.n).cast("long").alias("n"),
                      F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), "whitened", "explained",
                      F.lit(model.identity_error).alias("identity_error"))
