"""Whitening of embeddings: distributed covariance, leading components, projection.

Entries become whole numbers ``floor(64 * c) + 1000000``. Count and sums per dimension are exact (whole numbers, added
as decimals of 38 digits). The covariance is taken around that exact mean: ``n * x - S`` is formed as a whole number
before anything is rounded or multiplied, every task adds up its own matrix, Spark adds the matrices entry by entry. Only that
matrix, whose size follows the number of dimensions and never the rows, comes to the driver. There Householder reflections make it
tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse iteration the vectors; vectors of close
eigenvalues are made orthogonal within their cluster at every step. The projection goes to the tasks as a broadcast
(dimensions x components numbers), and a last sum over all rows measures how far the result is from white.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry are dropped; so are vectors of another length
than the most frequent one (of equally frequent ones the longest). Entries beyond the range of a long count as its nearest
bound of 2^62. Components with at most ``RANK_FLOOR`` of the variance have no direction of their own and are left out, so
a table of equal vectors, of one vector, or without usable rows gives no rows. ``deviation`` is null where the exact number
exceeds a long. Repeated and null ids are kept, equal vectors get equal values; the sign of a component makes its
largest entry positive; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
GRID = 64
SHIFT = 1_000_000
#: Share of the trace up to which an eigenvalue cannot be told from rounding.
RANK_FLOOR = 1e-10
#: Eigenvalues closer than this share of the norm form a cluster.
CLUSTER = 1e-3
#: Numbers of a batch worked on at once.
PART = 1 << 19
_LIMIT = 1 << 62
_EPS = np.finfo(float).eps


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (id, vec) whose vectors are whole, finite and of the table's length, and that length."""
    whole = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c)
                                            & (F.abs(c.cast("double")) < float("inf"))))
    common = whole.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = common["d"] if common else 0
    return whole.where(F.size("vec") == d), d


def _grid(column: pa.ListArray, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole-number matrix of parts of a batch."""
    step = max(1, PART // max(d, 1))
    for low in range(0, len(column), step):
        part = column.slice(low, step)
        c = np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(part), d)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(GRID * c), -float(_LIMIT), float(_LIMIT)).astype(np.int64)
        yield low, x + SHIFT


@dataclass
class Centre:
    """Exact count and sums of the fit list."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as longs where they fit, else as Python's whole numbers."""
        middle = [round(s / self.n) if abs(s) < 1 << 53 else s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle)]
        shifted = x.astype(object) - np.array(middle, object) if np.abs(x).max(initial=0) > _LIMIT >> 2 or max(
            map(abs, middle), default=0) > _LIMIT >> 2 else x - np.array(middle, np.int64)
        spread = int(abs(shifted).max(initial=0)) if shifted.size else 0
        if self.n * spread + max(map(abs, rest), default=0) < _LIMIT:
            return self.n * shifted.astype(np.int64) - np.array(rest, np.int64)
        return self.n * shifted.astype(object) - np.array(rest, object)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once; ``y`` is n * x - S."""
        return (y / self.n).astype(np.float64)

    @staticmethod
    def deviation(y: np.ndarray) -> list[int | None]:
        """Sum of squares of each row, None above a long."""
        top = int(abs(y).max(initial=0)) if y.size else 0
        if top * top * max(y.shape[1], 1) < 1 << 63:
            return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [s if (s := sum(v * v for v in row)) < 1 << 63 else None for row in y.tolist()]


def centre(rows: DataFrame, d: int) -> Centre:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            for _, x in _grid(batch.column("vec"), d):
                n += len(x)
                exact = x if len(x) * int(np.abs(x).max(initial=0)) < _LIMIT else x.astype(object)
                sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["at", "n", "total"])

    parts = rows.select("vec").mapInArrow(add, "at int, n long, total decimal(38,0)")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    return Centre(found[0]["n"] if found else 0, [int(r["total"]) for r in found])


def _summed(rows: DataFrame, size: int, matrix_of) -> np.ndarray:
    """Sum over all rows of a symmetric size x size matrix; ``matrix_of`` makes that of a part. Tasks add up their own
    parts, the upper halves are added by entry."""
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for part in matrix_of(batch):
                total += part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])],
                                         names=["at", "value"])

    cells = rows.select("vec").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = cells.toArrow()
    out = np.zeros((size, size))
    at = found["at"].to_numpy()
    out[upper[0][at], upper[1][at]] = found["value"].to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def covariance(rows: DataFrame, d: int, around: Centre) -> np.ndarray:
    """Covariance of the whole-number vectors, divisor n."""

    def products(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _grid(batch.column("vec"), d):
            centred = around.centred(around.scaled(x))
            yield centred.T @ centred

    return _summed(rows, d, products) / around.n


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the Householder vectors that lead there."""
    a, n = matrix.copy(), len(matrix)
    off, mirrors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        if not v[1:].any():
            off[k] = v[0]
            mirrors.append(None)
            continue
        off[k] = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        mirrors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return a.diagonal().copy(), off, mirrors


def count_below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each of ``at``."""
    tiny = np.finfo(float).tiny / _EPS
    q = np.full(len(at), np.inf)
    below = np.zeros(len(at), np.int64)
    for d, b in zip(diag, np.concatenate([[0.0], off])):
        q = d - at - b * b / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def bisect(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling."""
    n = len(diag)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    pad = 2 * _EPS * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high, rank = low - pad, high + pad, n - 1 - np.arange(k)
    for _ in range(1100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = count_below(diag, off, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low + (high - low) / 2


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 4) -> np.ndarray:
    """Unit vectors (columns) for the eigenvalues, which fall; those of a cluster are made orthogonal at every step."""
    n, k = len(diag), len(values)
    norm = max(np.abs(diag).max(initial=0) + 2 * np.abs(off).max(initial=0), np.finfo(float).tiny)
    shift = values.copy()
    together = np.zeros(k, np.int64)
    for j in range(1, k):
        together[j] = together[j - 1] if values[j - 1] - values[j] < CLUSTER * norm else j
        if together[j] != j:
            shift[j] = min(shift[j], shift[j - 1] - 4 * _EPS * norm)
    # Elimination with row exchanges, for all shifts at once: main holds the pivots, next and far what stands right of them.
    main, nxt, far = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    factor, swap = np.zeros((n, k)), np.zeros((n, k), bool)
    top, beside = diag[0] - shift, np.full(k, off[0] if n > 1 else 0.0)
    for i in range(n - 1):
        under, right = np.full(k, off[i]), diag[i + 1] - shift
        last = np.full(k, off[i + 1] if i + 2 < n else 0.0)
        swap[i] = np.abs(under) > np.abs(top)
        main[i] = np.where(swap[i], under, top)
        main[i] = np.where(np.abs(main[i]) < _EPS * norm, _EPS * norm, main[i])
        nxt[i] = np.where(swap[i], right, beside)
        far[i] = np.where(swap[i], last, 0.0)
        factor[i] = np.where(swap[i], top, under) / main[i]
        top = np.where(swap[i], beside, right) - factor[i] * nxt[i]
        beside = np.where(swap[i], 0.0, last) - factor[i] * far[i]
    main[n - 1] = np.where(np.abs(top) < _EPS * norm, _EPS * norm, top)
    z = np.random.default_rng(13).standard_normal((n, k))
    for _ in range(steps):
        for i in range(n - 1):
            first, second = np.where(swap[i], z[i + 1], z[i]), np.where(swap[i], z[i], z[i + 1])
            z[i], z[i + 1] = first, second - factor[i] * first
        for i in range(n - 1, -1, -1):
            z[i] -= nxt[i] * (z[i + 1] if i + 1 < n else 0) + far[i] * (z[i + 2] if i + 2 < n else 0)
            z[i] /= main[i]
        z /= np.abs(z).max(axis=0)
        for j in range(k):
            for _twice in range(2):
                before = z[:, together[j]:j]
                z[:, j] -= before @ (before.T @ z[:, j])
            z[:, j] /= np.linalg.norm(z[:, j])
    return z


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    scale = np.abs(matrix).max(initial=0)
    if not k or scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diag, off, mirrors = tridiagonal(matrix / scale)
    values = bisect(diag, off, k)
    z = inverse_iteration(diag, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        if mirrors[i] is not None:
            z[i + 1:] -= 2 * np.outer(mirrors[i], mirrors[i] @ z[i + 1:])
    z /= np.linalg.norm(z, axis=0)
    return values * scale, z * np.sign(z[np.abs(z).argmax(axis=0), np.arange(k)])


@dataclass
class Whitening:
    """What the fit knows: centre, eigenvalues and vectors kept, trace of the covariance."""

    around: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def of(self, y: np.ndarray) -> np.ndarray:
        return (self.around.centred(y) @ self.vectors) / np.sqrt(self.values)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    around = centre(rows, d)
    if not around.n or not d:
        return Whitening(around, np.zeros(0), np.zeros((d, 0)), 0.0)
    matrix = covariance(rows, d, around)
    trace = float(matrix.trace())
    values, vectors = leading(matrix, min(components, d))
    kept = values > RANK_FLOOR * trace
    return Whitening(around, values[kept], vectors[:, kept], trace)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component."""
    rows, d = usable(vectors, id_col, vec_col)
    model = fit(rows, d, components)
    k = len(model.values)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def products(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _grid(batch.column("vec"), d):
            # A last row of ones gives the sums beside the products.
            w = np.column_stack([sent.value.of(sent.value.around.scaled(x)), np.ones(len(x))])
            yield w.T @ w

    error = 0.0
    if k:
        moments = _summed(rows, k + 1, products) / model.around.n
        mean = moments[k, :k]
        error = float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names, shares = np.arange(1, k + 1, dtype=np.int32), own.values / own.trace if k else own.values
        for batch in batches:
            for low, x in _grid(batch.column("vec"), d):
                y, m = own.around.scaled(x), len(x)
                apart = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, m).take(pa.array(apart)), pa.array(np.tile(names, m)),
                     pa.array(np.full(m * k, own.around.n)), pa.array(own.around.deviation(y), pa.int64()).take(pa.array(apart)),
                     pa.array(own.of(y).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
