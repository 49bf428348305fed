"""Whitening of embeddings: principal components from a pivoted Cholesky factor.

Entries become whole numbers, so that sums and each vector's deviation are exact.  Tasks centre
their vectors on the exact mean before they multiply, and send the cells of their scatter, as
many as the dimension's square; Spark adds them up.  The scatter is factored by a Cholesky
decomposition with pivoting, and a one-sided Jacobi turns the columns of the triangular factor
until they are orthogonal: the lengths of the turned columns give the eigenvalues, the columns
made unit length are the components.  Both need the dimension's square only, whatever the
number of vectors, and run on the driver.  Every vector is then projected, and the covariance of
what came out is gathered the same way, to tell how far it is from the identity.

Defined results: rows whose vector is null or has a null or non-finite entry are left out, as
are those of another length than most (of equally frequent lengths the greater counts).  An
entry beyond the range of a long counts as the end of that range, and a deviation of more than 38
digits is null.  A direction without spread
has no eigenvalue to divide by: components end at the rank, so one vector, or equal ones, give
no row.  Equal eigenvalues stay in the order of the pivots; each component's largest entry is
positive.  Repeated rows and ids count and come out as often as they occur.  An empty table gives
an empty result.  Only the two named columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.tables import lean, only

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
ROWS = 4096
_LONG = 1 << 63
_SAFE = 1 << 62
_DIGITS = 10**38


@dataclass
class Fit:
    """The number of vectors, the exact sum of each dimension, components as columns, eigenvalues, their trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as longs; what a long cannot hold becomes its last value."""
    x = np.floor(SCALE * values.astype(np.float64)) + SHIFT
    low, high = x < -float(_LONG), x >= float(_LONG)
    out = np.where(low | high, 0, x).astype(np.int64)
    out[low], out[high] = -_LONG, _LONG - 1
    return out


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
            yield part, whole_numbers(flat.reshape(part.num_rows, size))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs where they suffice, in Python's numbers elsewhere."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest < _SAFE and max(map(abs, sums)) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    largest = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    if y.dtype != object and largest * largest * y.shape[1] >= _SAFE:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (vec_id, embedding) that take part, and their length."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = rows.filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    lengths = whole.groupBy(F.size("embedding").alias("size")).count()
    best = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    size = best["size"] if best else 0
    return whole.filter(F.size("embedding") == size), size


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for part, x in _matrices(batches, size):
            n += part.num_rows
            largest = max(abs(int(x.max())), abs(int(x.min())))
            total = total + (x if largest < _SAFE // ROWS else x.astype(object)).sum(axis=0).astype(object)
        if n:
            sums = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            cells = [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), sums]
            yield pa.RecordBatch.from_arrays(cells, ["i", "n", "total"])

    cells = rows.select("embedding").mapInArrow(lean(run), "i int, n long, total decimal(38, 0)")
    found = cells.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by = {r["i"]: r for r in found}  # one row a dimension
    return (by[0]["n"], [int(by[i]["total"]) for i in range(size)]) if by else (0, [])


def _scatter(rows: DataFrame, size: int, blocks_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of z z' over the vectors z that ``blocks_of`` makes of blocks of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for _, x in _matrices(batches, size):
            z = blocks_of(x)
            total += z.T @ z
            some = True
        if some:
            i, j = np.tril_indices(width)
            cells = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
            yield pa.RecordBatch.from_arrays(cells, ["i", "j", "value"])

    cells = rows.select("embedding").mapInArrow(lean(run), "i int, j int, value double")
    out = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # width x width at most
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the whole numbers, centred on their exact means, divisor n."""
    size = len(sums)
    return _scatter(rows, size, lambda x: (_deviations(x, n, sums) / n).astype(float), size) / n


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and p with ``matrix[p][:, p]`` = L L', as many columns as the rank, falling diagonal."""
    a, size = matrix.copy(), len(matrix)
    order, factor = np.arange(size), np.zeros_like(matrix)
    least = size * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        at = k + int(np.argmax(a.diagonal()[k:]))
        if a[at, at] <= least:
            return factor[:, :k], order
        for m in (a, a.T, factor):
            m[[k, at]] = m[[at, k]]
        order[[k, at]] = order[[at, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns in rounds of pairs that share none: a tournament."""
    seats = list(range(columns + columns % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < columns]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns turned in pairs until all are orthogonal."""
    g = factor.copy()
    small = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            need = np.abs(c) > small * np.sqrt(a * b)
            if not need.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore"):
                zeta = np.where(need, (b - a) / (2 * c), 0.0)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(need, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[:, p], g[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    return g


def principal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns and eigenvalues of a covariance, falling, up to its rank."""
    factor, order = pivoted_cholesky(matrix)
    turned = jacobi_columns(factor)
    lengths = np.sqrt((turned * turned).sum(axis=0))
    falling = np.argsort(-lengths, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[order] = turned[:, falling] / lengths[falling]
    if vectors.shape[1]:
        top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        vectors = vectors * np.sign(top)
    return vectors, lengths[falling] ** 2


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Fit:
    """Components of the usable rows (vec_id, embedding) of length ``size``."""
    n, sums = _sums(rows, size) if size else (0, [])
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    v = covariance(rows, n, sums)
    vectors, values = principal(v)
    return Fit(n, sums, vectors[:, :components], values[:components], float(v.trace()))


def _whiten(y: np.ndarray, model: Fit) -> np.ndarray:
    return (y / model.n).astype(float) @ model.components / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest entry, by size, of the whitened vectors' covariance less the identity."""
    size, k = len(model.sums), len(model.values)

    def projected(x: np.ndarray) -> np.ndarray:
        return _whiten(_deviations(x, model.n, model.sums), model)

    with_one = _scatter(rows, size, lambda x: np.column_stack([projected(x), np.ones(len(x))]), k + 1)
    mean = with_one[k, :k] / model.n
    found = _scatter(rows, size, lambda x: projected(x) - mean, k) / model.n
    return float(np.abs(found - np.eye(k)).max())


def whitened(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error; a row per vector and component."""
    rows, size = usable(only(table, vec_id=vec_id, embedding=embedding))
    model = fit(rows, size, components)
    error = identity_error(rows, model) if len(model.values) else 0.0
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, deviation decimal(38, 0), whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, size):
            y = _deviations(x, model.n, model.sums)
            w = _whiten(y, model)
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            deviation = pa.array([Decimal(v) if v < _DIGITS else None for v in _squares(y)], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    if not len(model.values):
        projected = rows.limit(0).selectExpr(
            "vec_id", "cast(null as decimal(38, 0)) as deviation", "cast(null as array<double>) as whitened"
        )
    else:
        projected = rows.mapInArrow(lean(run), shape)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return projected.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
