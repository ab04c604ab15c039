"""Embedding whitening: principal components of a distributed covariance, by mixed-precision refinement.

Entries become whole numbers, floor(256 c), so that sums, means and deviations are exact. The model is fitted
to each distinct vector once. Tasks add up sums and then products of centred vectors; what reaches the driver is
one number a dimension and one matrix of dimension by dimension, whatever the number of rows.

The eigenvectors of that matrix are found in single precision and corrected in double precision by the iteration
of Ogita and Aishima: with R = I - X'X and S = X'AX, X grows by X E, where E holds (S + l R) / (l - l') for
eigenvalues l, l' that are far apart and R / 2 otherwise. Eigenvalues too close to be told apart are a cluster:
the matrix is projected on the space of their vectors, shifted by their mean, scaled, and solved in the same way.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry take no part; all other rows
are returned, repeated ones and those without an id too. Vectors shorter than the longest count as filled up
with zeros. A component without variance (one distinct vector only, or fewer distinct vectors than dimensions)
has ``whitened`` null; with no variance at all ``explained`` is null too. A deviation beyond 64 bits is null.
Entries beyond 2^55 are cut to 64 bits. An empty table, or one of empty vectors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.shared import materialize, table

SCALE = 256
COMPONENTS = 4
#: Steps of the iteration, and levels of clusters within clusters; either ends much earlier.
_STEPS, _LEVELS = 12, 8
_LARGEST = (1 << 63) - 1


# The eigenvalue problem ------------------------------------------------------------------------------


def _clusters(values: np.ndarray, apart: float) -> Iterator[np.ndarray]:
    """Places of values that hang together by gaps of ``apart`` or less."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > apart) + 1
    yield from (g for g in np.split(order, breaks) if len(g) > 1)


def _bound(m: np.ndarray) -> float:
    """Of the spectral norm of a symmetric matrix."""
    return float(np.abs(m).sum(axis=1).max(initial=0.0))


def symmetric_eigen(a: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = len(a)
    norm = _bound(a)
    if not size or not norm:
        return np.zeros(size), np.eye(size)
    a = a / norm
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    solved = False
    for _ in range(_STEPS):
        r, s = np.eye(size) - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        apart = 2 * (_bound(off) + _bound(r)) + size * np.finfo(float).eps
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > apart
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x += x @ step
        if np.abs(step).max() < 1e-7:  # the error after this step is of the order of its square
            if solved:
                break
            solved = True
            groups = list(_clusters(values, apart)) if level < _LEVELS else []
            for g in groups:
                basis = np.linalg.qr(x[:, g])[0]
                mean = values[g].mean()
                inner = basis.T @ a @ basis - mean * np.eye(len(g))
                inner = (inner + inner.T) / 2
                # Below the rounding of the matrix itself any basis of the space is as good.
                x[:, g] = basis @ symmetric_eigen(inner, level + 1)[1] if _bound(inner) > size * np.finfo(float).eps else basis
            if not groups:
                break
    x += x @ (np.eye(size) - x.T @ x) / 2  # steps between close values leave vectors a little off the right angle
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return values[order] * norm, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(size)] < 0, -1, 1)


# Statistics over all rows ------------------------------------------------------------------------------


@dataclass
class Whitening:
    """``components`` are rows; ``deviations`` the square roots of their eigenvalues, zero where there is no variance."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    deviations: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float | None]:
        return [float(max(v, 0.0)) / self.trace if self.trace else None for v in self.values]


def whole_vectors(rows: DataFrame, vector: Column) -> DataFrame:
    """``rows`` with ``x``, the vector in whole numbers; without the rows that take no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(usable).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; short rows are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _sums(fit: DataFrame) -> tuple[int, list[int], bool]:
    """(rows, sums by dimension, whether lengths differ), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, total = 0, None, []
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            short = int(batch.column(0).value_lengths().to_numpy(zero_copy_only=False).min())
            n, least = n + len(x), short if least is None else min(least, short)
            safe = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2**62
            part = (x if safe else x.astype(object)).sum(axis=0).tolist()
            total = [a + b for a, b in zip(total + [0] * (len(part) - len(total)), part + [0] * (len(total) - len(part)), strict=True)]
        if n:
            numbers = [Decimal(0), *map(Decimal, total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n] * len(numbers), pa.int64()), pa.array([least] * len(numbers), pa.int32()), pa.array(numbers, pa.decimal128(38, 0))], names=["dim", "n", "least", "total"])

    found = fit.select("x").mapInArrow(run, "dim int, n long, least int, total decimal(38,0)")
    rows = found.groupBy("dim").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (rows[0].n, [int(r.total) for r in rows[1:]], rows[0].least < len(rows) - 1) if rows else (0, [], False)


def _products(fit: DataFrame, mean: np.ndarray, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum, sum of outer products) of the centred rows of ``fit``, turned by ``turn``; added up in tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(mean) if turn is None else turn.shape[1]
        total = np.zeros((width + 1, width))
        for batch in batches:
            y = _matrix(batch.column(0), len(mean)) - mean
            y = y if turn is None else y @ turn
            total[0] += y.sum(axis=0)
            total[1:] += y.T @ y
        yield _numbered(dict(enumerate(total)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix_of_doubles(batch.column(1)), strict=True):
                held[i] = held[i] + row if i in held else row
        yield _numbered(held)

    kind = "i int, row array<double>"
    spark = fit.sparkSession
    rows = fit.select("x").mapInArrow(each, kind).repartition(max(1, min(len(mean) + 1, spark.sparkContext.defaultParallelism)), "i").mapInArrow(merge, kind).collect()
    rows.sort(key=lambda r: r.i)
    return np.array(rows[0].row), np.array([r.row for r in rows[1:]])


def _numbered(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tolist() for r in rows.values()], pa.list_(pa.float64()))], names=["i", "row"])


def _matrix_of_doubles(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(vectors: DataFrame, components: int | None = None) -> Whitening:
    """The whitening of the distinct vectors ``x`` of ``vectors``, into so many components (default: as many as dimensions).

    The distinct vectors are written to the shared folder: three passes read them.
    """
    distinct = materialize(vectors.select("x").distinct(), "distinct_vectors")
    n, sums, ragged = _sums(distinct)
    if ragged:
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(len(sums)) - F.size("x")))
        distinct = materialize(distinct.select(filled.alias("x")).distinct(), "distinct_vectors")
        n, sums, _ = _sums(distinct)
    model = Whitening(n, sums)
    if not sums:
        return model
    total, products = _products(distinct, model.mean)
    covariance = products / n - np.outer(total / n, total / n)  # the mean of the centred rows is rounding only
    values, vectors_ = symmetric_eigen((covariance + covariance.T) / 2)
    model.trace = float(np.trace(covariance))
    keep = len(values) if components is None else min(components, len(values))
    model.values, model.components = values[:keep], vectors_[:, :keep].T.copy()
    real = model.values > len(values) * np.finfo(float).eps * values[0]
    model.deviations = np.where(real, np.sqrt(np.maximum(model.values, 0)), 0.0)
    if real.any():
        total, products = _products(distinct, model.mean, model.components[real].T / model.deviations[real])
        model.identity_error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(int(real.sum()))).max())
    return model


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; None beyond 64 bits."""
    top = n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, sums), default=0)
    if top * top * max(1, len(sums)) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= _LARGEST else None for v in exact]


def apply(vectors: DataFrame, model: Whitening, key: str) -> DataFrame:
    """(key, deviation, whitened) of every row of ``vectors``: one number for each component, null where it has no variance."""
    mean, sums, n = model.mean, model.sums, model.n
    real = model.deviations > 0
    turn = model.components.T / np.where(real, model.deviations, 1.0)
    names = [key, "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(sums))
            flat = ((x - mean) @ turn).ravel()
            none = np.tile(~real, len(x))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(real))
            whitened = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64(), mask=none))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(x, n, sums), pa.int64()), whitened], names=names)

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "x").mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` in its first four whitened components, one row for each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = whole_vectors(rows, F.col("embedding")).select("vec_id", "x")
    model = fit(vectors, COMPONENTS)
    done = apply(vectors, model, "vec_id").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(v).cast("double") for v in model.explained]).cast("array<double>")
    error = F.lit(model.identity_error).cast("double")
    return done.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), error.alias("identity_error"))
