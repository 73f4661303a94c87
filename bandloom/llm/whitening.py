"""Whitening of vectors: leading principal components by matrix-free block subspace iteration.

The covariance is never formed. A pass of Spark takes a block Q of a few columns and returns
Xᵀ(XQ)/n over centred rows, each task one matrix of (dimensions x columns); the driver orthonormalises
(QR), projects (Rayleigh-Ritz) and takes the residuals of the leading components. The next block is
what the pass added to the space. Earlier blocks and their products are kept, up to ``KEPT`` columns,
so that spectra without gaps need few passes; beyond that the iteration restarts from its best
vectors. It ends when the residuals of all k components are within ``TOLERANCE`` of the largest eigenvalue
(or what rounding leaves of a sum over so many rows), or when the space is exhausted, where the projection
is exact; ``passes`` without that are an error.

The fit list has each distinct whole vector once; every row is whitened with what the list gives.

Defined results: null vectors and vectors with a null or non-finite component are left out;
shorter vectors end in zeros; components that the fit list has no variance along (fewer distinct
vectors than components, say) can't be whitened and have no rows; a null id stays null and repeated
rows are rows of their own; whole numbers outside of a long are the nearest long; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .shared import small_batches, stored, temporary

K, SCALE, EXTRA, KEPT, PASSES, TOLERANCE = 4, 256, 12, 192, 200, 1e-13


def whole_vectors(table: DataFrame, id: str, vector: str, scale: int, wide: int) -> DataFrame:
    """(id, x array<long>) of the rows that take part, padded to one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, x in vectors.matrices(batch, "_vector", scale, wide):
                if x.dtype == object or np.abs(x).max(initial=0) >= vectors.EXACT:
                    x = np.array([[vectors.as_long(v) for v in row] for row in x], np.int64).reshape(x.shape)
                flat = pa.array(x.astype(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * wide, flat)], ["id", "x"])

    small_batches(table.sparkSession)
    return table.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("_vector")).mapInArrow(run, "id long, x array<long>")


def _matrix(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def summed(fit: DataFrame, wide: int, columns: int, of) -> np.ndarray:
    """The sum over rows of ``of(matrix)``, a (rows of it, ``columns``) matrix of doubles; a matrix for each task is added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch, wide)
            for k in range(0, len(x), 4096):
                part = of(x[k : k + 4096])
                total = part if total is None else total + part
        if total is not None:
            flat = np.asarray(total, float).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as the matrix has numbers
    out = np.zeros(max((r.i for r in rows), default=-1) + 1)
    for r in rows:
        out[r.i] = r.v
    return out.reshape(-1, columns)


def totals(fit: DataFrame, wide: int) -> tuple[int, list[int]]:
    """(n, S): the number of fit vectors and their exact sums by dimension; each task adds its own up, Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(wide, object)
        for batch in batches:
            x = _matrix(batch, wide)
            n += len(x)
            small = int(np.abs(x.astype(float)).max(initial=0)) * max(1, len(x)) < vectors.EXACT
            sums += (x if small else x.astype(object)).sum(axis=0).astype(object)
        if n:
            every = [*sums, n]  # the count goes last
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide + 1)), pa.array([Decimal(int(v)) for v in every], pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    found = [int(r.s) for r in sorted(rows, key=lambda r: r.i)]
    return (found[-1], found[:-1]) if found else (0, [])


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns that ``block`` adds to ``basis``, orthonormal; directions within rounding of it go."""
    size = np.linalg.norm(block, axis=0, keepdims=True)
    block = block / np.where(size > 0, size, 1.0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    new = left[:, size > 1e-10]
    return np.linalg.qr(new - basis @ (basis.T @ new))[0] if new.shape[1] else new


class Components:
    """What the iteration found: eigenvalues falling, unit vectors as columns, residuals, passes made."""

    def __init__(self, values: np.ndarray, vectors_: np.ndarray, residuals: np.ndarray, passes: int):
        self.values, self.vectors, self.residuals, self.passes = values, vectors_, residuals, passes


def leading(product, wide: int, k: int, extra: int = EXTRA, kept: int = KEPT, passes: int = PASSES, tolerance: float = TOLERANCE) -> Components:
    """The k leading eigenpairs of a symmetric operator known by ``product(Q)`` alone."""
    k = min(k, wide)
    width, kept = min(wide, k + extra), max(kept, 3 * (k + extra))
    basis, image = np.zeros((wide, 0)), np.zeros((wide, 0))
    block = np.linalg.qr(np.random.default_rng(13).normal(size=(wide, width)))[0]
    for done in range(1, passes + 1):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        rest = moved[:, :width] - ritz[:, :width] * values[:width]
        residuals = np.linalg.norm(rest[:, :k], axis=0)
        if basis.shape[1] >= wide or (residuals <= tolerance * max(values[0], 0.0)).all():
            return Components(values[:k], ritz[:, :k], residuals, done)
        if basis.shape[1] + width > kept:
            basis, image = ritz[:, : 2 * width], moved[:, : 2 * width]
        block = _orthonormal(rest, basis)
        if not block.shape[1]:
            return Components(values[:k], ritz[:, :k], residuals, done)
    raise ArithmeticError(f"residuals {residuals} after {passes} passes")


class Whitening:
    """A fitted whitening: n, S, components with variance, their share of it, and the largest error of the fit list's covariance."""

    def __init__(self, n: int, sums: list[int], found: Components, trace: float):
        good = found.values > max(trace, 0.0) * 1e-12
        self.n, self.sums, self.mean = n, sums, np.array([s / n for s in sums]) if n else np.zeros(len(sums))
        self.values, self.vectors = found.values[good], found.vectors[:, good]
        self.residuals, self.passes = found.residuals, found.passes
        self.explained = self.values / trace if trace > 0 else self.values
        self.error = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)² of each row."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * max(1, x.shape[1]) <= vectors.LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        return [vectors.as_long(sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True))) for row in x]


def fitted(fit: DataFrame, wide: int, k: int = K) -> Whitening:
    """Fits to a stored list of distinct vectors (x array<long>)."""
    n, sums = totals(fit, wide)
    if not n:
        return Whitening(0, [], Components(np.zeros(0), np.zeros((wide, 0)), np.zeros(0), 0), 0.0)
    mean = np.array([s / n for s in sums])
    trace = float(summed(fit, wide, 1, lambda x: np.square(x - mean).sum(keepdims=True)).sum()) / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            d = x - mean
            return d.T @ (d @ q)

        return summed(fit, wide, q.shape[1], part) / n

    out = Whitening(n, sums, leading(product, wide, k, tolerance=max(TOLERANCE, 4 * np.finfo(float).eps * n**0.5)) if trace > 0 else Components(np.zeros(0), np.zeros((wide, 0)), np.zeros(0), 0), trace)
    m = len(out.values)
    if m:
        own = summed(fit, wide, m + 1, lambda x: _moments(out.apply(x))) / n
        out.error = float(np.abs(own[:m, :m] - np.outer(own[:m, m], own[:m, m]) - np.eye(m)).max())
    return out


def _moments(w: np.ndarray) -> np.ndarray:
    """Products of columns, and in the last column their sums."""
    return np.hstack([w.T @ w, w.sum(axis=0)[:, None]])


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, id: str, vector: str, k: int = K, scale: int = SCALE) -> DataFrame:
    """A row for each row that takes part and each component up to ``k``."""
    spark = table.sparkSession
    wide = vectors.width(table, vector)
    if not wide:
        return spark.createDataFrame([], SCHEMA)
    with temporary(spark) as keep:
        rows = keep(stored(whole_vectors(table, id, vector, scale, wide), "vectors"))
        model = fitted(stored(rows.select("x").distinct(), "fit"), wide, k)
    shared = spark.sparkContext.broadcast(model)  # dimensions x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = shared.value
        c = len(m.values)
        for batch in batches:
            x = _matrix(batch, wide)
            one = np.arange(len(x)).repeat(c)
            each = [batch.column(0).take(pa.array(one)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(one), m.n)), pa.array(m.deviation(x), pa.int64()).take(pa.array(one))]
            each += [pa.array(m.apply(x).ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(one), m.error))]
            yield pa.RecordBatch.from_arrays(each, [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
