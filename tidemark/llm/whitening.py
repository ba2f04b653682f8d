"""Embedding whitening (operator 12): vectors on their leading components, each with variance one.

Entries are taken as whole numbers, ``floor(256 * c)``, so the statistics are exact: counts, sums and products of deviations are
integers, and adding them in any order gives one result. Vectors travel as bytes of the least width that holds them.

1. ``packed``: one pass over the table drops unusable rows and writes id and packed vector.
2. The fit list is each distinct vector once (an aggregate that combines before the shuffle, so a vector that a third
   of all rows hold is one row a task).
3. Sums, then products of deviations from the rounded mean, are added up inside each task; what comes out of a task is one row of d (d + 1) / 2
   numbers, and these are summed by place. The exact covariance follows from them, d x d numbers for the driver.
4. The leading eigenpairs come from ``spectrum``. All rows are projected in one more pass; the covariance of the projected
   fit list, by co-moments that are centred while they are made, tells how far it is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.spectrum import leading_pairs

SCALE = 256
COMPONENTS = 4
#: Larger entries count as this; products of 2^80 still sum up exactly.
LARGEST = 1 << 40
#: Numbers of a block of vectors that a kernel handles at once.
BLOCK = 1 << 18
_EXACT = 1 << 53


def _pieces(batches: Iterator[pa.RecordBatch], column: int, numbers) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``BLOCK`` numbers; ``numbers`` tells them by row."""
    for batch in batches:
        ends = np.cumsum(numbers(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, 1, _lengths):
        lists = batch.column(1)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        lengths, there = _lengths(lists), np.asarray(lists.is_valid())
        row = np.repeat(np.arange(len(lengths)), lengths)
        good = there & (np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) == 0)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths[good]).tolist():
            rows = np.flatnonzero(good & (lengths == dim))
            x = np.floor(SCALE * values[starts[rows][:, None] + np.arange(dim)])
            x = np.clip(x, -LARGEST, LARGEST).astype(np.int64)
            # The least width that holds a vector: equal vectors have equal bytes.
            most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
            width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
            for w in np.unique(width).tolist():
                mine = width == w
                packed = [r.tobytes() for r in x[mine].astype(f"<i{w}")]
                out = pa.array(rows[mine])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(out), pa.array(np.full(len(packed), dim, np.int32)), pa.array(packed, pa.binary())], ["vec_id", "dim", "x"]
                )


def _unpacked(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (int64), by width."""
    widths = pc.binary_length(column).to_numpy(zero_copy_only=False) // dim
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        joined = b"".join(column.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(joined, f"<i{w}").reshape(-1, dim).astype(np.int64)


def _packed_pieces(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[pa.RecordBatch]:
    return _pieces(batches, column, lambda c: np.full(len(c), dim, np.int64))


def _decimals(values) -> pa.Array:
    return pa.array([[Decimal(int(v)) for v in values]], pa.list_(pa.decimal128(38, 0)))


def _sum_up(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim, object)
        for piece in _packed_pieces(batches, 0, dim):
            for _, x in _unpacked(piece.column(0), dim):
                sums += x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([_decimals(sums)], ["sums"])

    return run


def _products(y: np.ndarray) -> np.ndarray:
    """Exact products of whole-number columns: in floating point while every partial sum is a whole number below 2^53."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < _EXACT:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _multiply(dim: int, center: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for piece in _packed_pieces(batches, 0, dim):
            for _, x in _unpacked(piece.column(0), dim):
                total += _products(x - center)
        yield pa.RecordBatch.from_arrays([_decimals(total[np.triu_indices(dim)])], ["sums"])

    return run


def _added(rows: DataFrame) -> list[int]:
    """Sums by place of arrays, one of which comes from each task."""
    each = rows.select(F.posexplode("sums").alias("place", "v"))
    return [int(r.v) for r in each.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()]


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, the rounded mean, eigenvalues, unit vectors (rows) and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    center: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.asarray([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.center)])
        return ((x - self.center) - mean) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, exact."""
        left = np.asarray([s - self.n * int(c) for s, c in zip(self.sums, self.center)], object)
        y, n = x - self.center, self.n
        most = int(np.abs(y).max(initial=0))
        small = most * most * y.shape[1] < 1 << 62 and most * n * y.shape[1] < 1 << 62
        squares = (y * y).sum(axis=1).tolist() if small else (y.astype(object) ** 2).sum(axis=1)
        crossed = (y @ left.astype(np.int64)).tolist() if small else y.astype(object) @ left
        rest = int((left * left).sum())
        return [n * n * a - 2 * n * b + rest for a, b in zip(squares, crossed)]


def packed(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and x (bytes) of every row whose vector is there and finite in every entry."""
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].alias("v"))
    return rows.mapInArrow(_pack, "vec_id long, dim int, x binary")


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Statistics of a list of distinct packed vectors (column ``x``), which should be written: it is read twice."""
    n = vectors.count()
    sums = _added(vectors.mapInArrow(_sum_up(dim), "sums array<decimal(38,0)>"))
    center = np.asarray([(2 * s + n) // (2 * n) for s in sums], np.int64)
    left = [s - n * int(c) for s, c in zip(sums, center)]
    products = _added(vectors.mapInArrow(_multiply(dim, center), "sums array<decimal(38,0)>"))
    covariance = np.zeros((dim, dim))
    for i, j, q in zip(*np.triu_indices(dim), products):
        covariance[i, j] = covariance[j, i] = (n * q - left[i] * left[j]) / (n * n)
    pairs = leading_pairs(covariance, components)
    return Whitening(n, tuple(sums), center, np.asarray([e for e, _ in pairs]), np.asarray([v for _, v in pairs]).reshape(-1, dim), float(np.trace(covariance)))


def identity_error(vectors: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened list's covariance minus the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _packed_pieces(batches, 0, dim):
            for _, x in _unpacked(piece.column(0), dim):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in model.project(x).T], [f"z{i}" for i in range(k)])

    z = vectors.mapInArrow(run, ", ".join(f"z{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = z.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, deviation_exact, whitened, explained and identity_error of every remaining row and component.

    Rows whose vector is null or holds null or non-finite entries go. Null ids and repeated rows keep their rows. Entries
    beyond 2^40 / 256 count as that. Vectors have one dimension: that of most rows (the smaller on a tie); rows of another go too.
    Components whose eigenvalue is not positive beyond rounding are left out, so equal vectors, a single one, or an empty table give no rows.
    ``deviation`` is null where it does not fit 64 bits; ``deviation_exact`` holds 38 digits.
    """
    schema = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    rows = written(packed(table, id_col, vector_col), "packed-vectors")
    most = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    nothing = rows.sparkSession.createDataFrame([], schema)
    if most is None or most.dim == 0:
        return nothing
    dim = most.dim
    same = rows.where(F.col("dim") == dim)
    vectors = written(same.select("x").distinct(), "fit-vectors")
    model = fit(vectors, dim, components)
    k = len(model.values)
    if not k:
        return nothing
    error = identity_error(vectors, dim, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _packed_pieces(batches, 1, dim):
            for at, x in _unpacked(piece.column(1), dim):
                exact = model.deviations(x)
                m, repeated = len(at), pa.array(np.repeat(np.arange(len(at)), k))
                long = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                columns = [
                    piece.column(0).take(pa.array(at)).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), long.take(repeated), pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(repeated),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return same.select("vec_id", "x").mapInArrow(run, schema)
