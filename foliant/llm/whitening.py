"""Embedding whitening with a cyclic Jacobi eigensolver.

Entries become whole numbers x = floor(256 * c), which sum exactly. The fit list holds each distinct x-vector once; its
sums, its centred scatter and, at the end, the covariance of the whitened fit list are added up partition by
partition on the executors, so that only matrices of the dimension reach the driver. There, rotations of disjoint
pairs of dimensions, each pair once a sweep, go on until every off-diagonal entry vanishes beside its two diagonal
entries; that is a relative measure, so small eigenvalues are as accurate as large ones. Components come by falling
eigenvalue; the whitening matrix and the mean are broadcast.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and those of another length
than most (the shortest of equally common lengths counts); rows without an id stay; repeated rows are each whitened and
count once in the fit; x beyond 64 bits ends at their bound; a component without variance (within rounding) has eigenvalue 0 and
no whitened value, and no part in identity_error; deviation is null where it exceeds 64 bits, deviation_exact where it exceeds
38 digits; other columns do not matter; an empty table, or one of empty vectors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import summed_counts
from foliant.session import cut_table

SCALE = 256.0
COMPONENTS = 4
MOST_SWEEPS = 60
_EPS = float(np.finfo(np.float64).eps)
_LIMB = (1 << 24) - 1
_RESULT = "vec_id {id}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix by cyclic rotations. A round turns
    disjoint pairs, as in a tournament in which all meet all, so that each is a few vector operations."""
    a, n = np.array(matrix, np.float64), len(matrix)
    turned = np.eye(n)
    order = [*range(n), *([-1] if n % 2 else [])]
    half, least = len(order) // 2, _EPS * math.sqrt(max(n, 1))
    floor = float(np.finfo(np.float64).tiny) / _EPS
    for _ in range(MOST_SWEEPS):
        still = True
        for _ in range(len(order) - 1):
            pairs = [(p, q) for p, q in zip(order[:half], order[:half - 1:-1], strict=True) if p >= 0 and q >= 0]
            order[1:] = [order[-1], *order[1:-1]]
            p, q = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            off, one, two = a[p, q], a[p, p], a[q, q]
            open_ = np.abs(off) > np.maximum(least * np.sqrt(np.abs(one * two)), floor)
            if not open_.any():
                continue
            still = False
            p, q, off, one, two = p[open_], q[open_], off[open_], one[open_], two[open_]
            angle = (two - one) / (2 * off)
            t = np.where(angle >= 0, 1.0, -1.0) / (np.abs(angle) + np.hypot(angle, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            up, low = a[p], a[q]
            a[p], a[q] = c[:, None] * up - s[:, None] * low, s[:, None] * up + c[:, None] * low
            for m in (a, turned):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = left * c - right * s, left * s + right * c
            a[p, p], a[q, q] = one - t * off, two + t * off
            a[p, q] = a[q, p] = 0.0
        if still:
            break
    values = np.diag(a).copy()
    falling = np.argsort(-values, kind="stable")
    return values[falling], turned[:, falling]


def _matrix(column: pa.Array) -> np.ndarray:
    """x of each entry of a column of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    inside = np.abs(wide) < 2.0**63
    x = np.where(inside, wide, 0.0).astype(np.int64)
    x[~inside] = np.where(wide[~inside] > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    return x.reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes of the least whole width that holds it; equal rows have equal bytes."""
    need = np.maximum(x.max(1), -(x.min(1) + 1)) if x.size else np.zeros(len(x), np.int64)
    width = np.select([need < 1 << 7, need < 1 << 15, need < 1 << 31], [1, 2, 4], 8)
    if len(width) and (width == width[0]).all():
        size = int(width[0]) * x.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, size * len(x) + 1, size, dtype=np.int32)), pa.py_buffer(x.astype(f"<i{width[0]}").tobytes())])
    return pa.array([row.astype(f"<i{w}").tobytes() for row, w in zip(x, width, strict=True)], pa.binary())


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), size), np.int64)
    for r, b in enumerate(rows):
        out[r] = np.frombuffer(b, f"<i{len(b) // size}")
    return out


def summed_rows(df: DataFrame, size: int, width: int, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of a (size, width) matrix of doubles that make() gives for each: its rows are
    added on the executors, and only their sums reach the driver."""
    schema = "row int, sums binary"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(row, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["row", "sums"])

    out = np.zeros((size, width))
    for k, row in df.mapInArrow(part, schema).repartition("row").mapInArrow(add, schema).collect():
        out[k] += np.frombuffer(row, np.float64)
    return out


@dataclass
class Whitening:
    """n and sums of the fit list (exact), its mean, all eigenvalues, the projection of the first components over the
    root of their eigenvalues, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    projection: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        total = float(self.values.sum())
        return self.values / total if total > 0 else np.full(len(self.values), np.nan)


def fit(vectors: DataFrame, dimension: int, components: int) -> Whitening | None:
    """The whitening of vectors(v), all of one length; None of an empty table."""
    keys = vectors.select("v").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([_packed(_matrix(b.column(0)))], names=["x"]) for b in batches if b.num_rows), "x binary")
    distinct = cut_table(keys.distinct())  # partial aggregation leaves one copy of a common vector in each task

    def add_up(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 + 3 * dimension, np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0), dimension)
            total[0] += len(x)
            for k, limb in enumerate((x & _LIMB, (x >> 24) & _LIMB, x >> 48)):
                total[1 + k * dimension : 1 + (k + 1) * dimension] += limb.sum(0)
        return total

    total = summed_counts(distinct, 1 + 3 * dimension, add_up)
    n = int(total[0])
    if not n:
        return None
    sums = [int(a) + (int(b) << 24) + (int(c) << 48) for a, b, c in total[1:].reshape(3, dimension).T.tolist()]
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def scatter(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((dimension, dimension))
        for batch in batches:
            y = _unpacked(batch.column(0), dimension) - mean
            out += y.T @ y
        return out

    covariance = summed_rows(distinct, dimension, dimension, scatter) / n
    values, vectors_of = jacobi((covariance + covariance.T) / 2)
    values = np.where(values > _EPS * dimension * max(float(values[0]), 0.0), values, 0.0)
    k = min(components, dimension)
    live = int((values[:k] > 0).sum())
    projection = np.full((dimension, k), np.nan)
    projection[:, :live] = vectors_of[:, :live] / np.sqrt(values[:live])

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((live + 1, live))
        for batch in batches:
            w = (_unpacked(batch.column(0), dimension) - mean) @ projection[:, :live]
            out[0] += w.sum(0)
            out[1:] += w.T @ w
        return out

    error = 0.0
    if live:
        moments = summed_rows(distinct, live + 1, live, spread) / n
        error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(live)).max())
    return Whitening(n, sums, mean, values, projection, error)


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error) of each usable row of
    table and each of its first components."""
    spark = table.sparkSession
    own = table.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    own = own.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    result = _RESULT.format(id=own.schema["id"].dataType.simpleString())
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = own.where(F.size("v") == (size["n"] if size else 0))
    found = fit(own, size["n"], components) if size and size["n"] else None
    if found is None:
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast(found)
    names = [f.split()[0] for f in result.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = w.projection.shape[1]
        explained = pa.array(w.explained[:k], from_pandas=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(1)), batch.num_rows
            exact, long = _deviations(x, w.n, w.sums)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, w.n), pa.int64()), long.take(each), exact.take(each),
                    pa.array(((x - w.mean) @ w.projection).ravel(), from_pandas=True), explained.take(pa.array(np.tile(np.arange(k), rows))), pa.array(np.full(rows * k, w.identity_error)),
                ],
                names=names,
            )

    return own.mapInArrow(apply, result)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[pa.Array, pa.Array]:
    """(as decimals, as longs): the sum over dimensions of (n * x - S) squared, in whole numbers."""
    most = n * (max(abs(int(x.max())), abs(int(x.min()))) + 1) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        long = pa.array((d * d).sum(1), pa.int64())
        return long.cast(pa.decimal128(38, 0)), long
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0)), pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())


def digest(table: DataFrame) -> DataFrame:
    return whiten(table)
