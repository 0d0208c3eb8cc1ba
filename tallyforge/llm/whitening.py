"""Embedding whitening from an exact scatter in residue numbers.

A vector's entries c become integers x = floor(scale * c) + offset.  Each partition
multiplies its integers' residues modulo a few primes below 2^20, in products of 8192
rows that a double holds exactly; residues are summed over partitions and the Chinese
remainder theorem gives the count, the sums and the whole scatter as exact integers.
How many primes are needed follows from the count and the largest magnitude of all x.
The covariance, its entries rounded once, goes through eigh twice: the second
diagonalises what rounding left off the diagonal after the first.

What the driver gets is a matrix of residues for each prime, summed by tasks in a
second level first; it grows with the square of the dimension, not with rows or tasks.

Rows whose vector is null or empty, or holds null or non-finite entries, are dropped, as
are vectors of another length than the commonest (ties: the longer).  Null and repeated ids and
repeated vectors are rows like others.  An empty table gives no rows.  Entries so large that x
leaves 63 bits are an error.  A component whose eigenvalue is zero, or lost in
rounding, has null ``whitened``; a deviation beyond 63 bits is null.  Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import bounded_batches

#: Residues are below this and a product has so many rows: 2^20 * 2^20 * 2^13 = 2^53.
LARGEST_PRIME, PRODUCT_ROWS = 1 << 20, 1 << 13
#: Shares of the tasks whose sums of a key are added apart; the driver adds these.
LOTS = 16
#: An eigenvalue below this share of the trace says nothing.
LOST = 1e-13


def primes(bound: int) -> list[int]:
    """The largest primes below 2^20 whose product exceeds ``bound``, falling."""
    sieve = np.ones(LARGEST_PRIME, bool)
    sieve[:2] = False
    for k in range(2, isqrt(LARGEST_PRIME) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    out: list[int] = []
    for p in np.flatnonzero(sieve)[::-1]:
        if prod(out) > bound:
            break
        out.append(int(p))
    return out


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: its integers' sums, components as columns, and how well they do."""

    scale: float
    offset: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    spread: int
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _held(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a column of double arrays that take part; all their entries in order; their lengths."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    entry_ok = np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(column)), size)
    bad = np.bincount(row[~entry_ok], minlength=len(column))
    ok = (size > 0) & (bad == 0)
    if dimension is not None:
        ok &= size == dimension
    return np.flatnonzero(ok), flat.fill_null(0.0).to_numpy(zero_copy_only=False)[ok[row]], size[ok]


def integers(values: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.floor(values * scale).astype(np.int64) + offset


def _vectors(df: DataFrame, vector_col: str, *others: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.select(*(F.col(c) for c in others), F.col(vector_col).cast("array<double>").alias("vector"))


def _shape(vectors: DataFrame, scale: float) -> tuple[int, int, float, float] | None:
    """Commonest length, how many have it, and the least and largest scaled entry of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values, size = _held(batch.column(0))
            if len(size):
                at = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(np.minimum.reduceat(values, at) * scale), pa.array(np.maximum.reduceat(values, at) * scale)], names=["size", "low", "high"])

    found = vectors.mapInArrow(K.lean(run), "size long, low double, high double").groupBy("size").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = found.orderBy(F.desc("n"), F.desc("size")).first()
    return tuple(best) if best else None


def _summed(parts: DataFrame, schema: str, tasks: int) -> list:
    """Rows (key, sums array), equal keys of several tasks added; as many rows as there are keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = values.values.to_numpy(zero_copy_only=False)
                total[key] = total[key] + row if key in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), batch.schema.field(1).type)], names=["key", "sums"])

    return parts.repartition(tasks, "key").mapInArrow(K.lean(run), schema).collect()


def scatter(vectors: DataFrame, dimension: int, scale: float, offset: int, moduli: list[int]) -> np.ndarray:
    """Exact (d + 1, d + 1) integers: the scatter of all vectors, their sums, and their count in the last cell."""
    d, schema = dimension, "key long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), d + 1, d + 1), np.int64)
        for batch in batches:
            _, values, _ = _held(batch.column(0), d)
            x = integers(values, scale, offset).reshape(-1, d)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
            for a in range(0, len(x), PRODUCT_ROWS):
                for k, p in enumerate(moduli):
                    residues = (x[a : a + PRODUCT_ROWS] % p).astype(np.float64)
                    total[k] = (total[k] + (residues.T @ residues).astype(np.int64)) % p
        if total.any():
            # a row of a matrix is a key, once for each lot of tasks
            lot = TaskContext.get().partitionId() % LOTS
            keys = np.arange(len(moduli) * (d + 1)) + lot * len(moduli) * (d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(total.reshape(-1, d + 1)), pa.list_(pa.int64()))], names=["key", "sums"])

    lots = _summed(vectors.mapInArrow(K.lean(run), schema), schema, 32)
    total = np.zeros((len(moduli) * (d + 1), d + 1), object)
    for r in lots:
        total[r["key"] % len(total)] += np.array(r["sums"], object)
    total = total.reshape(len(moduli), d + 1, d + 1)
    whole = prod(moduli)
    out = sum(total[k] % p * (whole // p * pow(whole // p, -1, p)) for k, p in enumerate(moduli)) % whole
    return np.where(out > whole // 2, out - whole, out)


def _components(exact: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors of the covariance as columns, their values, falling, and its trace."""
    n, sums = int(exact[-1, -1]), exact[-1, :-1]
    squared = n * n
    # integers over an integer: each entry is rounded once
    v = np.array([[int(n * exact[i, j] - sums[i] * sums[j]) / squared for j in range(len(sums))] for i in range(len(sums))])
    _, first = np.linalg.eigh(v)
    left = first.T @ v @ first
    values, second = np.linalg.eigh((left + left.T) / 2)
    vectors = (first @ second)[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    trace = sum(int(n * exact[i, i] - sums[i] ** 2) for i in range(len(sums))) / squared
    return vectors, values[::-1][:most], trace


def _projected(values: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows; a component of no spread is NaN."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([s % model.n / model.n for s in model.sums])
    centred = (integers(values, model.scale, model.offset).reshape(-1, model.dimension) - whole) - part
    with np.errstate(divide="ignore", invalid="ignore"):
        return centred @ model.vectors / np.sqrt(model.values)


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> Whitening | None:
    """The whitening of all vectors that take part; None if none does."""
    vectors = _vectors(df, vector_col)
    shape = _shape(vectors, scale)
    if shape is None:
        return None
    d, n, low, high = shape
    if max(abs(low), abs(high)) + abs(offset) >= 2.0**62:
        raise ValueError("scaled entries don't fit a long")
    largest = max(abs(int(np.floor(low)) + offset), abs(int(np.floor(high)) + offset), 1)
    exact = scatter(vectors, d, scale, offset, primes(2 * n * largest * largest))
    directions, eigenvalues, trace = _components(exact, min(components, d))
    lost = eigenvalues <= LOST * trace
    model = Whitening(scale, offset, n, [int(s) for s in exact[-1, :-1]], directions, np.where(lost, np.nan, eigenvalues), eigenvalues / trace if trace else np.full(len(eigenvalues), np.nan), int(np.floor(high)) - int(np.floor(low)))
    error = _identity_error(vectors, model)
    return Whitening(**(model.__dict__ | {"identity_error": error}))


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    live = np.flatnonzero(~np.isnan(model.values))
    if not len(live):
        return None
    k, schema = len(live), "key long, sums array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, values, _ = _held(batch.column(0), model.dimension)
            w = _projected(values, model)[:, live]
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        lot = TaskContext.get().partitionId() % LOTS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1) + lot * (k + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["key", "sums"])

    total = np.zeros((k + 1, k))
    for r in sorted(_summed(vectors.mapInArrow(K.lean(run), schema), schema, 32)):
        total[r["key"] % (k + 1)] += r["sums"]
    mean = total[k] / model.n  # zero but for rounding: the vectors were centred first
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(values: np.ndarray, model: Whitening) -> pa.Array:
    """Exact sums of (n * x - S)^2 over the entries of each vector."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = [s % model.n for s in model.sums]
    y = integers(values, model.scale, model.offset).reshape(-1, model.dimension) - whole
    if model.dimension * (model.n * (model.spread + 2)) ** 2 < 1 << 63:
        return pa.array(((model.n * y - np.array(rest, np.int64)) ** 2).sum(1))
    wide = [sum((model.n * a - b) ** 2 for a, b in zip(row, rest)) for row in y.tolist()]
    return pa.array([x if x < 1 << 63 else None for x in wide], pa.int64())


def whitened(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every row that takes part."""
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>"
    vectors = _vectors(df, vector_col, id_col)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, _ = _held(batch.column(1), model.dimension)
            if not len(rows):
                continue
            w = _projected(values, model)
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _deviations(values, model), pa.ListArray.from_arrays(offsets, flat)], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(K.lean(run), schema)


def components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """A row for each vector that takes part and each of its ``most`` first components."""
    model = fit(df, vector_col, most)
    found = whitened(df, model, id_col, vector_col)
    said = [None if np.isnan(x) else float(x) for x in model.explained] if model else []
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.lit(said).cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
