"""Embedding whitening: centred scatter by Spark, cyclic Jacobi on the driver, projections by Spark.

Entries become whole numbers x = floor(1024 c) + 100000, so counts and sums are exact. Tasks sum products of centred rows,
Spark adds these up cell by cell, and the driver, which holds one matrix of dimensions by dimensions and no rows,
turns it by symmetric Jacobi rotations until every off-diagonal entry vanishes beside its diagonal ones, which
keeps small eigenvalues accurate. Eigenvectors, sorted, scaled and broadcast, whiten all rows.

A vector that is null, empty or holds null or non-finite entries takes no part, nor one of another length than most (of
equally many the greater length), nor one with an entry beyond 2^30, whose sums would not be exact. Null vec_ids and
repeated rows stay. A component without variance (less than the rounding of the whole) has null whitened
values and no part in identity_error, which is null if no component has variance. A deviation beyond a
long is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_columns

# Steps of an entry's unit, what is added, components.
STEPS, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries beyond take no part.
LARGEST = float(1 << 30)
#: Rows that are worked on together.
AT_ONCE = 4096
EPS = float(np.finfo(np.float64).eps)


def whole_rows(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that may take part, and a matrix of these as whole numbers."""
    vectors = batch.column("embedding")
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    c = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    row = np.repeat(np.arange(len(length)), length)
    firm = (length > 0) & (np.bincount(row[~(np.abs(c) <= LARGEST)], minlength=len(length)) == 0)
    out = {}
    for size in np.unique(length[firm]).tolist():
        at = firm & (length == size)
        out[size] = (np.flatnonzero(at), np.floor(c[at[row]].reshape(-1, size) * STEPS).astype(np.int64) + SHIFT)
    return out


def matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and vectors of `size` whole numbers, in runs of at most AT_ONCE rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            if size in (found := whole_rows(part)):
                yield part.column("vec_id").take(pa.array(found[size][0])), found[size][1]


@dataclass
class Sums:
    """Of the vectors that take part: how many, and the sum of each dimension."""

    n: int
    total: np.ndarray  # of Python's whole numbers

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) // self.n + (int(s) % self.n) / self.n for s in self.total], dtype=np.float64)


def sums(vectors: DataFrame) -> Sums | None:
    """None if no vector takes part. A task gives a row of sums for each length of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for size, (at, x) in whole_rows(batch).items():
                held = found.setdefault(size, [0, np.zeros(size, dtype=np.int64)])
                held[0] += len(at)
                held[1] += x.sum(axis=0)
        for size, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n]), pa.array([total], pa.list_(pa.int64()))], names=["size", "n", "total"])

    part = map_batches(vectors, run, "size int, n long, total array<long>")
    each = part.select("size", "n", F.posexplode("total").alias("at", "s")).groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = each.where("at = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return None
    cells = each.where(F.col("size") == most[0]["size"]).select("at", "s").collect()  # one for each dimension
    return Sums(most[0]["n"], np.array([int(r["s"]) for r in sorted(cells, key=lambda r: r["at"])], dtype=object))


def added_up(partial: DataFrame, size: int) -> np.ndarray:
    """The sum of symmetric matrices given by rows (i, values from the diagonal on), cell by cell."""
    cells = partial.select("i", F.posexplode("tail").alias("at", "v")).groupBy("i", "at").agg(F.sum("v").alias("v")).collect()  # a cell for each two dimensions
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["i"] + r["at"]] = out[r["i"] + r["at"], r["i"]] = r["v"]
    return out


def tails(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = pa.array([r[i:] for i, r in enumerate(matrix)], pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(range(len(matrix)), pa.int32()), rows], names=["i", "tail"])


def scatter(vectors: DataFrame, about: Sums, basis: np.ndarray | None = None) -> np.ndarray:
    """The covariance, with divisor n, of the rows or of their projections on the basis's columns; centred before multiplying."""
    mean, size = about.mean, len(about.total)
    width = size if basis is None else basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for _, x in matrices(batches, size):
            y = x - mean
            y = y if basis is None else y @ basis
            out += y.T @ y
        yield from tails(out)

    return added_up(map_batches(vectors, run, "i int, tail array<double>"), width) / about.n


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, whose largest entry is positive.

    Cyclic: each sweep turns every pair of rows and columns by the angle that makes their entry 0, until all are below
    rounding beside their diagonal entries.
    """
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    v = np.eye(d)
    nothing = EPS * EPS * max(float(np.trace(a)), 0.0)
    for _ in range(sweeps):
        still = True
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(a[p, q]) <= max(EPS * np.sqrt(abs(a[p, p] * a[q, q])), nothing):
                    continue
                still = False
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s, low, high = t * c, a[p, p] - t * a[p, q], a[q, q] + t * a[p, q]
                for m in (a, a.T, v):  # columns, then rows, then the vectors
                    left = m[:, p].copy()
                    m[:, p] = c * left - s * m[:, q]
                    m[:, q] = s * left + c * m[:, q]
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
        if still:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    return e[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    about: Sums
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray
    explained: np.ndarray
    error: float | None


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first components of all vectors (vec_id, embedding); None if none takes part."""
    about = sums(vectors)
    if about is None:
        return None
    v = scatter(vectors, about)
    e, axes = jacobi(v)
    trace = float(np.trace(v))
    firm = e > len(e) * EPS * trace
    k = min(components, len(e))
    full = int(firm[:k].sum())
    error = None
    if full:
        error = float(np.abs(scatter(vectors, about, axes[:, :full] / np.sqrt(e[:full])) - np.eye(full)).max())
    return Whitening(about, np.where(firm, e, 0.0)[:k], axes[:, :k], (np.maximum(e, 0.0) / trace if trace > 0 else np.zeros(len(e)))[:k], error)


def deviations(x: np.ndarray, about: Sums) -> list[int | None]:
    """The sum of (n x - S)^2 over the dimensions of each row, exactly; None beyond a long."""
    total = about.total
    bound = about.n * int(np.abs(x).max()) + max(abs(int(s)) for s in total)
    if bound < 1 << 62:
        d = about.n * x - total.astype(np.int64)
        if len(total) * int(np.abs(d).max()) ** 2 < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    exact = (sum((about.n * c - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for row in x.tolist())
    return [s if s < 1 << 63 else None for s in exact]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whitened(vectors: DataFrame, by: Whitening) -> DataFrame:
    """A row for each vector and component."""
    mean, k = by.about.mean, len(by.values)
    scale = np.array([1 / np.sqrt(e) if e > 0 else np.nan for e in by.values])
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("eigenvalue", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches, len(mean)):
            rows = len(x)
            z = ((x - mean) @ by.vectors * scale).ravel()
            each = pa.array(np.repeat(np.arange(rows), k))
            tile = lambda values: pa.array(np.tile(values, rows))
            columns = [
                ids.take(each), tile(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(rows * k, by.about.n)), pa.array(deviations(x, by.about), pa.int64()).take(each),
                pa.array(z, mask=np.isnan(z)), tile(by.explained), pa.array([by.error] * (rows * k), pa.float64()), tile(by.values),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(vectors, run, WHITENED)


def whitening(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id and whitened components of all vectors; three passes for the fit, one for the result, rows never move."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    by = fit(vectors, components)
    if by is None:
        return map_columns(vectors.select("vec_id").limit(0), lambda batches: iter(()), WHITENED)
    return whitened(vectors, by)
