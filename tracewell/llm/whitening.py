"""Whitening of embeddings: moments by Chan's merging, an eigenproblem on the driver, and a check of the result.

Each task goes over its rows in batches and keeps their count, mean and centred scatter, two
batches being merged by Chan's formula; the tasks' moments are merged in pairs by treeReduce.
What leaves a task is one matrix, whatever its rows, so no key can be hot.  Sums are kept as
whole numbers too.  The driver solves for eigenvectors of dims x dims; a second pass projects
all rows into a stored table, and the moments of that table, found alike, tell how far the
covariance of what was whitened is from the identity.

Entries become x = floor(1024 c) + 100000.  Rows without a vector, or with an entry that is
null, not finite, or of an absolute value of 2**21 or more (whose x would not be exact with
others'), are dropped.  Vectors that are not of the commonest length (of equally common ones
the greater), or empty, have no covariance with the others and are dropped too.  A direction
in which the rows do not vary (e no more than 1e-12 of the trace) cannot be whitened: whitened
is null there and explained is 0; identity_error is over the other directions, and null if
there is none.  Repeated rows, ids or none, count each.  An empty table gives an empty result.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import store

SCALE, SHIFT, MOST = 1024, 100_000, 2**21
ROWS_AT_ONCE = 4096
FLAT = 1e-12  # of the trace


@dataclass
class Moments:
    """Of vectors: how many, their mean, the centred scatter, and the sums as whole numbers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray  # of Python's whole numbers

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        away = x - mean
        return Moments(len(x), mean, away.T @ away, x.sum(axis=0).astype(object) if x.dtype.kind == "i" else np.zeros(x.shape[1], object))

    def with_(self, other: Moments) -> Moments:
        """Chan's formula for the union of two sets of rows."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n), self.sums + other.sums)

    @staticmethod
    def none(dims: int) -> Moments:
        return Moments(0, np.zeros(dims), np.zeros((dims, dims)), np.zeros(dims, object))


def moments(frame: DataFrame, dims: int, matrix) -> Moments:
    """Of all rows; matrix makes rows of an Arrow batch's first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments.none(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = matrix(batch.column(0).slice(at, ROWS_AT_ONCE))
                held = held.with_(Moments.of(x)) if len(x) else held
        yield pa.record_batch([pa.array([pickle.dumps(held)], pa.binary())], ["moments"])

    parts = frame.mapInArrow(run, "moments binary").rdd.map(lambda r: pickle.loads(r[0]))
    n = parts.getNumPartitions()
    if not n:
        return Moments.none(dims)
    return parts.treeReduce(Moments.with_, depth=max(2, math.ceil(math.log(n, 64))))


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """x of rows that are all of dims entries."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(-1, dims)


def doubles(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(embeddings: DataFrame, doc: str, vector: str) -> DataFrame:
    """vec_id and vector of rows that have one with finite entries."""
    rows = embeddings.select(F.col(doc).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < MOST)))  # no bound holds for NaN, the greatest of all


def deviations(z: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; null beyond a long."""
    if z.dtype == object or np.abs(z).max(initial=0) >= math.isqrt(2**62 // max(z.shape[1], 1)):
        exact = (reduce(lambda s, v: s + v * v, row, 0) for row in z.astype(object))
        return [s if s < 2**63 else None for s in exact]
    return (z * z).sum(axis=1).tolist()


def whiten(embeddings: DataFrame, doc: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each usable vector and component: its whitened coordinate, its deviation, and what holds for the whole table."""
    rows = usable(embeddings, doc, vector)
    lengths = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    dims = commonest["dims"] if commonest else 1
    rows = rows.where(F.size("vector") == dims)
    fit = moments(rows.select("vector"), dims, lambda v: whole(v, dims))
    n, k = fit.n, min(components, dims)
    values, vectors = np.linalg.eigh(fit.scatter / max(n, 1))
    values, basis = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = float(np.trace(fit.scatter)) / max(n, 1)
    full = values > FLAT * trace
    scaled = np.where(full, basis / np.sqrt(np.where(full, values, 1.0)), 0.0)
    context = embeddings.sparkSession.sparkContext
    sent = context.broadcast((n, fit.sums, scaled))  # dims x components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scaled = sent.value
        small = n * (MOST * SCALE + SHIFT) < 2**62
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = whole(part.column("vector"), dims)
                z = x * n - sums.astype(np.int64) if small else x.astype(object) * n - sums
                y = (z.astype(np.float64) / max(n, 1)) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k), pa.int32()), pa.array(y.ravel()))
                yield pa.record_batch([part.column("vec_id"), pa.array(deviations(z), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["vec_id"]
    table = store(rows.select("vec_id", "vector").mapInArrow(project, f"vec_id {kind}, deviation bigint, whitened array<double>"), "whitened")
    check = moments(table.select("whitened"), k, lambda v: doubles(v, k))
    away = np.abs(check.scatter / max(n, 1) - np.eye(k))[np.ix_(full, full)]
    error = float(away.max()) if away.size else None

    shares = F.array(*(F.lit(float(e / trace) if f else 0.0) for e, f in zip(values, full)))
    varies = F.array(*(F.lit(bool(f)) for f in full))
    long = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "y"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", F.when(F.get(varies, F.col("at")), F.col("y")).alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
