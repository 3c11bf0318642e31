"""Embedding whitening by a cyclic Jacobi eigensolver.

Entries become integers, so a dimension's sum is exact.  Tasks add up the centred scatter of their
rows, of which Spark sums a value for each pair of dimensions; the driver, which holds a matrix of
dimensions and no rows, rotates pairs of dimensions until no off-diagonal entry counts against its
two diagonal entries, which keeps small eigenvalues accurate too.  Pairs are taken in cyclic
order, as many at a time as share no dimension: such rotations commute.  The whitening
matrix, eigenvectors by falling eigenvalue over the eigenvalues' roots, is broadcast, and rows are projected
in tasks.  The covariance of what comes out is taken again from the whitened rows, by Spark.

Edge cases: vectors that are null, or hold a null, an infinite or a not-a-number entry, are dropped; so are
those with an entry beyond ``RANGE``, which has no long form, and those that do not have the commonest number of
dimensions (of equally common ones the larger counts).  Rows that repeat are rows of their own; null
ids stay null.  Directions without variance (an eigenvalue under ``NOISE`` of the trace) have
no whitened form and no rows; if none is left, or the table is empty, the result is empty.
Other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded_batches, materialize, slices

SCALE, SHIFT = 1024, 100_000
#: Largest absolute entry that is taken.
RANGE = float(1 << 40)
#: Share of the trace below which an eigenvalue is rounding.
NOISE = 1e-13
#: Rows of a work array, and bits of the lower part of a number when it is summed.
ROWS, LOW = 1024, 26


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, by falling eigenvalue."""
    a, d = np.array(matrix, np.float64), len(matrix)
    vectors, eps = np.eye(d), np.finfo(np.float64).eps
    ring = list(range(d + d % 2))  # with an odd number one sits out in turn
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(p, q) for p, q in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(p, q) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            off, one, two = a[p, q], a[p, p], a[q, q]
            counts = np.abs(off) > eps * np.sqrt(np.abs(one * two))
            if not counts.any():
                continue
            turned = True
            p, q, off, one, two = (x[counts] for x in (p, q, off, one, two))
            ratio = (two - one) / (2 * off)
            t = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(ratio, 1))
            c = 1 / np.hypot(t, 1)
            s = c * t
            rows = a[p], a[q]
            a[p], a[q] = c[:, None] * rows[0] - s[:, None] * rows[1], s[:, None] * rows[0] + c[:, None] * rows[1]
            for m in (a, vectors):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = one - t * off, two + t * off
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[:, order]
    # Either sign is right: the largest entry is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]) if d else np.ones(0)
    return np.diag(a)[order], vectors * signs


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= RANGE)), F.lit(False))


def _blocks(batches, column: int, d: int):
    """Of each slice, the batch and its integers, (rows, d)."""
    for batch in slices(batches, ROWS):
        c = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        yield batch, np.floor(SCALE * c).astype(np.int64) + SHIFT


def column_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension's integers."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, 0, d):
            n += len(x)
            high += (x >> LOW).sum(axis=0)
            low += (x & ((1 << LOW) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = rows.select("v").mapInArrow(run, "i int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), *exact).collect(), key=lambda r: r["i"])  # a row a dimension
    return (int(found[0]["n"]) if found else 0), [(int(r["high"]) << LOW) + int(r["low"]) for r in found]


class Centre:
    """The mean as whole and rest, so that integers lose nothing when it is taken off."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.over = [s % n for s in sums]
        self.rest = np.array([float(Fraction(r, n)) for r in self.over])

    def apart(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Each row's sum over dimensions of ``(n x - S)^2``, exact."""
        apart = x - self.whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        wide = most * most * x.shape[1] >= 1 << 62
        y = (apart.astype(object) if wide else apart) * self.n - np.array(self.over, object if wide else np.int64)
        return pa.array([int(v) for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))


def scatter(rows: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """The covariance: sums of products of centred integers over the number of rows."""
    i, j = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for _, x in _blocks(batches, 0, d):
            y = centre.apart(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    parts = rows.select("v").mapInArrow(run, "i int, j int, v double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row for each pair of dimensions
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / centre.n
    return out


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``; ``deviation`` is a decimal."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    empty = spark.createDataFrame([], schema)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return empty
    d = sizes["d"]
    rows = rows.where(F.size("v") == d)
    n, sums = column_sums(rows, d)
    centre = Centre(n, sums)
    values, axes = jacobi(scatter(rows, d, centre))
    trace = math.fsum(values)
    kept = min(components, int((values > NOISE * trace).sum()))
    if not kept:
        return empty
    matrix = spark.sparkContext.broadcast((axes[:, :kept] / np.sqrt(values[:kept]), centre))

    def run(batches):
        axes, centre = matrix.value
        for batch, x in _blocks(batches, 1, d):
            w = pa.FixedSizeListArray.from_arrays(pa.array((centre.apart(x) @ axes).reshape(-1)), kept).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), centre.deviations(x), w], names=["vec_id", "deviation", "w"])

    white = materialize(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>"), "white")
    pairs = [(a, b) for a in range(kept) for b in range(a, kept)]
    got = white.agg(*(F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in pairs)).first()
    error = max(abs(c - (a == b)) for c, (a, b) in zip(got, pairs, strict=True))
    shares = F.array(*(F.lit(float(v / trace)) for v in values[:kept]))
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
