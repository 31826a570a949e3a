"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

Tasks sum the vectors, then the products of what is left after the mean is taken off. The scatter's
pivoted Cholesky factor L is rotated from the right until its columns are orthogonal: their squared
lengths are the eigenvalues and the columns, normalised, the components. The scatter itself is never
squared again or rotated, so small eigenvalues keep their digits. What goes to the driver
has the size of one covariance matrix; its cost depends on the dimension alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import release, staged
from sequela.llm.topk import integers
from sequela.llm.treequant import usual_length

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with L L' = ``scatter`` (rows in the given order), one column a rank; pivots are the largest left.

    Columns end where no pivot is left above rounding.
    """
    left = np.array(scatter, np.float64)
    d = len(left)
    limit = d * np.finfo(np.float64).eps * max(left.diagonal().max(initial=0.0), 0.0)
    columns = []
    for _ in range(d):
        at = int(left.diagonal().argmax())
        if not left[at, at] > limit:
            break
        column = left[:, at] / np.sqrt(left[at, at])
        columns.append(column)
        left -= np.outer(column, column)
        left[at, :] = left[:, at] = 0.0
    return np.array(columns).T.reshape(d, len(columns))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor @ factor.T``, falling, and its unit eigenvectors as columns, the
    largest entry of each positive. Pairs of columns are dealt as in a round robin, so those of a round are rotated together."""
    a = np.array(factor, np.float64)
    n = a.shape[1]
    ring = list(range(n + n % 2))  # one seat stays free if the number is odd
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(ring) - 1, 0)):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], ring[:half - 1:-1]) if max(p, q) < n]
            p, q = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1.0), 0.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= 4e-16:
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], a[:, order] / np.sqrt(np.where(values[order] > 0, values[order], 1.0))
    top = np.abs(vectors).argmax(0) if vectors.size else np.zeros(0, np.int64)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The last column's lists as rows."""
    column = batch.column(batch.num_columns - 1)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _sums(batches):
    total = None
    for batch in batches:
        if len(batch):
            part = _matrix(batch).sum(0)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "total"])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: in Python's integers where 64 bits do not hold it."""
    if float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0)) < 2.0**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _scatter(n: int, sums: np.ndarray):
    def run(batches):
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            if len(batch):
                y = (_centred(_matrix(batch), n, sums) / n).astype(np.float64)
                total += y.T @ y
        i, j = np.tril_indices(len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])
    return run


def _projected(n: int, sums: np.ndarray, axes: np.ndarray):
    def run(batches):
        for batch in batches:
            z = _centred(_matrix(batch), n, sums) if len(batch) else np.zeros((0, len(sums)), np.int64)
            w = (z / n).astype(np.float64) @ axes if len(batch) else np.zeros((0, axes.shape[1]))
            if float(np.abs(z).max(initial=0)) ** 2 * len(sums) < 2.0**62:
                far = pa.array((z * z).sum(1), pa.int64())
            else:
                exact = [int((r.astype(object) ** 2).sum()) for r in z]
                far = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * axes.shape[1]), pa.array(np.ascontiguousarray(w).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, flat], ["vec_id", "deviation", "w"])
    return run


def covariance_error(rows: DataFrame, column: str, many: int, n: int) -> float:
    """Largest absolute entry of the covariance of an array column of ``many`` entries, minus the identity."""
    if not many:
        return 0.0
    w = [F.col(column)[i] for i in range(many)]
    means = [m / n for m in rows.agg(*[F.sum(c) for c in w]).first()]
    pairs = [(i, j) for i in range(many) for j in range(i + 1)]
    found = rows.agg(*[F.sum((w[i] - means[i]) * (w[j] - means[j])) for i, j in pairs]).first()
    return max(abs(v / n - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component (from 1, by falling eigenvalue): ``vec_id, component, n, deviation, whitened,
    explained, identity_error``.

    Vectors that are null or empty, or hold null or non-finite components, are left out, and so are those
    whose length is not the most common one. Directions without variance (fewer than ``components`` are left,
    as with a single vector or only equal ones) have no rows. ``deviation`` is exact, and null where it does not fit 64 bits.
    Repeated or null vec_ids are rows like any others; other columns are not read.
    """
    x = F.transform(integers(F.col("embedding"), SCALE), lambda c: c + F.lit(SHIFT).cast("long"))
    rows = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("x IS NOT NULL"), "vectors")
    dim = usual_length(rows, "x") or 0
    rows_kept = rows.where(F.size("x") == dim)
    n = rows_kept.count()
    sums = np.zeros(dim, np.int64)
    for i, total in rows_kept.select("x").mapInArrow(_sums, "i int, total long").groupBy("i").agg(F.sum("total")).collect():
        sums[i] = total
    scatter = np.zeros((dim, dim))
    if n:
        parts = rows_kept.select("x").mapInArrow(_scatter(n, sums), "i int, j int, total double")
        for i, j, total in parts.groupBy("i", "j").agg(F.sum("total")).collect():
            scatter[i, j] = scatter[j, i] = total / n
    values, axes = jacobi(pivoted_cholesky(scatter))
    many = min(components, len(values))
    scaled = axes[:, :many] / np.sqrt(values[:many])
    wide = staged(rows_kept.mapInArrow(_projected(n, sums, scaled), "vec_id long, deviation long, w array<double>"), "whitened")
    release(rows)
    error = covariance_error(wide, "w", many, max(n, 1))
    trace = float(np.trace(scatter))
    explained = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values[:many]] or [F.lit(0.0)]), F.col("component"))
    long_ = wide.select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened")).withColumn("component", (F.col("p") + 1).cast("int"))
    return long_.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
