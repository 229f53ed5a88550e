"""Whitened embeddings: blockwise QR of the centred rows, then a bidiagonal qd solver.

Every task reduces its centred rows to one triangular factor, and factors are stacked and reduced
again in a tree of tasks, so the covariance is never squared up and no task or driver holds more
than a few factors of width x width.  The last one is solved on the driver (``bidiagonal``); its size
depends on the width of a vector alone.

Rows are dropped if the vector is null or holds null or non-finite entries (see ``vectors`` for vectors
of several lengths).  Entries become ``floor(64 * c) + 1000000``, held within +-2^36 before the shift.  A
direction without spread (at most 1e-13 of the largest variance times the width) can't be whitened and
has no rows.  Rows that repeat an id, or have none, are each whitened for themselves; further columns are
ignored; an empty table, or one without spread, gives no rows.  ``deviation`` is null where it doesn't fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_vectors
from .common import mapped, record
from .vectors import blocks, matrix_of, scaled, usable

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BOUND = 1 << 36
# Factors that one task stacks.
FAN = 16
SPREAD = 1e-13

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                     ("whitened", pa.float64()), ("explained", pa.float64())])


def _x(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return scaled(matrix_of(batch.column("v"), width), SCALE, BOUND) + SHIFT


def totals(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    schema = pa.schema([("at", pa.int32()), ("total", pa.int64())])

    def run(batches):
        sums = np.zeros(width + 1, dtype=np.int64)
        for batch in blocks(batches, width):
            sums[:-1] += _x(batch, width).sum(axis=0)
            sums[-1] += batch.num_rows
        yield record(schema, at=pa.array(np.arange(width + 1, dtype=np.int32)), total=pa.array(sums))

    parts = mapped(rows, run, "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["at"]: int(r["total"]) for r in parts.collect()}
    return found.get(width, 0), [found.get(j, 0) for j in range(width)]


def triangle(rows: DataFrame, width: int, mean: np.ndarray) -> np.ndarray:
    """The triangular factor of all centred rows."""
    schema = pa.schema([("task", pa.int64()), ("r", pa.binary())])

    def reduced(held: np.ndarray, more: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([held, more]), mode="r")
        return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r

    def local(batches):
        r = np.zeros((width, width))
        for batch in blocks(batches, width):
            r = reduced(r, _x(batch, width) - mean)
        yield record(schema, task=[TaskContext.get().partitionId()], r=[r.tobytes()])

    def stacked(batches):
        r = np.zeros((width, width))
        for batch in batches:
            for other in batch.column("r").to_pylist():
                r = reduced(r, np.frombuffer(other).reshape(width, width))
        yield record(schema, task=[TaskContext.get().partitionId()], r=[r.tobytes()])

    factors, tasks = mapped(rows, local, "task long, r binary"), rows.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        factors = mapped(factors.repartition(tasks, F.pmod("task", F.lit(tasks))), stacked, "task long, r binary")
    r = np.zeros((width, width))
    for row in factors.orderBy("task").toLocalIterator():
        r = reduced(r, np.frombuffer(bytes(row["r"])).reshape(width, width))
    return r


def spread_error(rows: DataFrame, width: int, mean: np.ndarray, directions: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = directions.shape[1]
    schema = pa.schema([("at", pa.int32()), ("total", pa.float64())])

    def run(batches):
        sums = np.zeros((k + 1, k))
        for batch in blocks(batches, width):
            y = (_x(batch, width) - mean) @ directions
            sums[:k] += y.T @ y
            sums[k] += y.sum(axis=0)
        yield record(schema, at=pa.array(np.arange(sums.size, dtype=np.int32)), total=pa.array(sums.reshape(-1)))

    parts = mapped(rows, run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros((k + 1) * k)
    sums[[r["at"] for r in parts]] = [r["total"] for r in parts]
    sums = sums.reshape(k + 1, k) / n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2, null where it exceeds a long."""
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True))
    if most < 1 << 63 and max(map(abs, [*(n * a for a in low), *(n * b for b in high), *sums])) < 1 << 63:
        off = x * n - np.array(sums, dtype=np.int64)
        return pa.array((off * off).sum(axis=1))
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component."""
    kept, width = usable(embeddings, vector)
    rows = kept.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    n, sums = totals(rows, width) if width else (0, [])
    values, vectors = np.zeros(0), np.zeros((0, 0))
    if n:
        mean = np.array([s / n for s in sums])
        values, vectors = right_vectors(triangle(rows, width, mean))
    shown = [k for k, v in enumerate(values[:components]) if v > SPREAD * width * values[0]]
    if not shown:
        return embeddings.sparkSession.createDataFrame([], _OUT + ", identity_error double")
    variance = values / n
    directions = vectors[:, shown] / np.sqrt(variance[shown])
    explained = (variance[shown] / variance.sum()).tolist()
    error = spread_error(rows, width, mean, directions, n)

    def run(batches):
        k = len(shown)
        for batch in blocks(batches, width):
            x = _x(batch, width)
            m = len(x)
            yield record(_SCHEMA, vec_id=batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                         component=pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), n=pa.array(np.full(m * k, n)),
                         deviation=deviations(x, n, sums).take(pa.array(np.repeat(np.arange(m), k))),
                         whitened=pa.array(((x - mean) @ directions).reshape(-1)), explained=pa.array(np.tile(explained, m)))

    return mapped(rows, run, _OUT).withColumn("identity_error", F.lit(error))
