"""Rows of an embeddings table that take part in vector operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that a task turns into one matrix, and elements of it.
BLOCK_ROWS = 16_384
BLOCK_CELLS = 4_000_000


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    inf = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def usable(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows with finite vectors, and the vectors' length.

    All vectors of a table should have one length.  Where they don't, the length of most rows holds
    (the greater of two as frequent), and rows of another length are dropped.
    """
    kept = embeddings.filter(finite(vector))
    lengths = kept.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    return kept.filter(F.size(vector) == width), width


def scaled(matrix: np.ndarray, factor: int, bound: int) -> np.ndarray:
    """Whole numbers ``floor(factor * x)``, held within the bound either way."""
    return np.clip(np.floor(matrix.astype(np.float64) * factor), -bound, bound).astype(np.int64)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined to at most ``BLOCK_ROWS`` rows or ``BLOCK_CELLS`` components."""
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(width, 1)))
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            if rows + piece.num_rows > most:
                yield pa.concat_batches(held)
                held, rows = [], 0
            held.append(piece)
            rows += piece.num_rows
    if rows:
        yield pa.concat_batches(held)
