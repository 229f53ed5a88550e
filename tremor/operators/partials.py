"""Sums of wide rows by several groupings at once.

Grouping sets copy every wide row once for each set before anything is added up.  Here a task
goes over its rows once: keys become dictionary codes, and for each grouping one add-reduce over
the columns gives sums for the codes met.  Only sums are shuffled, one row for each group that a
task met, and they are merged by an ordinary aggregate.  What a task holds is bounded: beyond
``HELD`` groups it hands on what it has and starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of all groupings together that a task holds.
HELD = 200_000


class _Sums:
    """Rows and sums by key, growing as keys are met."""

    def __init__(self, width: int):
        self.at: dict[tuple, int] = {}
        self.counts = np.zeros(64, dtype=np.int64)
        self.sums = np.zeros((64, width))

    def add(self, keys: list[tuple], counts: np.ndarray, sums: np.ndarray) -> None:
        places = np.array([self.at.setdefault(k, len(self.at)) for k in keys])
        while len(self.at) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.counts[places] += counts
        self.sums[places] += sums

    def batch(self, name: str, columns: Sequence[str]) -> pa.RecordBatch:
        n = len(self.at)
        keys = pa.array([list(k) for k in self.at], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()), keys, pa.array(self.counts[:n]), *(pa.array(self.sums[:n, j]) for j in range(len(columns)))],
            names=["grouping", "keys", "positions", *columns])


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    encoded = column.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def _grouped(coded: list[tuple[np.ndarray, list]], matrix: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Keys, rows and sums of one grouping of a batch."""
    together = np.zeros(len(matrix), dtype=np.int64)
    for codes, values in coded:
        together = together * len(values) + codes
    order = np.argsort(together, kind="stable")
    ordered = together[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    sums = np.add.reduceat(matrix[order], first, axis=0)
    picked = order[first]
    keys = list(zip(*([values[c] for c in codes[picked].tolist()] for codes, values in coded), strict=True))
    return keys, np.diff(np.append(first, len(order))), sums


def grouped_sums(df: DataFrame, groupings: Mapping[str, Sequence[str]], columns: Sequence[str], held: int = HELD) -> DataFrame:
    """``grouping, keys, positions`` and zero-safe sums of the columns, for every group of every grouping.

    A grouping has one or more columns of text; ``keys`` holds their values in order, null as a value.
    """
    names = list(dict.fromkeys(c for keys in groupings.values() for c in keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: _Sums(len(columns)) for g in groupings}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = {c: _coded(batch.column(c)) for c in names}
            matrix = np.empty((batch.num_rows, len(columns)))
            for j, c in enumerate(columns):
                matrix[:, j] = batch.column(c).to_numpy(zero_copy_only=False)
            for g, keys in groupings.items():
                sums[g].add(*_grouped([coded[c] for c in keys], matrix))
            if sum(len(s.at) for s in sums.values()) > held:
                yield from (s.batch(g, columns) for g, s in sums.items() if s.at)
                sums = {g: _Sums(len(columns)) for g in groupings}
        yield from (s.batch(g, columns) for g, s in sums.items() if s.at)

    shown = df.select(*names, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    schema = "grouping string, keys array<string>, positions long" + "".join(f", `{c}` double" for c in columns)
    merged = shown.mapInArrow(run, schema).groupBy("grouping", "keys").agg(
        F.sum("positions").alias("positions"), *[F.expr(f"sum(`{c}`) AS `{c}`") for c in columns])
    return merged
