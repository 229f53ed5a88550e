"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import BROADCAST_ROWS, arrow_rows, written

# A task takes at most this many texts in hand at once, and closes a hand early at this many characters.
HAND_ROWS = 256
HAND_CHARS = 2_000_000
# Rows of an Arrow batch on its way to a task's Python and back.
BATCH_ROWS = 2_000
# Bytes after which a batch on its way to Python is closed early.
BATCH_BYTES = 2 << 20
# Seconds without a task after which a worker forgets what it remembers of tokens.
IDLE = 3.0
# Parts of an array of counts that travel as rows of their own.
CHUNKS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hands(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of bounded rows and (but for one long text) bounded characters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = [x or 0 for x in _lengths(batch.column(text))]
        start, chars = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= HAND_ROWS or chars + n > HAND_CHARS):
                yield batch.slice(start, i - start)
                start, chars = i, 0
            chars += n
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def mapped(df: DataFrame, function: Callable, schema: str | StructType, tokens: bool = False) -> DataFrame:
    """``mapInArrow`` over whole partitions; the function gets and gives record batches.

    Batches hold whole texts, so they get fewer rows than Spark would give them.  Workers serve
    one operator after the other and stay when idle: unless the function encodes ``tokens``, it
    first frees what an earlier one has remembered of them, and memory goes back at its end.  What is
    remembered of tokens stays for the next task, but goes when none comes for ``IDLE`` seconds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _waiting:
            _waiting.pop().cancel()
        if not tokens:
            forget()
        yield from function(batches)
        release()
        if tokens:
            _waiting.append(threading.Timer(IDLE, _left))
            _waiting[-1].daemon = True
            _waiting[-1].start()

    arrow_rows(df.sparkSession, BATCH_ROWS).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def forget() -> None:
    """Drop the encoders of this worker, if it has any."""
    module = sys.modules.get(f"{__package__}.tokens")
    if module is not None and module.encoder.cache_info().currsize:
        module.encoder.cache_clear()
        gc.collect()


# The timer of this worker, if it waits for a next task.
_waiting: list[threading.Timer] = []


def _left() -> None:
    forget()
    release()


def release() -> None:
    """Give what this worker's allocators hold, but don't use, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the given columns in the order of the schema."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)


def fold_of(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null ids are in no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder can be set with TOKENIZERS_DIR."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def chunked(counts: np.ndarray) -> dict[str, list]:
    """Columns ``chunk`` and ``counts`` for a task's array of unsigned 32-bit counts."""
    return {"chunk": list(range(CHUNKS)), "counts": [part.tobytes() for part in counts.astype("<u4").reshape(CHUNKS, -1)]}


def added_up(made: DataFrame, size: int) -> np.ndarray:
    """The sum of the chunked count arrays of all tasks: added up in tasks, only the sum comes to the driver."""
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(counts, dtype="<u4").astype(np.uint64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield record(schema, chunk=list(sums), counts=[s.tobytes() for s in sums.values()])

    total = np.zeros((CHUNKS, size // CHUNKS), dtype=np.uint64)
    chunks = made.filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk")
    for row in mapped(chunks, run, "chunk int, counts binary").collect():
        total[row["chunk"]] += np.frombuffer(row["counts"], dtype=np.uint64)
    return total.reshape(-1)


def keyed(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id (null equal to null) is among ``ids``, or isn't (left_semi, left_anti).

    The ids are written once.  They are broadcast while they are few; else the join shuffles.
    """
    chosen = written(ids.distinct(), "ids").select(F.col("doc_id").alias("chosen_id"))
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["chosen_id"]), how)
