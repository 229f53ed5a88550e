"""Session helpers shared by readers, writers and streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a job or its analysis may raise: some executor errors arrive unconverted.
SPARK_ERRORS = (PySparkException, Py4JJavaError)
# A side is broadcast on request only below this many rows.
BROADCAST_ROWS = 1_000_000
# Rows of an Arrow batch of positions.
PRICED_ROWS = 10_000


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide plans want; call it once per session.

    The JVM does not compile methods above 8000 bytes of bytecode, so a fused
    span beyond that runs interpreted.  Splitting such spans is about twice as fast.
    Shuffle files are deleted when the query that wrote them ends, not when the driver's
    garbage collector happens to find them unused: a sequence of jobs needs the disk of its largest.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    return arrow_rows(spark, PRICED_ROWS)


def arrow_rows(spark: SparkSession, rows: int) -> SparkSession:
    """Rows of an Arrow batch on its way to Python, for whatever this session runs from now on.

    Wide numeric rows want many, rows of whole texts few; both set it before they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a single-process master (``local`` or ``local[n]``) may leave it unset: its driver is its
    only executor, so a temporary folder is shared by all there is.  Any other master must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="tremor-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# The folder of the work area that is open in this thread, if one is.
_area: ContextVar[str | None] = ContextVar("area", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_area.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, for calls on it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Put a file or folder under another name, in one step; the folders above it are made."""
    fs, p = hadoop(spark, path)
    _, target = hadoop(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not become {to}")


@contextmanager
def work_area(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside the block, under fresh paths, are deleted at its end.

    Frames that read them are of no use after it: what is to stay goes to a path named before.
    """
    folder = fresh_path(spark, "area")
    outer = _area.set(folder)
    try:
        yield
    finally:
        _area.reset(outer)
        delete_path(spark, folder)


def outcome(spark: SparkSession, name: str, made: Callable[[], DataFrame]) -> DataFrame:
    """What ``made`` gives, written and read back; whatever was written on the way there is deleted."""
    path = fresh_path(spark, name)
    with work_area(spark):
        df = made()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a frame to the shared folder and reading it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``written`` for the length of the block; the table is deleted at its end."""
    path = fresh_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_path(df.sparkSession, path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than there are cores.

    Pricing is processor bound, so a scan of one split must not pin it to one task.  A split is
    at most ``spark.sql.files.maxPartitionBytes``, so what is shuffled here is bounded by that
    size times the cores; a scan of more splits, however few its files, passes through.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
