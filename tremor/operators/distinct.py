"""Distinct counts that can be folded: bitmaps over dictionary codes.

A distinct count cannot be added up from one level to the next, a set of values can.  Every value of a
detail dimension has a code from 1 on, written once (``dictionary``), and the values of a group are the
bits of a bitmap, cut into words of 64 codes, of which a group has only those that it needs: a fine group of
few values takes no more rows than it has values, and a word is combined and counted as a number.  A coarser
level is the union of the finer one's bitmaps, and so is a book of its batches, if they share a dictionary.
Counts are exact; a null is a value like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text
from ..session import small, written
from .pivot import count_column

# Codes in a bucket: the bits of a long.
WORD = 64


def dictionary(df: DataFrame, details) -> DataFrame:
    """``detail, value, code`` of every value of the given columns, written once; codes ascend with the values from 1.

    Values are ranged over tasks and numbered from the counts of the ranges before: no task has all values of a detail.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(d).alias("detail"), as_text(df, d).alias("value")) for d in details])).alias("p")
    ranged = df.select(pair).select("p.*").distinct().repartitionByRange("detail", F.asc_nulls_first("value")).sortWithinPartitions("detail", F.asc_nulls_first("value"))
    placed = written(ranged.select("detail", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "values")
    sizes = placed.groupBy("detail", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    earlier = sizes.select(F.col("detail").alias("d"), F.col("part").alias("p"), F.col("n").alias("m"))
    # One row for each detail and range: the rows before a range are those of the detail's earlier ranges.
    offsets = sizes.join(earlier, (F.col("detail") == F.col("d")) & (F.col("p") < F.col("part")), "left").groupBy("detail", "part", "first").agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    return written(placed.join(F.broadcast(offsets), ["detail", "part"]).select(
        "detail", "value", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("code")), "dictionary")


def bitmaps(df: DataFrame, keys, details, codes: DataFrame) -> DataFrame:
    """``*keys, detail, bucket, bitmap`` of every group.  ``codes`` is a dictionary that knows the values; it is broadcast while it is small.

    Details are written one after the other, so the disk on the way is that of one; ``df`` is read once for each.
    """
    return reduce(DataFrame.unionByName, [written(_words(df, keys, d, codes), "words") for d in details])


def _words(df: DataFrame, keys, detail: str, codes: DataFrame) -> DataFrame:
    rows = df.select(*keys, as_text(df, detail).alias("v")).distinct()
    coded = rows.join(small(codes.where(F.col("detail") == detail)), F.col("v").eqNullSafe(F.col("value")))
    return coded.groupBy(*keys, "detail", F.expr(f"code div {WORD}").alias("bucket")).agg(
        F.expr(f"bit_or(shiftleft(1L, int(code % {WORD})))").alias("bitmap"))


def folded(maps: DataFrame, keys) -> DataFrame:
    """The bitmaps of a coarser level, or of several frames put together: the union within each group."""
    return maps.groupBy(*keys, "detail", "bucket").agg(F.expr("bit_or(bitmap)").alias("bitmap"))


def counted(maps: DataFrame, keys, details) -> DataFrame:
    """``*keys`` and a count column for each detail, zero where a group has no value of it."""
    sizes = maps.groupBy(*keys, "detail").agg(F.sum(F.expr("bit_count(bitmap)")).alias("n"))
    return sizes.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("detail") == d, F.col("n"))), F.lit(0)).cast("long").alias(count_column(d)) for d in details])


def level_counts(maps: DataFrame, levels, details) -> DataFrame:
    """Counts of several levels, finest first, each folded from the one before: ``level`` and the keys as text, null where a level has none."""
    names = list(levels[0])
    parts = []
    for n, keys in enumerate(levels):
        if n:
            maps = written(folded(maps, keys), "bitmaps")
        counts = counted(maps, keys, details)
        parts.append(counts.select(F.lit(len(keys)).alias("level"), *[(as_text(counts, c) if c in keys else F.lit(None).cast("string")).alias(c) for c in names],
                                   *[count_column(d) for d in details]))
    return reduce(DataFrame.unionByName, parts)
