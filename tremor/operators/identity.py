"""Dense row ids in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, written


def with_position_id(df: DataFrame, out: str = "position_id",
                     per_file: bool = False) -> DataFrame:
    """Number the rows of a file scan 0..n-1 in file order, or per file.

    ``df`` must be a scan (projections and filters on top are fine).  Within a
    file split the scan order is the file order, so a row's id is its split's
    offset plus its place in the split.  Only one row per split is aggregated;
    the data itself is neither sorted nor shuffled, and a lost task renumbers
    its splits the same way.  The offsets, a row a split, are written once; the
    join broadcasts them while they are few.
    """
    keep = df.columns
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )
    splits = tagged.groupBy("__file", "__block").agg(
        F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    order = (Window.partitionBy("__file").orderBy("__block") if per_file
             else Window.orderBy("__file", "__block"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "__file", "__block",
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    offsets = small(written(offsets, "splits"))
    return tagged.join(offsets, ["__file", "__block"]).select(
        *keep, (F.col("__seq") + F.col("__shift")).alias(out))
