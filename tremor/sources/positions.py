"""Prepared position files: already canonical, Parquet or CSV."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BY_NAME, TRADING_DAYS
from .text import read_source

_EXTRA = {"position_id": "bigint", "is_option": "boolean", "is_call": "boolean"}


def read_positions(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Canonical positions with ``sigma_daily``.

    Without a supplied deviation, implied volatility stands in.
    """
    kind = file_format or ("parquet" if str(path).rstrip("/").endswith(".parquet") else "csv")
    df = read_source(spark, path, kind)
    if kind == "csv":
        types = {n: f.dtype.simpleString() for n, f in BY_NAME.items()} | _EXTRA
        df = df.select(*[
            (F.col(f"`{c}`").try_cast(types[c]) if c in types else F.col(f"`{c}`")).alias(c)
            for c in df.columns])
    return with_sigma_from_vol(df)


def with_sigma_from_vol(df: DataFrame) -> DataFrame:
    if "sigma_daily" in df.columns:
        return df
    return df.withColumn(
        "sigma_daily", F.greatest(F.col("iv"), F.lit(0.01)) / F.lit(math.sqrt(TRADING_DAYS)))
