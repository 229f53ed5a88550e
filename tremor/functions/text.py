"""Text forms of numbers, safe for large values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(c: Column) -> Column:
    """``900.0``, ``147.5``: never the exponent form a plain cast may give."""
    whole = (c == F.round(c, 0)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(
        c.cast("string"))


def strike_label(c: Column) -> Column:
    """``150`` for a whole strike, ``147.5`` or ``147.25`` for a fractional one."""
    fraction = F.regexp_replace(F.round(c, 2).cast("decimal(38,2)").cast("string"), "0+$", "")
    return F.when(c == F.round(c, 0), c.cast("decimal(38,0)").cast("string")).otherwise(fraction)


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text, numbers in plain notation."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return number_text(c)
    return c.cast("string")
