"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sql import DIGITS


def rounded(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Round every double as the SQL side does; counts become long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = (F.round(c, DIGITS.get(name, 4) if digits is None else digits) + F.lit(0.0))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)
