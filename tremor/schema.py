"""Canonical position schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Canonical field names, types, required flags and defaults.
FIELDS: tuple[tuple[str, T.DataType, bool, object], ...] = (
    ("account", T.StringType(), True, None),
    ("master_account", T.StringType(), False, None),
    ("desk", T.StringType(), False, "UNASSIGNED"),
    ("firm", T.StringType(), False, "FIRM"),
    ("underlying", T.StringType(), True, None),
    ("sector", T.StringType(), False, "Unclassified"),
    ("industry", T.StringType(), False, "Unclassified"),
    ("instrument_type", T.StringType(), False, None),
    ("strike", T.DoubleType(), False, 0.0),
    ("expiry", T.StringType(), False, "-"),
    ("right", T.StringType(), False, "-"),
    ("contract", T.StringType(), False, None),
    ("qty", T.DoubleType(), True, None),
    ("multiplier", T.DoubleType(), False, None),
    ("underlying_price", T.DoubleType(), True, None),
    ("iv", T.DoubleType(), False, 0.0),
    ("dte", T.DoubleType(), False, None),
    ("rate", T.DoubleType(), False, 0.042),
    ("div_yield", T.DoubleType(), False, 0.0),
    ("sigma_daily", T.DoubleType(), False, None),
)


@dataclass(frozen=True)
class Field:
    name: str
    dtype: T.DataType
    required: bool
    default: object


BY_NAME: dict[str, Field] = {row[0]: Field(*row) for row in FIELDS}
REQUIRED: tuple[str, ...] = tuple(f.name for f in BY_NAME.values() if f.required)

# Pivot dimensions by axis, measures, and the names that exist
# only on an aggregate.
ACCOUNT_DIMENSIONS = ("firm", "desk", "master_account", "account")
INSTRUMENT_DIMENSIONS = (
    "sector", "industry", "underlying", "instrument_type",
    "expiry", "strike", "right", "contract",
)
DIMENSIONS = ACCOUNT_DIMENSIONS + INSTRUMENT_DIMENSIONS
ACCOUNT_DRILL = ("desk", "master_account", "account", "underlying", "contract")
INSTRUMENT_DRILL = ("sector", "industry", "underlying", "contract", "account")
MEASURES = ("market_value", "und_qty", "delta", "gamma", "vega", "theta", "rho")
GREEKS = ("delta", "gamma", "vega", "theta", "rho")
AGGREGATE_ONLY = ("positions", "worst", "worst_idx")
DERIVED = ("mark",) + MEASURES

# Columns the valuation reads.
VALUATION_INPUTS = (
    "underlying_price", "strike", "dte", "rate", "div_yield",
    "iv", "is_call", "qty", "multiplier", "is_option",
)

# Trading days per year, scaling a daily deviation to a year.
TRADING_DAYS = 252.0
