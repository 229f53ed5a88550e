"""Listed expiries and strike steps as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strike increments by underlying price.
STRIKE_BANDS = (10.0, 50.0, 100.0, 250.0, 1000.0)
STRIKE_STEPS = (0.5, 1.0, 2.5, 5.0, 10.0)
STRIKE_STEP_ABOVE = 50.0
# Tenors shorter than this many days trade weekly lines.
WEEKLY_BELOW = 30


def next_friday(day: Column) -> Column:
    """The first Friday on or after a day."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def third_friday(day: Column) -> Column:
    """The standard monthly expiry of a day's month."""
    return F.date_add(next_friday(F.trunc(day, "MM")), 14)


def listed_expiry(today: Column, tenor: Column) -> Column:
    """The listed date a tenor in days snaps to; always after today."""
    target = F.date_add(today, tenor.cast("int"))
    week = next_friday(target)
    weekly = F.when(week <= today, F.date_add(week, 7)).otherwise(week)
    month = third_friday(target)
    monthly = F.when(
        month <= today, third_friday(F.add_months(F.trunc(target, "MM"), 1))).otherwise(month)
    return F.when(tenor < WEEKLY_BELOW, weekly).otherwise(monthly)


def strike_step(price: Column) -> Column:
    """The strike increment for an underlying price."""
    step = F.lit(STRIKE_STEP_ABOVE)
    for band, size in reversed(list(zip(STRIKE_BANDS, STRIKE_STEPS))):
        step = F.when(price < band, F.lit(size)).otherwise(step)
    return step
