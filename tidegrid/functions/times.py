"""Exact arithmetic on instants as integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND


def floor_div(c: Column, n: Column | int) -> Column:
    """c / n rounded down, in integers; n is above 0. Exact for every bigint, also below 0."""
    by = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", c - F.pmod(c, by), by)


def day_number(ts: Column) -> Column:
    """UTC day number of a timestamp, counted from 1970-01-01."""
    return floor_div(F.unix_micros(ts), DAY).cast("int")
