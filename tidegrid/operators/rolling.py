"""Rolling totals over trailing calendar periods.

Rows are reduced to one sparse total per entity and active day; idle days get
calendar rows between the entity's first and last active day; range frames over
integer day numbers give the trailing totals, and fixed denominators (the length
of the period) the averages. After the daily reduction an entity has at most one
row per day, so a hot entity is no larger than the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.text import is_number
from tidegrid.functions.times import day_number  # noqa: F401


def current_rows(df: DataFrame, grain: Sequence[Column | str], order: Sequence[str], value: str) -> DataFrame:
    """One value per grain: that of the greatest ``order`` (null least), ties by value (NaN greatest)."""
    top = F.max(F.struct(*order, F.col(value).alias("_value"))).alias("_top")
    return df.groupBy(*grain).agg(top).withColumn("value", F.col("_top._value")).drop("_top")


def daily_totals(rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """(entity, day, total, active): sums of the values of active days; null and NaN are no activity."""
    return rows.where(is_number(F.col("value"))).groupBy(*entity, "day").agg(F.sum("value").alias("total"), F.count("*").alias("active"))


def rolling_totals(daily: DataFrame, entity: Sequence[str], periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages of the trailing periods for every calendar day.

    ``daily``: one row per entity and active day (day as an integer number of
    days since 1970, total, active). Result: entity, day, total (0 on idle days),
    active (rows, 0 on idle days), and total_N and average_N = total_N / N for
    each period of N days ending with the day. An entity without active days
    has no rows; days before its first active day count as 0.
    """
    line = Window.partitionBy(*entity).orderBy("day")
    idle = F.sequence(F.col("day") + 1, F.col("_next") - 1)
    ahead = daily.withColumn("_next", F.lead("day").over(line))
    row = F.struct(F.col("day"), F.col("total"), F.col("active"))
    fill = F.when(F.col("_next") > F.col("day") + 1, F.transform(idle, lambda d: F.struct(d.alias("day"), F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("active"))))
    days = ahead.select(*entity, F.explode(F.concat(F.array(row), F.coalesce(fill, F.array().cast("array<struct<day:int,total:double,active:bigint>>")))).alias("d")).select(*entity, "d.*")
    out = days
    for n in periods:
        frame = line.rangeBetween(-(n - 1), 0)
        out = out.withColumn(f"total_{n}", F.sum("total").over(frame)).withColumn(f"average_{n}", F.col(f"total_{n}") / F.lit(float(n)))
    return out


def day_text(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def quiet_spells(rolled: DataFrame, short: int = 7, long: int = 30, floor: float = 1e-6, ratio: float = 0.5) -> DataFrame:
    """Idle days whose short average lies below ``ratio`` times a positive long average."""
    return rolled.where((F.col("active") == 0) & (F.col(f"total_{long}") > floor) & (F.col(f"average_{short}") < ratio * F.col(f"average_{long}")))
