"""Irregular readings onto a regular grid.

The series of a source is cut into shards, one per source and UTC day. Each
shard is reduced to its occupied slots and to a summary of its first and last
reading; a prefix scan over the summaries carries the last known reading into
every shard; then the shards are filled independently of one another. Readings
are pre-aggregated by (source, day, slot) before any shuffle, so a source with
a third of all rows costs no more than its slots, and no window is larger than
a day of one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scan import carry_in
from tidegrid.functions.text import is_number, symbol_key
from tidegrid.functions.times import DAY, SECOND, floor_div
from tidegrid.session import bounded_broadcast, stage


def _grid(grid: DataFrame) -> DataFrame:
    """One row per normalised symbol; of several the least by period, open and close."""
    rows = grid.where(symbol_key(F.col("symbol")).isNotNull() & (F.col("period_seconds") > 0) & (F.col("close_second") > F.col("open_second")))
    one = rows.groupBy(symbol_key(F.col("symbol")).alias("_key")).agg(F.min(F.struct("period_seconds", "open_second", "close_second", "symbol")).alias("g"))
    return one.select("_key", "g.*").withColumn("_slots", F.floor((F.col("close_second") - F.col("open_second")) / F.col("period_seconds")).cast("int"))


def slot_readings(readings: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, grid) of the valid readings.

    Valid: ts_event not null, symbol in the grid, price above 0 and not NaN.
    Slots: (_key, day, slot, readings, _first, _last); slot is -1 for readings
    outside all slots; two readings at one instant are ordered by price.
    """
    g = _grid(grid)
    price = F.col("price")
    valid = readings.where(F.col("ts_event").isNotNull() & is_number(price) & (price > 0)).select(
        symbol_key(F.col("symbol")).alias("_key"), F.unix_micros("ts_event").alias("us"), "price"
    )
    at = valid.join(bounded_broadcast(g), "_key").withColumn("day", floor_div(F.col("us"), DAY).cast("int"))
    into = F.col("us") - F.col("day").cast("bigint") * DAY - F.col("open_second").cast("bigint") * 1_000_000
    slot = floor_div(into, F.col("period_seconds").cast("bigint") * SECOND).cast("int")
    at = at.withColumn("slot", F.when((slot >= 0) & (slot < F.col("_slots")), slot).otherwise(-1))
    slots = at.groupBy("_key", "day", "slot").agg(F.count("*").alias("readings"), F.min(F.struct("us", "price")).alias("_first"), F.max(F.struct("us", "price")).alias("_last"))
    return slots, g


def regular_shards(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per symbol of the grid and active day, with the day's readings.

    ``taken`` holds the occupied slots of the day in slot order (at most as many
    as the day has slots), ``summary`` the last reading, null for an idle day. A
    day is active if any symbol has a valid reading on it, in a slot or not.
    """
    slots, g = slot_readings(readings, grid)
    entry = F.struct("slot", "readings", F.col("_first.price").alias("first_price"), F.col("_last.us").alias("last_us"), F.col("_last.price").alias("last_price"))
    shards = stage(slots.groupBy("_key", "day").agg(F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, entry))).alias("taken")), "grid-shards")
    days = shards.select("day").distinct().agg(F.sort_array(F.collect_list("day")).alias("days"))  # an integer per active day
    active = g.withColumn("day", F.explode(days.scalar()))
    last = F.try_element_at("taken", F.lit(-1))
    return active.join(shards, ["_key", "day"], "left").withColumn("summary", F.when(last.isNotNull(), F.struct(last["last_us"].alias("us"), last["last_price"].alias("price"))))


def regularize(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """The regular series of every symbol of the grid on every active day.

    Columns: symbol (as in the grid), slot_start (epoch seconds), readings,
    first_price, last_price (null where the slot has none), price (the last
    reading known at the slot's end: the slot's own or one carried over earlier
    slots and days; null before the first), is_missing, filled_from (epoch
    microseconds of the reading that gives the price). Readings outside all
    slots carry nothing. No valid readings, or an empty grid: no rows.
    """
    carried = carry_in(regular_shards(readings, grid), ["_key"], "day", "summary", "_carry")
    taken = F.coalesce("taken", F.array().cast(carried.schema["taken"].dataType))
    every = F.sequence(F.lit(0), F.col("_slots") - 1)
    empty = F.transform(
        F.array_except(every, taken["slot"]),
        lambda s: F.struct(s.alias("slot"), F.lit(0).cast("bigint").alias("readings"), F.lit(None).cast("double").alias("first_price"), F.lit(None).cast("bigint").alias("last_us"), F.lit(None).cast("double").alias("last_price")),
    )
    spread = carried.select("symbol", "_key", "_block", "day", "open_second", "period_seconds", "_carry", F.explode(F.concat(taken, empty)).alias("e"))
    shard = Window.partitionBy("_key", "_block", "day").orderBy("e.slot").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("e.readings") > 0, F.struct(F.col("e.last_us").alias("us"), F.col("e.last_price").alias("price")))
    start = F.col("day").cast("bigint") * 86_400 + F.col("open_second") + F.col("e.slot").cast("bigint") * F.col("period_seconds")
    return spread.withColumn("_known", F.coalesce(F.last(own, ignorenulls=True).over(shard), F.col("_carry"))).select(
        "symbol",
        start.alias("slot_start"),
        "e.readings",
        "e.first_price",
        "e.last_price",
        F.col("_known.price").alias("price"),
        (F.col("e.readings") == 0).alias("is_missing"),
        F.col("_known.us").alias("filled_from"),
    )


def missing_slots(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """(symbol, slot_start) of the slots of the regular series that lack a reading."""
    return regularize(readings, grid).where("is_missing").select("symbol", "slot_start")
