"""Late and out-of-order events: aggregates by event time, corrected up to a cut-off.

Stream slicing: events are reduced to non-overlapping panes as long as the step
of the windows, separately by how late they arrived, counted in panes: after the
pane's publication and after its cut-off. A window's publication and cut-off come
with its own end, so an event late for its pane may be in time for a window that
ends later; the counts tell which. A late event changes one pane only; the windows
that cover a changed pane are composed again from their panes and emitted again.
Panes are partial aggregates, so a hot symbol is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.text import is_number, symbol_key
from tidegrid.functions.times import SECOND, floor_div

HOUR = 3600
PUBLISH_AFTER = 300
CUT_OFF = 86_400


def usable(deliveries: DataFrame) -> DataFrame:
    """Deliveries that count: symbol not blank, both times known, price above 0."""
    price = F.col("price")
    return deliveries.select(symbol_key(F.col("symbol")).alias("symbol"), F.unix_micros("ts_event").alias("event_us"), F.unix_micros("ts_ingest").alias("ingest_us"), "price", "volume", "delivery_id").where(
        F.col("symbol").isNotNull() & F.col("event_us").isNotNull() & F.col("ingest_us").isNotNull() & is_number(price) & (price > 0)
    )


def in_panes(events: DataFrame, pane_seconds: int, window_seconds: int, publish_after: int, cut_off: int) -> DataFrame:
    """Adds pane_start (epoch seconds, also before 1970), late and overdue.

    late (overdue) is the number of panes, begun ones included, by which the event
    arrived after the publication (cut-off) of its pane; 0 if not after it, and at
    most the number of panes of a window, as more makes no difference.
    """
    steps, pane = window_seconds // pane_seconds, pane_seconds * SECOND
    placed = events.withColumn("pane_start", floor_div(F.col("event_us"), pane) * pane_seconds)
    end = (F.col("pane_start") + pane_seconds) * SECOND

    def begun(limit: int) -> Column:
        behind = F.col("ingest_us") - end - limit * SECOND
        return F.least(F.lit(steps), F.greatest(F.lit(0), -floor_div(-behind, pane))).cast("int")

    return placed.withColumn("late", begun(publish_after)).withColumn("overdue", begun(cut_off))


#: What a pane is: its partial aggregates are kept apart by these.
PANE = ("symbol", "pane_start", "late", "overdue")


def partials() -> list[Column]:
    """The partial aggregates of a pane; opening and closing are (event_us, delivery_id, price). A volume sum beyond 64 bits is null."""
    mark = F.struct("event_us", "delivery_id", "price")
    return [
        F.count("*").alias("events"),
        F.try_sum("volume").alias("volume"),
        F.sum("price").alias("notional"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.min(mark).alias("opening"),
        F.max(mark).alias("closing"),
    ]


def panes(events: DataFrame, pane_seconds: int = HOUR, window_seconds: int = HOUR, publish_after: int = PUBLISH_AFTER, cut_off: int = CUT_OFF) -> DataFrame:
    """(symbol, pane_start, late, overdue) and the partial aggregates of the events of a pane that arrived alike.

    For windows of up to ``window_seconds``, a multiple of the pane.
    """
    return in_panes(events, pane_seconds, window_seconds, publish_after, cut_off).groupBy(*PANE).agg(*partials())


def compose(parts: DataFrame, pane_seconds: int = HOUR, window_seconds: int = HOUR) -> DataFrame:
    """Windows from panes: each pane goes to the window_seconds / pane_seconds windows that cover it.

    The panes must have been made for windows at least as long. revision 0 is the
    window as published, revision 1 after all corrections up to the window's
    cut-off (only for windows with a correction). Events after it change nothing;
    ``rejected`` counts them.
    """
    steps = window_seconds // pane_seconds
    spread = parts.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))) if steps > 1 else parts.withColumn("_back", F.lit(0))
    spread = spread.withColumn("pane_start", F.col("pane_start") - F.col("_back") * pane_seconds)
    ahead = steps - 1 - F.col("_back")  # panes between the end of this one and the window's
    on_time = F.col("late") <= ahead
    corrected = ~on_time & (F.col("overdue") <= ahead)
    rejected = ~on_time & (F.col("overdue") > ahead)

    def measures(taken: Column, tag: str) -> list[Column]:
        return [
            F.sum(F.when(taken, F.col("events")).otherwise(0)).alias(f"events_{tag}"),
            F.try_sum(F.when(taken, F.col("volume"))).alias(f"volume_{tag}"),
            F.sum(F.when(taken, F.col("notional"))).alias(f"notional_{tag}"),
            F.min(F.when(taken, F.col("low"))).alias(f"low_{tag}"),
            F.max(F.when(taken, F.col("high"))).alias(f"high_{tag}"),
            F.min(F.when(taken, F.col("opening"))).alias(f"opening_{tag}"),
            F.max(F.when(taken, F.col("closing"))).alias(f"closing_{tag}"),
        ]

    return spread.groupBy("symbol", F.col("pane_start").alias("window_start")).agg(
        *measures(on_time, "published"),
        *measures(on_time | corrected, "final"),
        F.sum(F.when(corrected, F.col("events")).otherwise(0)).alias("corrections"),
        F.sum(F.when(rejected, F.col("events")).otherwise(0)).alias("rejected"),
    )


def emissions(windows: DataFrame) -> DataFrame:
    """One row per emission of a window: revision 0 as published, revision 1 if corrections changed it."""

    def emission(revision: int, tag: str) -> Column:
        return F.struct(
            F.lit(revision).alias("revision"),
            F.col(f"events_{tag}").alias("events"),
            F.col(f"volume_{tag}").alias("volume"),
            (F.col(f"notional_{tag}") / F.col(f"events_{tag}")).alias("average_price"),
            F.col(f"low_{tag}").alias("low"),
            F.col(f"high_{tag}").alias("high"),
            F.col(f"opening_{tag}.price").alias("open_price"),
            F.col(f"closing_{tag}.price").alias("close_price"),
        )

    first = F.when(F.col("events_published") > 0, emission(0, "published"))
    again = F.when(F.col("corrections") > 0, emission(1, "final"))
    rows = windows.select("symbol", "window_start", "corrections", "rejected", F.explode(F.array_compact(F.array(first, again))).alias("e"))
    return rows.select("symbol", "window_start", "e.*", "corrections", "rejected")


def outcomes(windows: DataFrame) -> DataFrame:
    """(symbol, hour_start, outcome) of windows that late events corrected or were rejected from."""
    kinds = F.array_compact(F.array(F.when(F.col("corrections") > 0, F.lit("corrected")), F.when(F.col("rejected") > 0, F.lit("rejected"))))
    return windows.select("symbol", F.col("window_start").alias("hour_start"), F.explode(kinds).alias("outcome"))
