"""Daily bars from a stream of priced events; the batch form of the same query is plans.bars.event_bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def daily_bars(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One bar per event type and day, final once the watermark has passed the day; later events are dropped."""
    day = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("day"), "event_type")
    bar = day.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))
    return bar.select(F.col("event_type").alias("instrument_id"), F.to_date("day.start").alias("ts"), "open", "high", "low", "close", "volume")


def ordered_only(events: DataFrame, state_timeout: str = "NoTimeout") -> DataFrame:
    """(event_type, event_id, ts, late): whether an event goes back behind its type's newest one so far; the newest time is the state."""
    from collections.abc import Iterator

    import pandas as pd

    def run(key, batches: Iterator[pd.DataFrame], state):
        newest = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.Timestamp.min
        for b in batches:
            b = b.sort_values("event_id")
            before = b["ts"].cummax().shift(fill_value=pd.Timestamp.min).clip(lower=newest)
            newest = max(newest, b["ts"].max())
            yield pd.DataFrame({"event_type": key[0], "event_id": b["event_id"], "ts": b["ts"], "late": b["ts"] < before})
        state.update((int(newest.value // 1000),))

    return events.select("event_type", "event_id", "ts").groupBy("event_type").applyInPandasWithState(run, "event_type string, event_id long, ts timestamp, late boolean", "newest long", "append", state_timeout)
