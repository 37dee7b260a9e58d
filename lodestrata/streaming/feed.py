"""Whether a feed's bars keep the order of time, as a stateful stream operator, and the feed played from stored responses."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import feeds

_DAY_MS = 86_400_000
_EPOCH = date(1970, 1, 1)
MARKED = "instrument_id string, ts date, close double, arrived string, newest date, late boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tasks of a replayed feed; every one keeps a state store.
TASKS = 4


class Monotone(StatefulProcessor):
    """Marks bars that are older than the newest one which their instrument has revealed, and says which that was.

    Of an instrument one number is kept, and a timer forgets it when no bar came for ``idle_days`` days of running time, so the
    state grows with the instruments that are alive. Bars of one micro-batch count in the order of arrival and day.
    """

    def __init__(self, idle_days: int):
        self.idle = idle_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values(["arrived", "ts"], kind="stable")
        day = b["ts"].map(lambda d: (d - _EPOCH).days).astype("int64")
        known = self.newest.get()[0] if self.newest.exists() else None
        before = day.cummax().shift().astype("Int64")
        if known is not None:
            before = before.fillna(known).clip(lower=known)
        self.newest.update((int(day.max() if known is None else max(day.max(), known)),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)
        newest = [None if pd.isna(x) else _EPOCH + timedelta(days=int(x)) for x in before]
        yield pd.DataFrame({"instrument_id": key[0], "ts": b["ts"], "close": b["close"], "arrived": b["arrived"], "newest": newest, "late": (day < before).fillna(False).astype(bool)})

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def monotone(bars: DataFrame, idle_days: int = 30) -> DataFrame:
    """A stream of bars (instrument_id, ts, close, arrived) with ``newest`` (null for an instrument's first bar) and ``late``."""
    by = bars.select("instrument_id", "ts", "close", "arrived").groupBy("instrument_id")
    return by.transformWithStateInPandas(Monotone(idle_days), MARKED, "append", "processingTime")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replayed(spark: SparkSession, responses: str, folder: str, until: list[str | None]) -> DataFrame:
    """The marked bars of a feed of stored responses, read up to each arrival of ``until`` in turn (None: all).

    Every step is a run of its own on one checkpoint, as after a restart: offsets, state and results go on from the step before. The
    caller's settings are put back when the runs end.
    """
    feeds.register(spark)
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(TASKS)}):
        for step in until:
            source = spark.readStream.format("responses").option("path", responses)
            source = source if step is None else source.option("until", step)
            out = monotone(source.load()).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
            out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(MARKED).parquet(f"{folder}/rows")
