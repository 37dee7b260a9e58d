"""Registered queries of stored responses, in batch and as a feed, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds
from ..sources.files import fresh
from ..streaming.feed import replayed
from .bars import D, line_bars
from .oracle import STEPS, _sql
from .queries import query

SQL: dict[str, str] = {}


def _responses(spark, sf_dir) -> str:
    """Bars as responses by year; those of a month's seventh come in with the next year's."""
    path = fresh(spark, "responses")
    year = F.year("ts")
    late = (F.dayofmonth("ts") == 7).cast("int")
    feeds.write_responses(line_bars(spark, sf_dir).select("*", year.cast("string").alias("span"), (year + late).cast("string").alias("arrived")), path)
    return path


STEPS["arrivals"] = "SELECT *, (year(ts) + CASE WHEN day(ts) = 7 THEN 1 ELSE 0 END)::VARCHAR AS arrived FROM line_bars"


@query
def responses_in_range(spark, sf_dir):
    """Two instruments' bars of a year and a half; files of other years and instruments stay closed."""
    return feeds.read_responses(spark, _responses(spark, sf_dir), D("1996-03-01"), D("1997-09-14"), ["s2", "s5"])


SQL["responses_in_range"] = "SELECT instrument_id, ts, open, high, low, close, volume, arrived FROM arrivals WHERE ts >= DATE '1996-03-01' AND ts < DATE '1997-09-15' AND instrument_id IN ('s2', 's5')"


@query
def feed_order(spark, sf_dir):
    """Every bar as a feed reveals it, in three runs on one checkpoint: the newest day before it, and whether it goes back."""
    return replayed(spark, _responses(spark, sf_dir), fresh(spark, "feed"), ["1994", "1997", None])


SQL["feed_order"] = """SELECT instrument_id, ts, close, arrived, newest, coalesce(ts < newest, FALSE) AS late FROM (
  SELECT *, max(ts) OVER (PARTITION BY instrument_id ORDER BY arrived, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arrivals)"""

for _n, _s in SQL.items():
    SQL[_n] = _sql(_s)
