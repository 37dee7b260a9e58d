"""Point-in-time universes: membership intervals are closed, an open end is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import covering


def covers(day: Column, start: Column, end: Column) -> Column:
    return (start <= day) & (end.isNull() | (day <= end))


def overlaps(start: Column, end: Column, a, b) -> Column:
    return (start <= b) & (end.isNull() | (end >= a))


def members_asof(days: DataFrame, memberships: DataFrame) -> DataFrame:
    """(ts, instrument_id) of the members on each day of ``days`` (ts)."""
    return covering(days.select("ts"), memberships.select("instrument_id", "start", "end"), "ts", "start", "end").select("ts", "instrument_id")


def members_only(bars: DataFrame, memberships: DataFrame) -> DataFrame:
    """The bars of members; an equi join on the instrument, the interval as its condition."""
    m = memberships.select(F.col("instrument_id").alias("__i"), "start", "end")
    return bars.join(m, (F.col("instrument_id") == F.col("__i")) & covers(F.col("ts"), F.col("start"), F.col("end")), "left_semi")


def instruments_between(memberships: DataFrame, start, end, proxy: str | None = None) -> DataFrame:
    """Instruments that are members at any time in [start, end], and the market proxy."""
    found = memberships.where(overlaps(F.col("start"), F.col("end"), F.lit(start), F.lit(end))).select("instrument_id")
    if proxy is not None:
        found = found.union(memberships.sparkSession.createDataFrame([(proxy,)], "instrument_id string"))
    return found.distinct()


def member_spans(memberships: DataFrame, start, end) -> DataFrame:
    """Memberships cut to [start, end]."""
    a, b = F.lit(start), F.lit(end)
    return memberships.where(overlaps(F.col("start"), F.col("end"), a, b)).select("instrument_id", F.greatest("start", a).alias("start"), F.least(F.coalesce("end", b), b).alias("end"))


def former_members(memberships: DataFrame, proxy: str | None = None) -> DataFrame:
    """Instruments without an open membership."""
    present = memberships.where("end is null").select("instrument_id")
    out = memberships.select("instrument_id").distinct().join(present, "instrument_id", "left_anti")
    return out if proxy is None else out.where(F.col("instrument_id") != proxy)


def price_coverage(memberships: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """Per instrument: member days among ``days``, those with a bar, and their share."""
    wanted = members_asof(days, memberships)
    had = wanted.join(bars.select("ts", "instrument_id", F.lit(1).alias("had")), ["ts", "instrument_id"], "left")
    return had.groupBy("instrument_id").agg(F.count("*").alias("member_days"), F.count("had").alias("priced_days")).withColumn("share", F.col("priced_days") / F.col("member_days"))


def memberships_from_changes(changes: DataFrame, since) -> DataFrame:
    """Membership intervals from dated changes (instrument_id, day, added): each addition pairs with the next removal.

    A removal without an addition before it belongs to a member of ``since``.
    """
    w = Window.partitionBy("instrument_id").orderBy("day", "added")
    seq = changes.withColumn("next_day", F.lead("day").over(w)).withColumn("next_added", F.lead("added").over(w)).withColumn("prev_added", F.lag("added").over(w))
    opened = seq.where("added").select("instrument_id", F.col("day").alias("start"), F.when(~F.col("next_added"), F.date_sub("next_day", 1)).alias("end"))
    before = seq.where("not added and prev_added is null").select("instrument_id", F.lit(since).cast("date").alias("start"), F.date_sub("day", 1).alias("end"))
    return opened.union(before)


def touching_runs(memberships: DataFrame) -> DataFrame:
    """Memberships merged where one starts the day after another ends."""
    w = Window.partitionBy("instrument_id").orderBy("start")
    new = F.coalesce((F.date_add(F.lag("end").over(w), 1) < F.col("start")).cast("int"), F.lit(1))
    island = memberships.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    last = F.when(F.count(F.when(F.col("end").isNull(), 1)) > 0, F.lit(None).cast("date")).otherwise(F.max("end"))
    return island.groupBy("instrument_id", "island").agg(F.min("start").alias("start"), last.alias("end")).drop("island")
