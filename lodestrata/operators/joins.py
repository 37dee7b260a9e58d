"""Ordered joins: the nearest earlier or later row, and the intervals around a day. Neither compares every row with every other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, at: str, values: list[str], by: tuple[str, ...] = (), forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the nearest row of ``right`` whose ``at`` is not after its ``on`` (forward: not before; strict: not equal either).

    Rows with equal ``by`` meet; without such a row the values are null. Both sides are united, sorted once, and the last row of ``right`` is carried along,
    so the work is that of one sort. Of rows of ``right`` at the same place the one with the largest values counts. Without ``by`` all rows
    are ordered in one partition: for calendars.
    """
    own = [c for c in left.columns if c not in by]
    k = F.col(on).alias("__at")
    a = left.select(*by, k, F.lit(not strict).cast("int").alias("__side"), F.struct(*own).alias("__own"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__found"))
    b = right.select(*by, F.col(at).alias("__at"), F.lit(strict).cast("int").alias("__side"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("__own"), F.struct(*values).alias("__found"))
    order = F.desc("__at") if forward else F.asc("__at")
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy(order, "__side", "__found").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b.where(F.col("__at").isNotNull())).withColumn("__found", F.last("__found", ignorenulls=True).over(w)).where("__own is not null")
    found = F.when(F.col("__at").isNotNull(), F.col("__found"))
    return met.select(*by, *[F.col("__own")[c].alias(c) for c in own], *[found[v].alias(v) for v in values]).select(*left.columns, *values)


def covering(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, days: int = 64) -> DataFrame:
    """``points`` with each of ``spans`` whose [start, end] holds their day; a null end is open.

    Spans are cut at bins of ``days`` days (between the first and the last point), and both sides meet by an equal join on the bin.
    """
    first, last = points.agg(F.min(point)).scalar(), points.agg(F.max(point)).scalar()
    place = lambda c: F.floor(F.unix_date(c) / days)
    cut = spans.withColumn("__lo", F.greatest(start, first)).withColumn("__hi", F.least(F.coalesce(end, last), last)).where("__lo <= __hi")
    cut = cut.withColumn("__bin", F.explode(F.sequence(place(F.col("__lo")), place(F.col("__hi"))))).drop("__lo", "__hi")
    met = points.withColumn("__bin", place(F.col(point))).join(cut, "__bin")
    return met.where((F.col(start) <= F.col(point)) & (F.col(end).isNull() | (F.col(point) <= F.col(end)))).drop("__bin")
