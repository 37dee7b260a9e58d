"""Identity checks of former members: what the index called them against what a price source files under their tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_similarity
from .universe import covers

#: Days that a last price may come before the last member day.
SLACK = 7


def member_medians(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """(instrument_id, median_close, median_dollar_volume) of raw closes on member days."""
    m = spans.select(F.col("instrument_id").alias("__i"), "start", "end")
    own = bars.join(m, (F.col("instrument_id") == F.col("__i")) & covers(F.col("ts"), F.col("start"), F.col("end")), "left_semi")
    raw = F.coalesce("unadjusted_close", "close") if "unadjusted_close" in bars.columns else F.col("close")
    half = F.lit(0.5)
    return own.groupBy("instrument_id").agg(F.percentile(raw, half).alias("median_close"), F.percentile(raw * F.col("volume"), half).alias("median_dollar_volume"))


def ticker_audit(members: DataFrame, listings: DataFrame, names: DataFrame) -> DataFrame:
    """(symbol, name, similarity, flags) per member (symbol, first_day, last_day): listings (symbol, name, start, end) of the source, names (symbol, names)
    of the index. The similarity is that of the closest name; null without a listing or a name."""
    met = members.join(listings, "symbol", "left").join(names, "symbol", "left")
    likeness = met.select("symbol", "name", F.explode("names").alias("other")).where("name is not null").groupBy("symbol").agg(F.max(name_similarity(F.col("other"), F.col("name"))).alias("similarity"))
    met = met.join(likeness, "symbol", "left")
    s = F.col("similarity")
    # The texts of the flags, in their order.
    flags = F.array_compact(F.array(
        F.when(s.isNull(), "no name in the index's table").when(s == 0, "name differs").when(s < 1, "name partly differs"),
        F.when(F.col("start") > F.col("first_day"), "prices start after membership"),
        F.when(F.col("end") < F.date_sub("last_day", SLACK), "prices end before membership"),
    ))
    return met.select("symbol", "name", "similarity", F.when(F.col("name").isNull(), F.array(F.lit("unknown to the source"))).otherwise(flags).alias("flags"))


def review_order(audit: DataFrame) -> DataFrame:
    """Flagged ones first, the least similar names first among them (none: before all)."""
    return audit.orderBy(F.size("flags") == 0, F.col("similarity").asc_nulls_first(), "symbol")


def write_audit(audit: DataFrame, path: str) -> None:
    """The audit as CSV with a header, in review order."""
    review_order(audit).withColumn("flags", F.array_join("flags", "; ")).coalesce(1).write.option("header", True).csv(path)
