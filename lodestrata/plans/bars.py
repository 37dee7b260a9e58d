"""Daily bars derived from the order and event tables, and the small literal tables that go with them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight instruments (suppliers modulo 8) by ship date; the close is the day's volume-weighted price.

    Prices are 1000 plus a hundredth of the unit price, so that days differ by a few percent; sums are of whole cents, hence exact.
    """
    price = lambda cents, n: 1000 + cents / (n * 10000)
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("instrument_id"), F.to_date("l_shipdate").alias("ts"), F.round(F.col("l_extendedprice") * 100).alias("c"), F.col("l_quantity").alias("n"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("k"))
    line = line.withColumn("px", price(F.col("c"), F.col("n")))
    return line.groupBy("instrument_id", "ts").agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), price(F.sum("c"), F.sum("n")).alias("close"), F.sum("n").alias("volume"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five instruments (event types) over thirty days."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument_id"), F.to_date("ts").alias("ts"), "value", "event_id")
    return e.groupBy("instrument_id", "ts").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))


D = date.fromisoformat
MEMBERSHIPS = [("s0", D("1995-01-01"), None), ("s1", D("1996-01-01"), D("1998-06-30")), ("s1", D("1999-01-01"), None), ("s2", D("1995-01-01"), D("1997-12-31")), ("s2", D("1998-01-01"), D("1999-12-31")), ("s3", D("1995-01-01"), None), ("s5", D("1995-01-01"), D("1998-06-30")), ("s9", D("1996-01-01"), D("1996-12-31"))]
ACTIONS = [("s3", "split", D("1997-06-02"), 4.0, None), ("s0", "dividend", D("1998-03-02"), None, 50.0), ("s0", "split", D("1999-01-04"), 2.0, None), ("s1", "split", D("2009-01-04"), 2.0, None)]
DELISTINGS = [("s7", D("2002-01-05"), -0.3), ("s6", D("2002-02-01"), None)]
CASH = [(D("1995-06-01"), 100.0), (D("1997-01-01"), 105.0), (D("1999-01-01"), 111.5), (D("2001-01-01"), 118.0)]
SHOCKS = [(n, f"s{i}", s) for n, s in (("crash", -0.2), ("rally", 0.2)) for i in range(8)]


def literal(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = {
        "memberships": (MEMBERSHIPS, "instrument_id string, start date, end date"),
        "actions": (ACTIONS, "instrument_id string, kind string, ex_date date, ratio double, amount double"),
        "delistings": (DELISTINGS, "instrument_id string, date date, delisting_return double"),
        "cash": (CASH, "ts date, close double"),
        "shocks": (SHOCKS, "scenario string, instrument_id string, shock double"),
    }[name]
    return spark.createDataFrame(rows, schema)


def literal_sql(rows: list[tuple], columns: str) -> str:
    def value(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, date):
            return f"DATE '{x}'"
        return f"{x!r}::DOUBLE" if isinstance(x, float) else f"'{x}'"

    return f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS v({columns})"
