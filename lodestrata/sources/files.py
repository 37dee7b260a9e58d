"""Price tables, connector responses and result tables at rest."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import ACTIONS, BARS, DELISTINGS, INSTRUMENTS, MEMBERSHIPS


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared one; the folder goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder, read again: it is computed once and survives lost executors. It goes when the session ends."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_bars(spark: SparkSession, path: str, instrument_id: str | None = None, start=None, end=None) -> DataFrame:
    """Bars of a range (both ends included), oldest first; a missing table is empty. The filters reach the Parquet scan."""
    if not _exists(spark, path):
        return spark.createDataFrame([], BARS)
    if not _by_month(spark, path):
        out = spark.read.schema(BARS).parquet(path)
    else:
        # A range of days is a range of months, which prunes the folders.
        out = spark.read.schema(f"{BARS}, month string").parquet(path)
        if start is not None:
            out = out.where(F.col("month") >= F.date_format(F.lit(start).cast("date"), "yyyy-MM"))
        if end is not None:
            out = out.where(F.col("month") <= F.date_format(F.lit(end).cast("date"), "yyyy-MM"))
        out = out.drop("month")
    if instrument_id is not None:
        out = out.where(F.col("instrument_id") == instrument_id)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    return out.orderBy("instrument_id", "ts")


def latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two versions of bars; where both have a day, the new one's."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("instrument_id", "ts").orderBy(F.desc("__v"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__v")


def _by_month(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return any(f.getPath().getName().startswith("month=") for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def upsert_bars(bars: DataFrame, path: str) -> None:
    """Merges bars into the table at ``path``, in which every month has its folder: only the months that ``bars`` touch are read and written anew.

    The merged months are written aside first, as a folder can't be overwritten while it is read, and then take their folders' places; a repeated
    call gives the same table. A table without months is rewritten once.
    """
    spark = bars.sparkSession
    month = F.date_format("ts", "yyyy-MM")
    if _exists(spark, path) and not _by_month(spark, path):
        staging = f"{path}.staging-{uuid.uuid4().hex}"
        _write_months(read_bars(spark, path).withColumn("month", month), staging)
        swap(spark, staging, path)
    new = bars.withColumn("month", month)
    if _exists(spark, path):
        touched = F.broadcast(new.select("month").distinct())
        old = spark.read.schema(f"{BARS}, month string").parquet(path).join(touched, "month", "left_semi")
        new = stored(latest(old, new), "months")
    else:
        new = latest(new.limit(0), new)
    _write_months(new, path)


def _write_months(bars: DataFrame, path: str) -> None:
    order = ["month", "instrument_id", "ts"]
    bars.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def swap(spark: SparkSession, staging: str, path: str) -> None:
    """Puts a finished folder in another's place; the old one goes only when the new one is complete."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, now = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = now.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(now)
    if had:
        fs.rename(now, old)
    if not fs.rename(new, now):
        if had:
            fs.rename(old, now)
        raise OSError(f"could not move {staging} to {path}")
    if had:
        fs.delete(old, True)


def klines(pages: DataFrame, instrument_id: str, source: str = "klines") -> DataFrame:
    """Bars from a column ``body`` of kline pages: JSON arrays of [open time in ms, open, high, low, close, volume, ...]."""
    rows = pages.select(F.explode(F.from_json("body", "array<array<string>>")).alias("k"))
    k = F.col("k")
    price = [k[i].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    day = F.to_date(F.timestamp_millis(k[0].cast("long")))
    return rows.select(F.lit(instrument_id).alias("instrument_id"), day.alias("ts"), *price, F.lit(None).cast("double").alias("adj_close"), F.lit(source).alias("source"), F.lit(None).cast("double").alias("unadjusted_close"), F.lit(False).alias("delisting"))


_EOD = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,adjClose:double,divCash:double,splitFactor:double>>"


def eod_rows(pages: DataFrame) -> DataFrame:
    """(instrument_id, ts, raw prices, div_cash, split_factor) from end-of-day responses (instrument_id, body)."""
    r = F.col("r")
    rows = pages.select("instrument_id", F.explode(F.from_json("body", _EOD)).alias("r"))
    return rows.select("instrument_id", F.to_date(F.substring(r["date"], 1, 10)).alias("ts"), *[r[c].alias(c) for c in ("open", "high", "low", "close", "volume")], r["adjClose"].alias("adj_close"), r["divCash"].alias("div_cash"), r["splitFactor"].alias("split_factor"))


def eod_bars(rows: DataFrame, source: str = "eod") -> DataFrame:
    return rows.select("instrument_id", "ts", "open", "high", "low", "close", "volume", "adj_close", F.lit(source).alias("source"), F.lit(None).cast("double").alias("unadjusted_close"), F.lit(False).alias("delisting"))


def eod_actions(rows: DataFrame) -> DataFrame:
    """Splits (factor other than 1) and cash dividends (above 0) of end-of-day rows."""
    none = F.lit(None).cast("double")
    split = rows.where("split_factor != 1").select("instrument_id", F.lit("split").alias("kind"), F.col("ts").alias("ex_date"), F.col("split_factor").alias("ratio"), none.alias("amount"))
    cash = rows.where("div_cash > 0").select("instrument_id", F.lit("dividend").alias("kind"), F.col("ts").alias("ex_date"), none.alias("ratio"), F.col("div_cash").alias("amount"))
    return split.unionByName(cash)


def eod_delistings(last_days: DataFrame, start, end) -> DataFrame:
    """A delisting the day after a last price in [start, end), its return unknown. last_days: (instrument_id, last_day)."""
    inside = last_days.where((F.col("last_day") >= F.lit(start)) & (F.col("last_day") < F.lit(end)))
    return inside.select("instrument_id", F.date_add("last_day", 1).alias("date"), F.lit(None).cast("double").alias("delisting_return"))


def without(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of instruments that the source does have; excluded: (instrument_id)."""
    return rows.join(excluded, "instrument_id", "left_anti")


def cache_key(*parts: str) -> F.Column:
    return F.sha2(F.concat_ws(":", *[F.col(p) for p in parts]), 256)


def universe_from_yaml(spark: SparkSession, text: str) -> dict[str, Any]:
    """A universe file as its settings and two tables; refuses memberships of unknown instruments or overlapping ones."""
    import yaml

    raw = yaml.safe_load(text)
    instruments = spark.createDataFrame([(i["id"], i["symbol"], i["asset_class"], i["quote_asset"]) for i in raw["instruments"]], INSTRUMENTS)
    spans = [(m["instrument_id"], m["start"], m.get("end")) for m in raw.get("memberships", [])]
    known = {i["id"] for i in raw["instruments"]}
    if unknown := {s[0] for s in spans} - known:
        raise ValueError(f"memberships of unknown instruments: {sorted(unknown)}")
    by_id: dict[str, list] = {}
    for s in spans:
        by_id.setdefault(s[0], []).append(s)
    for own in by_id.values():
        own.sort(key=lambda s: s[1])
        for a, b in zip(own, own[1:], strict=False):
            if a[2] is None or a[2] >= b[1]:
                raise ValueError(f"overlapping memberships of {a[0]}")
    return {"name": raw["name"], "periods_per_year": raw["periods_per_year"], "market_proxy": raw.get("market_proxy"), "cash": raw.get("cash"), "instruments": instruments, "memberships": spark.createDataFrame(spans, MEMBERSHIPS)}


def events_frames(spark: SparkSession, events: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(actions, delistings) from a list of tagged events."""
    actions = [(e["instrument_id"], e["kind"], e["ex_date"], e.get("ratio"), e.get("amount")) for e in events if e["kind"] in ("split", "dividend")]
    ends = [(e["instrument_id"], e["date"], e.get("delisting_return")) for e in events if e["kind"] == "delisting"]
    return spark.createDataFrame(actions, ACTIONS), spark.createDataFrame(ends, DELISTINGS)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Result tables into ``folder``: all are written aside first and put in place together."""
    spark = next(iter(tables.values())).sparkSession
    staging = f"{folder}.staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}.parquet")
    swap(spark, staging, folder)


def write_registry(rows: DataFrame, path: str) -> None:
    """The registry table, replaced as a whole once the new one is complete."""
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    rows.write.parquet(staging)
    swap(rows.sparkSession, staging, path)


def write_once(path: str, record: dict, spark: SparkSession | None = None) -> None:
    """A JSON record that is never overwritten, in any file system that Spark reaches."""
    spark = spark or SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(record, sort_keys=True, default=str).encode()))
    out.close()


def finite(c: F.Column) -> F.Column:
    """Undefined numbers are null at rest, never NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
