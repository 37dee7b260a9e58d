"""An index's membership over time, from the pages that list its constituents and its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalise_ticker, parse_date
from ..sources.html_tables import named_rows


def _cell(*words: str) -> Column:
    """The cell under the first column whose name holds all ``words``; null without one."""
    at = F.transform("columns", lambda c: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))
    place = F.array_position(at, F.lit(True))
    return F.when(place > 0, F.try_element_at("cells", place.cast("int")))


def constituents(pages: DataFrame) -> DataFrame:
    """(ticker, date_added) of the table "constituents"; an unreadable date is null."""
    rows = named_rows(pages).where("table_id = 'constituents'")
    return rows.select(normalise_ticker(_cell("symbol")).alias("ticker"), parse_date(_cell("date added")).alias("date_added")).where("ticker != ''")


def changes(pages: DataFrame) -> DataFrame:
    """(position, day, added, added_name, removed, removed_name, raw) of the table "changes"; rows without a readable date have a null day."""
    rows = named_rows(pages).where("table_id = 'changes'")
    ticker = lambda side: F.nullif(normalise_ticker(_cell(side, "ticker")), F.lit(""))
    name = lambda side: F.coalesce(_cell(side, "security"), F.lit(""))
    raw = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    return rows.select(F.col("row_no").alias("position"), parse_date(_cell("date")).alias("day"), ticker("added").alias("added"), name("added").alias("added_name"), ticker("removed").alias("removed"), name("removed").alias("removed_name"), raw.alias("raw"))


def renamed(events: DataFrame, renames: DataFrame) -> DataFrame:
    """``events`` (ticker, day, ...) with the ticker of today: that of the first entry (position, old, new, start, end) of ``renames`` that covers the day."""
    r = F.broadcast(renames.select("position", F.col("old"), F.col("new"), F.col("start").alias("__a"), F.col("end").alias("__b")))
    covers = (F.col("__a").isNull() | (F.col("__a") <= F.col("day"))) & (F.col("__b").isNull() | (F.col("day") <= F.col("__b")))
    keys = events.select("ticker", "day").distinct().join(r, (F.col("ticker") == F.col("old")) & covers)
    first = keys.groupBy("ticker", "day").agg(F.min_by("new", "position").alias("__new"))
    return events.join(first, ["ticker", "day"], "left").withColumn("ticker", F.coalesce("__new", "ticker")).drop("__new")


def ticker_events(changes_: DataFrame, renames: DataFrame) -> DataFrame:
    """(ticker, day, position, kind, name): each addition (kind 0) and removal (1), under the ticker of today."""
    side = lambda kind, c: changes_.where(F.col(c).isNotNull() & F.col("day").isNotNull()).select(F.col(c).alias("ticker"), "day", "position", F.lit(kind).alias("kind"), F.col(f"{c}_name").alias("name"))
    return renamed(side(0, "added").union(side(1, "removed")).withColumnRenamed("position", "__p"), renames).withColumnRenamed("__p", "position")


STEP = "struct<inside:boolean,until:date,out:array<struct<what:string,day:date,until:date,name:string>>>"


def walked_back(now: DataFrame, events: DataFrame, since, as_of) -> DataFrame:
    """(ticker, what, day, until, name): periods (what = period) and what the changes contradict, from today's constituents (ticker) by undoing the changes
    in (since, as_of], newest first. A ticker's few events are folded in order as one array."""
    mine = events.where((F.col("day") > F.lit(since)) & (F.col("day") <= F.lit(as_of)))
    order = F.struct((-F.unix_date("day")).alias("k"), "position", "kind", "day", "name")
    per = mine.groupBy("ticker").agg(F.sort_array(F.collect_list(order)).alias("events"))
    all_ = per.join(now.select("ticker", F.lit(True).alias("inside")).distinct(), "ticker", "full")
    none = F.lit(None).cast("date")
    entry = lambda what, day, until, name: F.array(F.struct(F.lit(what).alias("what"), day.alias("day"), until.alias("until"), name.alias("name")))
    start = F.struct(F.coalesce("inside", F.lit(False)).alias("inside"), none.alias("until"), F.array().alias("out")).cast(STEP)
    state = lambda inside, until, out: F.struct(inside.alias("inside"), until.alias("until"), out.alias("out")).cast(STEP)

    def step(s, e):
        fits = s["inside"] & (s["until"].isNull() | (s["until"] >= e["day"]))
        undone = state(F.lit(False), none, F.concat(s["out"], entry("period", e["day"], s["until"], F.lit(None).cast("string"))))
        flagged = lambda what: state(s["inside"], s["until"], F.concat(s["out"], entry(what, e["day"], none, e["name"])))
        added = F.when(fits, undone).otherwise(flagged("added_but_not_in_index"))
        removed = F.when(s["inside"], flagged("removed_but_still_in_index")).otherwise(state(F.lit(True), F.date_sub(e["day"], 1), s["out"]))
        return F.when(e["kind"] == 0, added).otherwise(removed)

    def finish(s):
        return F.when(s["inside"], F.concat(s["out"], entry("period", F.lit(since).cast("date"), s["until"], F.lit(None).cast("string")))).otherwise(s["out"])

    walked = F.aggregate(F.coalesce("events", F.array().cast("array<struct<k:int,position:int,kind:int,day:date,name:string>>")), start, step, finish)
    return all_.select("ticker", F.inline(walked))


def present_starts(walked: DataFrame, now: DataFrame, since, as_of) -> DataFrame:
    """(ticker, date_added, start, what): constituents whose date added differs from their present period's start: what is started_at_date_added if the
    period is to start there, and date_added_mismatches if an earlier period reaches that far."""
    spans = walked.where("what = 'period'").select("ticker", F.col("day").alias("start"), F.col("until").alias("end"))
    w = Window.partitionBy("ticker").orderBy("start")
    touching = spans.withColumn("new", F.coalesce((F.date_add(F.lag("end").over(w), 1) != F.col("start")).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    chain = F.min("start").over(Window.partitionBy("ticker", "island"))
    present = touching.withColumn("chain_start", chain).where("end is null").select("ticker", "start", "chain_start")
    earlier = spans.where("end is not null").groupBy("ticker").agg(F.max("end").alias("earlier_end"))
    met = now.where((F.col("date_added") > F.lit(since)) & (F.col("date_added") <= F.lit(as_of))).join(present, "ticker").join(earlier, "ticker", "left")
    met = met.where("date_added != start and date_added != chain_start")
    return met.select("ticker", "date_added", "start", F.when(F.col("date_added") <= F.col("earlier_end"), "date_added_mismatches").otherwise("started_at_date_added").alias("what"))


def reconstruct(now: DataFrame, events: DataFrame, since, as_of) -> tuple[DataFrame, DataFrame]:
    """(memberships (ticker, start, end), findings (what, ticker, day, other, name)) of the index from ``since`` on."""
    walked = walked_back(now, events, since, as_of)
    starts = present_starts(walked, now, since, as_of)
    moved = starts.where("what = 'started_at_date_added'").select("ticker", "date_added")
    periods = walked.where("what = 'period'").join(moved, "ticker", "left")
    spans = periods.select("ticker", F.when(F.col("until").isNull(), F.coalesce("date_added", "day")).otherwise(F.col("day")).alias("start"), F.col("until").alias("end"))
    none = F.lit(None).cast("date")
    several = spans.groupBy("ticker").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("several_periods").alias("what"), "ticker", none.alias("day"), none.alias("other"), F.lit("").alias("name"))
    odd = walked.where("what != 'period'").select("what", "ticker", "day", none.alias("other"), "name")
    return spans, odd.union(starts.select("what", "ticker", F.col("date_added").alias("day"), F.col("start").alias("other"), F.lit(""))).union(several)


def universe_tables(memberships: DataFrame, proxy: str) -> tuple[DataFrame, DataFrame]:
    """(instruments, memberships) of a universe file: every ticker in lower case, and the market proxy."""
    out = memberships.select(F.lower("ticker").alias("instrument_id"), "start", "end")
    ids = memberships.select("ticker").distinct().union(memberships.sparkSession.createDataFrame([(proxy,)], "ticker string"))
    return ids.select(F.lower("ticker").alias("id"), F.col("ticker").alias("symbol"), F.lit("equity").alias("asset_class"), F.lit("USD").alias("quote_asset")), out


def security_names(events: DataFrame) -> DataFrame:
    """(ticker, names): the distinct names that the changes give a ticker, oldest first."""
    named = events.where("name != ''")
    order = F.sort_array(F.collect_list(F.struct("day", "position", "kind", "name")))
    return named.groupBy("ticker").agg(F.array_distinct(F.transform(order, lambda x: x["name"])).alias("names"))
