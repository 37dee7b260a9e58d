"""Bars as the engines need them: adjusted, ended by delistings, priced in cash, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, covering


def by_day() -> Window:
    return Window.partitionBy("instrument_id").orderBy("ts")


def sessions(bars: DataFrame) -> DataFrame:
    return bars.select("ts").distinct()


def next_session(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """``days`` (day) with ``session``: the first one on or after it; the day itself after the last."""
    after = asof(days.select("day").distinct(), calendar.select(F.col("ts").alias("session")), "day", "session", ["session"], forward=True)
    return days.join(after, "day").withColumn("session", F.coalesce("session", "day"))


def forward_filled(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument_id, ts, close) on every session from an instrument's first bar on; without a bar the last close stays."""
    first = bars.groupBy("instrument_id").agg(F.min("ts").alias("first"))
    open_ = first.withColumn("until", F.lit(None).cast("date"))
    grid = covering(calendar.select("ts"), open_, "ts", "first", "until").select("instrument_id", "ts")
    known = grid.join(bars.select("instrument_id", "ts", "close"), ["instrument_id", "ts"], "left")
    return known.select("instrument_id", "ts", F.last("close", ignorenulls=True).over(by_day()).alias("close"))


def action_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(instrument_id, ex_date, first_after, price_factor, volume_factor) of the actions that adjust something.

    An action counts from the first bar on or after its ex-date and needs a bar before it; a dividend's factor uses that bar's raw close.
    """
    b = bars.select("instrument_id", F.col("ts").alias("first_after"), F.col("close").alias("c0"), F.lag("ts").over(by_day()).alias("before"))
    met = asof(actions.select("instrument_id", "kind", "ex_date", "ratio", "amount").distinct(), b, "ex_date", "first_after", ["first_after", "c0", "before"], ("instrument_id",), forward=True)
    met = met.where("before is not null")
    price = F.when(F.col("kind") == "split", 1 / F.col("ratio")).otherwise(F.col("c0") / (F.col("c0") + F.col("amount")))
    return met.select("instrument_id", "ex_date", "first_after", price.alias("price_factor"), F.when(F.col("kind") == "split", F.col("ratio")).otherwise(F.lit(1.0)).alias("volume_factor"))


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Back-adjusted bars: all before an ex-date scaled by its factor; ``unadjusted_close`` keeps the raw close.

    Factors of one instrument are summed as logarithms over the bars behind them, by one backward window over both.
    """
    f = action_factors(bars, actions).groupBy("instrument_id", F.col("first_after").alias("ts")).agg(F.product("price_factor").alias("pf"), F.product("volume_factor").alias("vf"))
    later = Window.partitionBy("instrument_id").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    out = bars.drop("unadjusted_close").join(f, ["instrument_id", "ts"], "left").withColumn("p", F.coalesce(F.product(F.coalesce("pf", F.lit(1.0))).over(later), F.lit(1.0))).withColumn("v", F.coalesce(F.product(F.coalesce("vf", F.lit(1.0))).over(later), F.lit(1.0)))
    scaled = [(F.col(c) * F.col("p")).alias(c) for c in ("open", "high", "low")]
    rest = [c for c in out.columns if c not in ("open", "high", "low", "close", "volume", "pf", "vf", "p", "v")]
    return out.select(*rest, *scaled, (F.col("close") * F.col("p")).alias("close"), (F.col("volume") * F.col("v")).alias("volume"), F.col("close").alias("unadjusted_close"))


def delisted(bars: DataFrame, delistings: DataFrame, missing_return: float | None) -> DataFrame:
    """Bars with one last bar on each delisting's date at the last close times (1 + return), volume 0, flagged.

    An unknown return takes ``missing_return``; without one, or with a date not after the last bar, the plan raises.
    """
    raw = F.coalesce("unadjusted_close", "close") if "unadjusted_close" in bars.columns else F.col("close")
    last = bars.groupBy("instrument_id").agg(F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("last_close"), F.max_by(raw, "ts").alias("last_raw"))
    rate = F.coalesce("delisting_return", F.lit(missing_return).cast("double"))
    d = delistings.join(last, "instrument_id")
    rate = F.when(rate.isNull(), F.raise_error(F.lit("a delisting without a return")).cast("double")).when(F.col("date") <= F.col("last_ts"), F.raise_error(F.lit("a delisting before the last bar")).cast("double")).otherwise(rate)
    price = F.col("last_close") * (1 + rate)
    made = {"instrument_id": F.col("instrument_id"), "ts": F.col("date"), **{c: price for c in ("open", "high", "low", "close")}, "volume": F.lit(0.0), "unadjusted_close": F.col("last_raw") * (1 + rate), "delisting": F.lit(True)}
    end = d.select(*[made[c].alias(c) for c in made if c in bars.columns or c == "delisting"])
    with_flag = bars if "delisting" in bars.columns else bars.withColumn("delisting", F.lit(False))
    return with_flag.unionByName(end, allowMissingColumns=True)


def with_events(bars: DataFrame, actions: DataFrame, delistings: DataFrame, missing_return: float | None = None) -> DataFrame:
    """Bars adjusted for their actions, then ended by their delistings, each moved to the run's next session. assumed: whether the return was not given."""
    calendar = sessions(bars)
    moved = next_session(delistings.withColumnRenamed("date", "day"), calendar).withColumn("date", F.col("session")).drop("day", "session")
    ended = delisted(adjust(bars, actions), moved, missing_return)
    unknown = delistings.where("delisting_return is null").select("instrument_id", F.lit(True).alias("__assumed"))
    return ended.join(F.broadcast(unknown), "instrument_id", "left").withColumn("assumed", F.col("delisting") & F.coalesce("__assumed", F.lit(False))).drop("__assumed")


def with_assumed_return(market: DataFrame, rate: float) -> DataFrame:
    """``with_events``' bars with another return for every delisting that had none: only those last bars change."""
    w = Window.partitionBy("instrument_id").orderBy("ts")
    raw = F.coalesce("unadjusted_close", "close")
    price, before = F.lag("close").over(w) * (1 + rate), F.lag(raw).over(w) * (1 + rate)
    new = {**{c: price for c in ("open", "high", "low", "close")}, "unadjusted_close": before}
    return market.select(*[F.when(F.col("assumed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in market.columns])


def known_through(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(instrument_id, ts, known): on each day (ts) how many of an instrument's bars are known; all of them up to it, none after."""
    marks = bars.select("instrument_id").distinct().crossJoin(F.broadcast(days.select("ts"))).withColumn("bar", F.lit(0))
    both = bars.select("instrument_id", "ts", F.lit(1).alias("bar")).unionByName(marks)
    w = Window.partitionBy("instrument_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("known", F.sum("bar").over(w)).where("bar = 0").select("instrument_id", "ts", "known")


def calendar_days(bars: DataFrame) -> DataFrame:
    """Every day from the first bar to the last one, for markets that never close."""
    ends = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("ts"))


def reference_sessions(bars: DataFrame, every_day: bool) -> DataFrame:
    return calendar_days(bars) if every_day else sessions(bars)


def above_cash(bars: DataFrame, cash: DataFrame) -> DataFrame:
    """Prices in units of cash: scaled by the last cash close over the one of the bar's day or the last before it.

    ``cash``: (ts, close). Bars before the first cash close go. Each instrument's cash series is merged into its own and carried forward.
    """
    final = cash.agg(F.max_by("close", "ts").alias("final"))
    ids = bars.select("instrument_id").distinct()
    marks = ids.crossJoin(F.broadcast(cash.select("ts", F.col("close").alias("cash"))))
    merged = bars.select("instrument_id", "ts", *[c for c in bars.columns if c not in ("instrument_id", "ts")], F.lit(1).alias("own")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("instrument_id").orderBy("ts", F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = merged.withColumn("cash", F.last("cash", ignorenulls=True).over(w)).where("own = 1 and cash is not null").crossJoin(F.broadcast(final))
    return known.select(*[(F.col(c) * F.col("final") / F.col("cash")).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in bars.columns])


# ---- quality checks: each gives (check, level, instrument_id, day, value) ----


def _finding(df: DataFrame, check: str, level: str, day, value) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(level).alias("level"), "instrument_id", day.cast("date").alias("day"), value.cast("double").alias("value"))


def duplicate_dates(bars: DataFrame) -> DataFrame:
    twice = bars.groupBy("instrument_id", "ts").agg(F.count("*").alias("n")).where("n > 1")
    return _finding(twice, "duplicate_dates", "error", F.col("ts"), F.col("n"))


def non_positive_prices(bars: DataFrame) -> DataFrame:
    low = F.least("open", "high", "low", "close")
    bad = bars.where((low <= 0) & ~F.coalesce(F.col("delisting"), F.lit(False))) if "delisting" in bars.columns else bars.where(low <= 0)
    return _finding(bad, "non_positive_prices", "error", F.col("ts"), low)


def inconsistent_ohlc(bars: DataFrame, slack: float = 1e-9) -> DataFrame:
    top, bottom = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    bad = bars.where((F.col("high") < top - F.abs(top) * slack) | (F.col("low") > bottom + F.abs(bottom) * slack))
    return _finding(bad, "inconsistent_ohlc", "error", F.col("ts"), F.col("high"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions strictly between an instrument's first and last bar on which it has none."""
    spans = bars.groupBy("instrument_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    inner = spans.select("instrument_id", F.date_add("first", 1).alias("first"), F.date_sub("last", 1).alias("last"))
    due = covering(calendar.select("ts"), inner, "ts", "first", "last").select("instrument_id", "ts")
    gone = due.join(bars.select("instrument_id", "ts"), ["instrument_id", "ts"], "left_anti")
    return _finding(gone, "missing_sessions", "warning", F.col("ts"), F.lit(1.0))


def stale_closes(bars: DataFrame, least: int = 5) -> DataFrame:
    """Runs of at least ``least`` equal closes, on their first day."""
    same = bars.withColumn("new", F.coalesce((F.col("close") != F.lag("close").over(by_day())).cast("int"), F.lit(1)))
    runs = same.withColumn("run", F.sum("new").over(by_day())).groupBy("instrument_id", "run").agg(F.min("ts").alias("ts"), F.count("*").alias("n")).where(F.col("n") >= least)
    return _finding(runs, "stale_closes", "warning", F.col("ts"), F.col("n"))


def extreme_moves(bars: DataFrame, limit: float = 10.0, least_closes: int = 20) -> DataFrame:
    """Daily returns further than ``limit`` robust deviations (1.4826 times the median absolute deviation) from the median."""
    ok = bars.groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("close").alias("low")).where((F.col("n") > least_closes) & (F.col("low") > 0)).select("instrument_id")
    r = bars.join(ok, "instrument_id").withColumn("r", F.col("close") / F.lag("close").over(by_day()) - 1).where("r is not null").select("instrument_id", "ts", "r")
    middle = r.groupBy("instrument_id").agg(F.percentile("r", F.lit(0.5)).alias("mid"))
    spread = r.join(middle, "instrument_id").withColumn("off", F.col("r") - F.col("mid"))
    scale = spread.groupBy("instrument_id").agg((F.percentile(F.abs("off"), F.lit(0.5)) * 1.4826).alias("scale")).where("scale != 0")
    score = spread.join(scale, "instrument_id").withColumn("z", F.col("off") / F.col("scale")).where(F.abs("z") > limit)
    return _finding(score, "extreme_moves", "warning", F.col("ts"), F.col("z"))


CHECKS = ("duplicate_dates", "non_positive_prices", "inconsistent_ohlc", "missing_sessions", "stale_closes", "extreme_moves")


def quality_report(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    parts = [duplicate_dates(bars), non_positive_prices(bars), inconsistent_ohlc(bars), missing_sessions(bars, calendar), stale_closes(bars), extreme_moves(bars)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def quality_summary(findings: DataFrame) -> DataFrame:
    """Findings per check, 0 included, in the checks' order."""
    order = findings.sparkSession.createDataFrame(list(enumerate(CHECKS)), "position int, check string")
    return order.join(findings.groupBy("check").agg(F.count("*").alias("n")), "check", "left").select("position", "check", F.coalesce("n", F.lit(0)).alias("n"))
