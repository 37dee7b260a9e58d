"""Performance, risk and attribution of runs given as snapshots (run_id, ts, equity, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import holding_bucket
from .prep import by_day
from .quantiles import rolling_quantiles

def run_day() -> Window:
    return Window.partitionBy("run_id").orderBy("ts")



def returns(snaps: DataFrame) -> DataFrame:
    """With r, the day's return; null on the first day and after an equity of 0."""
    return snaps.withColumn("r", F.try_divide("equity", F.lag("equity").over(run_day())) - 1)


def drawdowns(snaps: DataFrame) -> DataFrame:
    top = F.max("equity").over(run_day().rowsBetween(Window.unboundedPreceding, 0))
    return snaps.withColumn("drawdown", F.col("equity") / top - 1)


def sharpe_of(r: Column, ppy: int) -> Column:
    """Mean over sample deviation, annualised; null with under two returns or none that differ."""
    return F.when((F.count(r) >= 2) & (F.stddev_samp(r) > 1e-15), F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(ppy))))


def sortino_of(r: Column, ppy: int) -> Column:
    down = F.avg(F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0)))
    return F.when(down > 0, F.avg(r) / F.sqrt(F.nullif(down, F.lit(0.0))) * F.sqrt(F.lit(float(ppy))))


def growth_rate(growth: Column, n: Column, ppy: int) -> Column:
    return F.when((n > 0) & (growth > 0), F.pow(growth, F.lit(float(ppy)) / F.nullif(n, F.lit(0))) - 1)


def run_metrics(snaps: DataFrame, ppy: int) -> DataFrame:
    """cagr, sharpe, sortino, max_drawdown, calmar and turnover (from the first trade on) of each run; null where undefined."""
    s = drawdowns(returns(snaps)).withColumn("begun", F.max((F.col("traded") > 0).cast("int")).over(run_day().rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("run_id").agg(
        growth_rate(F.max_by("equity", "ts") / F.min_by("equity", "ts"), F.count("r"), ppy).alias("cagr"),
        sharpe_of(F.col("r"), ppy).alias("sharpe"),
        sortino_of(F.col("r"), ppy).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        (F.coalesce(F.avg(F.when(F.col("begun") == 1, F.col("traded"))), F.lit(0.0)) * ppy).alias("turnover"),
    )
    return g.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))


def period_returns(snaps: DataFrame, unit: str = "month") -> DataFrame:
    """(run_id, period, ret): last equity of each period over the last of the one before (first: the curve's start)."""
    last = snaps.groupBy("run_id", F.trunc("ts", unit).alias("period")).agg(F.max_by("equity", "ts").alias("last"), F.min_by("equity", "ts").alias("first"))
    w = Window.partitionBy("run_id").orderBy("period")
    return last.select("run_id", "period", (F.try_divide("last", F.coalesce(F.lag("last").over(w), F.col("first"))) - 1).alias("ret"))


def active(snaps: DataFrame) -> DataFrame:
    """Days from the first held position on, with r and the previous day (prev_ts, prev_equity)."""
    s = returns(snaps).withColumn("prev_ts", F.lag("ts").over(run_day())).withColumn("prev_equity", F.lag("equity").over(run_day()))
    held = F.max((F.col("invested") > 0).cast("int")).over(run_day().rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("__held", held).where("__held = 1 and r is not null").drop("__held")


def walk_forward(snaps: DataFrame, ppy: int) -> DataFrame:
    """(run_id, year, days, cagr, sharpe, max_drawdown) per calendar year from the first position on; year null: all of them.

    A year's first return counts from the day before, and its drawdowns from that day's equity.
    """
    a = active(snaps).withColumn("year", F.year("ts"))
    w = Window.partitionBy("run_id", "year").orderBy("ts")
    whole = Window.partitionBy("run_id").orderBy("ts")

    def table(win, keys):
        base = F.first("prev_equity").over(win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        top = F.greatest(base, F.max("equity").over(win.rowsBetween(Window.unboundedPreceding, 0)))
        d = a.withColumn("base", base).withColumn("dd", F.col("equity") / top - 1)
        g = d.groupBy(*keys).agg(F.count("*").alias("days"), growth_rate(F.max_by("equity", "ts") / F.min("base"), F.count("*"), ppy).alias("cagr"), sharpe_of(F.col("r"), ppy).alias("sharpe"), F.least(F.min("dd"), F.lit(0.0)).alias("max_drawdown"))
        return g if "year" in keys else g.withColumn("year", F.lit(None).cast("int"))

    cols = ["run_id", "year", "days", "cagr", "sharpe", "max_drawdown"]
    return table(w, ["run_id", "year"]).select(cols).union(table(whole, ["run_id"]).select(cols))


def walk_forward_verdict(windows: DataFrame) -> DataFrame:
    """(run_id, defined, positive, passed): at least two thirds of the yearly Sharpes, and that of all years, above 0; null under three."""
    g = windows.groupBy("run_id").agg(F.count(F.when(F.col("year").isNotNull(), F.col("sharpe"))).alias("defined"), F.count_if(F.col("year").isNotNull() & (F.col("sharpe") > 0)).alias("positive"), F.max(F.when(F.col("year").isNull(), F.col("sharpe"))).alias("total"))
    passed = F.when(F.col("defined") >= 3, (3 * F.col("positive") >= 2 * F.col("defined")) & F.coalesce(F.col("total") > 0, F.lit(False)))
    return g.select("run_id", "defined", "positive", passed.alias("passed"))


def regime_labels(bars: DataFrame, instrument_id: str, window: int, history: int) -> DataFrame:
    """(ts, label): low, medium or high: the day's volatility against the terciles of the last ``history`` ones; undefined without them."""
    b = bars.where(F.col("instrument_id") == instrument_id).withColumn("ret", F.col("close") / F.lag("close").over(by_day()) - 1)
    v = b.withColumn("vol", F.when(F.count("ret").over(by_day().rowsBetween(-(window - 1), 0)) == window, F.stddev_samp("ret").over(by_day().rowsBetween(-(window - 1), 0))))
    # A window that lacks a volatility has no quantiles.
    t = v.join(rolling_quantiles(v, "instrument_id", "ts", "vol", history, (1 / 3, 2 / 3)), ["instrument_id", "ts"])
    label = F.when(F.col("q").isNull() | F.coalesce(F.col("vol") <= 0, F.lit(True)), "undefined").when(F.col("vol") <= F.col("q")[0], "low").when(F.col("vol") <= F.col("q")[1], "medium").otherwise("high")
    return t.select("ts", label.alias("label"))


def regime_metrics(snaps: DataFrame, labels: DataFrame, ppy: int) -> DataFrame:
    """Returns by the regime of the day before; a day without a label raises."""
    a = active(snaps).join(labels.withColumnRenamed("ts", "prev_ts"), "prev_ts", "left")
    label = F.when(F.col("label").isNull(), F.raise_error(F.lit("no regime label"))).otherwise(F.col("label"))
    return a.withColumn("label", label).groupBy("run_id", "label").agg(F.count("*").alias("days"), growth_rate(F.product(1 + F.col("r")), F.count("*"), ppy).alias("cagr"), sharpe_of(F.col("r"), ppy).alias("sharpe"), sortino_of(F.col("r"), ppy).alias("sortino"))


def stress(held: DataFrame, shocks: DataFrame) -> DataFrame:
    """(run_id, scenario, ts, impact) of shocks (scenario, instrument_id, shock) on each day's positions; a held one without a shock raises."""
    names = shocks.select("scenario").distinct()
    m = held.where("position != 0").crossJoin(names).join(shocks, ["scenario", "instrument_id"], "left")
    s = F.when(F.col("shock").isNull(), F.raise_error(F.lit("no shock for a held instrument")).cast("double")).otherwise(F.col("shock"))
    # Summed in the order of instruments, so that an impact of 0 stays 0 however rows are dealt.
    parts = F.sort_array(F.collect_list(F.struct("instrument_id", (F.col("position") * s).alias("x"))))
    return m.groupBy("run_id", "scenario", "ts").agg(F.aggregate(parts, F.lit(0.0), lambda total, p: total + p["x"]).alias("impact"))


def stress_summary(impacts: DataFrame) -> DataFrame:
    return impacts.groupBy("run_id", "scenario").agg(F.max("ts").alias("last_held_on"), F.max_by("impact", "ts").alias("last_impact"), F.min_by("ts", F.struct("impact", "ts")).alias("worst_held_on"), F.min("impact").alias("worst_impact"), F.avg((F.col("impact") < 0).cast("double")).alias("losing_share"))


def worst_day(bars: DataFrame, reference: str, scenario: str = "worst day") -> DataFrame:
    """Shocks that replay the reference's worst day; instruments that did not trade then move with it."""
    r = bars.withColumn("shock", F.col("close") / F.lag("close").over(by_day()) - 1).where("shock is not null").select("instrument_id", "ts", "shock")
    worst = r.where(F.col("instrument_id") == reference).agg(F.min(F.struct("shock", "ts")).alias("w")).select(F.col("w")["ts"].alias("ts"), F.col("w")["shock"].alias("ref"))
    ids = bars.select("instrument_id").distinct().crossJoin(F.broadcast(worst))
    return ids.join(r, ["instrument_id", "ts"], "left").select(F.lit(scenario).alias("scenario"), "instrument_id", F.coalesce("shock", "ref").alias("shock"))


def trade_ledger(simulated: DataFrame, bars: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per holding of an instrument on one side, with its P&L before and after costs and the regime at its entry's close."""
    whole = simulated.where("instrument_id is null").select("run_id", "ts", "equity")
    day = Window.partitionBy("run_id").orderBy("ts")
    eq = whole.withColumn("k", F.row_number().over(day)).withColumn("eq0", F.lag("equity").over(day)).withColumn("eq00", F.lag("equity", 2).over(day)).withColumn("last_ts", F.max("ts").over(Window.partitionBy("run_id"))).drop("equity")
    price = bars.select("instrument_id", "ts", "close")
    rows = simulated.where("instrument_id is not null").select("run_id", "ts", "prev_ts", "instrument_id", "position", "cost").join(eq, ["run_id", "ts"])
    rows = rows.join(price.withColumnRenamed("close", "p1"), ["instrument_id", "ts"], "left").join(price.select("instrument_id", F.col("ts").alias("prev_ts"), F.col("close").alias("p0")), ["instrument_id", "prev_ts"], "left")
    w = Window.partitionBy("run_id", "instrument_id").orderBy("k")
    side = F.signum("position").cast("int")
    rows = rows.withColumn("side", side).withColumn("money", F.col("cost") * F.col("eq0"))
    follows = F.lag("k").over(w) == F.col("k") - 1
    rows = rows.withColumn("side0", F.when(follows, F.lag("side").over(w)).otherwise(F.lit(0))).withColumn("w0", F.when(follows, F.lag("position").over(w))).withColumn("p00", F.lag("p0").over(w))
    rows = rows.withColumn("side0", F.coalesce("side0", F.lit(0))).withColumn("opens", ((F.col("side") != 0) & (F.col("side") != F.col("side0"))).cast("int")).withColumn("trade", F.sum("opens").over(w))
    flip = (F.col("opens") == 1) & (F.col("side0") != 0)
    held = F.abs(F.try_divide(F.col("w0") * F.try_divide("p0", "p00"), F.try_divide("eq0", "eq00")))
    rows = rows.withColumn("old_share", F.when(flip, held / (held + F.abs("position"))).otherwise(F.lit(0.0)))
    own = rows.select("run_id", "instrument_id", "trade", "ts", "prev_ts", "p0", "p1", "position", "side", "last_ts", (F.col("money") * (1 - F.col("old_share"))).alias("costs"), F.when(F.col("side") != 0, F.col("eq0") * F.col("position") * (F.col("p1") / F.col("p0") - 1)).otherwise(F.lit(0.0)).alias("gross"))
    old = rows.where("old_share > 0").select("run_id", "instrument_id", (F.col("trade") - 1).alias("trade"), F.lit(None).cast("date").alias("ts"), F.lit(None).cast("date").alias("prev_ts"), *[F.lit(None).cast("double").alias(c) for c in ("p0", "p1", "position")], F.lit(0).alias("side"), "last_ts", (F.col("money") * F.col("old_share")).alias("costs"), F.lit(0.0).alias("gross"))
    in_ = F.col("side") != 0
    t = own.unionByName(old).groupBy("run_id", "instrument_id", "trade").agg(
        F.max(F.when(in_, F.col("side"))).alias("side"), F.min(F.when(in_, F.col("prev_ts"))).alias("entry_ts"), F.min_by(F.when(in_, F.col("p0")), F.when(in_, F.col("ts"))).alias("entry_price"),
        F.max(F.when(in_, F.col("ts"))).alias("exit_ts"), F.max_by(F.when(in_, F.col("p1")), F.when(in_, F.col("ts"))).alias("exit_price"), F.abs(F.min_by(F.when(in_, F.col("position")), F.when(in_, F.col("ts")))).alias("size"),
        F.sum("gross").alias("gross_pnl"), F.sum("costs").alias("costs"), F.max("last_ts").alias("last_ts"),
    )
    t = t.join(labels.select(F.col("ts").alias("entry_ts"), F.col("label").alias("regime_at_entry")), "entry_ts", "left")
    return t.select("run_id", "instrument_id", F.when(F.col("side") > 0, "long").otherwise("short").alias("side"), "entry_ts", "entry_price", "exit_ts", "exit_price", "size", "gross_pnl", "costs", (F.col("gross_pnl") - F.col("costs")).alias("net_pnl"), F.datediff("exit_ts", "entry_ts").alias("holding_days"), "regime_at_entry", (F.col("exit_ts") == F.col("last_ts")).alias("open_at_end"))


def pnl_groups(trades: DataFrame) -> DataFrame:
    """(dimension, key, trades, win_rate, total, mean, median, worst, best, costs) by regime, holding time, instrument and exit month, in one pass."""
    t = trades.withColumn("bucket", holding_bucket(F.col("holding_days"))).withColumn("month", F.date_format("exit_ts", "yyyy-MM"))
    dims = ["regime_at_entry", "bucket", "instrument_id", "month"]
    g = t.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("trades"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"), F.sum("net_pnl").alias("total_net_pnl"), F.avg("net_pnl").alias("mean_net_pnl"),
        F.percentile("net_pnl", F.lit(0.5)).alias("median_net_pnl"), F.min("net_pnl").alias("worst_net_pnl"), F.max("net_pnl").alias("best_net_pnl"), F.sum("costs").alias("costs"),
    )
    name = F.when(F.col("gid") == 7, "regime").when(F.col("gid") == 11, "holding").when(F.col("gid") == 13, "instrument").otherwise("month")
    return g.select(name.alias("dimension"), F.coalesce(*dims).alias("key"), "trades", "win_rate", "total_net_pnl", "mean_net_pnl", "median_net_pnl", "worst_net_pnl", "best_net_pnl", "costs")


def total_costs(snaps: DataFrame) -> DataFrame:
    s = snaps.withColumn("eq0", F.lag("equity").over(run_day()))
    return s.groupBy("run_id").agg(F.sum(F.col("cost") * F.col("eq0")).alias("total_costs"))


def cost_sensitivity(metrics: DataFrame, lower: str, higher: str) -> DataFrame:
    """Whether the result survives the higher costs: a Sharpe within 0.1 and a growth of the same sign."""
    a = metrics.where(F.col("run_id") == lower).select(F.col("sharpe").alias("s0"), F.col("cagr").alias("c0"))
    b = metrics.where(F.col("run_id") == higher).select(F.col("sharpe").alias("s1"), F.col("cagr").alias("c1"))
    m = a.crossJoin(b)
    flip = (F.col("c0") > 0) != (F.col("c1") > 0)
    diff = F.col("s0") - F.col("s1")
    verdict = F.when(diff.isNull() | flip.isNull(), "undefined").when((F.abs(diff) < 0.1) & ~flip, "robust").otherwise("cost-dependent")
    return m.select(F.lit(lower).alias("lower_cost"), F.lit(higher).alias("higher_cost"), diff.alias("sharpe_difference"), flip.alias("cagr_sign_flip"), verdict.alias("verdict"))


def return_correlation(snaps: DataFrame) -> DataFrame:
    """(a, b, days, correlation) of every two runs' returns on days when both held something."""
    r = returns(snaps).where("r is not null and invested > 0").select("run_id", "ts", "r")
    x, y = r.select(F.col("run_id").alias("a"), "ts", F.col("r").alias("x")), r.select(F.col("run_id").alias("b"), "ts", F.col("r").alias("y"))
    g = x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("days"), F.corr("x", "y").alias("c"))
    return g.select("a", "b", "days", F.when(F.col("days") >= 2, F.when(~F.isnan("c"), F.col("c"))).alias("correlation"))


def sparkline(snaps: DataFrame, points: int = 120) -> DataFrame:
    """At most ``points`` values of each curve, evenly spaced, first and last among them."""
    s = snaps.withColumn("i", F.row_number().over(run_day()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("run_id")))
    m = F.least(F.col("n"), F.lit(points))
    picks = s.select("run_id", "n", m.alias("m")).distinct().select("run_id", F.explode(F.transform(F.sequence(F.lit(0), (F.col("m") - 1).cast("int")), lambda i: F.when(F.col("m") > 1, F.floor(i * (F.col("n") - 1) / (F.col("m") - 1))).otherwise(F.lit(0)))).alias("i"))
    return s.join(picks.distinct(), ["run_id", "i"]).select("run_id", "i", "ts", "equity")


def aligned(snaps: DataFrame) -> DataFrame:
    """(run_id, ts, r) on days when every run of the table is active."""
    a = active(snaps).select("run_id", "ts", "r")
    runs = a.agg(F.count_distinct("run_id").alias("runs"))
    full = a.groupBy("ts").agg(F.count("*").alias("n")).crossJoin(F.broadcast(runs)).where("n = runs").select("ts")
    return a.join(full, "ts", "left_semi")
