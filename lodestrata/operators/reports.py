"""What is stored and shown of runs: row sets with their order, comparisons, portfolio and scaling summaries, the registry of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, portfolio, validation
from .validation import concluded_status

#: The order in which groups of these dimensions are shown.
REGIMES = ["low", "medium", "high", "undefined"]
BUCKETS = ["1-7d", "8-30d", "31-90d", "91-365d", "366d+"]
#: The statuses that may follow each status.
TRANSITIONS = {"proposed": ["testing"], "testing": ["confirmed", "rejected", "inconclusive"], "confirmed": [], "rejected": [], "inconclusive": []}
SCHEMA_VERSION = 1


def in_order(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` (key, ...) with position: that of the key in ``keys``; others go."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    return groups.withColumn("position", place.cast("int")).where("position > 0")


def by_total(groups: DataFrame) -> DataFrame:
    """``groups`` (dimension, key, total_net_pnl, ...) with position: the largest total first, ties by key."""
    return groups.withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("total_net_pnl"), "key")))


def extremes(groups: DataFrame, each: int) -> DataFrame:
    """The first and the last ``each`` of every dimension by total (all of them where there are no more than twice as many)."""
    n = F.count("*").over(Window.partitionBy("dimension"))
    return by_total(groups).withColumn("__n", n).where((F.col("position") <= each) | (F.col("position") > F.col("__n") - each)).drop("__n")


def trade_counters(trades: DataFrame) -> DataFrame:
    return trades.groupBy("run_id").agg(F.count("*").alias("trades"), F.count_if("open_at_end").alias("open_at_end"), F.count_if(F.col("net_pnl") > 0).alias("winners"))


def sources_of(bars: DataFrame) -> DataFrame:
    """(sources): the distinct sources, sorted and joined by a comma."""
    return bars.agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def max_equity_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(days, gap): the largest gap of two curves (ts, equity); a day that only one has raises."""
    both = a.select("ts", F.col("equity").alias("x")).join(b.select("ts", F.col("equity").alias("y")), "ts", "full")
    gap = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("the curves have different days")).cast("double")).otherwise(F.abs(F.col("x") - F.col("y")))
    return both.agg(F.count("*").alias("days"), F.max(gap).alias("gap"))


def limited_orders(orders: DataFrame) -> DataFrame:
    """(run_id, orders, limited): how many orders were filled for less than they asked."""
    own = orders.where("instrument_id is not null")
    return own.groupBy("run_id").agg(F.count("*").alias("orders"), F.count_if(F.abs("filled") < F.abs("quantity")).alias("limited"))


def comparison_rows(snaps: DataFrame, orders: DataFrame | None, ppy: int) -> DataFrame:
    """(run_id, metrics, total_costs, limited) of each configuration; limited is null without ``orders``."""
    out = metrics.run_metrics(snaps, ppy).join(metrics.total_costs(snaps), "run_id")
    if orders is None:
        return out.withColumn("limited", F.lit(None).cast("long"))
    return out.join(limited_orders(orders).select("run_id", "limited"), "run_id", "left")


def run_rows(snaps: DataFrame, trades: DataFrame, ppy: int) -> DataFrame:
    """One row per run: its span, metrics, costs and trade counters, with the layout's version."""
    span = snaps.groupBy("run_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max_by("equity", "ts").alias("final_equity"))
    out = span.join(comparison_rows(snaps, None, ppy).drop("limited"), "run_id").join(trade_counters(trades), "run_id", "left")
    return out.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def monthly_rows(snaps: DataFrame) -> DataFrame:
    """(run_id, year, month, ret) in order."""
    p = metrics.period_returns(snaps, "month")
    return p.select("run_id", F.year("period").alias("year"), F.month("period").alias("month"), "ret").orderBy("run_id", "year", "month")


def result_tables(snaps: DataFrame, simulated: DataFrame, trades: DataFrame, labels: DataFrame, shocks: DataFrame, ppy: int) -> dict[str, DataFrame]:
    """The row sets that are stored of runs, by table name; numbers that are undefined are null."""
    from .backtest import holdings

    pnl = metrics.pnl_groups(trades)
    windows = metrics.walk_forward(snaps, ppy)
    return {
        "run": run_rows(snaps, trades, ppy),
        "equity": metrics.drawdowns(snaps).select("run_id", "ts", "equity", "drawdown"),
        "trades": trades,
        "monthly_returns": monthly_rows(snaps),
        "yearly_returns": metrics.period_returns(snaps, "year").select("run_id", F.year("period").alias("year"), "ret"),
        "walk_forward": windows.where("year is not null"),
        "regimes": metrics.regime_metrics(snaps, labels, ppy),
        "pnl_by_regime": in_order(pnl.where("dimension = 'regime'"), REGIMES),
        "pnl_by_holding": in_order(pnl.where("dimension = 'holding'"), BUCKETS),
        "pnl_by_instrument": by_total(pnl.where("dimension = 'instrument'")),
        "pnl_by_month": pnl.where("dimension = 'month'").withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy("key"))),
        "stress": metrics.stress_summary(metrics.stress(holdings(simulated), shocks)),
    }


def headline(registry: DataFrame, runs: DataFrame, primary: str) -> DataFrame:
    """(hypothesis, status, has_run, sharpe, cagr, max_drawdown, start, end): each definition with its primary run's figures, if it has one."""
    own = runs.where(F.col("run_id") == primary).select("hypothesis", "sharpe", "cagr", "max_drawdown", F.col("start").alias("run_start"), F.col("end").alias("run_end"))
    return registry.join(own, "hypothesis", "left").select("hypothesis", "status", "has_run", "sharpe", "cagr", "max_drawdown", "run_start", "run_end")


def status_of(has_run: Column, in_sample: Column, verdict: Column) -> Column:
    """The gates decide once the holdout is open (verdict); before that a stored run means testing."""
    passed = F.when(verdict == "passed", True).when(verdict == "rejected", False)
    return F.when(verdict.isNotNull(), concluded_status(in_sample, passed)).when(has_run, "testing").otherwise("proposed")


def registry_rows(definitions: DataFrame, gates: DataFrame, opened: DataFrame) -> DataFrame:
    """Every definition that is not deleted, oldest first, with its holdout record, how many trials share its data, and its status.

    definitions: (hypothesis, universe, training_start, training_end, registered_at, deleted, ...); gates: (hypothesis, in_sample_passed) of stored runs;
    opened: (hypothesis, verdict, ...). Deleted definitions still count as trials.
    """
    shared = validation.trials_on_same_data(definitions).groupBy("hypothesis").agg((F.count("*") + 1).alias("trials_on_same_data"))
    g = gates.select("hypothesis", F.col("in_sample_passed"), F.lit(True).alias("has_run"))
    out = definitions.where("not deleted").drop("deleted").join(g, "hypothesis", "left").join(opened, "hypothesis", "left").join(shared, "hypothesis", "left")
    out = out.withColumn("has_run", F.coalesce("has_run", F.lit(False))).withColumn("trials_on_same_data", F.coalesce("trials_on_same_data", F.lit(1)))
    return out.withColumn("status", status_of(F.col("has_run"), F.col("in_sample_passed"), F.col("verdict"))).orderBy("registered_at", "hypothesis")


def transitions(steps: DataFrame) -> DataFrame:
    """``steps`` (hypothesis, status, new_status, walk_forward_passed, holdout_passed) with allowed: whether the status may change so; confirming needs both gates."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]).cast("array<string>"))])
    both = F.coalesce(F.col("walk_forward_passed") & F.col("holdout_passed"), F.lit(False))
    return steps.withColumn("allowed", F.array_contains(table[F.col("status")], F.col("new_status")) & ((F.col("new_status") != "confirmed") | both))


def overlapping_holdouts(definitions: DataFrame) -> DataFrame:
    """(hypothesis) of definitions whose training and holdout periods (start, end) meet: they must not."""
    return definitions.where("training_start <= end and start <= training_end").select("hypothesis")


def missing_prerequisites(components: DataFrame, definitions: DataFrame, opened: DataFrame) -> DataFrame:
    """(hypothesis, component): components (hypothesis, component) whose holdout meets their owner's and is not open yet."""
    own = definitions.select("hypothesis", F.col("start").alias("s0"), F.col("end").alias("e0"))
    other = definitions.select(F.col("hypothesis").alias("component"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    met = components.join(own, "hypothesis").join(other, "component").where("s0 <= e1 and s1 <= e0")
    return met.join(opened.select(F.col("hypothesis").alias("component")), "component", "left_anti").select("hypothesis", "component")


def scale_summary(signals: DataFrame, max_scale: float) -> DataFrame:
    """(instrument_id, mean, least, most, at_cap) of the signals' weights."""
    w = F.col("weight")
    return signals.where("weight is not null").groupBy("instrument_id").agg(F.avg(w).alias("mean"), F.min(w).alias("least"), F.max(w).alias("most"), F.avg((w == max_scale).cast("double")).alias("at_cap"))


def contrast(snaps: DataFrame, ppy: int) -> DataFrame:
    """(run_id, sharpe, volatility, max_drawdown) of runs side by side."""
    s = metrics.drawdowns(metrics.returns(snaps))
    return s.groupBy("run_id").agg(metrics.sharpe_of(F.col("r"), ppy).alias("sharpe"), (F.stddev_samp("r") * F.sqrt(F.lit(float(ppy)))).alias("volatility"), F.min("drawdown").alias("max_drawdown"))


def allocation_summary(weights: DataFrame, ratios: DataFrame) -> DataFrame:
    """(run_id, mean, least, most, months, ratio) of monthly weights (month, run_id, weight) over months that allocate at all; a sleeve that is left out of such
    a month weighs 0 there. ratio: the median diversification ratio (month, ratio)."""
    months = weights.groupBy("month").agg(F.sum("weight").alias("total")).where("total > 0").select("month")
    grid = months.crossJoin(F.broadcast(weights.select("run_id").distinct())).join(weights, ["month", "run_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    g = grid.groupBy("run_id").agg(F.avg("weight").alias("mean"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.count("*").alias("months"))
    return g.crossJoin(F.broadcast(ratios.join(months, "month", "left_semi").agg(F.percentile("ratio", F.lit(0.5)).alias("ratio"))))


def grid_years(r: DataFrame, least: int, order: dict[str, int]) -> DataFrame:
    """(year, run_id, days, sharpe, chosen): on 1 January every run's Sharpe of all returns before it, and whether it is the year's choice."""
    y = r.groupBy("run_id", F.year("ts").alias("y")).agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    w = Window.partitionBy("run_id").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    c = y.select("run_id", (F.col("y") + 1).alias("year"), F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    sharpe = F.when((F.col("n") > 1) & (var > 0), F.col("s") / F.col("n") / F.sqrt(F.when(var > 0, var)))
    choice = portfolio.choose_by_year(r, least, order).select("year", "choice")
    return c.select("year", "run_id", F.col("n").alias("days"), sharpe.alias("sharpe")).join(choice, "year", "left").withColumn("chosen", F.coalesce(F.col("run_id") == F.col("choice"), F.lit(False))).drop("choice")


def grid_report(r: DataFrame, least: int, order: dict[str, int], blocks: int, ppy: int) -> dict[str, DataFrame]:
    """The evidence of a grid over aligned returns: yearly choices, overfitting probability, and paths of purged cross-validation."""
    return {"years": grid_years(r, least, order), "overfitting": validation.overfitting_probability(validation.overfitting_splits(r, blocks)), "paths": validation.path_sharpes(validation.purged_selection(r), ppy)}


def trials_comparison(snaps: DataFrame, ppy: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(metrics of every trial's run, overfitting probability over the days that all of them have)."""
    return metrics.run_metrics(snaps, ppy), validation.overfitting_probability(validation.overfitting_splits(metrics.aligned(snaps), blocks))


def multiple_testing(stats: DataFrame, configurations: DataFrame, ppy: int) -> DataFrame:
    """``stats`` (of sharpe_statistics) with configurations: the summed grid sizes of the trials (run_id, configurations), psr, the annualised threshold and dsr."""
    total = configurations.groupBy("run_id").agg(F.sum("configurations").alias("configurations"))
    met = validation.probabilistic_sharpe(stats.join(total, "run_id"))
    threshold = validation.expected_max_sharpe_of(1 / (F.col("n") - 1), F.col("configurations"))
    out = validation.probabilistic_sharpe(met.withColumn("threshold", threshold).withColumnRenamed("psr", "__psr"), F.col("threshold")).withColumnRenamed("psr", "dsr").withColumnRenamed("__psr", "psr")
    year = F.sqrt(F.lit(float(ppy)))
    return out.select("run_id", "configurations", F.col("n").alias("n_returns"), (F.col("sharpe") * year).alias("sharpe_annualized"), "psr", (F.col("threshold") * year).alias("threshold_annualized"), "dsr")
