"""The registered queries of the research operators, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import backtest as bt
from ..operators import cointegration as coint
from ..operators import metrics as mt
from ..operators import portfolio as pf
from ..operators import prep, signals, universe, validation
from ..sources.files import stored
from .bars import D, event_bars, line_bars, literal, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PPY = 365
#: Grid of the compared momentum runs.
GRID = {"m020": 20, "m060": 60, "m120": 120, "m250": 250}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places and nine figures, so that the order of a sum doesn't show; no negative zero.

    A factor just over 1 before each rounding keeps decimal ties from falling either way.
    """
    off = F.lit(1 + 3e-12)
    nine = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.8e", F.round(F.col(c) * off, digits) * off + F.lit(0.0)).cast("double"))
    return df.select(*[nine(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _run(spark: SparkSession, sf_dir: str, grid: dict[str, int] | None = None):
    """(bars, calendar, targets) of momentum runs by look-back."""
    bars = line_bars(spark, sf_dir)
    calendar = bt.periods(bars)
    market = bt.market(bars, calendar)
    parts = [bt.equal_weight(bt.tradable(signals.momentum(bars, k), market)).select(F.lit(n).alias("run_id"), "ts", "instrument_id", "weight") for n, k in (grid or {"m060": 60}).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return bars, calendar, out


def _simulated(spark: SparkSession, sf_dir: str, bps: float = 10.0, grid: dict[str, int] | None = None, hold: bool = False) -> DataFrame:
    bars, calendar, targets = _run(spark, sf_dir, grid)
    return bt.simulate(targets, bars, calendar, bt.naive_cost(bars, bps), hold)


def _snaps(spark: SparkSession, sf_dir: str, bps: float = 10.0, grid: dict[str, int] | None = None, hold: bool = False) -> DataFrame:
    bars, calendar, targets = _run(spark, sf_dir, grid)
    return bt.run_equity(targets, bars, calendar, bt.naive_cost(bars, bps), hold)


@query
def bars_from_lines(spark, sf_dir):
    return line_bars(spark, sf_dir)


@query
def bars_from_events(spark, sf_dir):
    return event_bars(spark, sf_dir)


@query
def bars_in_range(spark, sf_dir):
    return line_bars(spark, sf_dir).where((F.col("ts") >= D("1996-03-01")) & (F.col("ts") <= D("1996-06-30")) & (F.col("instrument_id") == "s2"))


@query
def momentum_signal(spark, sf_dir):
    return rounded(signals.momentum(line_bars(spark, sf_dir), 60).drop("weight"))


@query
def reversal_signal(spark, sf_dir):
    return rounded(signals.reversal(event_bars(spark, sf_dir), 7).drop("weight"))


@query
def rolling_volatility(spark, sf_dir):
    return rounded(signals.rolling_volatility(line_bars(spark, sf_dir), 30))


@query
def ewma_volatility(spark, sf_dir):
    return rounded(signals.ewma_volatility(event_bars(spark, sf_dir), 5.0, 10))


@query
def vol_target(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return rounded(signals.volatility_targeted(signals.momentum(bars, 60), signals.rolling_volatility(bars, 30), 0.4, 1.0, PPY))


@query
def month_end_bars(spark, sf_dir):
    return signals.month_ends(line_bars(spark, sf_dir))


@query
def cross_section(spark, sf_dir):
    return rounded(signals.cross_sectional_momentum(line_bars(spark, sf_dir), 12, 1, 0.25, True, 100.0))


@query
def cross_section_daily(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return signals.monthly_to_daily(signals.cross_sectional_momentum(bars, 12, 1, 0.25, True, 100.0), bars).groupBy("ts", "direction").agg(F.count("*").alias("n"))


def _path(spark, sf_dir):
    return signals.spread_path(line_bars(spark, sf_dir), spark.createDataFrame([("s1/s2", "s1", "s2")], "pair string, y string, x string"), 60)


@query
def pairs_spread(spark, sf_dir):
    return rounded(_path(spark, sf_dir).drop("pair"), 5)


@query
def pair_states(spark, sf_dir):
    return rounded(signals.pair_states(_path(spark, sf_dir), 1.5, 0.0).drop("pair"), 5)


def _every_pair(spark, sf_dir):
    pairs = [(f"s{j}/s{i}", f"s{j}", f"s{i}") for i in range(8) for j in range(i + 1, 8)]
    return signals.paired(line_bars(spark, sf_dir), spark.createDataFrame(pairs, "pair string, y string, x string"))


@query
def cointegration(spark, sf_dir):
    """The stated pairs: every two of the eight instruments."""
    return signals.cointegration(_every_pair(spark, sf_dir))


@query
def rolling_cointegration(spark, sf_dir):
    """The test of every 60-day window of every pair."""
    out = coint.rolling_statistics(_every_pair(spark, sf_dir), 60)
    return rounded(out.select("pair", "ts", "statistic", coint.mackinnon_p(F.col("statistic")).alias("p_value")), 5)


@query
def pair_states_gated(spark, sf_dir):
    """Positions of a pair that open only while its window rejects no cointegration at a fifth."""
    pair = spark.createDataFrame([("s1/s2", "s1", "s2")], "pair string, y string, x string")
    path = coint.gated(_path(spark, sf_dir), signals.paired(line_bars(spark, sf_dir), pair), 60, 0.2)
    return rounded(signals.pair_states(path, 1.5, 0.0).drop("pair"), 5)


@query
def members_on_days(spark, sf_dir):
    days = prep.sessions(line_bars(spark, sf_dir))
    return universe.members_asof(days, literal(spark, "memberships"))


@query
def members_only_bars(spark, sf_dir):
    return universe.members_only(line_bars(spark, sf_dir), literal(spark, "memberships")).select("instrument_id", "ts", "close")


FIRST, LAST = D("1995-01-01"), D("2001-12-31")


def order_changes(spark, sf_dir):
    """(instrument_id, day, added): customers join with an order that is open or pending and leave with a filled one; a day's last order counts."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("instrument_id"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    by_day = o.groupBy("instrument_id", "day").agg((F.max_by("o_orderstatus", "o_orderkey") != "F").alias("added"))
    before = F.lag("added").over(Window.partitionBy("instrument_id").orderBy("day"))
    return by_day.withColumn("before", before).where("before is null or before != added").drop("before")


def order_memberships(spark, sf_dir):
    return universe.memberships_from_changes(order_changes(spark, sf_dir), FIRST).where("end is null or start <= end")


@query
def instruments_between(spark, sf_dir):
    return universe.instruments_between(order_memberships(spark, sf_dir), D("1998-07-01"), D("1998-12-31"), "s4")


@query
def member_spans(spark, sf_dir):
    return universe.member_spans(order_memberships(spark, sf_dir), D("1996-06-01"), D("1999-06-01"))


@query
def former_members(spark, sf_dir):
    return universe.former_members(order_memberships(spark, sf_dir))


@query
def touching_runs(spark, sf_dir):
    """Memberships cut at the ends of years come together again."""
    m = order_memberships(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.year("start"), F.year(F.coalesce("end", F.lit(LAST))))))
    day = lambda month, d: F.make_date("y", F.lit(month), F.lit(d))
    end = F.when(F.col("end").isNull() & (F.col("y") == LAST.year), F.lit(None).cast("date")).otherwise(F.least(F.coalesce("end", day(12, 31)), day(12, 31)))
    return universe.touching_runs(m.select("instrument_id", F.greatest("start", day(1, 1)).alias("start"), end.alias("end")))


@query
def memberships_from_changes(spark, sf_dir):
    return universe.memberships_from_changes(order_changes(spark, sf_dir), FIRST)


@query
def price_coverage(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return rounded(universe.price_coverage(literal(spark, "memberships"), bars, prep.sessions(bars)))


@query
def adjusted_bars(spark, sf_dir):
    return rounded(prep.adjust(line_bars(spark, sf_dir), literal(spark, "actions")).select("instrument_id", "ts", "open", "close", "volume", "unadjusted_close"), 5)


@query
def delisted_bars(spark, sf_dir):
    b = prep.delisted(line_bars(spark, sf_dir), literal(spark, "delistings"), -0.3).where("delisting")
    return rounded(b.select("instrument_id", "ts", "close", "volume"), 4)


@query
def above_cash(spark, sf_dir):
    return rounded(prep.above_cash(line_bars(spark, sf_dir), literal(spark, "cash")).select("instrument_id", "ts", "open", "close"), 4)


@query
def next_session(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return prep.next_session(days, prep.sessions(line_bars(spark, sf_dir).where("instrument_id = 's1'")))


@query
def duplicate_dates(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    return prep.duplicate_dates(bars.union(bars.where("instrument_id = 'click'")))


@query
def inconsistent_ohlc(spark, sf_dir):
    return prep.inconsistent_ohlc(line_bars(spark, sf_dir).withColumn("high", F.when(F.dayofmonth("ts") == 3, F.col("high") * 0.5).otherwise(F.col("high"))))


@query
def non_positive_prices(spark, sf_dir):
    return prep.non_positive_prices(line_bars(spark, sf_dir).withColumn("low", F.when(F.dayofmonth("ts") == 3, -F.col("low")).otherwise(F.col("low"))))


@query
def missing_sessions(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return prep.missing_sessions(bars, prep.sessions(bars))


@query
def stale_closes(spark, sf_dir):
    return prep.stale_closes(line_bars(spark, sf_dir).withColumn("close", F.floor(F.col("close") / 10).cast("double")), 3)


@query
def extreme_moves(spark, sf_dir):
    return rounded(prep.extreme_moves(line_bars(spark, sf_dir), 4.0), 4)


@query
def quality_summary(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return prep.quality_summary(prep.quality_report(bars, prep.sessions(bars)))


@query
def equal_weights(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    return rounded(bt.equal_weight(bt.tradable(signals.momentum(bars, 60), bt.market(bars, bt.periods(bars)))).select("instrument_id", "ts", "weight"))


@query
def scaled_weights(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    s = signals.volatility_targeted(signals.momentum(bars, 60), signals.rolling_volatility(bars, 30), 0.4, 1.0, PPY)
    return rounded(bt.scaled_weight(s).select("instrument_id", "ts", "weight"))


@query
def realistic_cost(spark, sf_dir):
    return rounded(bt.realistic_cost(line_bars(spark, sf_dir), 10.0, 0.05, 30))


@query
def d_backtest_momentum(spark, sf_dir):
    """The flagship: growth of one unit under daily rebalanced momentum without costs."""
    bars, calendar, targets = _run(spark, sf_dir)
    return rounded(bt.frictionless(targets, bt.market(bars, calendar), calendar), 5)


@query
def backtest_with_costs(spark, sf_dir):
    return rounded(_snaps(spark, sf_dir).select("run_id", "ts", "equity", "cost", "traded", "cash"), 5)


@query
def backtest_holdings(spark, sf_dir):
    return rounded(bt.holdings(_simulated(spark, sf_dir)).select("ts", "instrument_id", "position", "cost", "traded"), 5)


@query
def backtest_held_until_change(spark, sf_dir):
    return rounded(_snaps(spark, sf_dir, hold=True).select("ts", "equity", "traded"))


@query
def event_driven(spark, sf_dir):
    bars, calendar, targets = _run(spark, sf_dir)
    return bt.event_driven(targets, bars, calendar, bt.naive_cost(bars, 10.0), "next_open", 0.025)


@query
def engine_parity(spark, sf_dir):
    """The largest gap between the two engines' equity curves, filled at the close without limits."""
    bars, calendar, targets = _run(spark, sf_dir)
    a = bt.snapshots(bt.simulate(targets, bars, calendar)).select("ts", F.col("equity").alias("x"))
    b = bt.event_driven(targets, bars, calendar, capital=1.0).where("instrument_id is null").select("ts", F.col("equity").alias("y"))
    return a.join(b, "ts", "full").agg(F.count("*").alias("days"), (F.max(F.abs(F.col("x") - F.col("y"))) < 1e-6).alias("equal"))


@query
def drawdown(spark, sf_dir):
    return rounded(mt.drawdowns(_snaps(spark, sf_dir)).select("ts", "drawdown"), 5)


@query
def run_metrics(spark, sf_dir):
    return rounded(mt.run_metrics(_snaps(spark, sf_dir, grid=GRID), PPY), 5)


@query
def monthly_returns(spark, sf_dir):
    return rounded(mt.period_returns(_snaps(spark, sf_dir), "month"), 5)


@query
def yearly_returns(spark, sf_dir):
    return rounded(mt.period_returns(_snaps(spark, sf_dir), "year"), 5)


@query
def walk_forward(spark, sf_dir):
    return rounded(mt.walk_forward(_snaps(spark, sf_dir), PPY), 5)


@query
def walk_forward_verdict(spark, sf_dir):
    return mt.walk_forward_verdict(mt.walk_forward(_snaps(spark, sf_dir, grid=GRID), PPY))


@query
def regime_labels(spark, sf_dir):
    return mt.regime_labels(line_bars(spark, sf_dir), "s0", 30, 365)


@query
def regime_metrics(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    labels = prep.sessions(bars).join(mt.regime_labels(bars, "s0", 30, 365), "ts", "left").select("ts", F.coalesce("label", F.lit("undefined")).alias("label"))
    return rounded(mt.regime_metrics(_snaps(spark, sf_dir), labels, PPY), 4)


@query
def stress_impacts(spark, sf_dir):
    return rounded(mt.stress(bt.holdings(_simulated(spark, sf_dir)), literal(spark, "shocks")).select("scenario", "ts", "impact"), 5)


@query
def stress_summary(spark, sf_dir):
    return rounded(mt.stress_summary(mt.stress(bt.holdings(_simulated(spark, sf_dir)), literal(spark, "shocks"))))


@query
def worst_day(spark, sf_dir):
    return rounded(mt.worst_day(line_bars(spark, sf_dir), "s0"))


def _trades(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    labels = prep.sessions(bars).join(mt.regime_labels(bars, "s0", 30, 365), "ts", "left").select("ts", F.coalesce("label", F.lit("undefined")).alias("label"))
    return mt.trade_ledger(stored(_simulated(spark, sf_dir), "simulated"), bars, labels)


@query
def trade_ledger(spark, sf_dir):
    return rounded(_trades(spark, sf_dir))


@query
def pnl_groups(spark, sf_dir):
    return rounded(mt.pnl_groups(_trades(spark, sf_dir)))


@query
def trades_count(spark, sf_dir):
    """How many trades the filter of ``trades_page`` leaves, of all that there are."""
    return _trades(spark, sf_dir).agg(F.count_if(F.col("side") == "long").alias("total"), F.count("*").alias("trades"))


@query
def event_instants(spark, sf_dir):
    """Each event's time in microseconds."""
    return table(spark, sf_dir, "events").select("event_id", scalars.epoch_us(F.col("ts")).alias("us"))


@query
def trades_page(spark, sf_dir):
    """One page of long trades, best first (a page is what is asked for)."""
    t = _trades(spark, sf_dir).where("side = 'long'")
    return rounded(t.orderBy(F.desc("net_pnl"), "entry_ts", "instrument_id").offset(25).limit(25))


@query
def total_costs(spark, sf_dir):
    return rounded(mt.total_costs(_snaps(spark, sf_dir)), 5)


@query
def cost_sensitivity(spark, sf_dir):
    m = mt.run_metrics(_snaps(spark, sf_dir, bps=0.0), PPY).withColumn("run_id", F.lit("free")).union(mt.run_metrics(_snaps(spark, sf_dir, bps=10.0), PPY).withColumn("run_id", F.lit("10bps")))
    return rounded(mt.cost_sensitivity(m, "free", "10bps"), 5)


@query
def capacity(spark, sf_dir):
    bars, calendar, targets = _run(spark, sf_dir)
    return bt.capacity(bt.event_driven(targets, bars, calendar), bars, 100_000.0)


@query
def return_correlation(spark, sf_dir):
    return rounded(mt.return_correlation(_grid(spark, sf_dir)), 5)


@query
def sparkline(spark, sf_dir):
    return rounded(mt.sparkline(_snaps(spark, sf_dir), 120), 5)


def _grid(spark, sf_dir):
    """The equity of the compared runs as a table: what follows reads it several times."""
    return stored(_snaps(spark, sf_dir, grid=GRID), "runs")


def _aligned(spark, sf_dir):
    return stored(mt.aligned(_grid(spark, sf_dir)), "aligned")


@query
def aligned_returns(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir))


@query
def sharpe_statistics(spark, sf_dir):
    return rounded(validation.sharpe_statistics(_aligned(spark, sf_dir)), 5)


@query
def probabilistic_sharpe(spark, sf_dir):
    return validation.probabilistic_sharpe(validation.sharpe_statistics(_aligned(spark, sf_dir)))


@query
def deflated_sharpe(spark, sf_dir):
    return validation.deflated_sharpe(validation.sharpe_statistics(_aligned(spark, sf_dir)), len(GRID))


@query
def overfitting_splits(spark, sf_dir):
    return rounded(validation.overfitting_splits(_aligned(spark, sf_dir), 16))


@query
def overfitting_probability(spark, sf_dir):
    return rounded(validation.overfitting_probability(validation.overfitting_splits(_aligned(spark, sf_dir), 16)))


@query
def purged_paths(spark, sf_dir):
    return validation.path_sharpes(validation.purged_selection(_aligned(spark, sf_dir), 10, 2, 1, 0.01), PPY)


@query
def paths_gate(spark, sf_dir):
    return validation.paths_gate(validation.path_sharpes(validation.purged_selection(_aligned(spark, sf_dir), 10, 2, 1, 0.01), PPY))


@query
def permutation_test(spark, sf_dir):
    bars, calendar, targets = _run(spark, sf_dir)
    return validation.p_value(validation.permutation_draws(targets, bt.market(bars, calendar), PPY, draws=10_000))


def _holdings(spark, sf_dir):
    """Growth within the holdings of the momentum run, whose decisions are daily."""
    bars = line_bars(spark, sf_dir)
    calendar = bt.periods(bars)
    market = bt.market(bars, calendar)
    signal = signals.momentum(bars, 60)
    weights = bt.equal_weight(bt.tradable(signal, market)).select("instrument_id", "ts", "weight")
    every = signal.select("instrument_id", "ts").join(weights, ["instrument_id", "ts"], "left").withColumn("run_id", F.lit("m060"))
    return calendar, validation.growth_in_holding(validation.decisions(every, market), prep.forward_filled(bars, prep.sessions(bars)), calendar, calendar.select(F.lit("m060").alias("run_id"), "ts"))


@query
def random_portfolios(spark, sf_dir):
    calendar, growth = _holdings(spark, sf_dir)
    runs = calendar.agg(F.count("*").alias("n")).select(F.lit("m060").alias("run_id"), "n")
    return validation.p_value(validation.random_portfolio_draws(growth, runs, PPY, draws=10_000))


@query
def chosen_by_year(spark, sf_dir):
    return rounded(pf.choose_by_year(mt.returns(_grid(spark, sf_dir)).where("r is not null").select("run_id", "ts", "r"), 200, {k: i for i, k in enumerate(GRID)}), 5)


def _windows(spark, sf_dir):
    return stored(pf.sleeve_windows(mt.returns(_grid(spark, sf_dir)).where("r is not null").select("run_id", "ts", "r"), 90, 60), "windows")


@query
def inverse_volatility(spark, sf_dir):
    return rounded(pf.inverse_volatility(_windows(spark, sf_dir)), 5)


@query
def risk_parity(spark, sf_dir):
    return pf.risk_parity(_windows(spark, sf_dir))


@query
def diversification(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return rounded(pf.diversification(w, pf.inverse_volatility(w)), 4)


@query
def netted_portfolio(spark, sf_dir):
    _, _, targets = _run(spark, sf_dir, GRID)
    return rounded(pf.netted(targets, pf.equal_sleeves(_windows(spark, sf_dir))).select("ts", "instrument_id", "weight"))


@query
def name_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("other")).where("other is not null")
    return rounded(p.select("p_partkey", scalars.name_similarity(F.col("p_name"), F.col("other")).alias("similarity")))


@query
def normalised_tickers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.normalise_ticker(F.concat_ws(" .", "c_mktsegment", "c_name")).alias("ticker"))


@query
def trials_on_same_data(spark, sf_dir):
    """A trial per customer, forty to a universe; its training starts with the first order."""
    key = F.col("o_custkey")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("training_start"), F.to_date(F.max("o_orderdate")).alias("registered_at"))
    universe_ = F.concat(F.lit("u"), F.floor(key / 40).cast("string"))
    t = o.select(F.concat(F.lit("c"), key.cast("string")).alias("hypothesis"), universe_.alias("universe"), "training_start", F.date_add("training_start", (30 + key % 60).cast("int")).alias("training_end"), "registered_at")
    return validation.trials_on_same_data(t)


from .oracle import ORACLE_SQL  # noqa: E402, F401
from . import feed_queries, index_queries, study_queries  # noqa: E402

ORACLE_SQL.update(feed_queries.SQL | index_queries.SQL | study_queries.SQL)
