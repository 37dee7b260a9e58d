"""Study definitions: frozen parameters that build a run's targets, costs and windows as DataFrame steps.

A definition says what is traded (a study), at which costs, on which universe and when; ``run_study`` builds the run from it. Every study has
``warm_up``, the sessions of history that its first signal needs, ``configurations``, how many parameter settings it tries, and ``targets``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored, write_once
from . import backtest as bt
from . import cointegration, metrics, portfolio, prep, signals, universe, validation


def checked(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Costs:
    """``zero``, ``naive`` (bps of what is traded) or ``realistic`` (a fee and k times the volatility over vol_window returns)."""

    name: str = "zero"
    bps: float = 0.0
    fee_bps: float = 0.0
    k: float = 0.0
    vol_window: int = 21

    def __post_init__(self):
        checked(self.name in ("zero", "naive", "realistic"), f"unknown cost model {self.name}")

    def rates(self, bars: DataFrame) -> DataFrame | None:
        if self.name == "zero":
            return None
        return bt.naive_cost(bars, self.bps) if self.name == "naive" else bt.realistic_cost(bars, self.fee_bps, self.k, self.vol_window)


@dataclass(frozen=True)
class Study:
    """What all studies share. ``holds``: positions drift while the targets stay equal, instead of trading every day."""

    @property
    def warm_up(self) -> int:
        return 0

    @property
    def configurations(self) -> int:
        return 1

    @property
    def holds(self) -> bool:
        return False

    def anchor(self, start: date) -> date:
        """The first day on which something of the study runs, if its own run starts at ``start``."""
        return start

    def warm_up_days(self, every_day: bool) -> int:
        """The warm-up in calendar days."""
        return self.warm_up if every_day else -(-self.warm_up * 3 // 2) + 10

    def signals(self, bars: DataFrame) -> DataFrame:
        raise TypeError("a study of several runs has no signals of its own")

    def size(self, tradable: DataFrame) -> DataFrame:
        return bt.equal_weight(tradable)

    def targets(self, bars: DataFrame, market: DataFrame, admit: Callable[[DataFrame], DataFrame], costs: Costs, calendar: DataFrame) -> DataFrame:
        """(ts, instrument_id, weight); admit: keeps the signals of members."""
        return self.size(bt.tradable(admit(self.signals(bars)), market)).select("ts", "instrument_id", "weight")


@dataclass(frozen=True)
class Momentum(Study):
    lookback_days: int = 60

    @property
    def warm_up(self) -> int:
        return self.lookback_days

    def signals(self, bars: DataFrame) -> DataFrame:
        return signals.momentum(bars, self.lookback_days)


@dataclass(frozen=True)
class Reversal(Study):
    formation_days: int = 7

    @property
    def warm_up(self) -> int:
        return self.formation_days

    def signals(self, bars: DataFrame) -> DataFrame:
        return signals.reversal(bars, self.formation_days)


@dataclass(frozen=True)
class Pairs(Study):
    dependent: str = ""
    explanatory: str = ""
    formation_days: int = 60
    entry_z: float = 2.0
    exit_z: float = 0.0
    max_coint_p_value: float | None = None

    def __post_init__(self):
        checked(self.dependent != self.explanatory, "a pair needs two instruments")
        checked(0 <= self.exit_z < self.entry_z, "exit_z must lie between 0 and entry_z")
        checked(self.max_coint_p_value is None or 0 < self.max_coint_p_value <= 1, "max_coint_p_value must lie between 0 and 1")

    @property
    def warm_up(self) -> int:
        return self.formation_days

    def pair(self, bars: DataFrame) -> DataFrame:
        return bars.sparkSession.createDataFrame([("pair", self.dependent, self.explanatory)], "pair string, y string, x string")

    def signals(self, bars: DataFrame) -> DataFrame:
        pair = self.pair(bars)
        path = signals.spread_path(bars, pair, self.formation_days)
        if self.max_coint_p_value is not None:
            path = cointegration.gated(path, signals.paired(bars, pair), self.formation_days, self.max_coint_p_value)
        return signals.pair_legs(signals.pair_states(path, self.entry_z, self.exit_z), pair)

    def size(self, tradable: DataFrame) -> DataFrame:
        return bt.pair_weight(tradable)

    def diagnostics(self, bars: DataFrame) -> DataFrame:
        """The cointegration test over all of ``bars``."""
        return signals.cointegration(signals.paired(bars, self.pair(bars)))


@dataclass(frozen=True)
class CrossSection(Study):
    formation_months: int = 12
    skip_months: int = 1
    quantile: float = 0.1
    long_short: bool = True
    min_price: float = 0.0

    def __post_init__(self):
        checked(0 <= self.skip_months < self.formation_months, "skip_months must be below formation_months")
        checked(0 < self.quantile <= 0.5, "quantile must be above 0 and at most a half")

    @property
    def warm_up(self) -> int:
        return (self.formation_months + 2) * 31

    def anchor(self, start: date) -> date:
        """The first day on which something of the study runs, if its own run starts at ``start``."""
        return start

    def warm_up_days(self, every_day: bool) -> int:
        return self.warm_up

    @property
    def holds(self) -> bool:
        return True

    def signals(self, bars: DataFrame) -> DataFrame:
        monthly = signals.cross_sectional_momentum(bars, self.formation_months, self.skip_months, self.quantile, self.long_short, self.min_price)
        return signals.monthly_to_daily(monthly, bars)


@dataclass(frozen=True)
class VolTargeted(Study):
    lookback_days: int = 60
    target_volatility: float = 0.1
    max_scale: float = 1.0
    vol_window: int = 30
    ewma_com: float | None = None
    periods_per_year: int = 365

    @property
    def warm_up(self) -> int:
        return max(self.lookback_days, self.vol_window)

    def sigma(self, bars: DataFrame) -> DataFrame:
        return signals.rolling_volatility(bars, self.vol_window) if self.ewma_com is None else signals.ewma_volatility(bars, self.ewma_com, self.vol_window)

    def signals(self, bars: DataFrame) -> DataFrame:
        return signals.volatility_targeted(signals.momentum(bars, self.lookback_days), self.sigma(bars), self.target_volatility, self.max_scale, self.periods_per_year)

    def size(self, tradable: DataFrame) -> DataFrame:
        return bt.scaled_weight(tradable)


@dataclass(frozen=True)
class Selected(Study):
    """Momentum whose look-back is chosen on each 1 January by the net Sharpe of all days before."""

    lookback_grid: tuple[int, ...] = (20, 60)
    min_history_days: int = 200

    def __post_init__(self):
        checked(len(set(self.lookback_grid)) == len(self.lookback_grid) > 1, "a grid needs different values")

    @property
    def warm_up(self) -> int:
        return max(self.lookback_grid)

    @property
    def configurations(self) -> int:
        return len(self.lookback_grid)

    def labels(self) -> dict[str, int]:
        return {f"m{k:03d}": k for k in self.lookback_grid}

    def grid_targets(self, bars, market, admit, costs, calendar) -> DataFrame:
        parts = [Momentum(k).targets(bars, market, admit, costs, calendar).withColumn("run_id", F.lit(n)) for n, k in self.labels().items()]
        return reduce(DataFrame.unionByName, parts)

    def grid_returns(self, targets, bars, costs, calendar) -> DataFrame:
        """(run_id, ts, r): the net returns of one run per value."""
        return metrics.returns(bt.run_equity(targets, bars, calendar, costs.rates(bars))).where("r is not null").select("run_id", "ts", "r")

    def targets(self, bars, market, admit, costs, calendar) -> DataFrame:
        own = stored(self.grid_targets(bars, market, admit, costs, calendar), "grid-targets")
        choice = portfolio.choose_by_year(self.grid_returns(own, bars, costs, calendar), self.min_history_days, {n: i for i, n in enumerate(self.labels())})
        chosen = F.broadcast(choice.select(F.col("choice").alias("run_id"), F.col("year").alias("__year")))
        return own.withColumn("__year", F.year("ts")).join(chosen, ["run_id", "__year"]).select("ts", "instrument_id", "weight")


@dataclass(frozen=True)
class Portfolio(Study):
    """Component studies by name with their own costs, weighted every month by a rule over their own net returns before it.

    The components run from ``history_start`` on (None: from the portfolio's start), whatever the portfolio's own start, rule and costs.
    """

    components: tuple[tuple[str, Study, Costs], ...] = ()
    allocation: str = "equal_weight"
    window_days: int = 90
    min_window_days: int = 60
    history_start: date | None = None

    def __post_init__(self):
        checked(len({n for n, *_ in self.components}) == len(self.components) > 1, "a portfolio needs different components")
        checked(not any(isinstance(s, Portfolio) for _, s, _ in self.components), "portfolios do not nest")
        checked(self.allocation in RULES, f"unknown rule {self.allocation}")
        checked(2 <= self.min_window_days <= self.window_days, "min_window_days must lie between 2 and window_days")

    @property
    def warm_up(self) -> int:
        return max(s.warm_up for _, s, _ in self.components)

    def anchor(self, start: date) -> date:
        return start if self.history_start is None else min(start, self.history_start)

    def sleeve_targets(self, bars, market, admit, calendar) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.targets(bars, market, admit, c, calendar).withColumn("run_id", F.lit(n)) for n, s, c in self.components])

    def sleeve_returns(self, targets, bars, calendar) -> DataFrame:
        """(run_id, ts, r): each sleeve's net returns by itself, at its own costs, traded or held as its own study says."""
        alike: dict[tuple[bool, Costs], list[str]] = {}
        for n, s, c in self.components:
            alike.setdefault((s.holds, c), []).append(n)
        runs = [bt.run_equity(targets.where(F.col("run_id").isin(names)), bars, calendar, c.rates(bars), hold) for (hold, c), names in alike.items()]
        return metrics.returns(reduce(DataFrame.unionByName, runs)).where("r is not null").select("run_id", "ts", "r")

    def history(self, bars: DataFrame, admit: Callable[[DataFrame], DataFrame], calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sleeve targets, sleeve returns), written once: every portfolio of the same components and anchor can take them."""
        if self.history_start is not None:
            calendar = stored(bt.periods(bars, self.history_start), "sleeve-calendar")
        own = stored(self.sleeve_targets(bars, bt.market(bars, calendar), admit, calendar), "sleeve-targets")
        return own, stored(self.sleeve_returns(own, bars, calendar), "sleeve-returns")

    def targets(self, bars, market, admit, costs, calendar, history: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        own, returns = history or self.history(bars, admit, calendar)
        windows = portfolio.sleeve_windows(returns, self.window_days, self.min_window_days)
        net = portfolio.netted(own, RULES[self.allocation](windows)).select("ts", "instrument_id", "weight")
        return net.join(F.broadcast(calendar.select("ts")), "ts", "left_semi").select("ts", "instrument_id", "weight")

    def size(self, tradable: DataFrame) -> DataFrame:
        return bt.carried_weight(tradable)


RULES = {"equal_weight": portfolio.equal_sleeves, "inverse_volatility": portfolio.inverse_volatility, "risk_parity": portfolio.risk_parity}
STUDIES: dict[str, type[Study]] = {
    "time_series_momentum": Momentum,
    "short_term_reversal": Reversal,
    "pairs_spread_reversion": Pairs,
    "cross_sectional_momentum": CrossSection,
    "volatility_targeted_momentum": VolTargeted,
    "time_series_momentum_selected": Selected,
    "strategy_portfolio": Portfolio,
}


@dataclass(frozen=True)
class Definition:
    hypothesis: str
    universe: str
    study: Study
    costs: Costs
    training: tuple[date, date]
    holdout: tuple[date, date]
    missing_delisting_return: float | None = None
    min_sharpe: float = 0.0
    max_p_value: float = 0.05
    description: str = ""
    requires: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for a, b in (self.training, self.holdout):
            checked(a < b, f"{self.hypothesis}: a period ends before it starts")
        checked(self.training[1] < self.holdout[0] or self.holdout[1] < self.training[0], f"{self.hypothesis}: training and holdout overlap")

    def fetch_start(self, start: date, every_day: bool) -> date:
        return self.study.anchor(start) - timedelta(days=self.study.warm_up_days(every_day))


def common_start(bars: DataFrame, warm_up_days: int, not_before: date) -> DataFrame:
    """(start): the first day on which every instrument can signal, the latest first bar and the warm-up later, or ``not_before``; null without bars."""
    first = bars.groupBy("instrument_id").agg(F.min("ts").alias("first")).agg(F.max("first").alias("first"))
    return first.select(F.when(F.col("first").isNotNull(), F.greatest(F.date_add("first", warm_up_days), F.lit(not_before))).alias("start"))


def study_targets(d: Definition, bars: DataFrame, memberships: DataFrame | None, start: date, end: date, every_day: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets (run_id, ts, instrument_id, weight), bars, calendar) of ``d`` over [start, end], from the bars that it needs."""
    own = bars.where((F.col("ts") >= F.lit(d.fetch_start(start, every_day))) & (F.col("ts") <= F.lit(end)))
    calendar = bt.periods(own, start, end)
    admit = (lambda s: s) if memberships is None else (lambda s: universe.members_only(s, memberships))
    t = d.study.targets(own, bt.market(own, calendar), admit, d.costs, calendar)
    return t.select(F.lit(d.hypothesis).alias("run_id"), "ts", "instrument_id", "weight"), own, calendar


def run_study(d: Definition, bars: DataFrame, memberships: DataFrame | None, start: date, end: date, every_day: bool = True) -> DataFrame:
    """The snapshots of ``d``'s run over [start, end] at its costs."""
    targets, own, calendar = study_targets(d, bars, memberships, start, end, every_day)
    return bt.run_equity(targets, own, calendar, d.costs.rates(own), d.study.holds)


def open_holdout(d: Definition, bars: DataFrame, memberships: DataFrame | None, opened: list[str], path: str, ppy: int, draws: int = 10_000, every_day: bool = True) -> dict:
    """Runs ``d`` once on its holdout and writes the record to ``path``, which must not exist. Refuses bars with errors, and before its prerequisites are opened."""
    checked(not (waiting := sorted(set(d.requires) - set(opened))), f"{d.hypothesis}: not opened yet: {waiting}")
    start, end = d.holdout
    findings = prep.quality_report(bars.where(F.col("ts") <= F.lit(end)), prep.reference_sessions(bars, every_day)).where("level = 'error'")
    checked(findings.isEmpty(), f"{d.hypothesis}: the bars have errors")
    targets, own, calendar = study_targets(d, bars, memberships, start, end, every_day)
    targets = stored(targets, "targets")
    snaps = stored(bt.run_equity(targets, own, calendar, d.costs.rates(own), d.study.holds), "snaps")
    m = metrics.run_metrics(snaps, ppy)
    p = validation.p_value(validation.permutation_draws(targets, bt.market(own, calendar), ppy, draws)).select("run_id", "p")
    verdict = validation.holdout_verdict(F.col("sharpe"), F.col("p"), d.min_sharpe, d.max_p_value)
    row = m.join(p, "run_id", "left").select("*", verdict.alias("verdict")).first()
    record = {"hypothesis": d.hypothesis, "start": start, "end": end, "cost_model": d.costs.name, **({k: row[k] for k in ("cagr", "sharpe", "sortino", "calmar", "max_drawdown", "verdict")} | {"p_value": row["p"]} if row else {"verdict": "inconclusive"})}
    write_once(path, record, bars.sparkSession)
    return record
