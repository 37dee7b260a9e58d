"""Registered queries of study definitions, reports and the registry, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import metrics as mt
from ..operators import portfolio as pf
from ..operators import prep, reports, signals, studies, validation
from ..sources import configs
from ..sources.files import stored
from .bars import D, line_bars, table
from .oracle import GRID, RUN, STEPS, _growth, _nine, _r, _sharpe, _sql
from .queries import PPY, QUERIES, _aligned, _grid, _holdings, _run, _simulated, _snaps, _trades, _windows, query, rounded

SQL: dict[str, str] = {}
START, END = D("1995-06-01"), D("2001-06-30")
FORM = """
hypothesis: {name}
training_start: 1995-06-01
training_end: 2001-06-30
start: 2001-07-01
end: 2001-12-31
parameters:
  strategy: {kind}
  universe: lines
  cost_model: {{name: naive, bps: 10}}
{more}
success_criterion: {{min_sharpe: 0.0, max_p_value: 0.1, description: better than chance}}
"""
KINDS = {
    "rev": ("short_term_reversal", "  formation_days: 7"),
    "mom": ("time_series_momentum", "  lookback_days: 60"),
    "xs": ("cross_sectional_momentum", "  formation_months: 12\n  quantile: 0.25\n  min_price: 100.0\n  missing_delisting_return: 0.0"),
    "pair": ("pairs_spread_reversion", "  dependent: s1\n  explanatory: s2\n  formation_days: 60\n  entry_z: 1.5"),
    "vol": ("volatility_targeted_momentum", "  lookback_days: 60\n  target_volatility: 0.4\n  vol_window: 30"),
    "sel": ("time_series_momentum_selected", "  lookback_grid: [20, 60, 120, 250]\n  min_history_days: 200"),
    "port": ("strategy_portfolio", "  components: [rev, mom, xs]\n  allocation: equal_weight\n  window_days: 90\n  min_window_days: 60"),
    "gate": ("pairs_spread_reversion", "  dependent: s1\n  explanatory: s2\n  formation_days: 60\n  entry_z: 1.5\n  max_coint_p_value: 0.2"),
    "anchored": ("strategy_portfolio", "  components: [rev, mom, xs]\n  allocation: equal_weight\n  window_days: 90\n  min_window_days: 60\n  history_start: 1995-03-01"),
}


#: The costs at which the portfolio's components run by themselves.
COMPONENT_BPS = {"rev": 5, "mom": 10, "xs": 20}


def definition(name: str, bps: int = 10) -> studies.Definition:
    kind, more = KINDS[name]
    return configs.definition_from_yaml(FORM.format(name=name, kind=kind, more=more).replace("bps: 10", f"bps: {bps}"), lambda n: definition(n, COMPONENT_BPS[n]))


# ---- SQL of the studies: targets of each, then the shared recursion over days ----

_SIGN = "(CASE direction WHEN 'long' THEN 1.0 ELSE -1.0 END)"
_IN = f"BETWEEN DATE '{START}' AND DATE '{END}'"
STEPS["study_calendar"] = f"SELECT * FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts, row_number() OVER (ORDER BY ts) AS k FROM sessions WHERE ts {_IN}) WHERE next_ts IS NOT NULL"


def _bars_from(name: str) -> str:
    """The bars that a study fetches: its warm-up before the start (windows only look back so far)."""
    first = definition(name).fetch_start(START, True)
    return f"SELECT * FROM line_bars WHERE ts BETWEEN DATE '{first}' AND DATE '{END}'"


def _trailing(name: str, bars: str, k: int, sign: str) -> str:
    v = f"{sign}v"
    return f"SELECT s.ts, s.instrument_id, CASE WHEN {v} > 0 THEN 'long' WHEN {v} < 0 THEN 'short' ELSE 'flat' END AS direction FROM (SELECT *, close / lag(close, {k}) OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS v FROM {bars}) s WHERE v IS NOT NULL"


def _equal(run: str, signals_: str, market: str = "study_market") -> str:
    return f"SELECT '{run}' AS run_id, s.ts, s.instrument_id, {_SIGN} / count(*) OVER (PARTITION BY s.ts) AS weight FROM ({signals_}) s JOIN {market} m ON m.instrument_id = s.instrument_id AND m.ts = s.ts WHERE direction <> 'flat'"


STEPS["study_market"] = "SELECT a.ts, c.next_ts, a.instrument_id, (b.close - a.close) / a.close AS r FROM line_bars a JOIN study_calendar c ON a.ts = c.ts JOIN line_bars b ON b.instrument_id = a.instrument_id AND b.ts = c.next_ts"
for _name in ("rev", "mom", "xs", "vol", "pair", "sel", "port", "anchored"):
    STEPS[f"bars_{_name}"] = _bars_from(_name)
STEPS["targets_rev"] = _equal("rev", _trailing("rev", "bars_rev", 7, "-"))
STEPS["targets_mom"] = _equal("mom", _trailing("mom", "bars_mom", 60, ""))
def _xs_steps(step: str, bars: str) -> None:
    STEPS[f"{step}_ends"] = f"SELECT instrument_id, date_trunc('month', ts)::DATE AS month, arg_max(close, ts) AS close FROM {bars} GROUP BY 1, 2"
    STEPS[f"{step}_ranked"] = f"""SELECT month, instrument_id, CASE WHEN hi <= n THEN 'long' WHEN lo <= n THEN 'short' ELSE 'flat' END AS direction FROM (
  SELECT *, floor(count(*) OVER (PARTITION BY month) * 0.25) AS n, row_number() OVER (PARTITION BY month ORDER BY momentum DESC, instrument_id) AS hi, row_number() OVER (PARTITION BY month ORDER BY momentum, instrument_id) AS lo FROM (
    SELECT (a.month + INTERVAL 1 MONTH)::DATE AS month, a.instrument_id, b.close / c.close - 1 AS momentum FROM {step}_ends a JOIN {step}_ends b ON b.instrument_id = a.instrument_id AND b.month = a.month - INTERVAL 1 MONTH JOIN {step}_ends c ON c.instrument_id = a.instrument_id AND c.month = a.month - INTERVAL 12 MONTH WHERE a.close >= 100))"""


def _xs_signals(step: str, bars: str) -> str:
    return f"SELECT b.ts, b.instrument_id, g.direction FROM {bars} b JOIN {step}_ranked g ON g.instrument_id = b.instrument_id AND g.month = date_trunc('month', b.ts)"


_xs_steps("xs", "bars_xs")
STEPS["targets_xs"] = _equal("xs", _xs_signals("xs", "bars_xs"))
STEPS["sigma_vol"] = "SELECT instrument_id, ts, CASE WHEN count(r) OVER w = 30 THEN stddev_samp(r) OVER w END AS sigma FROM (SELECT *, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS r FROM bars_vol) WINDOW w AS (PARTITION BY instrument_id ORDER BY ts ROWS 29 PRECEDING)"
STEPS["targets_vol"] = f"SELECT 'vol' AS run_id, s.ts, s.instrument_id, {_SIGN} * least(1.0, 0.4 / (g.sigma * sqrt(365.0))) / count(*) OVER (PARTITION BY s.ts) AS weight FROM ({_trailing('vol', 'bars_vol', 60, '')}) s JOIN sigma_vol g ON g.instrument_id = s.instrument_id AND g.ts = s.ts AND g.sigma > 0 JOIN study_market m ON m.instrument_id = s.instrument_id AND m.ts = s.ts WHERE direction <> 'flat'"
STEPS["pair_logs"] = "SELECT a.ts, ln(a.close) AS y, ln(b.close) AS x FROM bars_pair a JOIN bars_pair b ON a.ts = b.ts WHERE a.instrument_id = 's1' AND b.instrument_id = 's2'"
STEPS["pair_path"] = """SELECT ts, beta, (y - alpha - beta * x) / nullif(sqrt(greatest((syy - beta * sxy) / 59, 0.0)), 0) AS z, row_number() OVER (ORDER BY ts) AS i FROM (
  SELECT ts, y, x, count(*) OVER w AS n, regr_slope(y, x) OVER w AS beta, regr_intercept(y, x) OVER w AS alpha, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy FROM pair_logs WINDOW w AS (ORDER BY ts ROWS 59 PRECEDING)) WHERE n = 60"""
STEPS["pair_walk"] = """SELECT 0::BIGINT AS i, 0 AS state UNION ALL SELECT i, CASE WHEN z IS NULL THEN 0 WHEN exited = 0 AND z >= 1.5 THEN -1 WHEN exited = 0 AND z <= -1.5 THEN 1 ELSE exited END FROM (
  SELECT p.i, p.z, s.state, CASE WHEN s.state = -1 AND p.z <= 0 THEN 0 WHEN s.state = 1 AND p.z >= 0 THEN 0 ELSE s.state END AS exited FROM pair_walk s JOIN pair_path p ON p.i = s.i + 1)"""
STEPS["targets_pair"] = """SELECT 'pair' AS run_id, ts, instrument_id, weight FROM (SELECT l.*, count(*) OVER (PARTITION BY l.ts) AS legs FROM (
    SELECT p.ts, 's1' AS instrument_id, CASE WHEN state > 0 THEN 1 ELSE -1 END / (1 + abs(beta)) AS weight FROM pair_path p JOIN pair_walk s ON s.i = p.i WHERE state <> 0 AND beta <> 0
    UNION ALL SELECT p.ts, 's2', CASE WHEN state * beta > 0 THEN -1 ELSE 1 END * abs(beta) / (1 + abs(beta)) FROM pair_path p JOIN pair_walk s ON s.i = p.i WHERE state <> 0 AND beta <> 0) l JOIN study_market m ON m.instrument_id = l.instrument_id AND m.ts = l.ts) WHERE legs = 2"""
STEPS["targets_grid"] = "SELECT * FROM (" + " UNION ALL ".join(_equal(n, _trailing("sel", "bars_sel", k, "")) for n, k in GRID.items()) + ")"


def _run_steps(name: str, hold: bool, of: str = "study", rate: float = 0.001) -> None:
    """The recursion over days of a study's run, over the calendar and market of ``of``."""
    STEPS[f"days_{name}"] = f"""SELECT t.run_id, c.k, c.ts, c.next_ts, list(coalesce(CASE WHEN m.r IS NOT NULL THEN w.weight END, 0.0)::DOUBLE ORDER BY i.instrument_id) AS w, list(coalesce(m.r, 0.0)::DOUBLE ORDER BY i.instrument_id) AS r
  FROM (SELECT DISTINCT run_id FROM targets_{name}) t CROSS JOIN {of}_calendar c CROSS JOIN (SELECT DISTINCT instrument_id FROM line_bars) i
  LEFT JOIN {of}_market m ON m.instrument_id = i.instrument_id AND m.ts = c.ts LEFT JOIN targets_{name} w ON w.run_id = t.run_id AND w.instrument_id = i.instrument_id AND w.ts = c.ts GROUP BY t.run_id, c.k, c.ts, c.next_ts"""
    w = "CASE WHEN s.target = d.w THEN s.held ELSE d.w END" if hold else "d.w"
    STEPS[f"sim_{name}"] = f"""SELECT run_id, 0::BIGINT AS k, ts, 1.0::DOUBLE AS equity, NULL::DOUBLE AS p, list_transform(w, lambda x: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS traded, list_transform(w, lambda x: 0.0::DOUBLE) AS held, NULL::DOUBLE[] AS target FROM days_{name} WHERE k = 1
  UNION ALL SELECT run_id, k, next_ts, equity * (1 + p), p, w2, traded, list_transform(list_zip(w2, r), lambda x: x[1] * (1 + x[2]) / (1 + p)), w FROM (
    SELECT *, list_sum(list_transform(list_zip(w2, r), lambda x: x[1] * x[2])) - {rate} * traded AS p FROM (
      SELECT *, list_sum(list_transform(list_zip(w2, held), lambda x: abs(x[1] - x[2]))) AS traded FROM (
        SELECT s.run_id, d.k, d.next_ts, s.equity, s.held, d.r, d.w, {w} AS w2 FROM sim_{name} s JOIN days_{name} d ON d.run_id = s.run_id AND d.k = s.k + 1)))"""
    STEPS[f"returns_{name}"] = f"SELECT run_id, ts, equity, traded, list_sum(list_transform(w, lambda x: abs(x))) AS invested, equity / lag(equity) OVER ({RUN}) - 1 AS r FROM sim_{name}"


for _name, _hold in (("rev", False), ("mom", False), ("xs", True), ("vol", False), ("pair", False), ("grid", False)):
    _run_steps(_name, _hold)
STEPS["targets_sel"] = """SELECT 'sel' AS run_id, t.ts, t.instrument_id, t.weight FROM targets_grid t JOIN (SELECT year, arg_min(run_id, (-sharpe, run_id)) AS choice FROM (
    SELECT y.year, g.run_id, avg(r) / stddev_samp(r) AS sharpe FROM (SELECT DISTINCT run_id, (year(ts) + 1)::INT AS year FROM returns_grid WHERE r IS NOT NULL) y JOIN returns_grid g ON g.run_id = y.run_id AND year(g.ts) < y.year AND g.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 200 AND stddev_samp(r) > 0) GROUP BY 1) c ON c.choice = t.run_id AND c.year = year(t.ts)"""
def _portfolio_steps(name: str, first: date) -> None:
    """A portfolio's components share its bars, and run by themselves from ``first`` on at their own costs."""
    of, part = f"sleeve_{name}", f"{name}_part"
    STEPS[f"{of}_calendar"] = f"SELECT * FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts, row_number() OVER (ORDER BY ts) AS k FROM sessions WHERE ts BETWEEN DATE '{first}' AND DATE '{END}') WHERE next_ts IS NOT NULL"
    STEPS[f"{of}_market"] = STEPS["study_market"].replace("study_calendar", f"{of}_calendar")
    _xs_steps(f"{part}_xs", f"bars_{name}")
    signals_ = {"rev": _trailing("rev", f"bars_{name}", 7, "-"), "mom": _trailing("mom", f"bars_{name}", 60, ""), "xs": _xs_signals(f"{part}_xs", f"bars_{name}")}
    for n, bps in COMPONENT_BPS.items():
        STEPS[f"targets_{part}_{n}"] = _equal(n, signals_[n], f"{of}_market")
        _run_steps(f"{part}_{n}", n == "xs", of, bps / 1e4)
    union = lambda what: " UNION ALL ".join(what.format(n=n, part=part) for n in COMPONENT_BPS)
    STEPS[f"{name}_returns"] = union("SELECT '{n}' AS run_id, ts, r FROM returns_{part}_{n} WHERE r IS NOT NULL")
    STEPS[f"{name}_sleeves"] = f"""SELECT * FROM (SELECT month, run_id, ts, r, var_samp(r) OVER (PARTITION BY month, run_id) AS v FROM (
    SELECT *, count(*) FILTER (ts >= begun) OVER (PARTITION BY month, run_id) AS since FROM (
      SELECT m.month, g.*, row_number() OVER (PARTITION BY m.month, g.run_id ORDER BY g.ts DESC) AS back, min(CASE WHEN r <> 0 THEN g.ts END) OVER (PARTITION BY m.month, g.run_id) AS begun
      FROM {name}_returns g JOIN (SELECT DISTINCT date_trunc('month', ts)::DATE AS month FROM {name}_returns) m ON g.ts < m.month)) WHERE back <= 90 AND since >= 60) WHERE v > 0"""
    STEPS[f"targets_{name}"] = f"""SELECT '{name}' AS run_id, t.ts, t.instrument_id, sum(t.weight * s.share) AS weight FROM ({union("SELECT * FROM targets_{part}_{n}")}) t
  JOIN (SELECT month, run_id, 1.0 / count(*) OVER (PARTITION BY month) AS share FROM (SELECT DISTINCT month, run_id FROM {name}_sleeves)) s ON s.run_id = t.run_id AND s.month = date_trunc('month', t.ts)
  WHERE t.ts IN (SELECT ts FROM study_calendar) GROUP BY 1, 2, 3 HAVING sum(t.weight * s.share) <> 0"""
    _run_steps(name, False)


_portfolio_steps("port", START)
_portfolio_steps("anchored", D("1995-03-01"))
_run_steps("sel", False)


def _study(name: str) -> None:
    def run(spark, sf_dir):
        snaps = studies.run_study(definition(name), line_bars(spark, sf_dir), None, START, END)
        return rounded(snaps.select("run_id", "ts", "equity", "traded", "invested"), 5)

    run.__name__ = f"study_{name}"
    run.__doc__ = f"The training run of a frozen definition: {KINDS[name][0]}."
    query(run)
    if name != "gate":  # the window tests have no SQL; tests hold them against a loop over windows
        SQL[run.__name__] = f"SELECT run_id, ts, {_r('equity traded invested', 5)} FROM returns_{name}"


for _name in KINDS:
    _study(_name)


@query
def common_start(spark, sf_dir):
    d = definition("sel")
    return studies.common_start(line_bars(spark, sf_dir), d.study.warm_up_days(True), D("1995-03-01"))


SQL["common_start"] = "SELECT greatest(max(first) + 250, DATE '1995-03-01')::DATE AS start FROM (SELECT min(ts) AS first FROM line_bars GROUP BY instrument_id)"


# ---- the registry ----

REGISTERED = {n: date(2024, 1, 1 + i) for i, n in enumerate(KINDS) if n not in ("gate", "anchored")}
GATES = [("mom", True), ("rev", False), ("xs", None), ("vol", True)]
OPENED = [("mom", "passed", 0.4), ("rev", "passed", 0.2), ("xs", "inconclusive", 0.0)]


def _definitions(spark):
    return configs.definitions_table(spark, [definition(n) for n in REGISTERED], REGISTERED, {"pair"})


def _registry(spark):
    gates = spark.createDataFrame(GATES, "hypothesis string, in_sample_passed boolean")
    opened = spark.createDataFrame(OPENED, "hypothesis string, verdict string, holdout_sharpe double")
    return reports.registry_rows(_definitions(spark), gates, opened)


def _literals(rows: list[tuple], columns: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"DATE '{x}'" if isinstance(x, date) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"


STEPS["definitions"] = "SELECT * FROM " + _literals([(n, "naive", 4 if n == "sel" else 1, REGISTERED[n], n == "pair") for n in REGISTERED], "hypothesis, cost_model, configurations, registered_at, deleted")


@query
def registry(spark, sf_dir):
    return _registry(spark).select("hypothesis", "cost_model", "configurations", "registered_at", "has_run", "trials_on_same_data", "verdict", "holdout_sharpe", "status")


SQL["registry"] = f"""SELECT d.hypothesis, cost_model, configurations::INT AS configurations, registered_at, g.h IS NOT NULL AS has_run, (SELECT count(*) FROM definitions o WHERE o.registered_at <= d.registered_at) AS trials_on_same_data, verdict, holdout_sharpe::DOUBLE AS holdout_sharpe,
  CASE WHEN verdict IS NOT NULL THEN CASE WHEN in_sample AND verdict = 'passed' THEN 'confirmed' WHEN NOT in_sample OR verdict = 'rejected' THEN 'rejected' ELSE 'inconclusive' END WHEN g.h IS NOT NULL THEN 'testing' ELSE 'proposed' END AS status
  FROM definitions d LEFT JOIN {_literals(GATES, 'h, in_sample').replace(' AS v(', ' AS g(')} ON g.h = d.hypothesis LEFT JOIN {_literals(OPENED, 'o, verdict, holdout_sharpe').replace(' AS v(', ' AS p(')} ON p.o = d.hypothesis WHERE NOT deleted"""


@query
def registry_headline(spark, sf_dir):
    runs = mt.run_metrics(_snaps(spark, sf_dir), PPY).withColumn("hypothesis", F.lit("mom")).withColumn("start", F.lit(START)).withColumn("end", F.lit(END))
    return rounded(reports.headline(_registry(spark), runs, "m060"), 4)


SQL["registry_headline"] = f"SELECT r.hypothesis, r.status, r.has_run, {_r('sharpe cagr max_drawdown', 4)}, CASE WHEN m.run_id IS NOT NULL THEN DATE '{START}' END AS run_start, CASE WHEN m.run_id IS NOT NULL THEN DATE '{END}' END AS run_end FROM ({SQL['registry']}) r LEFT JOIN metrics_1 m ON r.hypothesis = 'mom'"

STATUSES = ["proposed", "testing", "confirmed", "rejected", "inconclusive"]


@query
def status_transitions(spark, sf_dir):
    """A step per order: statuses and gates follow from its keys."""
    status = lambda key: F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col(key) % 5 + 1).cast("int"))
    gate = lambda x: F.when(x % 3 != 0, x % 3 == 1)
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("hypothesis"), status("o_orderkey").alias("status"), status("o_custkey").alias("new_status"), gate(F.col("o_custkey")).alias("walk_forward_passed"), gate(F.col("o_orderkey") % 7).alias("holdout_passed"))
    return reports.transitions(steps).select("hypothesis", "allowed")


STEPS["order_steps"] = f"SELECT o_orderkey::VARCHAR AS h, ({STATUSES})[o_orderkey % 5 + 1] AS s, ({STATUSES})[o_custkey % 5 + 1] AS n, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 = 1 END AS w, CASE WHEN o_orderkey % 7 % 3 <> 0 THEN o_orderkey % 7 % 3 = 1 END AS o FROM orders"
SQL["status_transitions"] = "SELECT h AS hypothesis, (s = 'proposed' AND n = 'testing') OR (s = 'testing' AND (n IN ('rejected', 'inconclusive') OR (n = 'confirmed' AND coalesce(w AND o, FALSE)))) AS allowed FROM order_steps"


@query
def holdout_prerequisites(spark, sf_dir):
    """A holdout per customer from the first order on; every fifth one rests on the next two, and customers with money have opened theirs."""
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    key = F.col("o_custkey")
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start"))
    definitions = spans.select(name(key).alias("hypothesis"), "start", F.date_add("start", (key % 400).cast("int")).alias("end"))
    parts = spans.where("o_custkey % 5 = 0").select(name(key).alias("hypothesis"), F.explode(F.array(name(key + 1), name(key + 2))).alias("component"))
    opened = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(name(F.col("c_custkey")).alias("hypothesis"))
    return reports.missing_prerequisites(parts, definitions, opened)


STEPS["order_holdouts"] = "SELECT o_custkey AS k, min(o_orderdate)::DATE AS a, min(o_orderdate)::DATE + (o_custkey % 400)::INT AS b FROM orders GROUP BY o_custkey"
SQL["holdout_prerequisites"] = "SELECT 'c' || x.k AS hypothesis, 'c' || y.k AS component FROM order_holdouts x JOIN order_holdouts y ON y.k IN (x.k + 1, x.k + 2) AND x.a <= y.b AND y.a <= x.b WHERE x.k % 5 = 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = y.k AND c_acctbal > 0)"


# ---- reports ----


def _pnl(spark, sf_dir):
    return mt.pnl_groups(_trades(spark, sf_dir))


STEPS["pnl"] = """SELECT dimension, key, sum(net_pnl) AS total_net_pnl FROM (
      SELECT 'regime' AS dimension, regime_at_entry AS key, net_pnl FROM ledger UNION ALL SELECT 'instrument', instrument_id, net_pnl FROM ledger UNION ALL SELECT 'month', strftime(exit_ts, '%Y-%m'), net_pnl FROM ledger
      UNION ALL SELECT 'holding', CASE WHEN holding_days <= 7 THEN '1-7d' WHEN holding_days <= 30 THEN '8-30d' WHEN holding_days <= 90 THEN '31-90d' WHEN holding_days <= 365 THEN '91-365d' ELSE '366d+' END, net_pnl FROM ledger) GROUP BY 1, 2"""


@query
def pnl_extremes(spark, sf_dir):
    return rounded(reports.extremes(_pnl(spark, sf_dir), 3).select("dimension", "key", "total_net_pnl", "position"))


STEPS["pnl_placed"] = "SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total_net_pnl DESC, key) AS position, count(*) OVER (PARTITION BY dimension) AS n FROM pnl"
SQL["pnl_extremes"] = f"SELECT dimension, key, {_r('total_net_pnl')}, position::INT AS position FROM pnl_placed WHERE position <= 3 OR position > n - 3"


@query
def pnl_in_order(spark, sf_dir):
    p = _pnl(spark, sf_dir)
    both = reports.in_order(p.where("dimension = 'regime'"), reports.REGIMES).unionByName(reports.in_order(p.where("dimension = 'holding'"), reports.BUCKETS))
    return rounded(both.select("dimension", "key", "total_net_pnl", "position"))


SQL["pnl_in_order"] = f"SELECT dimension, key, {_r('total_net_pnl')}, list_position(CASE dimension WHEN 'regime' THEN {reports.REGIMES} ELSE {reports.BUCKETS} END, key)::INT AS position FROM pnl WHERE dimension IN ('regime', 'holding')"


@query
def run_rows(spark, sf_dir):
    rows = reports.run_rows(_snaps(spark, sf_dir), _trades(spark, sf_dir), PPY)
    return rounded(rows.select("run_id", "start", "end", "final_equity", "sharpe", "total_costs", "trades", "open_at_end", "winners", "schema_version"), 4)


SQL["run_rows"] = f"""SELECT m.run_id, s.a AS "start", s.b AS "end", {_r('final_equity=s.e sharpe=m.sharpe total_costs=c.total', 4)}, trades, open_at_end, winners, 1 AS schema_version FROM metrics_1 m
  CROSS JOIN (SELECT min(ts) AS a, max(ts) AS b, arg_max(equity, ts) AS e FROM snap_1) s CROSS JOIN (SELECT sum(cost * prev_equity) AS total FROM returns_1) c CROSS JOIN (SELECT count(*) AS trades, count(*) FILTER (open_at_end) AS open_at_end, count(*) FILTER (net_pnl > 0) AS winners FROM ledger)"""


@query
def monthly_table(spark, sf_dir):
    return rounded(reports.monthly_rows(_snaps(spark, sf_dir)), 5)


SQL["monthly_table"] = f"SELECT run_id, year(period)::INT AS year, month(period)::INT AS month, {_r('ret', 5)} FROM (SELECT run_id, period, last / coalesce(lag(last) OVER (PARTITION BY run_id ORDER BY period), first) - 1 AS ret FROM (SELECT run_id, date_trunc('month', ts)::DATE AS period, arg_max(equity, ts) AS last, arg_min(equity, ts) AS first FROM snap_1 GROUP BY 1, 2))"


@query
def bar_sources(spark, sf_dir):
    return reports.sources_of(line_bars(spark, sf_dir).withColumn("source", F.when(F.year("ts") < 1997, "old").otherwise(F.concat(F.lit("feed-"), "instrument_id"))))


SQL["bar_sources"] = "SELECT string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT CASE WHEN year(ts) < 1997 THEN 'old' ELSE 'feed-' || instrument_id END AS s FROM line_bars)"


@query
def equity_gap(spark, sf_dir):
    """With and without costs."""
    return rounded(reports.max_equity_difference(_snaps(spark, sf_dir, bps=0.0), _snaps(spark, sf_dir)), 5)


SQL["equity_gap"] = f"SELECT count(*) AS days, {_nine('max(abs(a.equity - b.equity))', 5)} AS gap FROM snap_free a JOIN snap_1 b ON a.ts = b.ts"


@query
def configuration_rows(spark, sf_dir):
    return rounded(reports.comparison_rows(_grid(spark, sf_dir), None, PPY).select("run_id", "sharpe", "turnover", "total_costs"), 4)


SQL["configuration_rows"] = f"SELECT m.run_id, {_r('sharpe=m.sharpe turnover=m.turnover total_costs=c.total', 4)} FROM metrics_4 m JOIN (SELECT run_id, sum(cost * prev_equity) AS total FROM returns_4 GROUP BY 1) c ON c.run_id = m.run_id"


@query
def scale_summary(spark, sf_dir):
    return rounded(reports.scale_summary(definition("vol").study.signals(line_bars(spark, sf_dir)), 1.0))


SQL["scale_summary"] = f"SELECT instrument_id, {_r('mean least most at_cap')} FROM (SELECT instrument_id, avg(weight) AS mean, min(weight) AS least, max(weight) AS most, avg((weight = 1.0)::INT) AS at_cap FROM targeted WHERE weight IS NOT NULL GROUP BY 1)"


@query
def scaling_contrast(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    both = [studies.run_study(definition(n), bars, None, START, END) for n in ("vol", "mom")]
    return rounded(reports.contrast(both[0].unionByName(both[1]), PPY), 4)


SQL["scaling_contrast"] = "SELECT run_id, {} FROM (SELECT run_id, {} AS sharpe, stddev_samp(r) * sqrt(365.0) AS volatility, min(dd) AS max_drawdown FROM (SELECT *, equity / max(equity) OVER ({} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT * FROM returns_vol UNION ALL SELECT * FROM returns_mom)) GROUP BY 1)".format(_r("sharpe volatility max_drawdown", 4), _sharpe(), RUN)


@query
def allocation_summary(spark, sf_dir):
    w = _windows(spark, sf_dir)
    weights = pf.inverse_volatility(w)
    return rounded(reports.allocation_summary(weights, pf.diversification(w, weights)), 4)


STEPS["ratios"] = "SELECT a.month, a.s / b.s AS ratio FROM (SELECT month, sum(sd * weight) AS s FROM (SELECT month, run_id, stddev_samp(r) AS sd FROM sleeves GROUP BY 1, 2) JOIN inverse USING (month, run_id) GROUP BY 1) a JOIN (SELECT month, stddev_samp(p) AS s FROM (SELECT month, ts, sum(r * weight) AS p FROM sleeves JOIN inverse USING (month, run_id) GROUP BY 1, 2) GROUP BY 1) b ON a.month = b.month"
SQL["allocation_summary"] = f"SELECT run_id, {_r('mean least most', 4)}, months, {_nine('(SELECT quantile_cont(ratio, 0.5) FROM ratios)', 4)} AS ratio FROM (SELECT r.run_id, avg(coalesce(i.weight, 0)) AS mean, min(coalesce(i.weight, 0)) AS least, max(coalesce(i.weight, 0)) AS most, count(*) AS months FROM (SELECT DISTINCT month FROM inverse) m CROSS JOIN (SELECT DISTINCT run_id FROM inverse) r LEFT JOIN inverse i ON i.month = m.month AND i.run_id = r.run_id GROUP BY 1)"


@query
def grid_years(spark, sf_dir):
    r = mt.returns(_grid(spark, sf_dir)).where("r is not null").select("run_id", "ts", "r")
    return rounded(reports.grid_years(r, 200, {k: i for i, k in enumerate(GRID)}), 5)


SQL["grid_years"] = f"SELECT year, run_id, days, {_r('sharpe', 5)}, coalesce(run_id = first_value(CASE WHEN days >= 200 THEN run_id END) OVER (PARTITION BY year ORDER BY days >= 200 DESC, sharpe DESC, run_id), FALSE) AS chosen FROM (SELECT y.year, g.run_id, count(*) AS days, avg(r) / nullif(stddev_samp(r), 0) AS sharpe FROM (SELECT DISTINCT run_id, (year(ts) + 1)::INT AS year FROM grid_returns) y JOIN grid_returns g ON g.run_id = y.run_id AND year(g.ts) < y.year GROUP BY 1, 2)"


@query
def trials_overfitting(spark, sf_dir):
    return rounded(reports.trials_comparison(_grid(spark, sf_dir), PPY, 16)[1])


STEPS["trial_sums"] = "SELECT run_id, floor(back / size)::INT AS block, sum(r) AS s, sum(r * r) AS q, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC) - 1 AS back, floor(count(*) OVER (PARTITION BY run_id) / 16) AS size FROM aligned_4) WHERE back < size * 16 GROUP BY 1, 2"


def _half(b: int) -> str:
    s, q, c = (f"sum(CASE WHEN (split >> block) & 1 = {b} THEN {x} ELSE 0 END)" for x in "sqc")
    v = f"(({q} - {s} * {s} / {c}) / ({c} - 1))"
    return f"CASE WHEN {v} > 0 THEN {s} / {c} / sqrt({v}) ELSE 0 END"


STEPS["trial_scores"] = f"SELECT split, run_id, {_half(1)} AS si, {_half(0)} AS so FROM (SELECT range AS split FROM range(65536) WHERE bit_count(range) = 8) CROSS JOIN trial_sums GROUP BY 1, 2"
STEPS["trial_ranks"] = "SELECT split, (count(*) FILTER (so < chosen) + (count(*) FILTER (so = chosen) + 1) / 2.0) / (count(*) + 1) AS omega FROM (SELECT *, first_value(so) OVER (PARTITION BY split ORDER BY si DESC, run_id) AS chosen FROM trial_scores) GROUP BY 1"
SQL["trials_overfitting"] = f"SELECT {_r('pbo')}, n_splits, {_r('logit_median')} FROM (SELECT avg((ln(omega / (1 - omega)) <= 0)::INT) AS pbo, count(*) AS n_splits, quantile_cont(ln(omega / (1 - omega)), 0.5) AS logit_median FROM trial_ranks)"


@query
def multiple_testing(spark, sf_dir):
    """Without SQL, as it has no normal distribution; tests hold it against Python's."""
    c = spark.createDataFrame([(n, i + 1) for i, n in enumerate(GRID)], "run_id string, configurations int")
    return reports.multiple_testing(validation.sharpe_statistics(_aligned(spark, sf_dir)), c, PPY)


@query
def holding_growth(spark, sf_dir):
    _, growth = _holdings(spark, sf_dir)
    return rounded(growth.select("decision", "ts", "instrument_id", "weight", "growth"), 5)


SQL["holding_growth"] = f"SELECT s.ts AS decision, c.next_ts AS ts, s.instrument_id, {_r('weight=coalesce(t.weight,0.0) growth=b.close/a.close', 5)} FROM mom60 s JOIN market m ON m.instrument_id = s.instrument_id AND m.ts = s.ts JOIN calendar c ON c.ts = s.ts JOIN filled a ON a.instrument_id = s.instrument_id AND a.ts = s.ts JOIN filled b ON b.instrument_id = s.instrument_id AND b.ts = c.next_ts LEFT JOIN targets_1 t ON t.ts = s.ts AND t.instrument_id = s.instrument_id"


@query
def traded_instruments(spark, sf_dir):
    t = _trades(spark, sf_dir)
    return t.groupBy("instrument_id").agg(F.count("*").alias("n")).orderBy("instrument_id")


SQL["traded_instruments"] = "SELECT instrument_id, count(*) AS n FROM ledger GROUP BY 1"

for _n, _s in SQL.items():
    SQL[_n] = _sql(_s)
