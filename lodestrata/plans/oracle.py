"""The SQL that the registered queries must equal, for DuckDB over the same tables.

Shared steps are named below and put in front of a query that uses them. The costed backtest is a recursion over days with one list of
weights per run; tests hold what has no SQL here (random draws, risk parity, order fills) against brute force.
"""

from __future__ import annotations

import re

from .bars import ACTIONS, CASH, DELISTINGS, MEMBERSHIPS, SHOCKS, literal_sql

STEPS: dict[str, str] = {}
ORACLE_SQL: dict[str, str] = {}
GRID = {"m020": 20, "m060": 60, "m120": 120, "m250": 250}
ID = "PARTITION BY instrument_id ORDER BY ts"
RUN = "PARTITION BY run_id ORDER BY ts"


def _sql(body: str) -> str:
    """``body`` after the steps that it names, directly or through others."""
    used: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, step in STEPS.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(step)
    parts = [f"{n} AS ({s})" for n, s in STEPS.items() if n in used]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def _nine(x: str, digits: int = 6) -> str:
    """A number to ``digits`` places and nine figures, off decimal ties by a factor just over 1."""
    return f"printf('%.8e', round(({x}) * (1 + 3e-12::DOUBLE), {digits}) * (1 + 3e-12::DOUBLE) + 0.0)::DOUBLE"


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"{_nine(c.split('=')[-1], digits)} AS {c.split('=')[0]}" for c in columns.split())


def _direction(v: str) -> str:
    return f"CASE WHEN {v} > 0 THEN 'long' WHEN {v} < 0 THEN 'short' ELSE 'flat' END"


def _sharpe(r: str = "r") -> str:
    return f"CASE WHEN count({r}) >= 2 AND stddev_samp({r}) > 1e-15 THEN avg({r}) / stddev_samp({r}) * sqrt(365.0) END"


def _sortino(r: str = "r") -> str:
    down = f"avg(least({r}, 0.0) * least({r}, 0.0))"
    return f"CASE WHEN {down} > 0 THEN avg({r}) / sqrt({down}) * sqrt(365.0) END"


def _growth(g: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 AND {g} > 0 THEN pow({g}, 365.0 / {n}) - 1 END"


STEPS["line_bars"] = """SELECT instrument_id, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, 1000 + sum(c) / (sum(n) * 10000) AS close, sum(n) AS volume FROM (
  SELECT 's' || (l_suppkey % 8) AS instrument_id, l_shipdate::DATE AS ts, round(l_extendedprice * 100) AS c, l_quantity AS n, 1000 + round(l_extendedprice * 100) / (l_quantity * 10000) AS px, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY instrument_id, ts"""
STEPS["event_bars"] = "SELECT event_type AS instrument_id, ts::DATE AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume FROM (SELECT event_type, e.ts, value, event_id FROM events e) GROUP BY 1, 2"
for _name, _rows, _cols in (
    ("memberships", MEMBERSHIPS, 'instrument_id, "start", "end"'),
    ("actions", ACTIONS, "instrument_id, kind, ex_date, ratio, amount"),
    ("delistings", DELISTINGS, 'instrument_id, "date", delisting_return'),
    ("cash_marks", CASH, "ts, close"),
    ("shocks", SHOCKS, "scenario, instrument_id, shock"),
):
    STEPS[_name] = f"SELECT * FROM {literal_sql(_rows, _cols)}"
STEPS["order_changes"] = "SELECT instrument_id, day, added FROM (SELECT *, lag(added) OVER (PARTITION BY instrument_id ORDER BY day) AS before FROM (SELECT 'c' || o_custkey AS instrument_id, o_orderdate::DATE AS day, arg_max(o_orderstatus, o_orderkey) <> 'F' AS added FROM orders GROUP BY 1, 2)) WHERE before IS NULL OR before <> added"
_FROM_CHANGES = """SELECT a.instrument_id, a.day AS "start", (SELECT min(day) - 1 FROM order_changes r WHERE r.instrument_id = a.instrument_id AND NOT r.added AND r.day > a.day) AS "end" FROM order_changes a WHERE added
      UNION ALL SELECT instrument_id, DATE '1995-01-01', day - 1 FROM order_changes c WHERE NOT added AND NOT EXISTS (SELECT 1 FROM order_changes e WHERE e.instrument_id = c.instrument_id AND e.day < c.day)"""
STEPS["order_memberships"] = f"""SELECT * FROM ({_FROM_CHANGES}) WHERE "end" IS NULL OR "start" <= "end\""""
STEPS["order_pieces"] = """SELECT instrument_id, greatest("start", make_date(y, 1, 1)) AS "start", CASE WHEN "end" IS NULL AND y = 2001 THEN NULL ELSE least(coalesce("end", make_date(y, 12, 31)), make_date(y, 12, 31)) END AS "end"
  FROM (SELECT *, unnest(range(year("start"), year(coalesce("end", DATE '2001-12-31')) + 1)) AS y FROM order_memberships)"""
STEPS["order_trials"] = "SELECT 'c' || o_custkey AS hypothesis, 'u' || floor(o_custkey / 40)::BIGINT AS universe, min(o_orderdate)::DATE AS training_start, min(o_orderdate)::DATE + (30 + o_custkey % 60)::INT AS training_end, max(o_orderdate)::DATE AS registered_at FROM orders GROUP BY o_custkey"
STEPS["sessions"] = "SELECT DISTINCT ts FROM line_bars"
STEPS["calendar"] = "SELECT * FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts, row_number() OVER (ORDER BY ts) AS k FROM sessions) WHERE next_ts IS NOT NULL"
STEPS["market"] = "SELECT a.ts, c.next_ts, a.instrument_id, (b.close - a.close) / a.close AS r FROM line_bars a JOIN calendar c ON a.ts = c.ts JOIN line_bars b ON b.instrument_id = a.instrument_id AND b.ts = c.next_ts"
STEPS["rets"] = f"SELECT *, close / lag(close) OVER ({ID}) - 1 AS r FROM line_bars"
STEPS["sigma30"] = f"SELECT instrument_id, ts, CASE WHEN count(r) OVER w = 30 THEN stddev_samp(r) OVER w END AS sigma FROM rets WINDOW w AS ({ID} ROWS 29 PRECEDING)"
for _k in sorted({*GRID.values()}):
    STEPS[f"mom{_k}"] = f"SELECT instrument_id, ts, {_direction('v')} AS direction, v AS strength FROM (SELECT *, close / lag(close, {_k}) OVER ({ID}) - 1 AS v FROM line_bars) WHERE v IS NOT NULL"
STEPS["targeted"] = "SELECT * FROM (SELECT m.*, CASE WHEN sigma > 0 THEN least(1.0, 0.4 / (sigma * sqrt(365.0))) END AS weight FROM mom60 m JOIN sigma30 USING (instrument_id, ts)) WHERE direction = 'flat' OR weight IS NOT NULL"


def _targets(run: str, k: int) -> str:
    return f"SELECT '{run}' AS run_id, m.ts, m.instrument_id, (CASE direction WHEN 'long' THEN 1.0 ELSE -1.0 END) / count(*) OVER (PARTITION BY m.ts) AS weight FROM mom{k} m JOIN market k ON k.instrument_id = m.instrument_id AND k.ts = m.ts WHERE direction <> 'flat'"


STEPS["targets_1"] = _targets("m060", 60)
STEPS["targets_4"] = f"SELECT * FROM ({' UNION ALL '.join(_targets(n, k) for n, k in GRID.items())})"
for _n in ("1", "4"):
    STEPS[f"days_{_n}"] = f"""SELECT t.run_id, c.k, c.ts, c.next_ts, list(coalesce(w.weight, 0.0)::DOUBLE ORDER BY i.instrument_id) AS w, list(coalesce(m.r, 0.0)::DOUBLE ORDER BY i.instrument_id) AS r, list(i.instrument_id ORDER BY i.instrument_id) AS ids
  FROM (SELECT DISTINCT run_id FROM targets_{_n}) t CROSS JOIN calendar c CROSS JOIN (SELECT DISTINCT instrument_id FROM line_bars) i
  LEFT JOIN market m ON m.instrument_id = i.instrument_id AND m.ts = c.ts LEFT JOIN targets_{_n} w ON w.run_id = t.run_id AND w.instrument_id = i.instrument_id AND w.ts = c.ts GROUP BY t.run_id, c.k, c.ts, c.next_ts"""
for _name, _n, _bps, _hold in (("1", "1", 10.0, False), ("4", "4", 10.0, False), ("free", "1", 0.0, False), ("held", "1", 10.0, True)):
    _w = "CASE WHEN s.target = d.w THEN s.held ELSE d.w END" if _hold else "d.w"
    STEPS[f"sim_{_name}"] = f"""SELECT run_id, 0::BIGINT AS k, ts, NULL::DATE AS prev_ts, 1.0::DOUBLE AS equity, NULL::DOUBLE AS equity0, NULL::DOUBLE AS period_return, list_transform(w, lambda x: 0.0::DOUBLE) AS w, list_transform(w, lambda x: 0.0::DOUBLE) AS tr, list_transform(w, lambda x: 0.0::DOUBLE) AS held, NULL::DOUBLE[] AS target, ids FROM days_{_n} WHERE k = 1
  UNION ALL
  SELECT run_id, k, next_ts, ts, equity * (1 + p), equity, p, w2, tr, list_transform(list_zip(w2, r), lambda x: x[1] * (1 + x[2]) / (1 + p)), w, ids FROM (
    SELECT *, list_sum(list_transform(list_zip(w2, r), lambda x: x[1] * x[2])) - {_bps / 1e4} * list_sum(tr) AS p FROM (
      SELECT *, list_transform(list_zip(w2, held), lambda x: abs(x[1] - x[2])) AS tr FROM (
        SELECT s.run_id, d.k, d.ts, d.next_ts, s.equity, s.held, d.r, d.w, d.ids, {_w} AS w2 FROM sim_{_name} s JOIN days_{_n} d ON d.run_id = s.run_id AND d.k = s.k + 1)))"""
    STEPS[f"snap_{_name}"] = f"SELECT *, equity * (1 - invested) AS cash FROM (SELECT run_id, k, ts, equity, period_return, {_bps / 1e4} * list_sum(tr) AS cost, list_sum(tr) AS traded, list_sum(list_transform(w, lambda x: abs(x))) AS invested FROM sim_{_name})"
    STEPS[f"returns_{_name}"] = f"SELECT *, equity / lag(equity) OVER ({RUN}) - 1 AS r, lag(ts) OVER ({RUN}) AS prev_ts, lag(equity) OVER ({RUN}) AS prev_equity FROM snap_{_name}"
    STEPS[f"active_{_name}"] = f"SELECT * FROM (SELECT *, max((invested > 0)::INT) OVER ({RUN} ROWS UNBOUNDED PRECEDING) AS begun FROM returns_{_name}) WHERE begun = 1 AND r IS NOT NULL"
STEPS["hold_1"] = "SELECT run_id, k, ts, prev_ts, equity, equity0, x[1] AS instrument_id, x[2] AS position, x[3] * 0.001 AS cost, x[3] AS traded FROM (SELECT run_id, k, ts, prev_ts, equity, equity0, unnest(list_zip(ids, w, tr)) AS x FROM sim_1 WHERE k > 0) WHERE x[2] <> 0 OR x[3] > 0"
STEPS["aligned_4"] = "SELECT run_id, ts, r FROM active_4 WHERE ts IN (SELECT ts FROM active_4 GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT run_id) FROM active_4))"
STEPS["regimes"] = """SELECT ts, CASE WHEN n < 365 OR coalesce(sigma <= 0, TRUE) THEN 'undefined' WHEN sigma <= q[1] THEN 'low' WHEN sigma <= q[2] THEN 'medium' ELSE 'high' END AS label FROM (
  SELECT ts, sigma, count(sigma) OVER w AS n, quantile_cont(sigma, [1.0 / 3, 2.0 / 3]) OVER w AS q FROM sigma30 WHERE instrument_id = 's0' WINDOW w AS (ORDER BY ts ROWS 364 PRECEDING))"""
STEPS["labels_all"] = "SELECT s.ts, coalesce(g.label, 'undefined') AS label FROM sessions s LEFT JOIN regimes g ON g.ts = s.ts"
STEPS["month_ends"] = "SELECT instrument_id, date_trunc('month', ts)::DATE AS month, max(ts) AS ts, arg_max(close, ts) AS close FROM line_bars GROUP BY 1, 2"
STEPS["ranked"] = """SELECT month, instrument_id, momentum, CASE WHEN hi <= n THEN 'long' WHEN lo <= n THEN 'short' ELSE 'flat' END AS direction FROM (
  SELECT *, floor(count(*) OVER (PARTITION BY month) * 0.25) AS n, row_number() OVER (PARTITION BY month ORDER BY momentum DESC, instrument_id) AS hi, row_number() OVER (PARTITION BY month ORDER BY momentum, instrument_id) AS lo FROM (
    SELECT (a.month + INTERVAL 1 MONTH)::DATE AS month, a.instrument_id, b.close / c.close - 1 AS momentum FROM month_ends a JOIN month_ends b ON b.instrument_id = a.instrument_id AND b.month = a.month - INTERVAL 1 MONTH JOIN month_ends c ON c.instrument_id = a.instrument_id AND c.month = a.month - INTERVAL 12 MONTH WHERE a.close >= 100))"""
STEPS["pair"] = "SELECT a.ts, ln(a.close) AS y, ln(b.close) AS x FROM line_bars a JOIN line_bars b ON a.ts = b.ts WHERE a.instrument_id = 's1' AND b.instrument_id = 's2'"
STEPS["spread"] = """SELECT ts, beta, (y - alpha - beta * x) / nullif(sqrt(greatest((syy - beta * sxy) / 59, 0.0)), 0) AS z, row_number() OVER (ORDER BY ts) AS i FROM (
  SELECT ts, y, x, count(*) OVER w AS n, regr_slope(y, x) OVER w AS beta, regr_intercept(y, x) OVER w AS alpha, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy FROM pair WINDOW w AS (ORDER BY ts ROWS 59 PRECEDING)) WHERE n = 60"""
STEPS["states"] = """SELECT 0::BIGINT AS i, 0 AS state UNION ALL SELECT i, CASE WHEN z IS NULL THEN 0 WHEN exited = 0 AND z >= 1.5 THEN -1 WHEN exited = 0 AND z <= -1.5 THEN 1 ELSE exited END FROM (
  SELECT p.i, p.z, s.state, CASE WHEN s.state = -1 AND p.z <= 0 THEN 0 WHEN s.state = 1 AND p.z >= 0 THEN 0 ELSE s.state END AS exited FROM states s JOIN spread p ON p.i = s.i + 1)"""


def _findings(check: str, level: str, rows: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{level}' AS level, instrument_id, ts AS day, value::DOUBLE AS value FROM ({rows})"


def _dates(bars: str) -> str:
    return _findings("duplicate_dates", "error", f"SELECT instrument_id, ts, count(*) AS value FROM {bars} GROUP BY 1, 2 HAVING count(*) > 1")


def _positive(bars: str) -> str:
    return _findings("non_positive_prices", "error", f"SELECT instrument_id, ts, least(open, high, low, close) AS value FROM {bars} WHERE least(open, high, low, close) <= 0")


def _ohlc(bars: str) -> str:
    return _findings("inconsistent_ohlc", "error", f"SELECT instrument_id, ts, high AS value FROM {bars} WHERE high < greatest(open, close, low) - abs(greatest(open, close, low)) * 1e-9 OR low > least(open, close, high) + abs(least(open, close, high)) * 1e-9")


_MISSING = _findings("missing_sessions", "warning", "SELECT s.instrument_id, c.ts, 1.0 AS value FROM (SELECT instrument_id, min(ts) AS a, max(ts) AS b FROM line_bars GROUP BY 1) s JOIN sessions c ON c.ts > s.a AND c.ts < s.b WHERE NOT EXISTS (SELECT 1 FROM line_bars l WHERE l.instrument_id = s.instrument_id AND l.ts = c.ts)")


def _stale(bars: str, least: int) -> str:
    return _findings("stale_closes", "warning", f"SELECT instrument_id, min(ts) AS ts, count(*) AS value FROM (SELECT *, sum(fresh) OVER ({ID}) AS island FROM (SELECT *, CASE WHEN close = lag(close) OVER ({ID}) THEN 0 ELSE 1 END AS fresh FROM {bars})) GROUP BY instrument_id, island HAVING count(*) >= {least}")


def _extreme(limit: float) -> str:
    return _findings("extreme_moves", "warning", f"""SELECT instrument_id, ts, off / scale AS value FROM (SELECT *, 1.4826 * quantile_cont(abs(off), 0.5) OVER (PARTITION BY instrument_id) AS scale FROM (
      SELECT instrument_id, ts, r - quantile_cont(r, 0.5) OVER (PARTITION BY instrument_id) AS off FROM rets WHERE r IS NOT NULL AND instrument_id IN (SELECT instrument_id FROM line_bars GROUP BY 1 HAVING count(*) > 20 AND min(close) > 0))) WHERE scale <> 0 AND abs(off / scale) > {limit}""")


_CHECKS = ("duplicate_dates", "non_positive_prices", "inconsistent_ohlc", "missing_sessions", "stale_closes", "extreme_moves")
STEPS["report"] = " UNION ALL ".join((_dates("line_bars"), _positive("line_bars"), _ohlc("line_bars"), _MISSING, _stale("line_bars", 5), _extreme(10.0)))
STEPS["ledger_rows"] = """SELECT h.*, e.eq0, e.eq00, e.last_ts, p1.close AS p1, p0.close AS p0, sign(h.position)::INT AS side, h.cost * e.eq0 AS money FROM hold_1 h
  JOIN (SELECT run_id, ts, lag(equity) OVER (PARTITION BY run_id ORDER BY ts) AS eq0, lag(equity, 2) OVER (PARTITION BY run_id ORDER BY ts) AS eq00, max(ts) OVER (PARTITION BY run_id) AS last_ts FROM sim_1) e ON e.run_id = h.run_id AND e.ts = h.ts
  LEFT JOIN line_bars p1 ON p1.instrument_id = h.instrument_id AND p1.ts = h.ts LEFT JOIN line_bars p0 ON p0.instrument_id = h.instrument_id AND p0.ts = h.prev_ts"""
STEPS["ledger_steps"] = """SELECT *, sum(opens) OVER (PARTITION BY run_id, instrument_id ORDER BY k) AS trade, CASE WHEN opens = 1 AND side0 <> 0 THEN abs(w0 * p0 / p00 / (eq0 / eq00)) ELSE 0 END AS drifted FROM (
  SELECT *, (side <> 0 AND side <> side0)::INT AS opens FROM (
    SELECT *, CASE WHEN lag(k) OVER w = k - 1 THEN lag(side) OVER w ELSE 0 END AS side0, CASE WHEN lag(k) OVER w = k - 1 THEN lag(position) OVER w END AS w0, lag(p0) OVER w AS p00 FROM ledger_rows WINDOW w AS (PARTITION BY run_id, instrument_id ORDER BY k)))"""
STEPS["ledger_parts"] = """SELECT run_id, instrument_id, trade, ts, prev_ts, p0, p1, position, side, last_ts, money * (1 - CASE WHEN drifted > 0 THEN drifted / (drifted + abs(position)) ELSE 0 END) AS costs, CASE WHEN side <> 0 THEN eq0 * position * (p1 / p0 - 1) ELSE 0 END AS gross FROM ledger_steps
  UNION ALL SELECT run_id, instrument_id, trade - 1, NULL, NULL, NULL, NULL, NULL, 0, last_ts, money * drifted / (drifted + abs(position)), 0 FROM ledger_steps WHERE drifted > 0"""
STEPS["ledger"] = """SELECT t.run_id, t.instrument_id, CASE WHEN t.side > 0 THEN 'long' ELSE 'short' END AS side, entry_ts, entry_price, exit_ts, exit_price, size, gross_pnl, costs, gross_pnl - costs AS net_pnl, date_diff('day', entry_ts, exit_ts)::INT AS holding_days, g.label AS regime_at_entry, exit_ts = last_ts AS open_at_end FROM (
  SELECT run_id, instrument_id, trade, max(side) FILTER (side <> 0) AS side, min(prev_ts) FILTER (side <> 0) AS entry_ts, arg_min(p0, ts) FILTER (side <> 0) AS entry_price, max(ts) FILTER (side <> 0) AS exit_ts, arg_max(p1, ts) FILTER (side <> 0) AS exit_price, abs(arg_min(position, ts) FILTER (side <> 0)) AS size, sum(gross) AS gross_pnl, sum(costs) AS costs, max(last_ts) AS last_ts FROM ledger_parts GROUP BY 1, 2, 3) t LEFT JOIN labels_all g ON g.ts = t.entry_ts"""
STEPS["stress_days"] = "SELECT h.run_id, s.scenario, h.ts, sum(h.position * s.shock) AS impact FROM hold_1 h JOIN shocks s ON s.instrument_id = h.instrument_id WHERE h.position <> 0 GROUP BY 1, 2, 3"
for _name in ("1", "4", "free"):
    STEPS[f"metrics_{_name}"] = f"""SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END AS calmar FROM (SELECT run_id, {_growth('(arg_max(equity, ts) / arg_min(equity, ts))', 'count(r)')} AS cagr, {_sharpe()} AS sharpe, {_sortino()} AS sortino, min(dd) AS max_drawdown, coalesce(avg(traded) FILTER (begun = 1), 0) * 365 AS turnover FROM (
      SELECT *, equity / max(equity) OVER ({RUN} ROWS UNBOUNDED PRECEDING) - 1 AS dd, max((traded > 0)::INT) OVER ({RUN} ROWS UNBOUNDED PRECEDING) AS begun FROM returns_{_name}) GROUP BY run_id)"""
    STEPS[f"yearly_{_name}"] = f"""SELECT run_id, year, count(*) AS days, {_growth('(arg_max(equity, ts) / min(base))', 'count(*)')} AS cagr, {_sharpe()} AS sharpe, least(min(dd), 0.0) AS max_drawdown FROM (
      SELECT *, equity / greatest(base, max(equity) OVER (PARTITION BY run_id, year ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (SELECT *, first_value(prev_equity) OVER (PARTITION BY run_id, year ORDER BY ts) AS base FROM (SELECT *, year(ts)::INT AS year FROM active_{_name}))) GROUP BY 1, 2
      UNION ALL SELECT run_id, NULL::INT, count(*), {_growth('(arg_max(equity, ts) / min(base))', 'count(*)')}, {_sharpe()}, least(min(dd), 0.0) FROM (
      SELECT *, equity / greatest(base, max(equity) OVER ({RUN} ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (SELECT *, first_value(prev_equity) OVER ({RUN}) AS base FROM active_{_name})) GROUP BY run_id"""
STEPS["grid_returns"] = "SELECT run_id, ts, r FROM returns_4 WHERE r IS NOT NULL"
STEPS["sleeves"] = """SELECT * FROM (SELECT month, run_id, ts, r, var_samp(r) OVER (PARTITION BY month, run_id) AS v FROM (
    SELECT *, count(*) FILTER (ts >= begun) OVER (PARTITION BY month, run_id) AS since FROM (
      SELECT m.month, g.*, row_number() OVER (PARTITION BY m.month, g.run_id ORDER BY g.ts DESC) AS back, min(CASE WHEN r <> 0 THEN g.ts END) OVER (PARTITION BY m.month, g.run_id) AS begun
      FROM grid_returns g JOIN (SELECT DISTINCT date_trunc('month', ts)::DATE AS month FROM grid_returns) m ON g.ts < m.month)) WHERE back <= 90 AND since >= 60) WHERE v > 0"""
STEPS["inverse"] = "SELECT month, run_id, v / sum(v) OVER (PARTITION BY month) AS weight FROM (SELECT month, run_id, 1 / stddev_samp(r) AS v FROM sleeves GROUP BY 1, 2)"
STEPS["block_sums"] = "SELECT run_id, floor(back / size)::INT AS block, sum(r) AS s, sum(r * r) AS q, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC) - 1 AS back, floor(count(*) OVER (PARTITION BY run_id) / 16) AS size FROM aligned_4) WHERE back < size * 16 GROUP BY 1, 2"


def _ratio(s: str, q: str, c: str) -> str:
    v = f"(({q} - {s} * {s} / {c}) / ({c} - 1))"
    return f"CASE WHEN {v} > 0 THEN {s} / {c} / sqrt({v}) ELSE 0 END"


STEPS["split_scores"] = f"""SELECT split, run_id, {_ratio('s1', 'q1', 'c1')} AS si, {_ratio('s0', 'q0', 'c0')} AS so FROM (SELECT split, run_id, {', '.join(f'sum(CASE WHEN (split >> block) & 1 = {b} THEN {c} ELSE 0 END) AS {c}{b}' for b in (0, 1) for c in 'sqc')}
  FROM (SELECT range AS split FROM range(65536) WHERE bit_count(range) = 8) CROSS JOIN block_sums GROUP BY 1, 2)"""
STEPS["split_ranks"] = """SELECT split, max(run_id) FILTER (rank = 1) AS best, (count(*) FILTER (so < chosen) + (count(*) FILTER (so = chosen) + 1) / 2.0) / (count(*) + 1) AS omega FROM (
  SELECT *, max(CASE WHEN rank = 1 THEN so END) OVER (PARTITION BY split) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY si DESC, run_id) AS rank FROM split_scores)) GROUP BY split"""
STEPS["factors"] = """SELECT instrument_id, first_after, product(CASE kind WHEN 'split' THEN 1 / ratio ELSE c0 / (c0 + amount) END) AS pf, product(CASE kind WHEN 'split' THEN ratio ELSE 1 END) AS vf FROM (
  SELECT a.instrument_id, a.kind, a.ratio, a.amount, min(b.ts) FILTER (b.ts >= a.ex_date) AS first_after, arg_min(b.close, b.ts) FILTER (b.ts >= a.ex_date) AS c0, min(b.ts) AS first_bar FROM actions a JOIN line_bars b ON b.instrument_id = a.instrument_id GROUP BY a.instrument_id, a.kind, a.ex_date, a.ratio, a.amount)
  WHERE first_after IS NOT NULL AND first_bar < first_after GROUP BY 1, 2"""

_BAR_COLUMNS = "instrument_id, ts, open, high, low, close, volume"
_Q: dict[str, str] = {
    "bars_from_lines": f"SELECT {_BAR_COLUMNS} FROM line_bars",
    "bars_from_events": f"SELECT {_BAR_COLUMNS} FROM event_bars",
    "bars_in_range": f"SELECT {_BAR_COLUMNS} FROM line_bars WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' AND instrument_id = 's2'",
    "momentum_signal": f"SELECT instrument_id, ts, direction, {_r('strength')} FROM mom60",
    "reversal_signal": f"SELECT instrument_id, ts, {_direction('-v')} AS direction, {_r('strength=v')} FROM (SELECT *, close / lag(close, 7) OVER ({ID}) - 1 AS v FROM event_bars) WHERE v IS NOT NULL",
    "rolling_volatility": f"SELECT instrument_id, ts, {_r('sigma')} FROM sigma30",
    "ewma_volatility": f"""SELECT instrument_id, ts, {_r('sigma')} FROM (SELECT instrument_id, ts, CASE WHEN len(rs) = 10 THEN sqrt(list_sum(list_transform(rs, lambda x, i: pow(5.0 / 6, 10 - i) / total * (x - mean) * (x - mean)))) END AS sigma FROM (
      SELECT *, list_sum(list_transform(rs, lambda x, i: pow(5.0 / 6, 10 - i) / total * x)) AS mean FROM (SELECT instrument_id, ts, list(r) FILTER (r IS NOT NULL) OVER ({ID} ROWS 9 PRECEDING) AS rs, (SELECT sum(pow(5.0 / 6, range)) FROM range(10)) AS total FROM (SELECT *, close / lag(close) OVER ({ID}) - 1 AS r FROM event_bars))))""",
    "vol_target": f"SELECT instrument_id, ts, direction, {_r('strength weight')} FROM targeted",
    "month_end_bars": "SELECT * FROM month_ends",
    "cross_section": f"SELECT month, instrument_id, {_r('momentum')}, direction FROM ranked",
    "cross_section_daily": "SELECT b.ts, g.direction, count(*) AS n FROM line_bars b JOIN ranked g ON g.instrument_id = b.instrument_id AND g.month = date_trunc('month', b.ts) GROUP BY 1, 2",
    "pairs_spread": f"SELECT ts, {_r('beta z', 5)} FROM spread",
    "pair_states": f"SELECT p.ts, {_r('beta z', 5)}, s.state FROM spread p JOIN states s ON s.i = p.i",
    "members_on_days": 'SELECT s.ts, m.instrument_id FROM sessions s JOIN memberships m ON m."start" <= s.ts AND (m."end" IS NULL OR s.ts <= m."end")',
    "members_only_bars": 'SELECT b.instrument_id, b.ts, b.close FROM line_bars b WHERE EXISTS (SELECT 1 FROM memberships m WHERE m.instrument_id = b.instrument_id AND m."start" <= b.ts AND (m."end" IS NULL OR b.ts <= m."end"))',
    "instruments_between": """SELECT instrument_id FROM order_memberships WHERE "start" <= DATE '1998-12-31' AND ("end" IS NULL OR "end" >= DATE '1998-07-01') UNION SELECT 's4'""",
    "member_spans": """SELECT instrument_id, greatest("start", DATE '1996-06-01') AS "start", least(coalesce("end", DATE '1999-06-01'), DATE '1999-06-01') AS "end" FROM order_memberships WHERE "start" <= DATE '1999-06-01' AND ("end" IS NULL OR "end" >= DATE '1996-06-01')""",
    "former_members": 'SELECT instrument_id FROM order_memberships GROUP BY 1 HAVING count(*) = count("end")',
    "touching_runs": """SELECT instrument_id, min("start") AS "start", CASE WHEN count(*) = count("end") THEN max("end") END AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY instrument_id ORDER BY "start") AS island FROM (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY instrument_id ORDER BY "start") + 1 >= "start" THEN 0 ELSE 1 END AS fresh FROM order_pieces)) GROUP BY instrument_id, island""",
    "memberships_from_changes": _FROM_CHANGES,
    "price_coverage": f"""SELECT m.instrument_id, count(*) AS member_days, count(b.ts) AS priced_days, {_nine('count(b.ts) / count(*)')} AS share FROM sessions s JOIN memberships m ON m."start" <= s.ts AND (m."end" IS NULL OR s.ts <= m."end") LEFT JOIN line_bars b ON b.instrument_id = m.instrument_id AND b.ts = s.ts GROUP BY 1""",
    "adjusted_bars": f"""SELECT instrument_id, ts, {_r('open=open*p close=close*p volume=volume*v unadjusted_close=close', 5)} FROM (SELECT b.*, coalesce((SELECT product(pf) FROM factors f WHERE f.instrument_id = b.instrument_id AND f.first_after > b.ts), 1) AS p, coalesce((SELECT product(vf) FROM factors f WHERE f.instrument_id = b.instrument_id AND f.first_after > b.ts), 1) AS v FROM line_bars b)""",
    "delisted_bars": f"""SELECT instrument_id, day AS ts, {_r('close volume', 4)} FROM (SELECT d.instrument_id, d."date" AS day, arg_max(b.close, b.ts) * (1 + coalesce(any_value(d.delisting_return), -0.3)) AS close, 0.0 AS volume FROM delistings d JOIN line_bars b ON b.instrument_id = d.instrument_id GROUP BY 1, 2)""",
    "above_cash": f"SELECT b.instrument_id, b.ts, {_r('open=open*118.0/c.close close=b.close*118.0/c.close', 4)} FROM line_bars b ASOF JOIN cash_marks c ON b.ts >= c.ts",
    "next_session": "SELECT d.day, coalesce(min(s.ts), d.day) AS session FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) d LEFT JOIN (SELECT ts FROM line_bars WHERE instrument_id = 's1') s ON s.ts >= d.day GROUP BY d.day",
    "duplicate_dates": _dates("(SELECT * FROM event_bars UNION ALL SELECT * FROM event_bars WHERE instrument_id = 'click')"),
    "inconsistent_ohlc": _ohlc("(SELECT * REPLACE (CASE WHEN day(ts) = 3 THEN high * 0.5 ELSE high END AS high) FROM line_bars)"),
    "non_positive_prices": _positive("(SELECT * REPLACE (CASE WHEN day(ts) = 3 THEN -low ELSE low END AS low) FROM line_bars)"),
    "missing_sessions": _MISSING,
    "stale_closes": _stale("(SELECT * REPLACE (floor(close / 10) AS close) FROM line_bars)", 3),
    "extreme_moves": f'SELECT "check", level, instrument_id, day, {_r("value", 4)} FROM ({_extreme(4.0)})',
    "quality_summary": "SELECT p.position, p.\"check\", count(r.\"check\") AS n FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_CHECKS)) + ') AS p(position, "check") LEFT JOIN report r ON r."check" = p."check" GROUP BY 1, 2',
    "equal_weights": f"SELECT instrument_id, ts, {_r('weight')} FROM targets_1",
    "scaled_weights": f"SELECT instrument_id, ts, {_r('weight')} FROM (SELECT instrument_id, ts, (CASE direction WHEN 'long' THEN 1.0 ELSE -1.0 END) * weight / count(*) OVER (PARTITION BY ts) AS weight FROM targeted WHERE direction <> 'flat')",
    "realistic_cost": f"SELECT instrument_id, ts, {_r('rate')} FROM (SELECT instrument_id, ts, 0.001 + 0.05 * CASE WHEN count(r) OVER w >= 2 THEN stddev_samp(r) OVER w END AS rate FROM rets WINDOW w AS ({ID} ROWS 29 PRECEDING))",
    "d_backtest_momentum": f"""SELECT ts, {_r('period_return', 5)}, n_pos, {_r('equity=product(1+period_return)OVER(ORDER/**/BY/**/ts/**/ROWS/**/UNBOUNDED/**/PRECEDING)', 5)} FROM (SELECT min(ts) AS ts, 0.0 AS period_return, 0::BIGINT AS n_pos FROM calendar UNION ALL
      SELECT c.next_ts, coalesce(sum(t.weight * m.r), 0), count(m.r) FROM calendar c LEFT JOIN targets_1 t ON t.ts = c.ts LEFT JOIN market m ON m.ts = t.ts AND m.instrument_id = t.instrument_id GROUP BY 1)""",
    "backtest_with_costs": f"SELECT run_id, ts, {_r('equity cost traded cash', 5)} FROM snap_1",
    "backtest_holdings": f"SELECT ts, instrument_id, {_r('position cost traded', 5)} FROM hold_1",
    "backtest_held_until_change": f"SELECT ts, {_r('equity traded')} FROM snap_held",
    "drawdown": f"SELECT ts, {_r('drawdown', 5)} FROM (SELECT ts, equity / max(equity) OVER ({RUN} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM snap_1)",
    "run_metrics": f"SELECT run_id, {_r('cagr sharpe sortino max_drawdown turnover calmar', 5)} FROM metrics_4",
    **{f"{unit}ly_returns": f"SELECT run_id, period, {_r('ret', 5)} FROM (SELECT run_id, period, last / coalesce(lag(last) OVER (PARTITION BY run_id ORDER BY period), first) - 1 AS ret FROM (SELECT run_id, date_trunc('{unit}', ts)::DATE AS period, arg_max(equity, ts) AS last, arg_min(equity, ts) AS first FROM snap_1 GROUP BY 1, 2))" for unit in ("month", "year")},
    "walk_forward": f"SELECT run_id, year, days, {_r('cagr sharpe max_drawdown', 5)} FROM yearly_1",
    "walk_forward_verdict": "SELECT run_id, defined, positive, CASE WHEN defined >= 3 THEN 3 * positive >= 2 * defined AND coalesce(total > 0, FALSE) END AS passed FROM (SELECT run_id, count(sharpe) FILTER (year IS NOT NULL) AS defined, count(*) FILTER (year IS NOT NULL AND sharpe > 0) AS positive, max(sharpe) FILTER (year IS NULL) AS total FROM yearly_4 GROUP BY 1)",
    "regime_labels": "SELECT * FROM regimes",
    "regime_metrics": f"SELECT run_id, label, days, {_r('cagr sharpe sortino', 4)} FROM (SELECT a.run_id, g.label, count(*) AS days, {_growth('product(1 + a.r)', 'count(*)')} AS cagr, {_sharpe('a.r')} AS sharpe, {_sortino('a.r')} AS sortino FROM active_1 a JOIN labels_all g ON g.ts = a.prev_ts GROUP BY 1, 2)",
    "stress_impacts": f"SELECT scenario, ts, {_r('impact', 5)} FROM stress_days",
    "stress_summary": f"SELECT run_id, scenario, last_held_on, {_r('last_impact')}, worst_held_on, {_r('worst_impact losing_share')} FROM (SELECT run_id, scenario, max(ts) AS last_held_on, arg_max(impact, ts) AS last_impact, arg_min(ts, (impact, ts)) AS worst_held_on, min(impact) AS worst_impact, avg((impact < 0)::INT) AS losing_share FROM stress_days GROUP BY 1, 2)",
    "worst_day": f"SELECT 'worst day' AS scenario, i.instrument_id, {_nine('coalesce(r.r, w.r)')} AS shock FROM (SELECT DISTINCT instrument_id FROM line_bars) i CROSS JOIN (SELECT ts, r FROM rets WHERE instrument_id = 's0' AND r IS NOT NULL ORDER BY r, ts LIMIT 1) w LEFT JOIN rets r ON r.instrument_id = i.instrument_id AND r.ts = w.ts",
    "trade_ledger": f"SELECT run_id, instrument_id, side, entry_ts, {_r('entry_price')}, exit_ts, {_r('exit_price size gross_pnl costs net_pnl')}, holding_days, regime_at_entry, open_at_end FROM ledger",
    "pnl_groups": f"""SELECT dimension, key, trades, {_r('win_rate total_net_pnl mean_net_pnl median_net_pnl worst_net_pnl best_net_pnl costs')} FROM (SELECT dimension, key, count(*) AS trades, avg((net_pnl > 0)::INT) AS win_rate, sum(net_pnl) AS total_net_pnl, avg(net_pnl) AS mean_net_pnl, quantile_cont(net_pnl, 0.5) AS median_net_pnl, min(net_pnl) AS worst_net_pnl, max(net_pnl) AS best_net_pnl, sum(costs) AS costs FROM (
      SELECT 'regime' AS dimension, regime_at_entry AS key, net_pnl, costs FROM ledger UNION ALL SELECT 'instrument', instrument_id, net_pnl, costs FROM ledger UNION ALL SELECT 'month', strftime(exit_ts, '%Y-%m'), net_pnl, costs FROM ledger
      UNION ALL SELECT 'holding', CASE WHEN holding_days <= 7 THEN '1-7d' WHEN holding_days <= 30 THEN '8-30d' WHEN holding_days <= 90 THEN '31-90d' WHEN holding_days <= 365 THEN '91-365d' ELSE '366d+' END, net_pnl, costs FROM ledger) GROUP BY 1, 2)""",
    "trades_count": "SELECT count(*) FILTER (WHERE side = 'long') AS total, count(*) AS trades FROM ledger",
    "event_instants": "SELECT event_id, epoch_us(ts) AS us FROM events",
    "trades_page": f"SELECT run_id, instrument_id, side, entry_ts, {_r('entry_price')}, exit_ts, {_r('exit_price size gross_pnl costs net_pnl')}, holding_days, regime_at_entry, open_at_end FROM (SELECT * FROM ledger WHERE side = 'long' ORDER BY net_pnl DESC, entry_ts, instrument_id LIMIT 25 OFFSET 25)",
    "total_costs": f"SELECT run_id, {_r('total_costs', 5)} FROM (SELECT run_id, sum(cost * prev_equity) AS total_costs FROM returns_1 GROUP BY 1)",
    "cost_sensitivity": f"SELECT 'free' AS lower_cost, '10bps' AS higher_cost, {_nine('d', 5)} AS sharpe_difference, flip AS cagr_sign_flip, CASE WHEN d IS NULL OR flip IS NULL THEN 'undefined' WHEN abs(d) < 0.1 AND NOT flip THEN 'robust' ELSE 'cost-dependent' END AS verdict FROM (SELECT a.sharpe - b.sharpe AS d, (a.cagr > 0) <> (b.cagr > 0) AS flip FROM metrics_free a CROSS JOIN metrics_1 b)",
    "return_correlation": f"SELECT a.run_id AS a, b.run_id AS b, count(*) AS days, CASE WHEN count(*) >= 2 THEN {_nine('corr(a.r, b.r)', 5)} END AS correlation FROM returns_4 a JOIN returns_4 b ON a.ts = b.ts AND a.run_id < b.run_id WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.invested > 0 AND b.invested > 0 GROUP BY 1, 2",
    "sparkline": f"SELECT run_id, i, ts, {_r('equity', 5)} FROM (SELECT run_id, row_number() OVER ({RUN}) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, ts, equity FROM snap_1) s WHERE EXISTS (SELECT 1 FROM range(120) WHERE range < least(s.n, 120) AND s.i = CASE WHEN least(s.n, 120) > 1 THEN (range * (s.n - 1)) // (least(s.n, 120) - 1) ELSE 0 END)",
    "aligned_returns": f"SELECT run_id, ts, {_r('r')} FROM aligned_4",
    "sharpe_statistics": f"""SELECT run_id, n, {_r('sharpe skew kurt', 5)} FROM (SELECT run_id, count(*) AS n, avg(r) / stddev_samp(r) AS sharpe, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS kurt FROM (SELECT *, avg(r) OVER (PARTITION BY run_id) AS m FROM aligned_4) GROUP BY 1)""",
    "overfitting_splits": f"SELECT split, best, {_r('omega logit')} FROM (SELECT *, ln(omega / (1 - omega)) AS logit FROM split_ranks)",
    "overfitting_probability": f"SELECT {_r('pbo')}, n_splits, {_r('logit_median')} FROM (SELECT avg((ln(omega / (1 - omega)) <= 0)::INT) AS pbo, count(*) AS n_splits, quantile_cont(ln(omega / (1 - omega)), 0.5) AS logit_median FROM split_ranks)",
    "chosen_by_year": f"SELECT year, arg_min(run_id, (-sharpe, run_id)) AS choice, {_nine('max(sharpe)', 5)} AS sharpe FROM (SELECT y.year, g.run_id, avg(r) / stddev_samp(r) AS sharpe FROM (SELECT DISTINCT run_id, (year(ts) + 1)::INT AS year FROM grid_returns) y JOIN grid_returns g ON g.run_id = y.run_id AND year(g.ts) < y.year GROUP BY 1, 2 HAVING count(*) >= 200 AND stddev_samp(r) > 0) GROUP BY 1",
    "inverse_volatility": f"SELECT month, run_id, {_r('weight', 5)} FROM inverse",
    "diversification": f"SELECT month, {_r('ratio', 4)} FROM (SELECT a.month, a.s / b.s AS ratio FROM (SELECT month, sum(sd * weight) AS s FROM (SELECT month, run_id, stddev_samp(r) AS sd FROM sleeves GROUP BY 1, 2) JOIN inverse USING (month, run_id) GROUP BY 1) a JOIN (SELECT month, stddev_samp(p) AS s FROM (SELECT month, ts, sum(r * weight) AS p FROM sleeves JOIN inverse USING (month, run_id) GROUP BY 1, 2) GROUP BY 1) b ON a.month = b.month)",
    "netted_portfolio": f"SELECT ts, instrument_id, {_r('weight')} FROM (SELECT t.ts, t.instrument_id, sum(t.weight * s.share) AS weight FROM targets_4 t JOIN (SELECT month, run_id, 1.0 / count(*) OVER (PARTITION BY month) AS share FROM (SELECT DISTINCT month, run_id FROM sleeves)) s ON s.run_id = t.run_id AND s.month = date_trunc('month', t.ts) GROUP BY 1, 2) WHERE weight <> 0",
    "normalised_tickers": "SELECT c_custkey, regexp_replace(replace(upper(trim(c_mktsegment || ' .' || c_name)), '.', '-'), '[^A-Z0-9-]', '', 'g') AS ticker FROM customer",
    "trials_on_same_data": "SELECT t.hypothesis, o.hypothesis AS other FROM order_trials t JOIN order_trials o ON o.universe = t.universe AND o.hypothesis <> t.hypothesis AND o.training_start <= t.training_end AND t.training_start <= o.training_end AND o.registered_at <= t.registered_at",
}


def _similarity() -> str:
    from ..functions.scalars import LEGAL_FORMS

    words = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: NOT list_contains([{', '.join(repr(w) for w in LEGAL_FORMS)}], x))"
    pairs = f"SELECT p_partkey, {words('p_name')} AS x, {words('other')} AS y FROM (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part) WHERE other IS NOT NULL"
    return f"SELECT p_partkey, CASE WHEN len(x) > 0 AND len(y) > 0 THEN {_nine('len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))')} ELSE 0.0 END AS similarity FROM ({pairs})"


_Q["name_similarity"] = _similarity()
ORACLE_SQL.update({name: _sql(body) for name, body in _Q.items()})
