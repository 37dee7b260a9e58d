"""Sleeves against loops: anchored histories, own costs, windows, holdings cut by empty decisions and by slices."""

from datetime import date, timedelta

import numpy as np
import pytest

from lodestrata.operators import portfolio, studies, validation
from lodestrata.plans import study_queries
from lodestrata.plans.bars import line_bars

D = date.fromisoformat


def day(k):
    return D("2020-01-01") + timedelta(k)


def test_sleeve_windows_equal_a_loop(spark):
    rnd = np.random.default_rng(2)
    runs = {}
    for k, (first, zeros) in enumerate([(0, 0), (10, 40), (75, 0), (0, 300)]):
        days = [d for d in range(first, 250) if rnd.random() < 0.8]
        runs[f"r{k}"] = [(day(d), 0.0 if i < zeros else float(rnd.normal())) for i, d in enumerate(days)]
    runs["flat"] = [(day(d), 0.5) for d in range(200)]
    rows = [(n, t, r) for n, v in runs.items() for t, r in v]
    got = {}
    for x in portfolio.sleeve_windows(spark.createDataFrame(rows, "run_id string, ts date, r double"), 30, 25).collect():
        got.setdefault((x.month, x.run_id), []).append((x.ts, x.r))
    want = {}
    for month in {t.replace(day=1) for _, t, _ in rows}:
        for n, v in runs.items():
            past = sorted(x for x in v if x[0] < month)
            begun = next((i for i, (_, r) in enumerate(past) if r != 0), None)
            if begun is not None and len(past) - begun >= 25 and np.var([r for _, r in past[-30:]]) > 1e-18:
                want[month, n] = past[-30:]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 10


def test_anchor_and_component_costs(spark, sf_dir):
    d = study_queries.definition("anchored")
    assert [c.bps for *_, c in d.study.components] == [5, 10, 20] and d.study.history_start == D("1995-03-01")
    assert d.fetch_start(D("2001-01-01"), True) == D("1995-03-01") - timedelta(14 * 31) and d.fetch_start(D("1995-01-01"), True) == D("1995-01-01") - timedelta(14 * 31)
    bars, end = line_bars(spark, sf_dir), D("1997-12-31")
    # A later start of the portfolio leaves the shared days' sleeves, and so its targets, alone.
    at = lambda start: {(r.ts, r.instrument_id): r.weight for r in studies.study_targets(d, bars, None, D(start), end)[0].collect()}
    early, late = at("1996-01-01"), at("1997-01-01")
    shared = {k: v for k, v in early.items() if k[0] >= D("1997-01-01")}
    assert late.keys() == shared.keys() and all(late[k] == pytest.approx(v, abs=1e-12) for k, v in shared.items()) and len(early) > len(late) > 50
    # Each component pays its own rate: a free copy of one of them earns more and the others the same.
    own = bars.where("ts <= '1997-12-31'")
    free = type(d.study)(**{**d.study.__dict__, "components": tuple((n, s, studies.Costs() if n == "rev" else c) for n, s, c in d.study.components)})
    sums = [{r["run_id"]: r["sum(r)"] for r in s.history(own, lambda x: x, None)[1].groupBy("run_id").sum("r").collect()} for s in (d.study, free)]
    assert sums[1]["rev"] > sums[0]["rev"] and sums[1]["mom"] == pytest.approx(sums[0]["mom"]) and sums[1]["xs"] == pytest.approx(sums[0]["xs"])


def test_empty_decisions_end_a_holding(spark):
    decided = spark.createDataFrame([("r", day(0), "a", 0.5), ("r", day(4), "a", 1.0)], "run_id string, decision date, instrument_id string, weight double")
    filled = spark.createDataFrame([("a", day(k), 10.0 + k) for k in range(6)], "instrument_id string, ts date, close double")
    calendar = spark.createDataFrame([(day(k), day(k + 1)) for k in range(5)], "ts date, next_ts date")
    trades = spark.createDataFrame([("r", day(k)) for k in (0, 2, 4)], "run_id string, ts date")
    days = lambda *t: sorted((r.decision, r.ts) for r in validation.growth_in_holding(decided, filled, calendar, *t).collect())
    assert days() == [(day(0), day(k)) for k in (1, 2, 3, 4)] + [(day(4), day(5))]
    assert days(trades) == [(day(0), day(1)), (day(0), day(2)), (day(4), day(5))]


@pytest.mark.parametrize("slice_days", [1, 2, 3, 5, 64])
def test_slices_of_a_holding_add_up(spark, slice_days):
    rnd = np.random.default_rng(8)
    n, days = 6, 10
    growth = np.exp(np.cumsum(rnd.normal(0, 0.05, (days, n)), 0))
    w = np.array([0.5, -0.5, 0, 0, 0.25, 0])
    rows = [("r", day(0), day(t + 1), f"i{k}", float(w[k]), float(growth[t, k])) for t in range(days) for k in range(n)]
    rows += [("r", day(10), day(11), f"i{k}", float(-w[k]), float(growth[0, k])) for k in range(n)] + [("r", day(11), day(12), "i0", 0.0, 1.5)]
    df = spark.createDataFrame(rows, "run_id string, decision date, ts date, instrument_id string, weight double, growth double")
    got = {x.draw: x.sharpe for x in validation.random_portfolio_draws(df, spark.createDataFrame([("r", 12)], "run_id string, n int"), 365, draws=9, seed=4, chunk=4, slice_days=slice_days).collect()}
    want = np.zeros((10, 12))
    for start, g, x in ((0, growth, w), (10, growth[:1], -w)):
        r = np.random.default_rng([4, (day(start) - D("1970-01-01")).days + 2**20])
        orders = [x, *np.concatenate([r.permuted(np.tile(x, (c, 1)), axis=1) for c in (4, 4, 1)])]
        for i, o in enumerate(orders):
            v = np.r_[1, 1 + (g - 1) @ o]
            want[i, start : start + len(g)] = v[1:] / v[:-1] - 1
    for i, r in enumerate(want):
        assert got[i - 1] == pytest.approx(r.mean() / r.std(ddof=1) * 365**0.5)
