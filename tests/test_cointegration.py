"""Rolling cointegration tests against one fit per window, the gate against a loop over days, and published p-values."""

from datetime import date, timedelta

import numpy as np
import pytest

from lodestrata.operators import cointegration as coint
from lodestrata.operators import signals
from lodestrata.plans.study_queries import definition
from pyspark.sql import functions as F


def series(seed, n, tied=True):
    rnd = np.random.default_rng(seed)
    x = 4 + np.cumsum(rnd.normal(0, 0.03, n))
    e = np.zeros(n)
    for t in range(1, n):
        e[t] = 0.9 * e[t - 1] + rnd.normal(0, 0.01)
    return (0.5 + 0.8 * x + e) if tied else 4 + np.cumsum(rnd.normal(0, 0.03, n)), x


@pytest.mark.parametrize(("seed", "window", "tied"), [(1, 60, True), (2, 60, False), (3, 25, True), (4, 120, False)])
def test_windows_equal_one_fit_each(seed, window, tied):
    y, x = series(seed, 300, tied)
    got = coint.window_statistics(y, x, window)
    assert np.isnan(got[: window - 1]).all()
    for end in range(window, 301, 7):
        assert got[end - 1] == pytest.approx(signals.engle_granger(y[end - window : end], x[end - window : end])["statistic"], rel=1e-6)


def test_odd_windows():
    y, x = series(5, 120)
    flat = x.copy()
    flat[:70] = 3.0
    got = coint.window_statistics(y, flat, 60)
    assert np.isnan(got[:70]).all() and np.isfinite(got[75:]).all()
    assert (coint.window_statistics(2 * x + 1, x, 60)[59:] == -np.inf).all()
    assert np.isnan(coint.window_statistics(y[:10], x[:10], 60)).all()


def test_p_values(spark):
    # The surface's critical values for many observations: 1, 5 and 10 %.
    known = [(-3.89644, 0.01), (-3.33613, 0.05), (-3.04445, 0.10)]
    df = spark.createDataFrame([(t,) for t, _ in known] + [(-20.0,), (1.0,), (float("-inf"),), (None,)], "t double")
    p = [r[0] for r in df.select(coint.mackinnon_p(F.col("t"))).collect()]
    assert all(a == pytest.approx(b, abs=7e-4) for a, (_, b) in zip(p, known, strict=False))
    assert p[3:] == [0.0, 1.0, 0.0, None]
    both = [r[0] for r in spark.createDataFrame([(-2.62 - 1e-9,), (-2.62 + 1e-9,), (-1.5,)], "t double").select(coint.mackinnon_p(F.col("t"))).collect()]
    assert both[0] == pytest.approx(both[1], abs=2e-3) and both[0] < both[2]
    c = coint.critical_values(500)
    assert c["1"] < c["5"] < c["10"]


def walked(z, entry, exit_, may):
    out, state = [], 0
    for v, ok in zip(z, may, strict=True):
        if v is None:
            state = 0
        else:
            if (state == 1 and v >= -exit_) or (state == -1 and v <= exit_):
                state = 0
            if state == 0 and ok and abs(v) >= entry:
                state = -1 if v > 0 else 1
        out.append(state)
    return out


def test_gated_states_equal_a_loop(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for pair in "abc":
        z = [None if rnd.random() < 0.05 else round(float(v), 1) for v in rnd.normal(0, 1.6, 200)]
        rows += [(pair, date(2020, 1, 1) + timedelta(i), 1.0, v, bool(rnd.random() < 0.4)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "pair string, ts date, beta double, z double, may_enter boolean")
    for entry, exit_, gate in [(2.0, 0.0, True), (1.5, 0.5, True), (2.0, 0.0, False)]:
        got = {(r.pair, r.ts): r.state for r in signals.pair_states(df if gate else df.drop("may_enter"), entry, exit_).collect()}
        for pair in "abc":
            own = [r for r in rows if r[0] == pair]
            assert [got[pair, r[1]] for r in own] == walked([r[3] for r in own], entry, exit_, [r[4] or not gate for r in own])


def test_chunks_and_gate(spark):
    day = lambda i: date(2020, 1, 1) + timedelta(i)
    want = {}
    rows = []
    for pair, seed, n in (("p", 1, 170), ("q", 2, 95), ("r", 3, 20)):
        y, x = series(seed, n, seed != 2)
        rows += [(pair, day(i), float(y[i]), float(x[i])) for i in range(n)]
        want |= {(pair, day(i)): s for i, s in enumerate(coint.window_statistics(y, x, 40))}
    df = spark.createDataFrame(rows, "pair string, ts date, y double, x double")
    for chunk in (16, 64, 2048):
        got = {(r.pair, r.ts): r.statistic for r in coint.rolling_statistics(df, 40, chunk).collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None and np.isnan(v)) or got[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())
    allowed = {(r.pair, r.ts): r.may_enter for r in coint.gated(df.select("pair", "ts"), df, 40, 0.05).collect()}
    # Without a whole window there is no entry; a limit on p-values is one on the statistic.
    assert all(not v for (_, d), v in allowed.items() if d < day(39)) and {True, False} <= set(allowed.values())
    assert max(want[k] for k, v in allowed.items() if v) < min(s for k, s in want.items() if not allowed[k] and not np.isnan(s))
    assert coint.rolling_statistics(df.limit(0), 40).count() == 0


def test_gate_of_a_definition(spark):
    d = definition("gate").study
    assert d.max_coint_p_value == 0.2
    y, x = series(6, 200, False)
    bars = spark.createDataFrame([(k, date(2020, 1, 1) + timedelta(i), float(np.exp(v[i]))) for k, v in (("s1", y), ("s2", x)) for i in range(200)], "instrument_id string, ts date, close double")
    free = type(d)(**{**d.__dict__, "max_coint_p_value": None})
    assert d.signals(bars).count() < free.signals(bars).count()
    with pytest.raises(ValueError):
        type(d)(**{**d.__dict__, "max_coint_p_value": 0.0})
