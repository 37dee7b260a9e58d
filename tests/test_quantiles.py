"""Sliding quantiles against sorting every window."""

from datetime import date, timedelta

import numpy as np
import pytest

from lodestrata.operators.quantiles import rolling_quantiles, sliding_quantiles


def test_equals_sorted_windows():
    rnd = np.random.default_rng(3)
    for values, history in ((rnd.normal(size=300), 40), (rnd.integers(0, 5, 300).astype(float), 7), (rnd.normal(size=60), 1), (rnd.normal(size=5), 9), (np.zeros(0), 3)):
        x = np.where(rnd.random(len(values)) < 0.02, np.nan, values)
        got = sliding_quantiles(x, history, (0.0, 1 / 3, 0.5, 2 / 3, 1.0))
        for i in range(len(x)):
            w = x[max(0, i - history + 1) : i + 1]
            if len(w) < history or np.isnan(w).any():
                assert got[i] is None
            else:
                assert got[i] == pytest.approx(np.quantile(w, (0.0, 1 / 3, 0.5, 2 / 3, 1.0)), abs=1e-12)


def test_chunks_agree(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, date(2020, 1, 1) + timedelta(i), None if rnd.random() < 0.01 else float(rnd.normal())) for k, n in (("a", 200), ("b", 31), ("c", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "instrument_id string, ts date, vol double")
    want = {}
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        q = sliding_quantiles(np.array([np.nan if r[2] is None else r[2] for r in own]), 20, (0.25, 0.75))
        want |= {(k, r[1]): v for r, v in zip(own, q, strict=True)}
    for chunk in (8, 50, 4096):
        assert {(r.instrument_id, r.ts): r.q for r in rolling_quantiles(df, "instrument_id", "ts", "vol", 20, (0.25, 0.75), chunk).collect()} == want
    assert rolling_quantiles(df.limit(0), "instrument_id", "ts", "vol", 20, (0.5,)).count() == 0
