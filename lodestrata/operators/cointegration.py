"""Rolling tests of cointegration (Engle and Granger) on every window of a pair, from running cross-products.

A window regresses log y on log x; its residuals e are tested for a unit root without a constant, with as many lagged changes as AIC chooses on the
sample that all lags share. e is a linear combination of y, x and 1, so the products that every regression needs, sums of
e[t-a] * e[t-b], follow from running sums of products of y and x with each other's lags; no window's residuals are formed. The regressions of all lags are
nested, so one Cholesky factor of a window's moments holds the residual sums of all of them.

Windows are dealt in chunks: a task holds the days of one chunk and the window before it, however long the history is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, once

#: Windows of one task.
CHUNK = 2048


def most_lags(n: int) -> int:
    """Lagged changes that AIC may choose for ``n`` observations."""
    return min(n // 2 - 1, int(np.ceil(12 * (n / 100) ** 0.25)))


class _Products:
    """Running sums of y, x and of their products at each lag, relative to the first values so that the sums stay small."""

    def __init__(self, y: np.ndarray, x: np.ndarray, lags: int):
        self.n = len(y)
        self.series = {"1": np.ones(self.n), "y": y - y[0], "x": x - x[0]}
        self.sums: dict[tuple[str, str, int], np.ndarray] = {}
        for d in range(lags + 1):
            for a in self.series:
                for b in self.series:
                    p = np.zeros(self.n + 1)
                    np.cumsum(self.series[a][d:] * self.series[b][: self.n - d], out=p[d + 1 :])
                    self.sums[a, b, d] = p

    def between(self, a: str, b: str, i: int, j: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sums over t in [lo, hi) of a[t - i] * b[t - j]."""
        if i > j:
            a, b, i, j = b, a, j, i
        p = self.sums[a, b, j - i]
        return p[hi - i] - p[lo - i]


def _moments(s: _Products, coef: dict[str, np.ndarray], lags: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(windows, lags + 2, lags + 2): products, summed over t in [lo, hi), of e[t-1], the changes of e at t-1 .. t-lags, and last the change at t."""
    level = np.zeros((len(lo), lags + 2, lags + 2))
    for i in range(lags + 2):
        for j in range(i, lags + 2):
            level[:, i, j] = level[:, j, i] = sum(coef[a] * coef[b] * s.between(a, b, i, j, lo, hi) for a in coef for b in coef)
    # A change is the difference of two levels.
    to = np.zeros((lags + 2, lags + 2))
    to[0, 1] = 1
    for k in range(1, lags + 1):
        to[k, k], to[k, k + 1] = 1, -1
    to[lags + 1, 0], to[lags + 1, 1] = 1, -1
    return to @ level @ to.T


def _factor(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Cholesky factors, whether they exist)."""
    out, ok = np.zeros_like(m), np.zeros(len(m), bool)
    try:
        return np.linalg.cholesky(m), np.ones(len(m), bool)
    except np.linalg.LinAlgError:
        for i, one in enumerate(m):
            try:
                out[i], ok[i] = np.linalg.cholesky(one), True
            except np.linalg.LinAlgError:
                out[i] = np.eye(len(one))
    return out, ok


def window_statistics(y: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """The test's statistic for the window that ends at each place; NaN before the first whole one and where x does not vary, -inf for an exact line."""
    n, out = len(y), np.full(len(y), np.nan)
    lags = most_lags(window)
    if n < window or lags < 0:
        return out
    s = _Products(y, x, lags + 1)
    end = np.arange(window, n + 1)
    lo = end - window
    sums = {k: s.between(*k, 0, 0, lo, end) for k in (("y", "1"), ("x", "1"), ("y", "x"), ("x", "x"), ("y", "y"))}
    my, mx = sums["y", "1"] / window, sums["x", "1"] / window
    cxx, cxy, cyy = (sums[k] - window * a * b for k, a, b in ((("x", "x"), mx, mx), (("y", "x"), my, mx), (("y", "y"), my, my)))
    varies = cxx > 1e-12 * np.maximum(1, sums["x", "x"])
    beta = np.where(varies, cxy / np.where(varies, cxx, 1), 0)
    coef = {"y": np.ones(len(end)), "x": -beta, "1": -(my - beta * mx)}
    exact = varies & (cyy - beta * cxy <= 100 * np.sqrt(np.finfo(float).eps) * np.maximum(cyy, 1e-300))
    common, ok = _factor(_moments(s, coef, lags, lo + lags + 1, end))
    size = window - 1 - lags
    # Row by row the factor's last line holds what each further regressor explains of the change.
    part = common[:, -1, :] ** 2
    left = part.sum(1)[:, None] - np.cumsum(part[:, : lags + 1], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        aic = size * np.log(left / size) + 2 * np.arange(1, lags + 2)
    chosen = np.where(ok, np.argmin(np.nan_to_num(aic, nan=np.inf), 1), -1)
    for k in np.unique(chosen[chosen >= 0]):
        at = np.flatnonzero(chosen == k)
        m = _moments(s, {c: v[at] for c, v in coef.items()}, int(k), lo[at] + k + 1, end[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            try:
                inverse = np.linalg.inv(m[:, :-1, :-1])
            except np.linalg.LinAlgError:
                continue
            b = (inverse @ m[:, :-1, -1:])[:, :, 0]
            rest = m[:, -1, -1] - (b * m[:, :-1, -1]).sum(1)
            out[end[at] - 1] = b[:, 0] / np.sqrt(rest / (window - 1 - k - (k + 1)) * inverse[:, 0, 0])
    out[end[exact] - 1] = -np.inf
    out[end[~varies] - 1] = np.nan
    return out


def rolling_statistics(pairs: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """(pair, ts, statistic): for rows (pair, ts, y, x) of log prices the statistic of the ``window`` common days up to each day; null without one."""
    place = pairs.select("pair", "ts", "y", "x", (F.row_number().over(Window.partitionBy("pair").orderBy("ts")) - 1).alias("at"))
    # A day belongs to its own chunk and to those whose first windows reach back to it.
    dealt = place.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("at") + window - 1) / chunk))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        stat = window_statistics(pdf["y"].to_numpy(), pdf["x"].to_numpy(), window)
        own = pdf["at"] // chunk == pdf["chunk"]
        return pd.DataFrame({"pair": pdf["pair"], "ts": pdf["ts"], "statistic": stat})[own]

    out = dealt.groupBy("pair", "chunk").applyInPandas(run, "pair string, ts date, statistic double")
    return out.withColumn("statistic", F.when(~F.isnan("statistic"), F.col("statistic")))


def mackinnon_p(statistic: Column) -> Column:
    """Chance of so small a statistic without cointegration, for two series and a constant; null stays null."""

    # MacKinnon (1994), two series with a constant: the normal quantile as a polynomial of the statistic below and above -2.62, from the constant
    # term up, and the ends of the surface.
    small = (2.92, 1.5012, 0.039796)
    large = (2.1945, 0.64695, -0.29198, -0.042377)
    least, turn, most = -18.86, -2.62, 0.92

    def p(t: Column) -> Column:
        inside = F.greatest(F.least(t, F.lit(most)), F.lit(least))
        poly = lambda c: sum((v * F.pow(inside, F.lit(i)) for i, v in enumerate(c[1:], 1)), F.lit(c[0]))
        z = F.when(t <= turn, poly(small)).otherwise(poly(large))
        return F.when(t < least, 0.0).when(t > most, 1.0).when(t.isNotNull(), once(z, normal_cdf))

    return once(statistic, p)


def critical_values(n: int) -> dict[str, float]:
    """Critical statistics at 1, 5 and 10 % for two series of ``n`` observations with a constant."""
    # MacKinnon (2010), by powers of 1 / observations from the constant term up.
    table = {"1": (-3.89644, -10.9519, -22.527), "5": (-3.33613, -6.1101, -6.823), "10": (-3.04445, -4.2412, -2.720)}
    return {k: a + b / (n - 1) + c / (n - 1) ** 2 for k, (a, b, c) in table.items()}


def gated(path: DataFrame, pairs: DataFrame, window: int, max_p: float) -> DataFrame:
    """``path`` (pair, ts, ..) with may_enter: whether the window up to the day rejects no cointegration at ``max_p``; without a statistic it does not."""
    tested = rolling_statistics(pairs, window).select("pair", "ts", (mackinnon_p(F.col("statistic")) < max_p).alias("__enter"))
    return path.join(tested, ["pair", "ts"], "left").withColumn("may_enter", F.coalesce("__enter", F.lit(False))).drop("__enter")
