"""Signals: (instrument_id, ts, direction, strength, weight) from bars, by windows over each instrument's own bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import direction, vol_scale
from .cointegration import critical_values, mackinnon_p
from .prep import by_day


def trailing_return(bars: DataFrame, k: int) -> DataFrame:
    """``bars`` with value = close / close k bars ago - 1; days without so many bars go."""
    return bars.withColumn("value", F.col("close") / F.lag("close", k).over(by_day()) - 1).where("value is not null")


def momentum(bars: DataFrame, lookback: int) -> DataFrame:
    return trailing_return(bars, lookback).select("instrument_id", "ts", direction(F.col("value")).alias("direction"), F.col("value").alias("strength"), F.lit(None).cast("double").alias("weight"))


def reversal(bars: DataFrame, formation: int) -> DataFrame:
    return trailing_return(bars, formation).select("instrument_id", "ts", direction(-F.col("value")).alias("direction"), F.col("value").alias("strength"), F.lit(None).cast("double").alias("weight"))


def rolling_volatility(bars: DataFrame, window: int) -> DataFrame:
    """Sample deviation of exactly ``window`` daily returns up to the day; null with fewer."""
    r = bars.withColumn("r", F.col("close") / F.lag("close").over(by_day()) - 1)
    w = by_day().rowsBetween(-(window - 1), 0)
    return r.select("instrument_id", "ts", F.when(F.count("r").over(w) == window, F.stddev_samp("r").over(w)).alias("sigma"))


def ewma_volatility(bars: DataFrame, com: float, window: int) -> DataFrame:
    """Deviation round the weighted mean, both with weights (c / (1 + c))**age over the last ``window`` returns; null with fewer."""
    r = bars.withColumn("r", F.col("close") / F.lag("close").over(by_day()) - 1)
    decay = com / (1 + com)
    raw = [decay ** (window - 1 - i) for i in range(window)]
    weights = F.array(*[F.lit(x / sum(raw)) for x in raw])
    got = r.withColumn("rs", F.collect_list("r").over(by_day().rowsBetween(-(window - 1), 0)))
    dot = lambda xs, f: F.aggregate(F.zip_with(xs, weights, lambda x, w: f(x) * w), F.lit(0.0), lambda a, x: a + x)
    got = got.withColumn("mean", dot(F.col("rs"), lambda x: x)).withColumn("var", dot(F.transform("rs", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), lambda x: x))
    return got.select("instrument_id", "ts", F.when(F.size("rs") == window, F.sqrt("var")).alias("sigma"))


def volatility_targeted(signals: DataFrame, sigma: DataFrame, target: float, max_scale: float, ppy: int) -> DataFrame:
    """Non-flat signals weighted towards a target volatility; those without an estimate go."""
    scaled = signals.drop("weight").join(sigma, ["instrument_id", "ts"]).withColumn("weight", vol_scale(F.col("sigma"), target, max_scale, ppy))
    return scaled.where("direction = 'flat' or weight is not null").drop("sigma")


def month_ends(bars: DataFrame) -> DataFrame:
    """(instrument_id, month, ts, close): each instrument's last bar of a month."""
    return bars.groupBy("instrument_id", F.trunc("ts", "MM").alias("month")).agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def cross_sectional_momentum(bars: DataFrame, formation: int = 12, skip: int = 1, quantile: float = 0.1, long_short: bool = True, min_price: float = 0.0) -> DataFrame:
    """(month, instrument_id, momentum, direction): ranks by the return from month -1-formation to -1-skip, both month ends, for a month.

    The best share ``quantile`` goes long and, if long_short, as many of the worst short; ties go to the lower id in both legs.
    """
    ends = month_ends(bars)
    at = lambda k, name: ends.select("instrument_id", F.add_months("month", k).alias("month"), F.col("close").alias(name))
    formed = at(1, "price").join(at(1 + skip, "recent"), ["instrument_id", "month"]).join(at(1 + formation, "old"), ["instrument_id", "month"])
    formed = formed.where(F.col("price") >= min_price).withColumn("momentum", F.col("recent") / F.col("old") - 1)
    all_ = Window.partitionBy("month")
    up, down = all_.orderBy(F.desc("momentum"), "instrument_id"), all_.orderBy("momentum", "instrument_id")
    ranked = formed.withColumn("n", F.floor(F.count("*").over(all_) * F.lit(float(quantile)))).withColumn("hi", F.row_number().over(up)).withColumn("lo", F.row_number().over(down))
    leg = F.when(F.col("hi") <= F.col("n"), "long")
    if long_short:
        leg = leg.when(F.col("lo") <= F.col("n"), "short")
    return ranked.select("month", "instrument_id", "momentum", leg.otherwise("flat").alias("direction"))


def monthly_to_daily(monthly: DataFrame, bars: DataFrame) -> DataFrame:
    """A month's legs on every bar of it."""
    days = bars.select("instrument_id", "ts", F.trunc("ts", "MM").alias("month"))
    return days.join(monthly, ["instrument_id", "month"]).select("instrument_id", "ts", "direction", F.col("momentum").alias("strength"), F.lit(None).cast("double").alias("weight"))


def paired(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, ts, y, x): log prices of stated pairs (pair, y, x: instruments) on their common days."""
    own = lambda side: bars.select(F.col("instrument_id").alias(f"__{side}"), "ts", F.ln("close").alias(side))
    named = pairs.select("pair", F.col("y").alias("__y"), F.col("x").alias("__x"))
    return own("y").join(F.broadcast(named), "__y").join(own("x"), ["__x", "ts"]).select("pair", "ts", "y", "x")


def spread_path(bars: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """(pair, ts, beta, z): rolling regression of log y on log x over ``window`` common days; z is the last residual over their deviation."""
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(-(window - 1), 0)
    fit = paired(bars, pairs).select("pair", "ts", "y", "x", F.count("*").over(w).alias("n"), F.regr_slope("y", "x").over(w).alias("beta"), F.regr_intercept("y", "x").over(w).alias("alpha"), F.regr_syy("y", "x").over(w).alias("syy"), F.regr_sxy("y", "x").over(w).alias("sxy"))
    fit = fit.where(F.col("n") == window)
    sd = F.sqrt(F.greatest((F.col("syy") - F.col("beta") * F.col("sxy")) / (window - 1), F.lit(0.0)))
    return fit.select("pair", "ts", "beta", F.try_divide(F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"), sd).alias("z"))


def pair_states(path: DataFrame, entry: float, exit_: float) -> DataFrame:
    """(pair, ts, beta, z, state): +1 long the spread, -1 short, 0 flat; enters at ``entry`` or beyond, leaves at ``exit_`` or without a z; an exit may turn on its day.

    A column ``may_enter`` of ``path`` gates new positions only. A state is that of the last day that may enter unless its exit came after that day, so two
    running looks back give it; a day at ``entry`` within a position of the same side changes nothing.
    """
    w = Window.partitionBy("pair").orderBy("ts")
    allowed = F.col("may_enter") if "may_enter" in path.columns else F.lit(True)
    signal = F.when(allowed & (F.col("z") >= entry), -1).when(allowed & (F.col("z") <= -entry), 1)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    left = lambda when: last(F.when(F.col("z").isNull() | when, F.col("ts")))
    seen = path.withColumn("__sign", last(signal)).withColumn("__entry", last(F.when(signal.isNotNull(), F.col("ts")))).withColumn("__out", F.when(F.col("__sign") == -1, left(F.col("z") <= exit_)).otherwise(left(F.col("z") >= -exit_)))
    gone = F.col("__sign").isNull() | F.coalesce(F.col("__out") > F.col("__entry"), F.lit(False))
    return seen.select("pair", "ts", "beta", "z", F.when(gone, 0).otherwise(F.col("__sign")).cast("int").alias("state"))


def pair_legs(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """Signals of a pair's legs on days with a state: weights 1 / (1 + |beta|) and |beta| / (1 + |beta|), the second leg against the first for a positive beta."""
    b = F.abs("beta")
    on = states.where("state != 0 and beta != 0").join(F.broadcast(pairs.select("pair", F.col("y").alias("__y"), F.col("x").alias("__x"))), "pair")
    way = lambda up: F.when(up, "long").otherwise("short")
    leg = lambda name, up, w: F.struct(F.col(name).alias("instrument_id"), way(up).alias("direction"), w.alias("weight"))
    legs = F.array(leg("__y", F.col("state") > 0, 1 / (1 + b)), leg("__x", F.col("state") * F.col("beta") <= 0, b / (1 + b)))
    return on.withColumn("leg", F.explode(legs)).select("leg.instrument_id", "ts", "leg.direction", F.col("z").alias("strength"), "leg.weight")


def engle_granger(y: np.ndarray, x: np.ndarray) -> dict[str, float | None]:
    """Residual test of cointegration: statistic (lag by AIC on a common sample), its critical values, beta and half-life."""
    n = len(y)
    a = np.c_[np.ones(n), x]
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ coef
    d = np.diff(e)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 1)

    def fit(k: int, first: int) -> tuple[float, float]:
        rows = np.c_[e[first:-1], *[d[first - i : len(d) - i] for i in range(1, k + 1)]]
        target = d[first:]
        b = np.linalg.lstsq(rows, target, rcond=None)[0]
        res = target - rows @ b
        s2 = res @ res / (len(target) - rows.shape[1])
        se = np.sqrt(s2 * np.linalg.inv(rows.T @ rows)[0, 0])
        aic = len(target) * np.log(res @ res / len(target)) + 2 * rows.shape[1]
        return b[0] / se, aic

    lag = min(range(most + 1), key=lambda k: fit(k, most)[1])
    slope = np.polyfit(e[:-1], d, 1)[0]
    critical = {f"critical_{k}": float(v) for k, v in critical_values(n).items()}
    return {"statistic": float(fit(lag, lag)[0]), **critical, "beta": float(coef[1]), "half_life": float(-np.log(2) / np.log(1 + slope)) if -1 < slope < 0 else None}


def cointegration(pairs: DataFrame) -> DataFrame:
    """(pair, statistic, p_value, critical_1, critical_5, critical_10, beta, half_life) for rows (pair, ts, y, x) of log prices; one task per pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pd.DataFrame([{"pair": pdf["pair"].iloc[0], **engle_granger(pdf["y"].to_numpy(), pdf["x"].to_numpy())}])

    out = pairs.groupBy("pair").applyInPandas(run, "pair string, statistic double, critical_1 double, critical_5 double, critical_10 double, beta double, half_life double")
    return out.select("pair", "statistic", mackinnon_p(F.col("statistic")).alias("p_value"), "critical_1", "critical_5", "critical_10", "beta", "half_life")
