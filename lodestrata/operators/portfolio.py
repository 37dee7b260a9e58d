"""Portfolios of strategies: monthly weights of sleeves from their returns before the month, and their netted targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sleeve_windows(r: DataFrame, window: int, least: int) -> DataFrame:
    """(month, run_id, ts, r): for every month each eligible sleeve's last ``window`` returns before it.

    Eligible: at least ``least`` days since its first return other than 0, and returns that vary in the window.
    Returns are numbered once per sleeve; a month takes those of the last ``window`` numbers before it, so no month meets the whole past.
    """
    at = Window.partitionBy("run_id").orderBy("ts")
    upto = Window.partitionBy("run_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    own = r.select("run_id", "ts", "r", F.trunc("ts", "MM").alias("month"), F.row_number().over(at).alias("n"))
    months = own.select("month").distinct()
    by_month = own.groupBy("run_id", "month").agg(F.count("*").alias("days"), F.min(F.when(F.col("r") != 0, F.col("n"))).alias("begun"))
    every = own.select("run_id").distinct().crossJoin(F.broadcast(months)).join(by_month, ["run_id", "month"], "left")
    known = every.select("run_id", "month", F.sum("days").over(upto).alias("last"), F.min("begun").over(upto).alias("begun"))
    ready = known.where((F.col("last") - F.col("begun") + 1 >= least)).withColumn("n", F.explode(F.sequence(F.greatest(F.col("last") - window + 1, F.lit(1)), F.col("last"))))
    recent = ready.select("run_id", "month", "n").join(own.select("run_id", "n", "ts", "r"), ["run_id", "n"])
    return recent.withColumn("var", F.var_samp("r").over(Window.partitionBy("month", "run_id"))).where("var > 0").select("month", "run_id", "ts", "r")


def inverse_volatility(windows: DataFrame) -> DataFrame:
    """(month, run_id, weight): shares of 1 / deviation among the eligible sleeves; they sum to 1."""
    v = windows.groupBy("month", "run_id").agg((1 / F.stddev_samp("r")).alias("v"))
    return v.select("month", "run_id", (F.col("v") / F.sum("v").over(Window.partitionBy("month"))).alias("weight"))


def equal_sleeves(windows: DataFrame) -> DataFrame:
    v = windows.select("month", "run_id").distinct()
    return v.select("month", "run_id", (F.lit(1.0) / F.count("*").over(Window.partitionBy("month"))).alias("weight"))


def risk_parity_weights(cov: np.ndarray, tolerance: float = 1e-12, rounds: int = 10_000) -> np.ndarray:
    """Weights with equal risk contributions, by cyclical coordinate descent; raises if they don't settle."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        before = x.copy()
        for i in range(n):
            b = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - before).max() <= tolerance * np.abs(x).max():
            return x / x.sum()
    raise ValueError("risk parity did not settle")


def risk_parity(windows: DataFrame) -> DataFrame:
    """(month, run_id, weight) on days that all eligible sleeves of a month share; one task per month."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="ts", columns="run_id", values="r").dropna()
        w = risk_parity_weights(np.cov(m.to_numpy(), rowvar=False).reshape(m.shape[1], m.shape[1]))
        return pd.DataFrame({"month": pdf["month"].iloc[0], "run_id": m.columns, "weight": w})

    return windows.groupBy("month").applyInPandas(run, "month date, run_id string, weight double")


def netted(targets: DataFrame, weights: DataFrame, run_id: str = "portfolio") -> DataFrame:
    """The sleeves' targets (run_id, ts, instrument_id, weight) times their month's weights, summed per instrument; zeros go."""
    t = targets.withColumn("month", F.trunc("ts", "MM")).join(weights.withColumnRenamed("weight", "share"), ["month", "run_id"])
    net = t.groupBy("ts", "instrument_id").agg(F.sum(F.col("weight") * F.col("share")).alias("weight")).where("weight != 0")
    return net.select(F.lit(run_id).alias("run_id"), "ts", "instrument_id", "weight")


def diversification(windows: DataFrame, weights: DataFrame) -> DataFrame:
    """(month, ratio): the weighted deviations over the portfolio's deviation, on the windows' days."""
    j = windows.join(weights, ["month", "run_id"])
    total = j.groupBy("month", "ts").agg(F.sum(F.col("weight") * F.col("r")).alias("p")).groupBy("month").agg(F.stddev_samp("p").alias("sd"))
    own = windows.groupBy("month", "run_id").agg(F.stddev_samp("r").alias("s")).join(weights, ["month", "run_id"]).groupBy("month").agg(F.sum(F.col("s") * F.col("weight")).alias("sum"))
    return own.join(total, "month").select("month", F.try_divide("sum", "sd").alias("ratio"))


def choose_by_year(r: DataFrame, least: int, order: dict[str, int]) -> DataFrame:
    """(year, choice, sharpe): on 1 January the run with the best Sharpe of all returns before it; ties go to the earlier in ``order``.

    The runs' prefixes are sums over their years, so each run is made once for all years.
    """
    y = r.groupBy("run_id", F.year("ts").alias("y")).agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    w = Window.partitionBy("run_id").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    c = y.select("run_id", (F.col("y") + 1).alias("year"), F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    place = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    ok = c.where((F.col("n") >= least) & (F.col("n") > 1)).withColumn("var", var).where("var > 0").withColumn("sharpe", F.col("s") / F.col("n") / F.sqrt("var"))
    return ok.groupBy("year").agg(F.min_by("run_id", F.struct(-F.col("sharpe"), place[F.col("run_id")])).alias("choice"), F.max("sharpe").alias("sharpe"))
