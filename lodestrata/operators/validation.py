"""Inference on runs: Sharpe statistics, overfitting probability, purged cross-validation, shuffles and random portfolios.

Returns come as (run_id, ts, r). Where a test compares configurations, all have the same days.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, normal_quantile, once
from .joins import covering

#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329


def sharpe_statistics(r: DataFrame) -> DataFrame:
    """(run_id, n, sharpe, skew, kurt) per period: population moments, kurtosis not in excess; null under three or without variance."""
    g = r.groupBy("run_id").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    ok = (F.col("n") >= 3) & (F.col("sd") > 1e-15)
    return g.select("run_id", "n", F.when(ok, F.col("m") / F.nullif("sd", F.lit(0.0))).alias("sharpe"), F.when(ok, F.col("skew")).alias("skew"), F.when(ok, F.col("kurt")).alias("kurt"))


def probabilistic_sharpe(stats: DataFrame, benchmark: float | F.Column = 0.0) -> DataFrame:
    """``stats`` with psr: the probability that the true Sharpe exceeds ``benchmark``."""
    b = benchmark if not isinstance(benchmark, float) else F.lit(benchmark)
    var = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = (F.col("sharpe") - b) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(var > 0, var))
    return stats.withColumn("psr", once(z, normal_cdf))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """The largest of ``trials`` Sharpes of that variance around 0, in expectation."""
    if trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return variance**0.5 * ((1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * np.e)))


def expected_max_sharpe_of(variance: F.Column, trials: F.Column) -> F.Column:
    """``expected_max_sharpe`` of columns."""
    n = F.when(trials > 1, trials)
    top = (1 - EULER) * once(1 - 1 / n, normal_quantile) + EULER * once(1 - 1 / (n * float(np.e)), normal_quantile)
    return F.coalesce(F.sqrt(variance) * top, F.lit(0.0))


def deflated_sharpe(stats: DataFrame, trials: int) -> DataFrame:
    """psr against the expected largest Sharpe of ``trials`` tries, whose variance without skill is 1 / (n - 1)."""
    factor = expected_max_sharpe(1.0, trials)
    return probabilistic_sharpe(stats, F.lit(factor) / F.sqrt(F.col("n") - 1)).withColumnRenamed("psr", "dsr")


def _sharpe_of_sums(total, squares, n):
    var = (squares - total * total / n) / (n - 1)
    return F.when(var > 0, (total / n) / F.sqrt(F.when(var > 0, var))).otherwise(F.lit(0.0))


def overfitting_splits(r: DataFrame, blocks: int = 16) -> DataFrame:
    """(split, best, omega, logit) for every choice of half of ``blocks`` equal blocks of days (the earliest left-over days go).

    Block sums and squares per run are joined with the splits' 0/1 incidence, so the days themselves are read once.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks must be even and at least 2")
    spark = r.sparkSession
    runs = Window.partitionBy("run_id")
    t = r.withColumn("back", F.row_number().over(runs.orderBy(F.desc("ts"))) - 1).withColumn("size", F.floor(F.count("*").over(runs) / blocks)).where("back < size * " + str(blocks))
    sums = t.groupBy("run_id", (F.floor(F.col("back") / F.col("size"))).alias("block")).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("c"))
    masks = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).select(F.col("id").alias("split"))
    chosen = F.expr("(shiftright(split, cast(block as int)) & 1) = 1")
    agg = masks.crossJoin(F.broadcast(sums)).groupBy("split", "run_id").agg(
        *[F.sum(F.when(chosen if inside else ~chosen, F.col(c)).otherwise(F.lit(0))).alias(f"{c}_{name}") for inside, name in ((True, "in"), (False, "out")) for c in ("s", "q", "c")]
    )
    both = agg.select("split", "run_id", _sharpe_of_sums(F.col("s_in"), F.col("q_in"), F.col("c_in")).alias("si"), _sharpe_of_sums(F.col("s_out"), F.col("q_out"), F.col("c_out")).alias("so"))
    one = Window.partitionBy("split")
    first = F.row_number().over(one.orderBy(F.desc("si"), "run_id"))
    ranked = both.withColumn("rank", first).withColumn("n", F.count("*").over(one)).withColumn("best_so", F.max(F.when(F.col("rank") == 1, F.col("so"))).over(one))
    g = ranked.groupBy("split").agg(F.max(F.when(F.col("rank") == 1, F.col("run_id"))).alias("best"), F.count_if(F.col("so") < F.col("best_so")).alias("below"), F.count_if(F.col("so") == F.col("best_so")).alias("tied"), F.max("n").alias("n"))
    omega = (F.col("below") + (F.col("tied") + 1) / 2) / (F.col("n") + 1)
    return g.select("split", "best", omega.alias("omega")).withColumn("logit", F.ln(F.col("omega") / (1 - F.col("omega"))))


def overfitting_probability(splits: DataFrame) -> DataFrame:
    return splits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"), F.percentile("logit", F.lit(0.5)).alias("logit_median"))


def purged_splits(days: DataFrame, groups: int, test_groups: int, purge: int, embargo_share: float) -> DataFrame:
    """(split, grp, path, lo, hi, out_lo, out_hi): for each choice of test groups the [lo, hi) days that they test and those that may not train.

    days: one row with n, their number. Groups are as equal as can be, the first ones longer; path j takes, for each group, the j-th split that tests it.
    """
    chosen = [(k, g) for k, c in enumerate(combinations(range(groups), test_groups)) for g in c]
    splits = days.sparkSession.createDataFrame(chosen, "split int, grp int").withColumn("path", F.row_number().over(Window.partitionBy("grp").orderBy("split")) - 1)
    size, longer = F.floor(F.col("n") / groups), F.col("n") % groups
    start = lambda g: g * size + F.least(g, longer)
    lo, hi = start(F.col("grp")), start(F.col("grp") + 1)
    enough = F.when(F.col("n") < groups, F.raise_error(F.lit("more groups than days")).cast("long")).otherwise(F.col("n"))
    s = F.broadcast(splits).crossJoin(days.select(enough.alias("n")))
    embargo = F.ceil(F.lit(embargo_share) * F.col("n"))
    return s.select("split", "grp", "path", lo.alias("lo"), hi.alias("hi"), F.greatest(lo - purge, F.lit(0)).alias("out_lo"), F.least(hi + embargo, F.col("n")).alias("out_hi"))


def purged_selection(r: DataFrame, groups: int = 10, test_groups: int = 2, purge: int = 1, embargo_share: float = 0.01) -> DataFrame:
    """(split, grp, path, choice, t, r): the run with the best Sharpe on each split's training days, and its returns on the test days.

    Days are summed once, as running sums of each run; a split's training sums are the totals less those of its excluded ranges, two look-ups each.
    """
    run = Window.partitionBy("run_id").orderBy("ts")
    sums = lambda w: [F.count("*").over(w).alias("c"), F.sum("r").over(w).alias("s"), F.sum(F.col("r") * F.col("r")).over(w).alias("q")]
    days = r.select("run_id", "ts", "r", F.row_number().over(run).alias("upto"), *sums(run.rowsBetween(Window.unboundedPreceding, 0)))
    n = days.agg(F.max("upto").alias("n")).where("n is not null")
    splits = purged_splits(n, groups, test_groups, purge, embargo_share)
    # Excluded ranges of a split that touch count once.
    by_split = Window.partitionBy("split").orderBy("out_lo", "out_hi")
    seen = F.max("out_hi").over(by_split.rowsBetween(Window.unboundedPreceding, -1))
    merged = splits.withColumn("new", F.coalesce((F.col("out_lo") > seen).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_split)).groupBy("split", "island").agg(F.min("out_lo").alias("a"), F.max("out_hi").alias("b"))
    ends = merged.select("split", F.explode(F.array(F.struct(F.col("a").alias("upto"), F.lit(1).alias("sign")), F.struct(F.col("b").alias("upto"), F.lit(-1).alias("sign")))).alias("e")).select("split", "e.upto", "e.sign")
    ends = ends.union(n.crossJoin(splits.select("split").distinct()).select("split", F.col("n").alias("upto"), F.lit(1).alias("sign")))
    sums_of = ends.join(days.select("run_id", "upto", "c", "s", "q"), "upto").groupBy("split", "run_id").agg(*[F.sum(F.col("sign") * F.col(k)).alias(k) for k in ("c", "s", "q")])
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("c")) / (F.col("c") - 1)
    best = sums_of.where("c >= 2").withColumn("var", var).where("var > 1e-30").select("split", "run_id", (F.col("s") / F.col("c") / F.sqrt("var")).alias("sharpe"))
    choice = best.groupBy("split").agg(F.min_by("run_id", F.struct(-F.col("sharpe"), "run_id")).alias("choice"))
    tests = splits.select("split", "grp", "path", "lo", "hi").join(choice, "split", "left")
    all_days = tests.select("split", "grp", "path", "choice", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("t"))
    own = days.select(F.col("run_id").alias("choice"), (F.col("upto") - 1).alias("t"), "r")
    return all_days.join(own, ["choice", "t"], "left").select("split", "grp", "path", "choice", F.col("t").cast("int").alias("t"), F.coalesce("r", F.lit(0.0)).alias("r"))


def path_sharpes(selection: DataFrame, ppy: int) -> DataFrame:
    sd = F.stddev_samp("r")
    return selection.groupBy("path").agg(F.count("*").alias("days"), F.when(sd > 1e-15, F.avg("r") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(ppy)))).alias("sharpe"))


def paths_gate(paths: DataFrame) -> DataFrame:
    """(n_paths, defined, median_sharpe, passed): median above 0; null if under half are defined."""
    g = paths.agg(F.count("*").alias("n_paths"), F.count("sharpe").alias("defined"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"))
    return g.withColumn("passed", F.when(F.col("defined") * 2 >= F.col("n_paths"), F.col("median_sharpe") > 0))


DRAWS = "run_id string, draw int, total double, squares double"


def _draws(name: str, total: np.ndarray, squares: np.ndarray) -> pd.DataFrame:
    """Draw -1 (the run itself) comes first."""
    return pd.DataFrame({"run_id": name, "draw": np.arange(-1, len(total) - 1), "total": total, "squares": squares})


def draw_sharpes(sums: DataFrame, runs: DataFrame, ppy: int) -> DataFrame:
    """(run_id, draw, sharpe) from partial sums of returns and of their squares; runs: (run_id, n), the number of returns. NaN without variance."""
    g = sums.groupBy("run_id", "draw").agg(F.sum("total").alias("s"), F.sum("squares").alias("q")).join(runs, "run_id")
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1)
    return g.select("run_id", "draw", F.when(var > 0, mean / F.sqrt(F.when(var > 0, var)) * F.sqrt(F.lit(float(ppy)))).otherwise(F.lit(float("nan"))).alias("sharpe"))


_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shuffled_places(n: int, rows: np.ndarray, draws: np.ndarray, seed: int, rounds: int = 8) -> np.ndarray:
    """(draws, rows): where each draw's shuffle of ``n`` days puts ``rows``; draw -1 leaves them. Each draw is a bijection of [0, n).

    A Feistel network keyed by seed and draw permutes the next larger power of four; places beyond ``n`` go through it again until they fall inside.
    So any rows' places follow from themselves, without the order of the other days.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = _U((1 << half) - 1), _U(half)
    with np.errstate(over="ignore"):
        key = _mixed(draws.astype(np.int64).astype(_U)[:, None] * _U(0x9E3779B97F4A7C15) + _U(seed))
        keys = [_mixed(key + _U(r + 1) * _U(0xD1342543DE82EF95)) for r in range(rounds)]
    out = np.repeat(rows.astype(_U)[None, :], len(draws), 0)
    d, t = np.nonzero(np.repeat(draws[:, None] >= 0, len(rows), 1))
    while len(d):
        left, right = out[d, t] >> shift, out[d, t] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k[d, 0]) & mask)
        v = left << shift | right
        out[d, t] = v
        again = v >= _U(n)
        d, t = d[again], t[again]
    return out.astype(np.int64)


def permutation_draws(held: DataFrame, market_: DataFrame, ppy: int, draws: int = 10_000, seed: int = 0, block: int = 512, chunk: int = 2500) -> DataFrame:
    """(run_id, draw, sharpe): gross Sharpes of each run with its weights fixed and the market's days shuffled, all instruments alike; draw -1 is the run itself.

    held: (run_id, ts, instrument_id, weight); market_: (ts, instrument_id, r). Days are dealt into blocks of ``block``; first each two blocks' weights and returns are
    multiplied to cells, a product for every two days; then a task takes one block's row of cells and ``chunk`` draws, and adds up the cells that the draws pick there. A draw's places
    of a block follow from seed, draw and days alone (``shuffled_places``), so each is worked out once.
    """
    day = market_.select("ts").distinct().withColumn("t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1)
    n = day.agg(F.count("*").alias("n"))
    days = F.broadcast(day.crossJoin(n))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block)))
    runs = held.select("run_id").distinct()
    w = held.where("weight != 0").join(days, "ts").select("run_id", "n", "t", "instrument_id", F.col("weight").alias("x"), F.lit(0).alias("side"), F.floor(F.col("t") / block).alias("i"), blocks.alias("j"))
    r = market_.join(days, "ts").select("n", "t", "instrument_id", F.col("r").alias("x"), F.lit(1).alias("side"), blocks.alias("i"), F.floor(F.col("t") / block).alias("j"))
    both = w.unionByName(F.broadcast(runs).crossJoin(r))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        n_, i, j = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        code, _ = pd.factorize(pdf["instrument_id"])
        t, x, side = pdf["t"].to_numpy(), pdf["x"].to_numpy(), pdf["side"].to_numpy()
        dense = []
        for k, at in ((0, i), (1, j)):
            own, m = side == k, np.zeros((min(n_, (at + 1) * block) - at * block, code.max() + 1))
            np.add.at(m, (t[own] - at * block, code[own]), x[own])
            dense.append(m)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "n": n_, "i": i, "j": j, "cells": [(dense[0] @ dense[1].T).tobytes()]})

    cells = both.groupBy("run_id", "i", "j").applyInPandas(multiply, "run_id string, n int, i int, j int, cells binary")
    cells = cells.withColumn("first", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1), F.lit(chunk))))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        n_, i, first = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["first"].iloc[0])
        rows = np.arange(i * block, min(n_, (i + 1) * block))
        # Blocks of returns without a bar have no cells: their products are 0.
        row = np.zeros((len(rows), n_))
        for j, raw in zip(pdf["j"], pdf["cells"], strict=True):
            row[:, j * block : min(n_, (j + 1) * block)] = np.frombuffer(raw).reshape(len(rows), -1)
        own = np.arange(first, min(first + chunk, draws))
        total, squares = np.zeros(len(own)), np.zeros(len(own))
        for a in range(0, len(own), 256):
            x = row[np.arange(len(rows))[None, :], shuffled_places(n_, rows, own[a : a + 256], seed)]
            total[a : a + 256], squares[a : a + 256] = x.sum(1), (x * x).sum(1)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "draw": own, "total": total, "squares": squares})

    sums = cells.groupBy("run_id", "i", "first").applyInPandas(pick, DRAWS)
    return draw_sharpes(sums, runs.crossJoin(n), ppy)


def decisions(signals: DataFrame, market_: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """(run_id, decision, instrument_id, weight): the cross-section of each decision to trade, weight 0 where none was chosen.

    signals: (run_id, ts, instrument_id, weight), flat ones with a null or zero weight; those count that trade at both ends of the next period (market_).
    trades: (run_id, ts) of the days that trade to new targets; none: every day.
    """
    s = signals.join(market_.select("ts", "instrument_id"), ["ts", "instrument_id"], "left_semi")
    if trades is not None:
        s = s.join(trades.select("run_id", "ts"), ["run_id", "ts"], "left_semi")
    return s.select("run_id", F.col("ts").alias("decision"), "instrument_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def growth_in_holding(decided: DataFrame, filled: DataFrame, calendar: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """(run_id, decision, ts, instrument_id, weight, growth): on each day of a holding, from the decision (exclusive) to the next one (inclusive), the price over
    that at the decision. filled: (instrument_id, ts, close) without gaps; calendar: (ts, next_ts).

    trades: (run_id, ts) of all decisions; those without a cross-section in ``decided`` end the holding before, too. None: the decisions of ``decided``.
    """
    made = decided.select("run_id", "decision") if trades is None else trades.select("run_id", F.col("ts").alias("decision"))
    w = Window.partitionBy("run_id").orderBy("decision")
    spans = made.distinct().withColumn("until", F.lead("decision").over(w))
    spans = spans.select("run_id", "decision", F.date_sub("until", 1).alias("until"))
    days = covering(calendar.select("ts", "next_ts"), spans, "ts", "decision", "until").select("run_id", "decision", F.col("next_ts").alias("ts"))
    start = filled.select("instrument_id", F.col("ts").alias("decision"), F.col("close").alias("p0"))
    held = decided.join(start, ["instrument_id", "decision"]).join(days, ["run_id", "decision"])
    return held.join(filled.select("instrument_id", "ts", "close"), ["instrument_id", "ts"]).select("run_id", "decision", "ts", "instrument_id", "weight", (F.col("close") / F.col("p0")).alias("growth"))


def random_portfolio_draws(growth: DataFrame, runs: DataFrame, ppy: int, draws: int = 10_000, seed: int = 0, chunk: int = 1000, slice_days: int = 64) -> DataFrame:
    """(run_id, draw, sharpe): each decision's weights on random instruments of its cross-section, held to the next decision; draw -1 is the run itself.

    growth: as growth_in_holding gives it; runs: (run_id, n), the number of periods. A task holds ``slice_days`` days of one decision's holding at a time, and
    the day before them, as a day's return needs no more; the slices' sums add up. The draws of a decision follow from seed and day alone, so that all its
    slices draw alike.
    """
    of = Window.partitionBy("run_id", "decision").orderBy("ts")
    # The last day of a slice stands before the next one's first, too. The window deals rows out by holding, so the groups need no further shuffle.
    cut = growth.withColumn("n", F.dense_rank().over(of) - 1).withColumn("slice", F.explode(F.sequence(F.floor(F.col("n") / slice_days), F.floor((F.col("n") + 1) / slice_days))))
    cells = F.sort_array(F.collect_list(F.struct("ts", "instrument_id", "growth", "weight"))).alias("cells")
    held = cut.groupBy("run_id", "decision", "slice").agg(cells, F.max(F.abs("weight")).alias("most")).where("most > 0")
    held = held.select("run_id", F.unix_date("decision").alias("decision"), "slice", F.col("cells.growth").alias("growth"), F.col("cells.weight").alias("weight"), F.size(F.array_distinct("cells.ts")).alias("days"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for x in b.itertuples(index=False):
                gain = np.asarray(x.growth).reshape(x.days, -1) - 1
                if x.slice and x.days == 1:  # only the day before: the holding ends with the slice before
                    continue
                w = np.asarray(x.weight)[: gain.shape[1]]
                total, squares = sums.setdefault(x.run_id, [np.zeros(draws + 1), np.zeros(draws + 1)])
                rnd = np.random.default_rng([seed, x.decision + 2**20])
                for first in (-1, *range(0, draws, chunk)):
                    count = 1 if first < 0 else min(chunk, draws - first)
                    order = w[:, None] if first < 0 else rnd.permuted(np.tile(w, (count, 1)), axis=1).T
                    value = 1 + gain @ order
                    if not x.slice:
                        value = np.vstack([np.ones((1, count)), value])
                    r = value[1:] / value[:-1] - 1
                    total[first + 1 : first + 1 + count] += r.sum(0)
                    squares[first + 1 : first + 1 + count] += (r * r).sum(0)
        for name, (total, squares) in sums.items():
            yield _draws(name, total, squares)

    return draw_sharpes(held.mapInPandas(run, DRAWS), runs, ppy)


def p_value(draws: DataFrame) -> DataFrame:
    """(run_id, sharpe, n, p): (1 + draws at least as good) / (1 + draws with a Sharpe); ties within 1e-12 count as good."""
    own = F.max(F.when(F.col("draw") < 0, F.col("sharpe"))).over(Window.partitionBy("run_id"))
    d = draws.withColumn("own", own).where("draw >= 0 and not isnan(sharpe)")
    return d.groupBy("run_id").agg(F.max("own").alias("sharpe"), F.count("*").alias("n"), ((1 + F.count_if(F.col("sharpe") >= F.col("own") - 1e-12)) / (1 + F.count("*"))).alias("p"))


def holdout_verdict(sharpe: F.Column, p: F.Column, min_sharpe: float, max_p: float) -> F.Column:
    return F.when(sharpe.isNull(), "inconclusive").when(sharpe <= min_sharpe, "rejected").when(p.isNull() | (p >= max_p), "inconclusive").otherwise("passed")


def concluded_status(a: F.Column, b: F.Column) -> F.Column:
    """Two gates that may be null: both true confirms, any false rejects."""
    return F.when(a & b, "confirmed").when(F.coalesce(~a, F.lit(False)) | F.coalesce(~b, F.lit(False)), "rejected").otherwise("inconclusive")


def trials_on_same_data(trials: DataFrame) -> DataFrame:
    """(hypothesis, other): trials of the same universe whose training periods overlap, registered no later."""
    o = trials.select(F.col("hypothesis").alias("other"), "universe", F.col("training_start").alias("os"), F.col("training_end").alias("oe"), F.col("registered_at").alias("oa"))
    return trials.join(o, "universe").where("other != hypothesis and os <= training_end and training_start <= oe and oa <= registered_at").select("hypothesis", "other")
