"""From signals to equity: sizing, costs, and two engines.

Targets decided at a day's close are held to the next session. Without costs and with daily rebalancing the equity is a running product
(``frictionless``), all windows. Costs are charged on the turnover against the drifted holdings, which depend on earlier costs only through one
number a day, the growth of the whole portfolio since the last trade. So ``book`` prepares every instrument's target and drifted weight by joins and sums
over all instruments and days at once, and ``equity`` folds that number over each run's days in order, one day's cross-section at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sign_of
from .prep import by_day

DUST = 1e-12


def periods(bars: DataFrame, start=None, end=None) -> DataFrame:
    """(ts, next_ts): consecutive sessions, any instrument's days being sessions."""
    days = bars.select("ts").distinct()
    if start is not None:
        days = days.where(F.col("ts") >= F.lit(start))
    if end is not None:
        days = days.where(F.col("ts") <= F.lit(end))
    # A calendar has a few thousand days at most: one ordered partition is enough.
    return days.withColumn("next_ts", F.lead("ts").over(Window.partitionBy(F.lit(0)).orderBy("ts"))).where("next_ts is not null")


def market(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ts, next_ts, instrument_id, r): the return of every instrument with a close at both ends of a period."""
    ahead = bars.select("instrument_id", "ts", "close", F.lead("close").over(by_day()).alias("c1"), F.lead("ts").over(by_day()).alias("next_ts"))
    return ahead.join(calendar, ["ts", "next_ts"]).select("ts", "next_ts", "instrument_id", ((F.col("c1") - F.col("close")) / F.col("close")).alias("r"))


def tradable(signals: DataFrame, market_: DataFrame) -> DataFrame:
    return signals.where("direction != 'flat'").join(market_.select("instrument_id", "ts"), ["instrument_id", "ts"], "left_semi")


def _keys(signals: DataFrame) -> list[str]:
    return [c for c in ("run_id", "ts") if c in signals.columns]


def equal_weight(signals: DataFrame) -> DataFrame:
    """Non-flat signals with weight = sign / number of them on the day."""
    n = F.count("*").over(Window.partitionBy(*_keys(signals)))
    return signals.where("direction != 'flat'").withColumn("weight", sign_of(F.col("direction")) / n)


def scaled_weight(signals: DataFrame) -> DataFrame:
    """Sign times the signal's own weight over the number of non-flat signals; a missing weight raises."""
    n = F.count("*").over(Window.partitionBy(*_keys(signals)))
    own = F.when(F.col("weight").isNull(), F.raise_error(F.lit("a signal without a weight")).cast("double")).otherwise(F.col("weight"))
    return signals.where("direction != 'flat'").withColumn("weight", sign_of(F.col("direction")) * own / n)


def carried_weight(signals: DataFrame) -> DataFrame:
    return signals.where("direction != 'flat'").withColumn("weight", sign_of(F.col("direction")) * F.col("weight"))


def pair_weight(signals: DataFrame) -> DataFrame:
    """Carried weights on days when exactly two legs can trade, else nothing."""
    n = F.count("*").over(Window.partitionBy(*_keys(signals)))
    return carried_weight(signals.where("direction != 'flat'").withColumn("__n", n).where("__n = 2").drop("__n"))


def naive_cost(bars: DataFrame, bps: float) -> DataFrame:
    return bars.select("instrument_id", "ts", F.lit(bps / 1e4).alias("rate"))


def realistic_cost(bars: DataFrame, fee_bps: float, k: float, window: int) -> DataFrame:
    """(fee + k * sigma) per weight traded; sigma of the last ``window`` returns or as many as there are, two at least."""
    r = bars.withColumn("r", F.col("close") / F.lag("close").over(by_day()) - 1)
    w = by_day().rowsBetween(-(window - 1), 0)
    sigma = F.when(F.count("r").over(w) >= 2, F.stddev_samp("r").over(w))
    return r.select("instrument_id", "ts", (F.lit(fee_bps / 1e4) + F.lit(float(k)) * sigma).alias("rate"))


def frictionless(targets: DataFrame, market_: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ts, period_return, n_pos, equity) at each period's end, rebalanced daily without costs; equity starts at 1."""
    held = targets.select("instrument_id", "ts", "weight").join(market_, ["instrument_id", "ts"])
    gross = held.groupBy("next_ts").agg(F.sum(F.col("weight") * F.col("r")).alias("g"), F.count("*").alias("n"))
    days = calendar.select(F.col("next_ts")).join(gross, "next_ts", "left").select(F.col("next_ts").alias("ts"), F.coalesce("g", F.lit(0.0)).alias("period_return"), F.coalesce("n", F.lit(0)).alias("n_pos"))
    first = calendar.agg(F.min("ts").alias("ts")).where("ts is not null").select("ts", F.lit(0.0).alias("period_return"), F.lit(0).cast("long").alias("n_pos"))
    w = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return days.unionByName(first).withColumn("equity", F.product(1 + F.col("period_return")).over(w))


def book(targets: DataFrame, bars: DataFrame, calendar: DataFrame, rates: DataFrame | None = None, hold_unchanged: bool = False) -> DataFrame:
    """(run_id, ts, instrument_id, weight, before, after, drifted, rate, trades): what each instrument brings to each day of each run (run_id) of ``targets``.

    weight: the last traded target; before and after: its price growth since that trade at the day's start and end; drifted: on days that trade, the
    weight held until then (in units of the portfolio at the trade before). rate: the cost of trading, 0 without ``rates`` (instrument_id, ts, rate),
    the last known one where it is null. An instrument whose delisting bar has come is paid out without a trade and has no row.
    """
    held = targets.select("run_id", "instrument_id", "ts", "weight").join(market(bars, calendar), ["instrument_id", "ts"])
    one = F.lit(1.0)
    if hold_unchanged:
        spell = Window.partitionBy("run_id", "spell", "instrument_id").orderBy("ts")
        held = held.join(trade_days(held, calendar), ["run_id", "ts"]).withColumn("after", F.product(1 + F.col("r")).over(spell)).withColumn("before", F.coalesce(F.lag("after").over(spell), one))
    else:
        held = held.withColumn("before", one).withColumn("after", 1 + F.col("r")).withColumn("trades", F.lit(True)).withColumn("next_trades", F.lit(True))
    zero = F.lit(0.0)
    now = held.select("run_id", "ts", "instrument_id", "weight", "before", "after", zero.alias("drifted"), "trades")
    left = held.where("next_trades").select("run_id", F.col("next_ts").alias("ts"), "instrument_id", zero.alias("weight"), zero.alias("before"), zero.alias("after"), (F.col("weight") * F.col("after")).alias("drifted"), F.lit(True).alias("trades"))
    both = now.unionByName(left).groupBy("run_id", "ts", "instrument_id").agg(*[F.sum(c).alias(c) for c in ("weight", "before", "after", "drifted")], F.max("trades").alias("trades"))
    flag = F.coalesce(F.col("delisting"), F.lit(False)) if "delisting" in bars.columns else F.lit(False)
    if rates is None:
        if "delisting" in bars.columns:
            both = both.join(bars.where(flag).select("instrument_id", "ts"), ["instrument_id", "ts"], "left_anti")
        return both.withColumn("rate", zero)
    known = bars.select("instrument_id", "ts", flag.alias("gone")).join(rates, ["instrument_id", "ts"], "left").join(F.broadcast(calendar.select("ts")), "ts", "left_semi")
    known = known.select("instrument_id", "ts", "gone", F.coalesce(F.last("rate", ignorenulls=True).over(by_day()), zero).alias("rate"))
    return both.join(known, ["instrument_id", "ts"], "left").where("not coalesce(gone, false)").drop("gone").withColumn("rate", F.coalesce("rate", zero))


def trade_days(held: DataFrame, calendar: DataFrame) -> DataFrame:
    """(run_id, ts, spell, trades, next_trades) of every run's days when positions are held while the targets stay equal: a day trades if they differ from the day before's."""
    now = held.select("run_id", "ts", "instrument_id", "weight", F.lit(0.0).alias("w0"))
    before = held.select("run_id", F.col("next_ts").alias("ts"), "instrument_id", F.lit(0.0).alias("weight"), F.col("weight").alias("w0"))
    same = now.union(before).groupBy("run_id", "ts", "instrument_id").agg((F.sum("weight") != F.sum("w0")).alias("moved")).groupBy("run_id", "ts").agg(F.max("moved").alias("moved"))
    days = held.select("run_id").distinct().crossJoin(F.broadcast(calendar.select("ts"))).join(same, ["run_id", "ts"], "left")
    w = Window.partitionBy("run_id").orderBy("ts")
    trades = days.withColumn("trades", (F.row_number().over(w) == 1) | F.coalesce("moved", F.lit(False)))
    return trades.select("run_id", "ts", "trades", F.last(F.when(F.col("trades"), F.col("ts")), ignorenulls=True).over(w).alias("spell"), F.lead("trades", 1, False).over(w).alias("next_trades"))


EQUITY = "run_id string, ts date, prev_ts date, equity double, period_return double, cost double, traded double, invested double, grown double, growth double"


def equity(book_: DataFrame, runs: DataFrame, calendar: DataFrame) -> DataFrame:
    """EQUITY rows of each run (run_id): one per day (ts: its end, prev_ts: its start) and one for the start with an equity of 1.

    growth: of the portfolio since its last trade, at the day's start; grown: between the two trades before (on days that trade).
    """
    items = F.collect_list(F.when(F.col("trades"), F.struct("weight", "drifted", "rate")))
    day = book_.groupBy("run_id", "ts").agg(F.sum(F.col("weight") * (F.col("after") - 1)).alias("gain"), F.sum(F.abs(F.col("weight") * F.col("before"))).alias("gross"), F.max("trades").alias("trades"), items.alias("items"))
    rows = runs.select("run_id").crossJoin(F.broadcast(calendar)).join(day, ["run_id", "ts"], "left")
    rows = rows.select("run_id", "ts", "next_ts", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("trades", F.lit(True)).alias("trades"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, value, base, fee, grown, growth = None, 1.0, 1.0, 0.0, 1.0, 1.0
        for b in batches:
            ids, ts, nxt = b.column("run_id").to_pylist(), b.column("ts").to_pylist(), b.column("next_ts").to_pylist()
            gain, gross, trades = (b.column(c).to_numpy(zero_copy_only=False) for c in ("gain", "gross", "trades"))
            at = np.r_[0, np.cumsum(b.column("items").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
            flat = b.column("items").flatten()
            w, a, c = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("weight", "drifted", "rate"))
            out = []
            for k, name in enumerate(ids):
                if name != who:
                    who, value, base, fee, growth = name, 1.0, 1.0, 0.0, 1.0
                    out.append((name, ts[k], None, 1.0, None, None, None, None, None, None))
                cost = moved = 0.0
                if trades[k]:
                    d = slice(at[k], at[k + 1])
                    change = np.abs(w[d] - a[d] / growth)
                    cost, moved = float(change @ c[d]), float(change.sum())
                    base, fee, grown, growth = value, cost, growth, 1.0
                end = 1 - fee + gain[k]
                value, period = base * end, end / growth - 1
                out.append((name, nxt[k], ts[k], value, period, cost, moved, gross[k] / abs(growth), grown, growth))
                growth = end
            fields = [f.split() for f in EQUITY.split(", ")]
            types = {"string": pa.string(), "date": pa.date32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(col, types[t]) for col, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return rows.repartition("run_id").sortWithinPartitions("run_id", "ts").mapInArrow(run, EQUITY)


def run_equity(targets: DataFrame, bars: DataFrame, calendar: DataFrame, rates: DataFrame | None = None, hold_unchanged: bool = False) -> DataFrame:
    """``snapshots`` of the runs without their holdings."""
    return _days(equity(book(targets, bars, calendar, rates, hold_unchanged), targets.select("run_id").distinct(), calendar))


def simulate(targets: DataFrame, bars: DataFrame, calendar: DataFrame, rates: DataFrame | None = None, hold_unchanged: bool = False) -> DataFrame:
    """Runs (run_id) of ``targets``: one row per day and instrument held or traded, and one per day without an instrument for the whole:
    (run_id, ts, prev_ts, instrument_id, position, cost, traded, equity, period_return).

    position: weight over the day ending at ts (whole: their absolute sum); cost and traded as fractions of the equity before;
    hold_unchanged: positions drift while targets stay equal. rates: (instrument_id, ts, rate), none: no costs. A position in an instrument
    whose delisting bar has come is paid out without a trade.
    """
    own = book(targets, bars, calendar, rates, hold_unchanged)
    days = equity(own, targets.select("run_id").distinct(), calendar)
    whole = days.select("run_id", "ts", "prev_ts", F.lit(None).cast("string").alias("instrument_id"), F.col("invested").alias("position"), "cost", "traded", "equity", "period_return")
    day = days.where("prev_ts is not null").select("run_id", F.col("ts").alias("__end"), F.col("prev_ts").alias("ts"), "grown", "growth", "equity", "period_return")
    traded = F.when(F.col("trades"), F.abs(F.col("weight") - F.col("drifted") / F.col("grown"))).otherwise(F.lit(0.0))
    held = own.join(day, ["run_id", "ts"]).withColumn("traded", traded).withColumn("position", F.col("weight") * F.col("before") / F.col("growth")).where("position != 0 or traded > 0")
    return whole.union(held.select("run_id", F.col("__end").alias("ts"), F.col("ts").alias("prev_ts"), "instrument_id", "position", (F.col("traded") * F.col("rate")).alias("cost"), "traded", "equity", "period_return"))


def _days(whole: DataFrame) -> DataFrame:
    return whole.select("run_id", "ts", "equity", "period_return", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("traded", F.lit(0.0)).alias("traded"), F.coalesce("invested", F.lit(0.0)).alias("invested"), (F.col("equity") * (1 - F.coalesce("invested", F.lit(0.0)))).alias("cash"))


def snapshots(simulated: DataFrame) -> DataFrame:
    """(run_id, ts, equity, period_return, cost, traded, invested, cash) per day; invested 0: no position."""
    return _days(simulated.where("instrument_id is null").withColumnRenamed("position", "invested"))


def holdings(simulated: DataFrame) -> DataFrame:
    return simulated.where("instrument_id is not null").drop("equity", "period_return")


EVENTS = "run_id string, ts date, instrument_id string, quantity double, filled double, price double, cost double, cash double, equity double"


class _Book:
    """One run's cash and quantities, moved on by a day at a time."""

    def __init__(self, run: str, when: str, participation: float | None, capital: float):
        self.run, self.when, self.participation, self.cash, self.start = run, when, participation, capital, capital
        self.quantity: dict[str, float] = {}
        self.last: dict[str, float] = {}
        self.pending: dict[str, float] = {}

    def fill(self, ts, bar: dict, q: float, price: float) -> tuple:
        asked, name = q, bar["instrument_id"]
        if self.participation is not None:
            q = float(np.copysign(min(abs(q), self.participation * bar["volume"]), q))
        fee = abs(q) * price * (bar["rate"] or 0.0)
        self.cash -= q * price + fee
        self.quantity[name] = self.quantity.get(name, 0.0) + q
        if abs(self.quantity[name]) * price < DUST * self.start:
            self.quantity[name] = 0.0
        return self.run, ts, name, asked, q, price, fee, self.cash, None

    def day(self, ts, bars: list[dict], final: bool) -> Iterator[tuple]:
        """Fills due orders, values the book, and submits the day's orders (not on the final day)."""
        rows = {r["instrument_id"]: r for r in bars if r["close"] is not None}
        for phase in ("open", "close"):
            if self.when == f"next_{phase}":
                for i, q in sorted(self.pending.items()):
                    if i in rows and not rows[i]["delisting"]:
                        yield self.fill(ts, rows[i], q, rows[i][phase])
                    else:
                        yield self.run, ts, i, q, 0.0, None, 0.0, self.cash, None
                self.pending = {}
        self.last.update({i: r["close"] for i, r in rows.items()})
        for i, r in rows.items():
            if r["delisting"] and self.quantity.get(i):
                self.cash += self.quantity.pop(i) * r["close"]
        equity = self.cash + sum(q * self.last[i] for i, q in self.quantity.items())
        yield self.run, ts, None, None, None, None, None, self.cash, equity
        if final:
            return
        wanted = {i: r["weight"] for i, r in rows.items() if r["weight"] is not None}
        orders = {i: wanted.get(i, 0.0) * equity / self.last[i] - self.quantity.get(i, 0.0) for i in sorted(wanted.keys() | self.quantity.keys())}
        orders = {i: q for i, q in orders.items() if abs(q) * self.last[i] > DUST * equity}
        if self.when == "close":
            yield from (self.fill(ts, rows[i], q, rows[i]["close"]) for i, q in orders.items() if i in rows)
        else:
            self.pending = orders


def event_driven(targets: DataFrame, bars: DataFrame, calendar: DataFrame, rates: DataFrame | None = None, when: str = "close", participation: float | None = None, capital: float = 100_000.0) -> DataFrame:
    """Orders and the book of each run of ``targets``, one day at a time: EVENTS rows (instrument null: the book after the day's close).

    when: "close" (filled at the deciding close), "next_open" or "next_close" (filled on the next session's bar or cancelled);
    participation: the share of a bar's volume that an order may take, the rest is cancelled.
    """
    days = calendar.select("ts").union(calendar.select("next_ts")).distinct()
    b = bars if "delisting" in bars.columns else bars.withColumn("delisting", F.lit(False))
    b = b.select("instrument_id", "ts", "open", "close", "volume", F.coalesce("delisting", F.lit(False)).alias("delisting")).join(days, "ts", "left_semi")
    b = b.join(rates, ["instrument_id", "ts"], "left") if rates is not None else b.withColumn("rate", F.lit(0.0))
    # One row per run and day with that day's bars: a task holds the book and one day, never a run's history.
    bar = F.struct("instrument_id", "open", "close", "volume", "delisting", "rate", "weight")
    rows = targets.select("run_id").distinct().crossJoin(b).join(targets.select("run_id", "instrument_id", "ts", "weight"), ["run_id", "instrument_id", "ts"], "left")
    rows = rows.groupBy("run_id", "ts").agg(F.sort_array(F.collect_list(bar)).alias("bars")).crossJoin(F.broadcast(days.agg(F.max("ts").alias("last_ts"))))
    rows = rows.select("run_id", "ts", (F.col("ts") == F.col("last_ts")).alias("final"), "bars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        fields = [f.split() for f in EVENTS.split(", ")]
        types = {"string": pa.string(), "date": pa.date32(), "double": pa.float64()}
        for part in batches:
            for k in range(0, part.num_rows, 64):
                out = []
                for r in part.slice(k, 64).to_pylist():
                    if now is None or now.run != r["run_id"]:
                        now = _Book(r["run_id"], when, participation, capital)
                    out += now.day(r["ts"], r["bars"], r["final"])
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return rows.repartition("run_id").sortWithinPartitions("run_id", "ts").mapInArrow(run, EVENTS)


def capacity(orders: DataFrame, bars: DataFrame, capital: float, share: float = 0.025) -> DataFrame:
    """(run_id, capacity): the capital at which the largest order, by its share of the bar's volume, still fits ``share`` of it."""
    f = orders.where("instrument_id is not null and filled != 0").join(bars.select("instrument_id", "ts", "volume"), ["instrument_id", "ts"])
    use = F.when(F.col("volume") > 0, F.abs("filled") / (share * F.col("volume"))).otherwise(F.lit(float("inf")))
    return f.groupBy("run_id").agg((F.lit(float(capital)) / F.max(use)).alias("capacity"))
