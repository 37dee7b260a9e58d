"""Studies, holdouts, index histories, sinks and streams, beyond what SQL checks."""

import json
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.scalars import normal_quantile
from lodestrata.operators import backtest as bt
from lodestrata.operators import index_history, prep, reports, signals, studies, validation
from lodestrata.plans import study_queries
from lodestrata.plans.bars import line_bars
from lodestrata.plans.queries import QUERIES
from lodestrata.sources import configs, files, html_tables
from lodestrata.streaming import daily

D = date.fromisoformat


def bars_of(spark, closes):
    """closes: {instrument: [close, ...]} on consecutive days; None: no bar."""
    rows = [(i, D("2020-01-01") + timedelta(k), c, c, c, c, 1000.0) for i, v in closes.items() for k, c in enumerate(v) if c is not None]
    return spark.createDataFrame(rows, "instrument_id string, ts date, open double, high double, low double, close double, volume double")


def folded(weights, r, rate, gone, hold):
    """The backtest of one run by a plain loop over days; weights and r: (days, instruments), r NaN where nothing trades."""
    held, equity, before, out = np.zeros(weights.shape[1]), 1.0, None, []
    for w, x, c, g in zip(weights, r, rate, gone, strict=True):
        w = np.where(np.isnan(x), 0.0, w)
        target, x = w, np.nan_to_num(x)
        if hold and before is not None and (before == target).all():
            w = held
        before = target
        traded = np.where(g, 0.0, np.abs(w - held))
        period = (w * x).sum() - (traded * c).sum()
        equity *= 1 + period
        held = w * (1 + x) / (1 + period)
        out.append((equity, (traded * c).sum(), traded.sum(), np.abs(w).sum()))
    return np.array(out)


@pytest.mark.parametrize("hold", [False, True])
def test_backtest_equals_a_loop_over_days(spark, hold):
    rnd = np.random.default_rng(2)
    days, names = 40, ["a", "b", "c", "d"]
    closes = np.exp(np.cumsum(rnd.normal(0, 0.05, (days, 4)), 0)) * 50
    closes[20:, 3] = np.nan  # delisted: its last bar is flagged
    closes[7, 1] = np.nan
    weights = np.repeat(rnd.normal(0, 0.4, (10, 4)), 4, axis=0)
    weights[:3] = 0
    bars = bars_of(spark, {n: [None if np.isnan(x) else float(x) for x in closes[:, k]] for k, n in enumerate(names)})
    bars = bars.withColumn("delisting", (F.col("instrument_id") == "d") & (F.col("ts") == F.lit(D("2020-01-20"))))
    rows = [(run, D("2020-01-01") + timedelta(t), n, float(weights[t, k] * f)) for run, f in (("x", 1.0), ("y", -0.5)) for t in range(days) for k, n in enumerate(names)]
    targets = spark.createDataFrame(rows, "run_id string, ts date, instrument_id string, weight double").where("weight != 0").repartition(5)
    rates = bars.select("instrument_id", "ts", F.when(F.dayofmonth("ts") % 3 != 0, F.lit(0.01)).alias("rate"))
    calendar = bt.periods(bars)
    got = bt.simulate(targets, bars, calendar, rates, hold).collect()
    r = closes[1:] / closes[:-1] - 1
    rate = np.zeros((days - 1, 4))
    for k in range(4):
        last = 0.0
        for t in range(days - 1):
            if not np.isnan(closes[t, k]) and (t + 1) % 31 % 3 != 0:
                last = 0.01
            rate[t, k] = last
    gone = np.zeros((days - 1, 4), bool)
    gone[19, 3] = True
    for run, f in (("x", 1.0), ("y", -0.5)):
        want = folded(weights[:-1] * f, r, rate, gone, hold)
        whole = sorted((g for g in got if g.run_id == run and g.instrument_id is None and g.prev_ts), key=lambda g: g.ts)
        assert np.allclose([(g.equity, g.cost, g.traded, g.position) for g in whole], want)
        parts = [g for g in got if g.run_id == run and g.instrument_id is not None]
        by_day = {g.ts: (g.cost, g.traded) for g in whole}
        for day, (cost, traded) in by_day.items():
            own = [g for g in parts if g.ts == day]
            assert np.isclose(sum(g.cost for g in own), cost) and np.isclose(sum(g.traded for g in own), traded)


def test_no_look_ahead(spark, sf_dir):
    """What is known on a day stays the same when later bars are cut off."""
    bars = line_bars(spark, sf_dir)
    cut = D("1997-06-30")
    for make in (lambda b: signals.momentum(b, 60), lambda b: signals.rolling_volatility(b, 30), lambda b: signals.cross_sectional_momentum(b, 6, 1, 0.25).withColumnRenamed("month", "ts"), lambda b: prep.forward_filled(b, prep.sessions(b))):
        full, part = make(bars), make(bars.where(F.col("ts") <= F.lit(cut)))
        early = full.where(F.col("ts") <= F.lit(cut))
        assert early.exceptAll(part.where(F.col("ts") <= F.lit(cut))).isEmpty() and not early.isEmpty()


def test_studies_read_no_later_bars(spark, sf_dir):
    bars, d = line_bars(spark, sf_dir), study_queries.definition("sel")
    run = lambda end: {r.ts: r.equity for r in studies.run_study(d, bars, None, D("1995-06-01"), end).collect()}
    short, long = run(D("1998-03-31")), run(D("1999-03-31"))
    assert len(short) > 500 and all(abs(long[t] - e) < 1e-12 for t, e in short.items())


def test_definitions_refuse_what_does_not_fit():
    text = study_queries.FORM.format(name="x", kind="short_term_reversal", more="  formation_days: 7")
    assert configs.definition_from_yaml(text).study == studies.Reversal(7)
    with pytest.raises(ValueError, match="overlap"):
        configs.definition_from_yaml(text.replace("start: 2001-07-01", "start: 2001-06-01"))
    with pytest.raises(ValueError, match="unknown strategy"):
        configs.definition_from_yaml(text.replace("short_term_reversal", "astrology"))
    with pytest.raises(ValueError):
        studies.CrossSection(formation_months=2, skip_months=2)
    with pytest.raises(ValueError):
        studies.Portfolio(components=(("a", studies.Momentum()), ("b", studies.Portfolio(components=(("c", studies.Momentum()), ("d", studies.Reversal()))))))
    d = study_queries.definition("port")
    assert d.requires == ("rev", "mom", "xs") and d.study.warm_up == 14 * 31 and study_queries.definition("sel").study.configurations == 4
    assert d.fetch_start(D("2001-01-01"), False) == D("2001-01-01") - timedelta(14 * 31 * 3 // 2 + 10)


def test_a_holdout_opens_once(spark, sf_dir, tmp_path):
    d, bars = study_queries.definition("mom"), line_bars(spark, sf_dir)
    path = str(tmp_path / "mom.opened.json")
    record = studies.open_holdout(d, bars, None, [], path, 365, draws=50)
    assert record["verdict"] in ("passed", "rejected", "inconclusive") and json.loads((tmp_path / "mom.opened.json").read_text())["verdict"] == record["verdict"]
    with pytest.raises(FileExistsError):
        studies.open_holdout(d, bars, None, [], path, 365, draws=50)
    with pytest.raises(ValueError, match="not opened yet"):
        studies.open_holdout(study_queries.definition("port"), bars, None, ["mom"], str(tmp_path / "p.json"), 365)


def test_random_portfolios_hold_to_the_next_decision(spark):
    """One holding of three days and one of two, against the products by hand; with one instrument every draw is the run itself."""
    bars = bars_of(spark, {"a": [10.0, 11.0, None, 12.0, 9.0, 9.9], "b": [10.0, 10.0, 10.0, 10.0, 10.0, 10.0]})
    calendar = bt.periods(bars)
    day = lambda k: D("2020-01-01") + timedelta(k)
    decided = spark.createDataFrame([("r", day(0), "a", 0.5), ("r", day(3), "a", -1.0)], "run_id string, decision date, instrument_id string, weight double")
    growth = validation.growth_in_holding(decided, prep.forward_filled(bars, prep.sessions(bars)), calendar)
    got = {(r.decision, r.ts): r.growth for r in growth.collect()}
    assert got == pytest.approx({(day(0), day(1)): 1.1, (day(0), day(2)): 1.1, (day(0), day(3)): 1.2, (day(3), day(4)): 0.75, (day(3), day(5)): 0.825})
    value = [1, 1.05, 1.05, 1.1]
    r = [b / a - 1 for a, b in zip(value, value[1:], strict=False)] + [1.25 - 1, (1 - (0.825 - 1)) / 1.25 - 1]
    draws = validation.random_portfolio_draws(growth, spark.createDataFrame([("r", 5)], "run_id string, n int"), 365, draws=7, chunk=3).collect()
    assert len(draws) == 8 and all(x.sharpe == pytest.approx(np.mean(r) / np.std(r, ddof=1) * 365**0.5) for x in draws)


def test_shuffled_places_are_even():
    """Places, pairs of places and the number of fixed days over many draws, as uniform shuffles have them."""
    for n in (1, 2, 5, 13):
        p = validation.shuffled_places(n, np.arange(n), np.arange(20_000), 1)
        assert (np.sort(p, 1) == np.arange(n)).all()
        for t in range(min(n, 3)):
            seen = np.bincount(p[:, t], minlength=n)
            assert ((seen - 20_000 / n) ** 2 / (20_000 / n)).sum() < n - 1 + 5 * (2 * n) ** 0.5 + 1e-9
        if n > 1:
            pairs = np.bincount(p[:, 0] * n + p[:, 1], minlength=n * n)[~np.eye(n, dtype=bool).ravel()]
            each = 20_000 / len(pairs)
            assert ((pairs - each) ** 2 / each).sum() < len(pairs) + 5 * (2 * len(pairs)) ** 0.5
            assert abs((p == np.arange(n)).sum(1).mean() - 1) < 0.04
    part = validation.shuffled_places(1000, np.arange(300, 400), np.array([-1, 7]), 5)
    whole = validation.shuffled_places(1000, np.arange(1000), np.array([-1, 7]), 5)
    assert (part == whole[:, 300:400]).all()


def test_permutations_by_blocks_equal_whole_matrices(spark):
    rnd = np.random.default_rng(4)
    w, r = rnd.normal(size=(23, 3)), rnd.normal(size=(23, 3))
    cells = lambda m, c: spark.createDataFrame([("r", D("2020-01-01") + timedelta(t), f"i{k}", float(m[t, k])) for t in range(23) for k in range(3)], f"run_id string, ts date, instrument_id string, {c} double")
    got = {x.draw: x.sharpe for x in validation.permutation_draws(cells(w, "weight"), cells(r, "r").drop("run_id"), 365, draws=20, seed=3, block=7, chunk=6).collect()}
    for d in range(-1, 20):
        order = validation.shuffled_places(23, np.arange(23), np.array([d]), 3)[0]
        assert sorted(order) == list(range(23)) and (d >= 0 or (order == np.arange(23)).all())
        x = (w * r[order]).sum(1)
        assert got[d] == pytest.approx(x.mean() / x.std(ddof=1) * 365**0.5)


def test_gates_and_capacity(spark):
    paths = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "path int, sharpe double")
    gate = lambda xs: validation.paths_gate(paths(xs)).first()
    assert gate([1.0, -1.0, 0.5]).passed is True and gate([None, None, 1.0]).passed is None and gate([-1.0, -2.0, 3.0, None]).median_sharpe == -1.0
    orders = spark.createDataFrame([("r", D("2020-01-01"), "a", 50.0), ("r", D("2020-01-02"), "a", -5.0), ("r", D("2020-01-02"), None, None)], "run_id string, ts date, instrument_id string, filled double")
    bars = bars_of(spark, {"a": [1.0, 1.0]})
    assert bt.capacity(orders, bars, 100.0, 0.025).first().capacity == pytest.approx(100 / (50 / (0.025 * 1000)))
    assert bt.capacity(orders, bars.withColumn("volume", F.lit(0.0)), 100.0).first().capacity == 0.0


def test_multiple_testing_equals_the_formula(spark):
    r = np.random.default_rng(6).normal(0.05, 1, 300)
    frame = spark.createDataFrame([("x", k, float(v)) for k, v in enumerate(r)], "run_id string, ts int, r double")
    got = reports.multiple_testing(validation.sharpe_statistics(frame), spark.createDataFrame([("x", 3), ("x", 4)], "run_id string, configurations int"), 365).first()
    s, n = r.mean() / r.std(ddof=1), len(r)
    z = (r - r.mean()) / r.std()
    top = validation.expected_max_sharpe(1 / (n - 1), 7)
    prob = lambda b: NormalDist().cdf((s - b) * (n - 1) ** 0.5 / (1 - (z**3).mean() * s + ((z**4).mean() - 1) / 4 * s * s) ** 0.5)
    assert got.configurations == 7 and got.psr == pytest.approx(prob(0.0)) and got.dsr == pytest.approx(prob(top)) and got.threshold_annualized == pytest.approx(top * 365**0.5)
    xs = [1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-7]
    q = [x.q for x in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_quantile(F.col("x")).alias("q")).collect()]
    assert np.allclose(q, [NormalDist().inv_cdf(x) for x in xs], atol=1e-12)


def test_pages_without_tables_and_odd_spans(spark):
    assert html_tables.grids("<table><tr><td rowspan=99999>a<td>b<tr><td>c</table>") == [[["a", "b"], ["a", "c"]]]
    assert html_tables.grids("<table><tr><td>x<sup>[1]</sup> y</table>") == [[["x y"]]]
    none = spark.createDataFrame([(1, "<p>no table"), (2, None)], "page_id long, html string")
    assert index_history.constituents(none).count() == 0 and index_history.changes(none).count() == 0


def test_configuration_files(spark, tmp_path):
    r = configs.renames_from_yaml(spark, "renames: [{old: FB, new: META, end: 2022-06-08}, {old: 'ON', new: ONN}]").collect()
    assert [(x.old, x.new, x.end) for x in r] == [("FB", "META", D("2022-06-08")), ("ON", "ONN", None)]
    with pytest.raises(ValueError, match="quotes"):
        configs.not_in_source_from_yaml(spark, "not_in_source: [ON, A]")
    spans = spark.createDataFrame([("a", D("2020-01-01"), None), ("a", D("2010-01-01"), D("2012-01-01"))], "instrument_id string, start date, end date")
    ids = spark.createDataFrame([("a", "A", "equity", "USD"), ("spy", "SPY", "equity", "USD")], "id string, symbol string, asset_class string, quote_asset string")
    text = configs.universe_to_yaml("idx", ids, spans, 252, "spy", "made by hand")
    back = files.universe_from_yaml(spark, text)
    assert text.startswith("# made by hand") and back["market_proxy"] == "spy" and back["memberships"].count() == 2 and back["instruments"].count() == 2
    got = spark.createDataFrame([(1,)], "x int").select(*[configs.settled(F.to_date(F.lit(a)), F.to_date(F.lit(b)), F.to_date(F.lit("2020-01-10"))).alias(n) for n, a, b in (("old", "2020-01-02", "2020-01-18"), ("fresh", "2020-01-02", "2020-01-17"), ("past", "2020-01-10", "2020-01-11"))]).first()
    assert (got.old, got.fresh, got.past) == (True, False, True)
    page = spark.createDataFrame([(1, '{"parse": {"text": "<p>x"}}')], "page_id long, body string")
    assert configs.rendered_pages(page).first().html == "<p>x"


def test_sinks(spark, sf_dir, tmp_path):
    path = str(tmp_path / "registry")
    rows = QUERIES["registry"](spark, sf_dir)
    files.write_registry(rows, path)
    files.write_registry(rows.where("status != 'proposed'"), path)
    assert spark.read.parquet(path).count() == 4
    files.write_tables({"a": rows, "b": rows.limit(1)}, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store" / "b.parquet")).count() == 1


def test_streams_give_the_batch_bars_and_flag_late_events(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartitionByRange(4, "ts").write.parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    q = daily.daily_bars(source.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").writeStream.format("memory").queryName("daily_bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    from lodestrata.plans.bars import event_bars

    assert spark.table("daily_bars").select("instrument_id", "ts", "close", "volume").exceptAll(event_bars(spark, sf_dir).select("instrument_id", "ts", "close", "volume")).isEmpty()
    assert spark.table("daily_bars").count() == event_bars(spark, sf_dir).count()
    late = spark.createDataFrame([("e", 1, "2020-01-01 00:00:00"), ("e", 2, "2020-01-03 00:00:00"), ("e", 3, "2020-01-02 00:00:00"), ("e", 4, "2020-01-04 00:00:00")], "event_type string, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    late.coalesce(1).write.parquet(str(tmp_path / "late"))
    s = spark.readStream.schema(late.schema).parquet(str(tmp_path / "late"))
    q = daily.ordered_only(s).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {r.event_id: r.late for r in spark.table("ordered").collect()} == {1: False, 2: False, 3: True, 4: False}


def test_result_tables_have_rows(spark, sf_dir):
    from lodestrata.operators import metrics as mt
    from lodestrata.plans.bars import literal
    from lodestrata.plans.queries import PPY, _simulated, _trades

    sim = files.stored(_simulated(spark, sf_dir), "sim")
    bars = line_bars(spark, sf_dir)
    labels = prep.sessions(bars).join(mt.regime_labels(bars, "s0", 30, 365), "ts", "left").select("ts", F.coalesce("label", F.lit("undefined")).alias("label"))
    tables = reports.result_tables(bt.snapshots(sim), sim, _trades(spark, sf_dir), labels, literal(spark, "shocks"), PPY)
    assert len(tables) == 12 and all(not df.isEmpty() for df in tables.values())
