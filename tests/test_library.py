"""What has no SQL form, against brute force or its own invariants."""

from itertools import combinations
from math import ceil
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestrata.functions.scalars import epoch_us, normal_cdf
from lodestrata.operators import portfolio, signals, validation
from lodestrata.plans.queries import QUERIES
from lodestrata.sources import files, html_tables


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ts", "period_return", "n_pos", "equity"] and df.count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_engines_agree(spark, sf_dir):
    assert QUERIES["engine_parity"](spark, sf_dir).first()["equal"]


def test_fills_are_limited(spark, sf_dir):
    got = QUERIES["event_driven"](spark, sf_dir).where("instrument_id is not null").collect()
    assert got and all(abs(r.filled) <= abs(r.quantity) + 1e-9 for r in got) and any(r.filled != r.quantity for r in got)


@pytest.mark.parametrize("name", ["permutation_test", "random_portfolios"])
def test_p_values(spark, sf_dir, name):
    r = QUERIES[name](spark, sf_dir).first()
    assert 1 / (1 + r.n) <= r.p <= 1


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -3.3, -1.0, 0.0, 0.5, 2.2, 7.5, 9.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [NormalDist().cdf(x) for x in xs], atol=1e-14)


def test_risk_parity():
    a = np.random.default_rng(1).normal(size=(5, 5))
    cov = a @ a.T
    w = portfolio.risk_parity_weights(cov)
    share = w * (cov @ w)
    assert abs(w.sum() - 1) < 1e-12 and np.allclose(share, share.mean())


def test_cointegration():
    rnd = np.random.default_rng(3)
    x = np.cumsum(rnd.normal(size=600))
    tied = signals.engle_granger(2 * x + rnd.normal(size=600), x)
    apart = signals.engle_granger(np.cumsum(rnd.normal(size=600)), x)
    assert tied["statistic"] < tied["critical_5"] < apart["statistic"] and abs(tied["beta"] - 2) < 0.1 and 0 < tied["half_life"] < 3


def test_purged_selection(spark):
    rnd = np.random.default_rng(5)
    n, groups, tests, purge, share = 61, 6, 2, 1, 0.05
    r = {k: rnd.normal(0.01 * k, 1, n) for k in range(3)}
    rows = [(f"r{k}", t, float(x)) for k, v in r.items() for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "run_id string, ts int, r double")
    got = {(x.split, x.t): (x.choice, x.r) for x in validation.purged_selection(df, groups, tests, purge, share).collect()}
    size, longer = divmod(n, groups)
    at = np.cumsum([0] + [size + (g < longer) for g in range(groups)])
    want = {}
    for s, chosen in enumerate(combinations(range(groups), tests)):
        out = np.zeros(n, bool)
        for g in chosen:
            out[max(0, at[g] - purge) : at[g + 1] + ceil(share * n)] = True
        best = max(r, key=lambda k: (r[k][~out].mean() / r[k][~out].std(ddof=1), -k))
        want |= {(s, t): (f"r{best}", r[best][t]) for g in chosen for t in range(at[g], at[g + 1])}
    assert got == want


def test_html_spans():
    assert html_tables.grids("<table><tr><th rowspan=2>a<td>b<tr><td>c</table>") == [[["a", "b"], ["a", "c"]]]
    # Marks are skipped up to their end, or where that is missing up to the next cell; elements without an end hide nothing, and a line break is a space.
    assert html_tables.grids("<table><tr><td>a<sup>1<sup>2</sup></sup>x<td>b<sup>3<td>c<br>d<tr><td>e<script>f</script></sup>g</table><p>h") == [[["ax", "b", "c d"], ["eg", "", ""]]]
    assert html_tables.grids("<table><tr><td>o<table><tr><td>i<sup>1</table>p</table>") == [[["o"]], [["i"]]]


def test_upsert_keeps_the_newer(spark, tmp_path):
    from datetime import date

    bar = lambda day, close: ("x", date(2020, 1, day), close, close, close, close, 1.0, None, "t", None, False)
    path = str(tmp_path / "bars")
    files.upsert_bars(spark.createDataFrame([bar(1, 1.0), bar(2, 2.0)], files.BARS), path)
    files.upsert_bars(spark.createDataFrame([bar(2, 3.0), bar(3, 4.0)], files.BARS), path)
    assert [(r.ts.day, r.close) for r in files.read_bars(spark, path, "x", date(2020, 1, 2)).collect()] == [(2, 3.0), (3, 4.0)]
    assert files.read_bars(spark, path + "-none").count() == 0


def test_upsert_leaves_other_months_alone(spark, tmp_path):
    from datetime import date, timedelta

    def bars(first, n, close):
        days = [date(2020, 1, 1) + timedelta(first + i) for i in range(n)]
        return spark.createDataFrame([(k, d, close, close, close, close, 1.0, None, "t", None, False) for k in "xy" for d in days], files.BARS)

    path = tmp_path / "bars"
    files.upsert_bars(bars(0, 200, 1.0), str(path))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len({p.parent.name for p in before}) == 7
    files.upsert_bars(bars(55, 10, 2.0), str(path))  # the end of February and the start of March
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    kept = {p for p in before if p.parent.name not in ("month=2020-02", "month=2020-03")}
    assert kept and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in before.keys() - kept) and {p.parent.name for p in after.keys() - kept} == {"month=2020-02", "month=2020-03"}
    got = files.read_bars(spark, str(path)).groupBy("close").count().collect()
    assert {r["close"]: r["count"] for r in got} == {1.0: 380, 2.0: 20}
    spring = files.read_bars(spark, str(path), "x", date(2020, 3, 2), date(2020, 4, 3))
    assert spring.count() == 33 and {f.split("month=")[1][:7] for f in spring.inputFiles()} >= {"2020-03", "2020-04"}
    plan = spring._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    old = str(tmp_path / "old")
    bars(0, 40, 1.0).write.parquet(old)
    files.upsert_bars(bars(39, 2, 3.0), old)
    assert files.read_bars(spark, old).count() == 82 and (tmp_path / "old" / "month=2020-01").exists()


def test_draws_and_paths_are_the_references(spark, sf_dir):
    assert 9_900 < QUERIES["permutation_test"](spark, sf_dir).first().n <= 10_000
    assert QUERIES["purged_paths"](spark, sf_dir).count() == 9


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2021-03-28 02:30:00.000001'), (TIMESTAMP_NTZ'1969-12-31 23:59:59.5'), (NULL) AS t(ts)")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.us for r in df.select(epoch_us(F.col("ts")).alias("us")).collect()] == [1616898600000001, -500000, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
