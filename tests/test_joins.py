"""As-of and interval joins against loops, and plans without nested loops."""

import random
from datetime import date, timedelta

import pytest

from lodestrata.operators import prep, universe
from lodestrata.operators.joins import asof, covering
from lodestrata.plans.bars import line_bars, literal


def day(k):
    return None if k is None else date(2020, 1, 1) + timedelta(k)


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_a_loop(spark, forward, strict):
    rnd = random.Random(4)
    left = [(rnd.choice("abc"), i, day(rnd.choice([None, *range(40)]))) for i in range(120)]
    right = [(rnd.choice("ab"), day(rnd.choice([None, *range(0, 40, 3)])), rnd.choice([None, 1, 2, 3])) for _ in range(40)]
    a = spark.createDataFrame(left, "g string, i int, t date")
    b = spark.createDataFrame(right, "g string, at date, v int")
    for by in (("g",), ()):
        got = {r.i: (r.at, r.v) for r in asof(a, b if by else b.drop("g"), "t", "at", ["at", "v"], by, forward, strict).collect()}
        assert len(got) == len(left)
        for g, i, t in left:
            ok = [(x, v) for h, x, v in right if (not by or h == g) and t is not None and x is not None and ((x > t if strict else x >= t) if forward else (x < t if strict else x <= t))]
            near = (min if forward else max)((x for x, _ in ok), default=None)
            want = max((v for x, v in ok if x == near), key=lambda v: (v is not None, v or 0), default=None)
            assert got[i] == (near, want)
    assert asof(a.limit(0), b, "t", "at", ["v"], ("g",)).count() == 0 and {r.v for r in asof(a, b.limit(0), "t", "at", ["v"], ("g",)).collect()} == {None}


def test_covering_equals_a_loop(spark):
    rnd = random.Random(6)
    points = sorted({rnd.randrange(-200, 900) for _ in range(150)})
    spans = [(i, day(s := rnd.randrange(-400, 1000)), day(rnd.choice([None, s, s - 3, s + rnd.randrange(500)]))) for i in range(60)] + [(99, None, day(3))]
    p, s = spark.createDataFrame([(day(k),) for k in points], "ts date"), spark.createDataFrame(spans, "i int, a date, b date")
    want = sorted((day(k), i) for k in points for i, a, b in spans if a is not None and a <= day(k) and (b is None or day(k) <= b))
    for days in (1, 7, 64, 5000):
        assert sorted((r.ts, r.i) for r in covering(p, s, "ts", "a", "b", days).collect()) == want
    assert covering(p.limit(0), s, "ts", "a", "b").count() == 0


def test_no_nested_loops(spark, sf_dir):
    bars = line_bars(spark, sf_dir)
    days, members = prep.sessions(bars), literal(spark, "memberships")
    delistings = literal(spark, "delistings")
    for df in (
        universe.members_asof(days, members), universe.price_coverage(members, bars, days), prep.action_factors(bars, literal(spark, "actions")), prep.adjust(bars, literal(spark, "actions")),
        prep.next_session(delistings.select("date").withColumnRenamed("date", "day"), days), prep.missing_sessions(bars, days), prep.forward_filled(bars, days),
    ):
        assert "NestedLoop" not in text(df) and "CartesianProduct" not in text(df)


def test_next_session_and_members(spark):
    calendar = spark.createDataFrame([(day(k),) for k in (0, 1, 5, 9)], "ts date")
    days = spark.createDataFrame([(day(k), n) for n, k in enumerate((-3, 0, 2, 2, 9, 10))], "day date, n int")
    assert {r.n: r.session for r in prep.next_session(days, calendar).collect()} == {0: day(0), 1: day(0), 2: day(5), 3: day(5), 4: day(9), 5: day(10)}
    m = spark.createDataFrame([("x", day(1), day(5)), ("x", day(4), None), ("y", day(9), day(8))], "instrument_id string, start date, end date")
    assert sorted((r.ts, r.instrument_id) for r in universe.members_asof(calendar, m).collect()) == [(day(1), "x"), (day(5), "x"), (day(5), "x"), (day(9), "x")]
