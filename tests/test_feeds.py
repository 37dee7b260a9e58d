"""Stored responses as a data source: pruning, parsing, refusals, and a feed that doesn't go back."""

from datetime import date

import pytest
from lodestrata.sources import feeds
from lodestrata.streaming.feed import replayed

BARS = "arrived string, instrument_id string, span string, ts date, open double, high double, low double, close double, volume double"


def bar(arrived, instrument, day, close):
    return (arrived, instrument, day[:7], date.fromisoformat(day), close, close, close, close, 5.0)


def written(spark, path, rows):
    feeds.write_responses(spark.createDataFrame(rows, BARS), str(path))
    return str(path)


def test_a_range_opens_its_files_alone(spark, tmp_path):
    days = ["2020-01-31", "2020-02-01", "2020-02-29", "2020-03-01"]
    path = written(spark, tmp_path / "r", [bar(d[:7], i, d, 1.5) for d in days for i in ("a/b", "c")])
    r = feeds.Reader({"path": path, "partitionbytes": "1", "first": "2020-02-01", "last": "2020-02-29", "instruments": '["a/b", "x"]'})
    assert [[(f.span, f.instrument_id) for f in p.files] for p in r.partitions()] == [[("2020-02", "a/b")]]
    got = feeds.read_responses(spark, path, date(2020, 2, 1), date(2020, 2, 29), ["a/b"])
    assert [(x.ts.isoformat(), x.close) for x in got.orderBy("ts").collect()] == [("2020-02-01", 1.5), ("2020-02-29", 1.5)]
    df = feeds.read_responses(spark, path)
    # One frame under several filters, also in one query.
    assert df.where("ts > '2020-02-01'").count() == 4 and df.count() == 8
    assert df.where("instrument_id = 'c'").join(df.where("ts < '2020-02-01'").select("ts"), "ts").count() == 2
    assert feeds.read_responses(spark, path, date(2021, 1, 1)).count() == 0 == feeds.read_responses(spark, path, instruments=[]).count()


def test_unreadable_files_of_other_spans_are_never_opened(spark, tmp_path):
    path = written(spark, tmp_path / "r", [bar("2020-01", "a", "2020-01-05", 1.0)])
    spark.createDataFrame([("2020-02", "a", "2020-02", "{{")], "arrived string, instrument_id string, span string, value string").write.mode("append").partitionBy("arrived", "instrument_id", "span").text(path)
    assert feeds.read_responses(spark, path, last=date(2020, 1, 31)).count() == 1
    with pytest.raises(Exception, match="JSON|Expecting"):
        feeds.read_responses(spark, path).count()


def test_bodies():
    assert feeds.body_rows('[[86400000, "1", "2", "0.5", "1.5", "7", 0, "x"]]') == [(date(1970, 1, 2), 1.0, 2.0, 0.5, 1.5, 7.0)]
    assert feeds.body_rows('[{"date": "2020-01-02T00:00:00.000Z", "open": 1, "high": 2, "low": null, "close": 1.5}]') == [(date(2020, 1, 2), 1.0, 2.0, None, 1.5, None)]
    assert feeds.body_rows('{"code": -1121, "msg": "Invalid symbol."}') == [] == feeds.body_rows("[]")
    with pytest.raises(LookupError, match="Invalid symbol"):
        feeds.body_rows('{"code": -1121, "msg": "Invalid symbol."}', "fail")


def test_spans_and_parts():
    f = [feeds.Stored(str(i), 4, "a", s, s) for i, s in enumerate(("2019", "2020-02", "2020-12"))]
    assert [x.days() for x in f] == [(date(2019, 1, 1), date(2019, 12, 31)), (date(2020, 2, 1), date(2020, 2, 29)), (date(2020, 12, 1), date(2020, 12, 31))]
    assert [[x.path for x in p.files] for p in feeds.in_parts(f, 8)] == [["0", "1"], ["2"]]
    assert feeds.in_parts([], 8) == []


def test_a_missing_folder_is_empty(spark, tmp_path):
    assert feeds.read_responses(spark, str(tmp_path / "none")).count() == 0


def test_state_and_offsets_go_on_after_a_restart(spark, tmp_path):
    rows = [bar("1", "a", "2020-01-05", 1.0), bar("1", "a", "2020-01-03", 2.0), bar("2", "a", "2020-01-04", 3.0), bar("2", "b", "2020-01-01", 4.0), bar("3", "a", "2020-01-05", 5.0), bar("3", "a", "2020-01-06", 6.0)]
    path = written(spark, tmp_path / "r", rows)
    got = replayed(spark, path, str(tmp_path / "f"), ["1", "1", "2", None])
    want = {(2.0, None, False), (1.0, "2020-01-03", False), (3.0, "2020-01-05", True), (4.0, None, False), (5.0, "2020-01-05", False), (6.0, "2020-01-05", False)}
    assert {(r.close, r.newest and r.newest.isoformat(), r.late) for r in got.collect()} == want and got.count() == 6
    feed = feeds.Feed({"path": path, "until": "2"})
    assert feed.latestOffset() == {"arrived": "2"}
    assert [f.arrived for p in feed.partitions({"arrived": "1"}, {"arrived": "2"}) for f in p.files] == ["2", "2"]
    with pytest.raises(ValueError, match="go back"):
        feed.partitions({"arrived": "3"}, {"arrived": "2"})
