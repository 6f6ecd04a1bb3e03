"""No row depends on the session's zone: days, windows, times read from lines, stores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brooklog import model
from brooklog.functions import predicates as q
from brooklog.functions import relative, utc
from brooklog.operators import histogram
from brooklog.operators.timeres import TimeConfig, resolve
from brooklog.sources import store
from checks import tables
from checks.queries import QUERIES
from tests.conftest import DATA

ZONES = ("America/New_York", "Asia/Tokyo")
NAMES = (
    "page_desc", "total", "distribution", "fit_window", "in_window_zone", "retain", "day_counts", "parse_ts", "carry_forward", "rollover_days",
    "two_digit_year", "component_times", "forced_date", "synthetic_ts", "time_quality", "in_zone", "delete_ids", "export_rows", "ingest_rows", "row_ids",
)


@pytest.fixture
def in_session_zone(spark):
    """Sets the session's zone for a test."""
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture(scope="module")
def in_utc(spark):
    return {name: sorted(map(str, QUERIES[name](spark, str(DATA)).collect())) for name in NAMES if name in QUERIES}


def test_names_are_there():
    assert sum(name in QUERIES for name in NAMES) >= 15


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("name", [n for n in NAMES if n in QUERIES])
def test_query(spark, in_utc, in_session_zone, monkeypatch, zone, name):
    monkeypatch.setattr(tables, "ZONE", zone)
    in_session_zone(zone)
    found = QUERIES[name](spark, str(DATA))
    assert spark.conf.get("spark.sql.session.timeZone") == zone
    assert sorted(map(str, found.collect())) == in_utc[name]


def moments():
    at = [dt.datetime(2024, 1, 5, 2), dt.datetime(2024, 3, 10, 7, 30), dt.datetime(2024, 11, 3, 5, 59, 59, 999999), dt.datetime(1969, 12, 31, 23, 59, 59, 1), dt.datetime(1901, 2, 28), dt.datetime(2400, 2, 29, 12)]
    return [(i, model.micros(t), t) for i, t in enumerate(at)]


@pytest.mark.parametrize("zone", ("UTC", *ZONES))
def test_calendar_views(spark, in_session_zone, zone):
    in_session_zone(zone)
    df = spark.createDataFrame([(i, us) for i, us, _ in moments()], "i int, us long").withColumn("ts", F.timestamp_micros("us"))
    wall = utc.wall("ts")
    got = df.select(
        "i", utc.date("ts").alias("date"), utc.year("ts").alias("y"), utc.month("ts").alias("mo"), utc.day("ts").alias("d"), utc.text("ts", 6).alias("text"),
        F.unix_micros(utc.midnight(utc.date("ts"))).alias("midnight"), wall.cast("string").alias("wall"), F.unix_micros(utc.from_wall(wall)).alias("back"),
        utc.wall("ts", "Asia/Tokyo").cast("string").alias("tokyo"),
    ).orderBy("i").collect()
    for r, (_, us, t) in zip(got, moments(), strict=True):
        assert (r.date, r.y, r.mo, r.d) == (t.date(), t.year, t.month, t.day)
        assert r.text == t.strftime("%Y-%m-%dT%H:%M:%S.%fZ") and r.back == us
        assert r.midnight == model.micros(dt.datetime.combine(t.date(), dt.time()))
        assert dt.datetime.fromisoformat(r.wall) == t
    assert got[0].tokyo == "2024-01-05 11:00:00"


@pytest.mark.parametrize("zone", ZONES)
def test_a_row_near_midnight(spark, in_session_zone, tmp_path, zone):
    """The day that is written, the day a window prunes by, and the day that retention and deletion take are one."""
    in_session_zone(zone)
    at = dt.datetime(2024, 1, 5, 2, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([(model.micros(at), "a", 1), (model.micros(at - dt.timedelta(hours=3)), "b", 2)], "us long, _src string, _seq long")
    rows = model.with_row_id(model.with_log_date(rows.withColumn("timestamp", F.timestamp_micros("us"))))
    path = str(tmp_path / "store")
    store.append(rows, path)
    held = store.read_store(spark, path)
    window = (at - dt.timedelta(minutes=1), at + dt.timedelta(minutes=1))
    assert held.filter(q.in_window(*window)).count() == held.filter(q.in_window(*window, prune=False)).count() == 1
    assert store.scan(spark, path, *window).select("_src").collect() == [("a",)]
    assert held.filter(relative.in_last(1, "hours", at + dt.timedelta(minutes=30))).count() == 1
    assert {r.log_date for r in held.collect()} == {dt.date(2024, 1, 4), dt.date(2024, 1, 5)}
    edge = histogram.fit_window(held).select(F.unix_micros("start"), F.unix_micros("end")).first()
    assert tuple(edge) == (model.micros(dt.datetime(2024, 1, 3)), model.micros(dt.datetime(2024, 1, 6, 23, 59, 59)))
    gone = held.filter("_src = 'a'").first()._id
    assert store.delete_from_store(spark, path, [gone]) == 1 and store.read_store(spark, path).count() == 1
    assert store.retain_store(spark, path, dt.timedelta(days=1), at + dt.timedelta(hours=1)) == 1


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("dated", [True, False])
def test_times_of_lines(spark, in_session_zone, zone, dated):
    in_session_zone(zone)
    fields = [{"timestamp": "2024-01-05 00:00:00"}, {"timestamp": "2024-03-10 02:30:00"}, {"timestamp": "2024-06-01 00:00:00+09:00"}, {"year": "24", "month": "11", "day": "3", "time": "01:30:00"}, {}]
    df = spark.createDataFrame([("s", i // 2, i, f, True, "") for i, f in enumerate(fields)], "_src string, block long, line_no long, attrs map<string,string>, matched boolean, _raw string")
    cfg = TimeConfig(anchor=dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc), dated=dated, rollover=False)
    got = [r[0] for r in resolve(df, cfg).orderBy("line_no").select(utc.text("timestamp")).collect()]
    assert got == ["2024-01-05T00:00:00Z", "2024-03-10T02:30:00Z", "2024-05-31T15:00:00Z", "2024-11-03T01:30:00Z", "2024-11-03T01:30:00Z"]
