import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake.operators import conform, marts, model

T0 = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)
TELEMETRY = "site_id string, building_id string, asset_id string, sensor_id string, timestamp timestamp, temperature double, humidity double, pressure double, vibration double, power_consumption double, operating_mode string"
EVENTS = "event_id string, timestamp timestamp, asset_id string, event_type string, severity string, message string"
ASSETS = "asset_id string, asset_name string, asset_type string, manufacturer string, model string, installation_date date, rated_power_kw double, site_id string, building_id string, parent_asset_id string"


def telemetry(spark, *rows):
    """Rows of (minutes, sensor, power, mode)."""
    return spark.createDataFrame([("S", "B", "A", s, T0 + dt.timedelta(minutes=m), 21.0, 45.0, 300.0, 1.0, p, mode) for m, s, p, mode in rows], TELEMETRY)


def energy(rows):
    return rows.agg(F.sum("energy_kwh")).first()[0]


def test_energy_is_power_by_time(spark):
    assert energy(model.readings(telemetry(spark, *((5 * i, "s", 10.0, "RUNNING") for i in range(13))))) == pytest.approx(65 / 6)


def test_gaps_hold_two_intervals_at_most(spark):
    assert energy(model.readings(telemetry(spark, (0, "s", 100.0, "RUNNING"), (360, "s", 100.0, "RUNNING")))) == pytest.approx(25.0)


def test_sensors_of_an_asset_are_not_added(spark):
    rows = model.readings(telemetry(spark, *((5 * i, s, 10.0, "RUNNING") for i in range(12) for s in "xy")))
    assert rows.count() == 12 and energy(rows) == pytest.approx(10.0)


def test_utilization_and_availability(spark):
    half = marts.daily_utilization(model.readings(telemetry(spark, *((5 * i, "s", 1.0, "RUNNING" if i < 12 else "IDLE") for i in range(24))))).first()
    assert half.utilization_pct == pytest.approx(50) and half.data_coverage_pct < 15
    down = marts.daily_utilization(model.readings(telemetry(spark, *((5 * i, "s", 1.0, "RUNNING" if i < 6 else "FAULT") for i in range(12))))).first()
    assert down.availability_pct == pytest.approx(50)


def test_fault_statistics(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(f"{h}", at(h), "A", "Fault", "High", "m") for h in (0, 8, 20)] + [("a", at(1), "A", "Alarm", "Low", "m"), ("w", at(2), "W", "Warning", "Low", "m"), ("f", at(2), "F", "Fault", "Low", "m")]
    got = {r.asset_id: r for r in marts.fault_statistics(spark.createDataFrame(rows, EVENTS)).collect()}
    assert (got["A"].mtbf_hours, got["A"].health_score, got["A"].risk_band) == (10.0, 84.0, "Low")
    assert got["W"].mtbf_hours is None and got["W"].health_score == 99.75
    assert got["F"].faults == 1 and got["F"].mtbf_hours is None


def test_dates_have_fiscal_years(spark):
    bounds = spark.createDataFrame([(dt.date(2026, 3, 30), dt.date(2026, 4, 2))], "first_date date, last_date date")
    got = [(r.date_key, r.fiscal_year, r.fiscal_quarter, r.is_weekend) for r in model.dim_date(bounds).orderBy("full_date").collect()]
    assert got == [(20260330, 2026, 4, False), (20260331, 2026, 4, False), (20260401, 2027, 1, False), (20260402, 2027, 1, False)]


def asset(i, building="B1", parent=None, name="n"):
    return (i, name, "PUMP", "Acme", "M1", dt.date(2020, 1, 1), 5.0, "S", building, parent)


def test_versions_close_and_open_and_an_equal_snapshot_adds_nothing(spark):
    at = lambda d: F.lit(dt.datetime(2026, 1, d, tzinfo=dt.timezone.utc))
    v1 = model.asset_versions(spark.createDataFrame([asset("A"), asset("B"), asset("C")], ASSETS), at(1))
    second = spark.createDataFrame([asset("A", "B2"), asset("B"), asset("D")], ASSETS)
    v2 = model.merge_versions(v1, second, at(2)).cache()
    assert v2.count() == 5 and v2.where("is_current").count() == 4
    assert v2.where("is_current").groupBy("asset_id").count().where("count > 1").count() == 0
    old = v2.where("asset_id = 'A' and not is_current").first()
    assert old.building_id == "B1" and old.valid_to is not None
    assert model.merge_versions(v2, second, at(3)).count() == 5


def test_records_are_typed_and_cleaned(spark):
    rows = [("2026-06-01T00:05:00Z", " a-1 ", "1.5", " boost"), ("2026-06-01 00:05:00", "", "x", ""), ("2026-06-01T00:05:00.250", None, None, None), ("junk", "a", "-1e3", "Off"), ("", "a", " ", "off")]
    raw = spark.createDataFrame([(t, "s", "b", a, "x", v, v, v, v, v, m) for t, a, v, m in rows], "timestamp string, site_id string, building_id string, asset_id string, sensor_id string, temperature string, humidity string, pressure string, vibration string, power_consumption string, operating_mode string")
    got = conform.typed_telemetry(raw).collect()
    assert [r.timestamp is not None for r in got] == [True, True, True, False, False]
    assert got[0].timestamp == got[1].timestamp
    assert [r.asset_id for r in got] == ["A-1", None, None, "A", "A"]
    assert [r.temperature for r in got] == [1.5, None, None, -1000.0, None]
    assert [r.operating_mode for r in got] == ["BOOST", None, None, "OFF", "OFF"]


def test_lateness_is_in_whole_days(spark):
    rows = spark.createDataFrame([(T0 + dt.timedelta(hours=23), dt.date(2026, 6, 2)), (T0, dt.date(2026, 6, 1)), (None, dt.date(2026, 6, 1))], "timestamp timestamp, ingest_date date")
    assert [(r._lateness_seconds, r._is_late) for r in conform.with_lateness(rows).collect()] == [(86_400, True), (0, False), (None, False)]


def test_baseline_leaves_out_the_day_itself(spark):
    days = [("S", dt.date(2026, 6, 1) + dt.timedelta(days=i), 1, 10.0 + i % 2 if i < 8 else 50.0, 1.0, 1.0, 1.0, 1.0, 0, 0, 0, 0, "B", 21.0, 0) for i in range(9)]
    frame = spark.createDataFrame(days, "site_id string, event_date date, reporting_assets int, energy_kwh double, peak_power_kw double, utilization_pct double, availability_pct double, data_coverage_pct double, events int, faults int, alarms int, warnings int, building_id string, avg_temperature double, high_severity_events int")
    sites = spark.createDataFrame([("S", "n", "c", "x")], "site_id string, site_name string, city string, country string")
    assert [r.event_date.day for r in marts.site_daily(frame, sites).where("is_energy_anomaly").collect()] == [9]
