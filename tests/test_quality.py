import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake.operators import quality
from meterlake.operators.quality import Rule

SCHEMA = "timestamp timestamp, _raw_timestamp string, site_id string, building_id string, asset_id string, sensor_id string, temperature double, humidity double, pressure double, vibration double, power_consumption double, operating_mode string, _ingested_at timestamp, _asset_known boolean, _register_site_id string, _lateness_seconds long"
T0 = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)
GOOD = dict(timestamp=T0, _raw_timestamp="2026-06-01T00:00:00Z", site_id="SITE-A", building_id="B-1", asset_id="A-1", sensor_id="S-1", temperature=20.5, humidity=40.0, pressure=310.0, vibration=1.1, power_consumption=11.0, operating_mode="RUNNING", _ingested_at=T0, _asset_known=True, _register_site_id="SITE-A", _lateness_seconds=0)


def judged(spark, *changes, as_of="2026-06-02T00:00:00Z"):
    rows = [tuple((GOOD | {"sensor_id": f"S-{i}"} | c).values()) for i, c in enumerate(changes)]
    frame = quality.with_duplicate_rank(spark.createDataFrame(rows, SCHEMA), ("asset_id", "sensor_id", "timestamp"), [F.col("_ingested_at").asc_nulls_last()])
    rules = quality.telemetry_rules(as_of=as_of)
    good, bad = quality.split(frame, rules)
    failed = {r.rule_id: r.failed for r in quality.rule_results(frame, rules).collect() if r.failed}
    return good.collect(), bad.collect(), failed


def test_clean_rows_pass(spark):
    good, bad, failed = judged(spark, {}, {}, {})
    assert (len(good), bad, failed) == (3, [], {})


def test_there_are_35_rules():
    assert (len(quality.telemetry_rules()), len(quality.event_rules()), len(quality.stream_rules())) == (22, 13, 20)


@pytest.mark.parametrize(
    ("change", "rule", "quarantined"),
    [
        ({"asset_id": None}, "tel.completeness.asset_id_not_null", True),
        ({"building_id": "  "}, "tel.completeness.building_id_not_null", True),
        ({"temperature": None}, "tel.completeness.temperature_present", False),
        ({"timestamp": None, "_raw_timestamp": "junk"}, "tel.validity.timestamp_parseable", True),
        ({"timestamp": dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)}, "tel.validity.timestamp_plausible", True),
        ({"timestamp": T0 + dt.timedelta(days=400)}, "tel.validity.timestamp_plausible", True),
        ({"temperature": 9999.0}, "tel.accuracy.temperature_in_range", True),
        ({"humidity": -1.0}, "tel.accuracy.humidity_in_range", True),
        ({"temperature": 120.0, "humidity": 0.0}, None, False),
        ({"operating_mode": "ODD"}, "tel.validity.operating_mode_enum", False),
        ({"_asset_known": False}, "tel.consistency.asset_registered", True),
        ({"_register_site_id": "SITE-B"}, "tel.consistency.site_matches_register", False),
        ({"_lateness_seconds": 86_400}, "tel.timeliness.late_arrival", False),
        ({"_lateness_seconds": 86_399}, None, False),
    ],
)
def test_one_defect_fails_its_rule(spark, change, rule, quarantined):
    good, bad, failed = judged(spark, {}, change)
    assert len(bad) == quarantined and len(good) == 2 - quarantined
    if rule is None:
        assert not failed
    else:
        assert failed[rule] == 1
        assert rule in (bad[0]._quarantine_reasons if quarantined else next(r for r in good if r._dq_warnings)._dq_warnings)


def test_first_copy_wins_and_null_keys_duplicate_nothing(spark):
    late = {"sensor_id": "S", "_ingested_at": T0 + dt.timedelta(hours=1)}
    good, bad, failed = judged(spark, late, {"sensor_id": "S", "temperature": 1.0}, {"sensor_id": None}, {"sensor_id": None})
    assert failed == {"tel.uniqueness.business_key": 1} and len(bad) == 1 and bad[0].temperature == 20.5


def test_all_reasons_are_kept(spark):
    _, bad, _ = judged(spark, {"building_id": None, "_asset_known": False, "temperature": 1e6})
    assert len(bad[0]._quarantine_reasons) == 3


def test_gate(spark):
    frame = spark.createDataFrame([(True,), (True,), (False,)], "_asset_known boolean")
    rules = [Rule("r", "consistency", quality.BLOCKING, lambda: ~F.col("_asset_known"), 0.1, ("_asset_known",))]
    results = quality.rule_results(frame, rules)
    with pytest.raises(quality.QualityBreach, match="r"):
        quality.enforce(results)
    assert quality.enforce(results, fail=False) == ["r"]
    with pytest.raises(ValueError, match="_asset_known"):
        quality.rule_results(frame.drop("_asset_known"), rules)
    assert quality.enforce(quality.rule_results(frame.where("false"), rules)) == []


def test_outliers_are_judged_by_their_own_group(spark):
    rows = [("COLD", "s", 7 + i * 0.05) for i in range(30)] + [("COLD", "s", 45.0)] + [("HOT", "s", 80 + i * 0.05) for i in range(30)] + [("FLAT", "s", 1.0)] * 5
    frame = spark.createDataFrame(rows, "asset_id string, sensor_id string, x double")
    assert [r.x for r in quality.robust_outliers(frame, "x").where("is_outlier").collect()] == [45.0]


def test_freshness_and_completeness(spark):
    rows = [("A", "s", T0 + dt.timedelta(minutes=5 * i)) for i in range(12)] + [("B", "s", T0 - dt.timedelta(hours=3))]
    frame = spark.createDataFrame(rows, "asset_id string, sensor_id string, timestamp timestamp")
    fresh = {r.asset_id: r for r in quality.freshness(frame, F.lit(T0 + dt.timedelta(hours=1)), 60).collect()}
    assert fresh["A"].lag_minutes == 5 and not fresh["A"].is_stale and fresh["B"].is_stale
    full = {r.asset_id: r for r in quality.completeness(frame, 300).collect()}
    assert full["A"].received == 12 and full["A"].expected == 288 and full["A"].missing == 276 and full["A"].completeness_pct == pytest.approx(100 * 12 / 288)
