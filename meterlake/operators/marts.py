"""Marts and roll-ups over readings, hourly energy and events.

Nothing is rounded before it is shown, so roll-ups of roll-ups are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DOWN_MODES, PRODUCTIVE_MODES
from ..functions.expressions import elapsed, graded, ratio


def hourly_energy(hourly: DataFrame) -> DataFrame:
    """Hourly energy beside the 24th row before and the average of the 24 hours before."""
    order = Window.partitionBy("asset_id").orderBy(F.unix_seconds("event_hour"))
    day = F.lag("energy_kwh", 24).over(order)
    rows = hourly.withColumns({"prev_day_kwh": day, "rolling_24h_avg_kwh": F.avg("energy_kwh").over(order.rangeBetween(-86_400, -1))})
    change = F.when(F.col("prev_day_kwh") > 0, F.round((F.col("energy_kwh") - F.col("prev_day_kwh")) / F.col("prev_day_kwh") * 100, 2))
    return rows.withColumn("dod_change_pct", change)


def _hours(modes: tuple[str, ...]) -> Column:
    return F.sum(F.when(F.col("operating_mode").isin(*modes), F.col("duration_hours")).otherwise(0.0))


def daily_utilization(rows: DataFrame) -> DataFrame:
    """Per asset and day: hours observed, productive and down, their shares, energy and modes seen."""
    day = rows.groupBy("site_id", "building_id", "asset_id", "event_date").agg(
        F.sum("duration_hours").alias("observed_hours"),
        _hours(PRODUCTIVE_MODES).alias("productive_hours"),
        _hours(DOWN_MODES).alias("downtime_hours"),
        F.sum("energy_kwh").alias("energy_kwh"),
        F.avg("power_kw").alias("avg_power_kw"),
        F.max("power_kw").alias("peak_power_kw"),
        F.count_distinct("operating_mode").alias("modes_seen"),
        F.count("*").alias("readings"),
    )
    observed = F.col("observed_hours")
    return day.withColumns(
        {
            "utilization_pct": ratio(F.col("productive_hours"), observed) * 100,
            "availability_pct": (1 - ratio(F.col("downtime_hours"), observed)) * 100,
            "data_coverage_pct": F.least(observed / 24, F.lit(1.0)) * 100,
        }
    )


def daily_environment(rows: DataFrame) -> DataFrame:
    """Per asset and day: average, extremes, deviation and 95th percentile of the ambient measures, and comfort."""
    stats = {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "p95": lambda c: F.percentile_approx(c, 0.95, 10_000)}
    day = rows.groupBy("site_id", "building_id", "asset_id", "event_date").agg(*(f(m).alias(f"{k}_{m}") for m in ("temperature", "humidity", "pressure", "vibration") for k, f in stats.items()))
    comfort = F.col("avg_temperature").between(18, 27) & F.col("avg_humidity").between(30, 65)
    return day.withColumn("thermal_comfort_ok", F.coalesce(comfort, F.lit(False)))


def fault_statistics(events: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Per asset: events by type, days with any, faults a day, mean time between faults, a health score and its risk band."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    fault = F.when(F.col("event_type") == "Fault", F.col("timestamp"))
    rows = events.groupBy("asset_id").agg(
        F.count("*").alias("total_events"),
        kind("Fault").alias("faults"),
        kind("Alarm").alias("alarms"),
        kind("Warning").alias("warnings"),
        kind("Info").alias("infos"),
        F.count_if(F.col("severity") == "High").alias("high_severity_events"),
        F.min(fault).alias("first_fault_at"),
        F.max(fault).alias("last_fault_at"),
        F.count_distinct(F.to_date("timestamp")).alias("days_with_events"),
        F.greatest(F.datediff(F.max("timestamp"), F.min("timestamp")), F.lit(1)).alias("observed_days"),
    )
    span = elapsed(F.col("first_fault_at"), F.col("last_fault_at"))
    health = F.greatest(F.lit(0.0), F.round(100 - (5.0 * F.col("faults") + F.col("alarms") + 0.25 * F.col("warnings")), 2))
    rows = rows.withColumns({"mtbf_hours": F.when(F.col("faults") > 1, F.round(span / 3600 / (F.col("faults") - 1), 2)), "faults_per_day": F.round(F.col("faults") / F.col("observed_days"), 3), "health_score": health})
    rows = rows.withColumn("risk_band", graded(F.col("health_score"), (80, "Low"), (50, "Medium"), otherwise="High"))
    return rows if assets is None else rows.join(assets.select("asset_id", "asset_name", "asset_type", "site_id", "building_id"), "asset_id", "left")


def daily_event_counts(events: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events.groupBy("asset_id", F.to_date("timestamp").alias("event_date")).agg(F.count("*").alias("events"), kind("Fault").alias("faults"), kind("Alarm").alias("alarms"), kind("Warning").alias("warnings"), F.count_if(F.col("severity") == "High").alias("high_severity_events"))


COUNTS = ("events", "faults", "alarms", "warnings", "high_severity_events")


def asset_daily(utilization: DataFrame, environment: DataFrame, events: DataFrame) -> DataFrame:
    keys = ["asset_id", "event_date"]
    ambient = environment.select(*keys, "avg_temperature", "avg_humidity", "thermal_comfort_ok")
    return utilization.join(ambient, keys, "left").join(daily_event_counts(events), keys, "left").fillna(0, list(COUNTS))


def building_daily(daily: DataFrame, buildings: DataFrame) -> DataFrame:
    """Sums of sums and averages of averages over a building's assets; energy per area where the area is known."""
    rows = daily.groupBy("site_id", "building_id", "event_date").agg(
        F.count_distinct("asset_id").alias("reporting_assets"),
        F.sum("energy_kwh").alias("energy_kwh"),
        *(F.avg(c).alias(c) for c in ("utilization_pct", "availability_pct", "data_coverage_pct")),
        *(F.avg(c).alias(c) for c in ("avg_temperature", "avg_humidity")),
        F.max("peak_power_kw").alias("peak_power_kw"),
        *(F.sum(c).alias(c) for c in COUNTS),
    )
    rows = rows.join(buildings.select("building_id", "building_name", "building_type", "floor_area_sqm"), "building_id", "left")
    return rows.withColumn("energy_per_sqm", F.when(F.col("floor_area_sqm") > 0, F.col("energy_kwh") / F.col("floor_area_sqm")))


def site_daily(buildings: DataFrame, sites: DataFrame, baseline_days: int = 7, limit: float = 2.0) -> DataFrame:
    """A site's day over its buildings, with a baseline of the calendar days before and an anomaly flag."""
    rows = buildings.groupBy("site_id", "event_date").agg(
        F.count_distinct("building_id").alias("buildings"),
        F.sum("reporting_assets").alias("reporting_assets"),
        F.sum("energy_kwh").alias("energy_kwh"),
        F.max("peak_power_kw").alias("peak_power_kw"),
        *(F.avg(c).alias(c) for c in ("utilization_pct", "availability_pct", "data_coverage_pct", "avg_temperature")),
        *(F.sum(c).alias(c) for c in COUNTS),
    )
    before = Window.partitionBy("site_id").orderBy(F.unix_date("event_date")).rangeBetween(-baseline_days, -1)
    rows = rows.withColumns({"baseline_kwh": F.avg("energy_kwh").over(before), "baseline_stddev": F.stddev_samp("energy_kwh").over(before)})
    z = F.when(F.col("baseline_stddev") > 0, (F.col("energy_kwh") - F.col("baseline_kwh")) / F.col("baseline_stddev"))
    pct = F.when(F.col("baseline_kwh") > 0, (F.col("energy_kwh") - F.col("baseline_kwh")) / F.col("baseline_kwh") * 100)
    rows = rows.withColumns({"energy_zscore": z, "pct_vs_baseline": pct, "is_energy_anomaly": F.coalesce(z > limit, F.lit(False))})
    return rows.join(sites.select("site_id", "site_name", "city", "country"), "site_id", "left")


def machine_health(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Each asset's vibration against the mean of its type's assets."""
    stats = rows.groupBy("asset_id").agg(F.avg("temperature").alias("avg_temperature"), F.avg("vibration").alias("avg_vibration"), F.count("*").alias("readings"))
    stats = stats.join(assets.select("asset_id", "asset_type", "site_id", "building_id"), "asset_id")
    normal = stats.groupBy("asset_type").agg(F.avg("avg_vibration").alias("normal_vibration"), F.avg("avg_temperature").alias("normal_temperature"))
    out = stats.join(normal, "asset_type")
    times = ratio(F.col("avg_vibration"), F.col("normal_vibration"))
    health = F.when(F.col("avg_vibration") > 2 * F.col("normal_vibration"), "UNHEALTHY").when(F.col("avg_vibration") > 1.4 * F.col("normal_vibration"), "WATCH").otherwise("OK")
    return out.withColumns({"vibration_vs_normal": times, "temperature_above_normal": F.col("avg_temperature") - F.col("normal_temperature"), "health": health})
