"""Dimensions, versioned assets, duration-weighted readings and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import banded, content_hash, elapsed
from ..schemas import MEASURES

#: Attributes whose change makes a new version of an asset.
TRACKED = ("asset_name", "asset_type", "manufacturer", "model", "rated_power_kw", "site_id", "building_id", "parent_asset_id")


def dim_date(bounds: DataFrame) -> DataFrame:
    """A row a day from ``first_date`` to ``last_date`` (a one-row table); fiscal years begin in April."""
    d = F.col("full_date")
    days = bounds.select(F.explode(F.sequence("first_date", "last_date", F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    month = F.month(d)
    return days.select(
        (F.year(d) * 10_000 + month * 100 + F.dayofmonth(d)).alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        month.alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("iso_week"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.when(month >= 4, F.year(d) + 1).otherwise(F.year(d)).alias("fiscal_year"),
        (F.floor(F.pmod(month + 8, F.lit(12)) / 3) + 1).cast("int").alias("fiscal_quarter"),
    )


def dim_time(spark: SparkSession) -> DataFrame:
    """A row a minute of the day."""
    hour = (F.col("id") / 60).cast("int")
    minutes = spark.range(1440).select(F.col("id").cast("int").alias("time_key"), hour.alias("hour"), (F.col("id") % 60).cast("int").alias("minute"))
    part = banded(F.col("hour"), (6, "Night"), (12, "Morning"), (18, "Afternoon"), otherwise="Evening")
    return minutes.withColumns({"hh_mm": F.format_string("%02d:%02d", "hour", "minute"), "day_part": part, "is_business_hours": F.col("hour").between(8, 19)})


def dim_site(sites: DataFrame) -> DataFrame:
    return sites.withColumn("site_key", F.xxhash64("site_id"))


def dim_building(buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """Buildings with their site's name and a size band; an unknown area counts as large."""
    named = buildings.join(sites.select("site_id", "site_name", "city", "country"), "site_id", "left")
    band = banded(F.col("floor_area_sqm"), (5_000, "Small"), (15_000, "Medium"), otherwise="Large")
    return named.withColumns({"building_key": F.xxhash64("building_id"), "size_band": band})


def asset_versions(snapshot: DataFrame, effective_at: Column) -> DataFrame:
    """The first version of every asset of a snapshot."""
    rows = snapshot.withColumn("scd_hash", content_hash(TRACKED, mark="~"))
    age = F.round(F.datediff(F.to_date(effective_at), "installation_date") / 365.25, 2)
    return rows.withColumns({"asset_key": F.xxhash64(F.concat_ws("|", "asset_id", "scd_hash")), "age_years": age, "valid_from": effective_at, "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})


def merge_versions(existing: DataFrame, snapshot: DataFrame, effective_at: Column) -> DataFrame:
    """Slowly changing dimension, type 2: close the current version of each changed asset and add a new one.

    Assets absent from the snapshot stay as they are; an unchanged snapshot adds nothing.
    """
    new = asset_versions(snapshot, effective_at)
    now = existing.where("is_current").select("asset_id", F.col("scd_hash").alias("_old_hash"))
    changed = new.join(now, "asset_id", "left").where(F.col("_old_hash").isNull() | (F.col("_old_hash") != F.col("scd_hash"))).drop("_old_hash")
    ids = changed.select("asset_id").withColumn("_changed", F.lit(True))
    kept = existing.join(ids, "asset_id", "left")
    closes = F.col("is_current") & F.coalesce("_changed", F.lit(False))
    kept = kept.withColumns({"valid_to": F.when(closes, effective_at).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~closes}).drop("_changed")
    return kept.unionByName(changed, allowMissingColumns=True)


def readings(telemetry: DataFrame, sampling_seconds: int = 300) -> DataFrame:
    """One reading an asset and instant, weighted by how long it held.

    Sensors of an asset that report at one instant are averaged (their mode is
    the least), so energy isn't counted twice.  A reading holds until the next,
    but at most two sampling intervals; the last holds one.
    """
    keys = ("site_id", "building_id", "asset_id", "timestamp")
    merged = telemetry.where("timestamp is not null").groupBy(*keys).agg(
        *(F.avg(m).alias("power_kw" if m == "power_consumption" else m) for m in MEASURES), F.min("operating_mode").alias("operating_mode"), F.count("*").alias("sensor_readings")
    )
    w = Window.partitionBy("asset_id").orderBy("timestamp", "site_id", "building_id")
    held = F.coalesce(elapsed(F.col("timestamp"), F.lead("timestamp").over(w)), F.lit(float(sampling_seconds)))
    rows = merged.withColumn("duration_hours", F.least(held, F.lit(2.0 * sampling_seconds)) / 3600)
    return rows.withColumns({"energy_kwh": F.col("power_kw") * F.col("duration_hours"), "event_date": F.to_date("timestamp"), "event_hour": F.date_trunc("hour", "timestamp")})


def fact_telemetry(telemetry: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return telemetry.select(
        F.xxhash64("asset_id").alias("asset_hash"),
        "site_id",
        "building_id",
        "asset_id",
        "sensor_id",
        ts,
        (F.year(ts) * 10_000 + F.month(ts) * 100 + F.dayofmonth(ts)).alias("date_key"),
        (F.hour(ts) * 60 + F.minute(ts)).alias("time_key"),
        *MEASURES,
        "operating_mode",
        F.coalesce("_is_late", F.lit(False)).alias("is_late") if "_is_late" in telemetry.columns else F.lit(False).alias("is_late"),
        F.to_date(ts).alias("event_date"),
        F.date_trunc("hour", ts).alias("event_hour"),
    )


def fact_energy_hourly(rows: DataFrame) -> DataFrame:
    """Energy of each asset and hour; a reading counts wholly to the hour it begins in."""
    return rows.groupBy("site_id", "building_id", "asset_id", "event_date", "event_hour").agg(
        F.sum("energy_kwh").alias("energy_kwh"),
        F.avg("power_kw").alias("avg_power_kw"),
        F.max("power_kw").alias("peak_power_kw"),
        F.min("power_kw").alias("min_power_kw"),
        F.round(F.sum("duration_hours"), 4).alias("coverage_hours"),
        F.count("*").alias("readings"),
    )


def fact_event(events: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "High", 3).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "Low", 1)
    return events.withColumns({"is_fault": F.col("event_type") == "Fault", "severity_rank": rank, "event_date": F.to_date("timestamp")})
