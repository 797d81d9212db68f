"""The registered queries of the library: each runs an operator over whole tables of the test estate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hierarchy, marts, model, quality
from ..schemas import MEASURES
from ..sources import tables
from ..sources.scratch import scratch_path
from . import analytics
from .testbed import SAMPLING_SECONDS, Estate

AS_OF = "2024-01-31T00:00:00Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _registered(make: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Estate(spark, sf_dir))
    return make


def _plain(*names: str) -> list[Column]:
    """Times as they are in the test tables, without a zone."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def _rounded(*names: str, digits: int = 5) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def _report(name: str, e: Estate, **params: object) -> DataFrame:
    made = {"hourly": "hourly", "assets": "assets", "site_daily": "site_daily", "dates": "dates", "events": "events", "hierarchy": "hierarchy", "telemetry": "telemetry", "readings": "readings", "buildings": "buildings", "closure": "closure", "faults": "faults"}
    text = analytics.REPORTS[name]
    return analytics.report(e.spark, name, {k: getattr(e, v) for k, v in made.items() if f"{{{k}}}" in text}, **params)


# --- conforming


@_registered
def cast_telemetry(e: Estate) -> DataFrame:
    rows = e.prepared
    return rows.select("landing_no", *_plain("timestamp"), "site_id", "building_id", "asset_id", "sensor_id", "temperature", "humidity", "pressure", "vibration", "power_consumption", "operating_mode", "_asset_known", "_lateness_seconds", "_is_late", "_dup_rank")


@_registered
def parse_timestamps(e: Estate) -> DataFrame:
    kind = F.when(F.col("_raw_timestamp") == "", "empty").when(F.col("timestamp").isNull(), "unparseable").when(F.col("_raw_timestamp").contains("T"), "iso").otherwise("spaced")
    return e.prepared.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("timestamp").cast("timestamp_ntz").alias("first"), F.max("timestamp").cast("timestamp_ntz").alias("last"))


@_registered
def clean_strings(e: Estate) -> DataFrame:
    return e.prepared.groupBy("operating_mode", F.col("asset_id").isNull().alias("no_asset"), F.col("building_id").isNull().alias("no_building")).agg(F.count("*").alias("n"))


@_registered
def conform_assets(e: Estate) -> DataFrame:
    return e.assets.select("asset_id", "asset_name", "asset_type", "manufacturer", "model", "installation_date", "site_id", "building_id", "parent_asset_id", "is_orphan", "is_root", *_rounded("rated_power_kw"))


# --- quality


def _rules() -> list[quality.Rule]:
    return quality.telemetry_rules(as_of=AS_OF)


@_registered
def dq_rule_results(e: Estate) -> DataFrame:
    return quality.rule_results(e.prepared, _rules())


@_registered
def dq_event_rule_results(e: Estate) -> DataFrame:
    known = e.events.withColumns({"_raw_timestamp": F.col("timestamp").cast("string"), "_asset_known": F.col("site_id").isNotNull(), "_lateness_seconds": F.lit(0).cast("long")})
    ranked = quality.with_duplicate_rank(known, ["event_id"], [F.col("timestamp")])
    return quality.rule_results(ranked, quality.event_rules(as_of=AS_OF))


@_registered
def dq_quarantine(e: Estate) -> DataFrame:
    _, bad = quality.split(e.prepared, _rules())
    return bad.select("landing_no", F.array_join(F.array_sort("_quarantine_reasons"), ",").alias("reasons"))


@_registered
def dq_warnings(e: Estate) -> DataFrame:
    good, _ = quality.split(e.prepared, _rules())
    return good.where(F.size("_dq_warnings") > 0).select("landing_no", F.array_join(F.array_sort("_dq_warnings"), ",").alias("warnings"))


@_registered
def dq_by_dimension(e: Estate) -> DataFrame:
    return quality.by_dimension(quality.rule_results(e.prepared, _rules()))


@_registered
def quarantine_reasons(e: Estate) -> DataFrame:
    return quality.reason_counts(quality.split(e.prepared, _rules())[1])


@_registered
def dedupe_first_wins(e: Estate) -> DataFrame:
    """Line items: of those with one order and number, the first by all other columns."""
    rows = e.table("lineitem")
    order = [F.col(c).asc_nulls_last() for c in rows.columns if c not in ("l_orderkey", "l_linenumber")]
    return quality.with_duplicate_rank(rows, ["l_orderkey", "l_linenumber"], order).where("_dup_rank = 1").drop("_dup_rank")


@_registered
def late_arrivals(e: Estate) -> DataFrame:
    return e.prepared.groupBy("_is_late", "_lateness_seconds").agg(F.count("*").alias("n"))


@_registered
def robust_outliers(e: Estate) -> DataFrame:
    rows = quality.robust_outliers(e.telemetry, "power_consumption")
    return rows.where("is_outlier").select("asset_id", "sensor_id", *_plain("timestamp"), "power_consumption", *_rounded("robust_z"))


@_registered
def freshness(e: Estate) -> DataFrame:
    rows = quality.freshness(e.telemetry, F.lit(AS_OF).cast("timestamp"), stale_minutes=1440)
    return rows.select("asset_id", *_plain("last_reading_at"), "readings", *_rounded("lag_minutes"), "is_stale")


@_registered
def completeness(e: Estate) -> DataFrame:
    return quality.completeness(e.telemetry, SAMPLING_SECONDS)


# --- model


@_registered
def readings_weighted(e: Estate) -> DataFrame:
    return e.readings.select("site_id", "building_id", "asset_id", *_plain("timestamp"), "operating_mode", "sensor_readings", *_rounded("temperature", "power_kw", "duration_hours", "energy_kwh"), "event_date")


@_registered
def fact_energy_hourly(e: Estate) -> DataFrame:
    return e.hourly.select("site_id", "building_id", "asset_id", "event_date", *_plain("event_hour"), *_rounded("energy_kwh", "avg_power_kw", "peak_power_kw", "min_power_kw"), "coverage_hours", "readings")


@_registered
def dim_date(e: Estate) -> DataFrame:
    return e.dates


@_registered
def dim_time(e: Estate) -> DataFrame:
    return model.dim_time(e.spark)


@_registered
def dim_site(e: Estate) -> DataFrame:
    return model.dim_site(e.sites).drop("site_key")


@_registered
def dim_building(e: Estate) -> DataFrame:
    return model.dim_building(e.buildings, e.sites).drop("building_key")


@_registered
def scd2_dim_asset(e: Estate) -> DataFrame:
    """Two snapshots of the register: in the second every tenth asset has moved and 5 % of the assets are new."""
    first = e.assets.where("pmod(cast(substr(asset_id, 5) as bigint), 20) <> 7")
    moves = F.expr("pmod(cast(substr(asset_id, 5) as bigint), 10) = 0")
    second = e.assets.withColumn("building_id", F.when(moves, F.concat("building_id", F.lit("-B"))).otherwise(F.col("building_id")))
    before, after = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    merged = model.merge_versions(model.asset_versions(first, before), second, after)
    keyed = F.col("asset_key") == F.xxhash64(F.concat_ws("|", "asset_id", "scd_hash"))
    return merged.select("asset_id", "building_id", "age_years", keyed.alias("keyed"), F.count("*").over(Window.partitionBy("asset_id", "scd_hash")).alias("same_content"), *_plain("valid_from", "valid_to"), "is_current")


@_registered
def fact_telemetry(e: Estate) -> DataFrame:
    from ..operators.conform import with_lateness

    rows = model.fact_telemetry(with_lateness(e.telemetry)).drop("asset_hash")
    return rows.select("site_id", "building_id", "asset_id", "sensor_id", *_plain("timestamp"), "date_key", "time_key", *MEASURES, "operating_mode", "is_late", "event_date", *_plain("event_hour"))


@_registered
def fact_event(e: Estate) -> DataFrame:
    return model.fact_event(e.events).select("event_id", "asset_id", "site_id", "building_id", *_plain("timestamp"), "event_type", "severity", "message", "is_fault", "severity_rank", "event_date")


# --- marts


@_registered
def hourly_energy_mart(e: Estate) -> DataFrame:
    return marts.hourly_energy(e.hourly).select("asset_id", *_plain("event_hour"), *_rounded("energy_kwh", "prev_day_kwh", "rolling_24h_avg_kwh"), "dod_change_pct")


@_registered
def daily_utilization(e: Estate) -> DataFrame:
    return e.utilization.select("site_id", "building_id", "asset_id", "event_date", *_rounded("observed_hours", "productive_hours", "downtime_hours", "energy_kwh", "avg_power_kw", "peak_power_kw", "utilization_pct", "availability_pct", "data_coverage_pct"), "modes_seen", "readings")


@_registered
def daily_environment(e: Estate) -> DataFrame:
    return e.environment.select("asset_id", "event_date", *_rounded(*(f"{k}_{m}" for m in ("temperature", "humidity", "pressure", "vibration") for k in ("avg", "min", "max", "stddev", "p95"))), "thermal_comfort_ok")


@_registered
def fault_statistics(e: Estate) -> DataFrame:
    return e.faults.select("asset_id", "total_events", "faults", "alarms", "warnings", "infos", "high_severity_events", *_plain("first_fault_at", "last_fault_at"), "days_with_events", "observed_days", "mtbf_hours", "faults_per_day", "health_score", "risk_band")


@_registered
def agg_asset_daily(e: Estate) -> DataFrame:
    return e.asset_daily.select("asset_id", "event_date", *_rounded("energy_kwh", "peak_power_kw", "utilization_pct"), "thermal_comfort_ok", *marts.COUNTS)


@_registered
def agg_building_daily(e: Estate) -> DataFrame:
    return e.building_daily.select("site_id", "building_id", "building_name", "building_type", "event_date", "reporting_assets", *_rounded("energy_kwh", "utilization_pct", "availability_pct", "avg_temperature", "peak_power_kw", "energy_per_sqm"), *marts.COUNTS)


@_registered
def agg_site_daily(e: Estate) -> DataFrame:
    return e.site_daily.select("site_id", "site_name", "event_date", "buildings", "reporting_assets", *_rounded("energy_kwh", "avg_temperature", "peak_power_kw", "baseline_kwh", "energy_zscore", "pct_vs_baseline", digits=4), "is_energy_anomaly", *marts.COUNTS)


@_registered
def machine_health(e: Estate) -> DataFrame:
    return marts.machine_health(e.readings, e.assets).select("asset_id", "asset_type", "site_id", "readings", *_rounded("avg_temperature", "avg_vibration", "vibration_vs_normal", "temperature_above_normal"), "health")


# --- hierarchy


@_registered
def asset_closure(e: Estate) -> DataFrame:
    return e.closure


@_registered
def asset_closure_recursive(e: Estate) -> DataFrame:
    return hierarchy.closure_recursive(e.spark, e.assets)


@_registered
def asset_hierarchy(e: Estate) -> DataFrame:
    return e.hierarchy


@_registered
def site_assets(e: Estate) -> DataFrame:
    return _report("site_assets", e, site="SITE-1")


@_registered
def parent_children(e: Estate) -> DataFrame:
    return hierarchy.parent_and_children(e.hierarchy, e.closure, "AST-3")


@_registered
def downstream_impact(e: Estate) -> DataFrame:
    return _report("impact", e, asset="AST-3")


@_registered
def critical_assets(e: Estate) -> DataFrame:
    return _report("critical_assets", e)


@_registered
def orphans(e: Estate) -> DataFrame:
    return e.hierarchy.where("is_orphan").select("asset_id", "asset_name", "asset_type", "site_id", "building_id", "connectivity_status")


@_registered
def disconnected(e: Estate) -> DataFrame:
    return _report("disconnected", e)


@_registered
def subtree_energy(e: Estate) -> DataFrame:
    rows = hierarchy.subtree_sum(e.closure, e.hourly, "energy_kwh").join(e.hierarchy.select("asset_id", "asset_name", "asset_type"), "asset_id")
    return rows.select("asset_id", "asset_name", "asset_type", *_rounded("subtree_energy_kwh"), "assets_in_subtree").orderBy(F.desc("subtree_energy_kwh"), "asset_id").limit(15)


def _graph(e: Estate) -> tuple[DataFrame, DataFrame]:
    return hierarchy.graph(e.assets, e.buildings, e.sites)


@_registered
def graph_edges(e: Estate) -> DataFrame:
    return _graph(e)[1]


@_registered
def components(e: Estate) -> DataFrame:
    return hierarchy.components(*_graph(e))


@_registered
def topology_report(e: Estate) -> DataFrame:
    nodes, edges = _graph(e)
    return hierarchy.topology_report(nodes, edges, e.closure, e.assets)


# --- reports


@_registered
def q1_top_energy_assets(e: Estate) -> DataFrame:
    return _report("top_energy_assets", e)


@_registered
def q2_daily_energy_by_site(e: Estate) -> DataFrame:
    return _report("daily_energy_by_site", e)


@_registered
def q3_frequent_faults(e: Estate) -> DataFrame:
    return _report("frequent_faults", e)


@_registered
def q4_silent_assets(e: Estate) -> DataFrame:
    return _report("silent_assets", e)


@_registered
def q5_building_utilization(e: Estate) -> DataFrame:
    return _report("building_utilization", e)


@_registered
def q6_site_power_anomalies(e: Estate) -> DataFrame:
    return _report("site_power_anomalies", e)


@_registered
def v_site_energy_daily(e: Estate) -> DataFrame:
    return e.site_daily.select("site_id", "site_name", "city", "event_date", *_rounded("energy_kwh", "baseline_kwh", "energy_zscore", "data_coverage_pct", digits=4), "is_energy_anomaly")


@_registered
def v_asset_health(e: Estate) -> DataFrame:
    named = e.hierarchy.select("asset_id", "asset_name", "asset_type", "site_id", "building_id", F.col("descendant_count").alias("assets_downstream"), "connectivity_status")
    return e.faults.select("asset_id", "faults", "alarms", "high_severity_events", "mtbf_hours", "health_score", "risk_band").join(named, "asset_id", "left")


@_registered
def v_silent_assets(e: Estate) -> DataFrame:
    return _report("silent_leaves", e)


@_registered
def silent_machines(e: Estate) -> DataFrame:
    return _report("silent_machines", e)


# --- tables


@_registered
def upsert_merge(e: Estate) -> DataFrame:
    """Orders, then a correction: every seventh order gets status X, and one order in a hundred is new."""
    path = scratch_path(e.spark, "orders")
    year = F.year("o_orderdate").alias("o_year")
    orders = e.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", year)
    tables.write(orders, path, partition_by=["o_year"])
    changed = orders.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X"))
    new = orders.where("o_orderkey % 100 = 1").withColumn("o_orderkey", -F.col("o_orderkey"))
    tables.upsert(e.spark, changed.unionByName(new), path, keys=["o_orderkey"], partition_by=["o_year"])
    return tables.read(e.spark, path).withColumn("o_year", F.col("o_year").cast("int"))


@_registered
def partition_overwrite(e: Estate) -> DataFrame:
    """Readings by date, one date written again with doubled power: other dates stay."""
    path = scratch_path(e.spark, "facts")
    rows = e.telemetry.select("asset_id", "sensor_id", "timestamp", "power_consumption", F.to_date("timestamp").alias("event_date"))
    tables.write(rows, path, partition_by=["event_date"])
    again = rows.where("event_date = DATE '2024-01-10'").withColumn("power_consumption", F.col("power_consumption") * 2)
    tables.write(again, path, partition_by=["event_date"])
    return tables.read(e.spark, path).groupBy("event_date").agg(F.count("*").alias("n"), F.round(F.sum("power_consumption"), 4).alias("power"))


@_registered
def restate_late(e: Estate) -> DataFrame:
    """Daily energy of the dates alone that late records touched."""
    from ..operators.conform import with_lateness

    late = with_lateness(e.telemetry)
    dates = tables.late_dates(late.withColumn("event_date", F.to_date("timestamp")))
    return e.utilization.join(dates, "event_date", "left_semi").groupBy("event_date").agg(F.round(F.sum("energy_kwh"), 4).alias("energy_kwh"), F.count("*").alias("assets"))


@_registered
def compaction(e: Estate) -> DataFrame:
    path = scratch_path(e.spark, "events")
    tables.write(e.events.repartition(16), path)
    tables.compact(e.spark, path, cluster_by=["asset_id", "timestamp"], files=2)
    return tables.read(e.spark, path).groupBy("asset_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.min("timestamp").cast("timestamp_ntz").alias("first_at"), F.max("timestamp").cast("timestamp_ntz").alias("last_at"), F.count_if(F.col("severity") == "High").alias("high"))


@_registered
def snapshot_time_travel(e: Estate) -> DataFrame:
    """Version 0 of a table whose version 1 lacks half the rows."""
    root = scratch_path(e.spark, "versions")
    tables.write_version(e.sites, root)
    tables.write_version(e.sites.where("site_id < 'SITE-2'"), root)
    return tables.read_version(e.spark, root, 0).withColumn("newest", F.lit(tables.read_version(e.spark, root).count()))


# --- streams


@_registered
def stream_clean(e: Estate) -> DataFrame:
    from ..streaming.replay import replayed

    rows = replayed(e).clean
    return rows.select("asset_id", "sensor_id", *_plain("timestamp"), "temperature", "operating_mode")


@_registered
def stream_quarantine(e: Estate) -> DataFrame:
    from ..streaming.replay import replayed

    return replayed(e).quarantine.select("landing_no", F.array_join(F.array_sort("_quarantine_reasons"), ",").alias("reasons"))


@_registered
def stream_dlq(e: Estate) -> DataFrame:
    from ..streaming.replay import replayed

    return replayed(e).dlq.select("raw")


@_registered
def stream_rollup_5min(e: Estate) -> DataFrame:
    from ..streaming.replay import replayed

    return replayed(e).rollup.select("site_id", "asset_id", *_plain("window_start", "window_end"), "readings", *_rounded("avg_power_kw", "max_power_kw", "approx_kwh"))
