"""The estate that queries run on: sites, buildings, assets, telemetry and events derived from the driver's tables.

Regions are sites, nations buildings, customers assets (each fed by customer
(n - 1) / 4), and the ``events`` table is both telemetry and event log.  The
derivations are plain expressions, repeated in :mod:`meterlake.plans.oracles`
as SQL, so that every operator can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, marts, model

#: Readings of the test estate come about every 12 hours.
SAMPLING_SECONDS = 43_200
MODES = {"view": "RUNNING", "purchase": "BOOST", "click": "IDLE", "signup": "STANDBY", "error": "FAULT"}
TYPES = {"error": "Fault", "click": "Alarm", "view": "Warning"}


def _mapped(column: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for key, value in names.items():
        out = F.when(column == key, value).otherwise(out)
    return out


class Estate:
    """The derived tables of one directory of test data; each is a lazy DataFrame, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        make = getattr(type(self), f"make_{name}", None)
        if make is None:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = make(self)
        return self._made[name]

    def make_sites(self) -> DataFrame:
        key = F.col("r_regionkey").cast("string")
        return self.table("region").select(F.concat(F.lit("SITE-"), key).alias("site_id"), F.col("r_name").alias("site_name"), F.concat("r_name", F.lit(" City")).alias("city"), F.col("r_name").alias("country"))

    def make_buildings(self) -> DataFrame:
        kind = F.element_at(F.array(F.lit("Office"), F.lit("Hospital"), F.lit("Plant")), F.col("n_nationkey") % 3 + 1)
        return self.table("nation").select(
            F.concat(F.lit("BLD-"), F.col("n_nationkey").cast("string")).alias("building_id"),
            F.col("n_name").alias("building_name"),
            F.concat(F.lit("SITE-"), F.col("n_regionkey").cast("string")).alias("site_id"),
            (2500.0 + 900 * F.col("n_nationkey")).alias("floor_area_sqm"),
            kind.alias("building_type"),
        )

    def make_register(self) -> DataFrame:
        """Assets as landed, with dangling parents."""
        key = F.col("c_custkey")
        parent = F.when(key == 0, None).when(key % 97 == 0, "AST-GHOST").otherwise(F.concat(F.lit("AST-"), F.floor((key - 1) / 4).cast("string")))
        rows = self.table("customer").select(
            key.alias("asset_no"),
            F.concat(F.lit("AST-"), key.cast("string")).alias("asset_id"),
            F.col("c_name").alias("asset_name"),
            F.col("c_mktsegment").alias("asset_type"),
            F.concat(F.lit("MFR-"), (key % 7).cast("string")).alias("manufacturer"),
            F.concat(F.lit("M"), (key % 5).cast("string")).alias("model"),
            F.date_add(F.lit("2015-01-01").cast("date"), (key % 3000).cast("int")).alias("installation_date"),
            (1 + F.abs("c_acctbal") / 100).alias("rated_power_kw"),
            F.concat(F.lit("BLD-"), F.col("c_nationkey").cast("string")).alias("building_id"),
            parent.alias("parent_asset_id"),
        )
        return rows.join(self.buildings.select("building_id", "site_id"), "building_id", "left")

    def make_assets(self) -> DataFrame:
        from ..operators.conform import conformed_assets

        return conformed_assets(self.register)

    def _located(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.register.select("asset_id", "site_id", "building_id"), "asset_id")

    def make_telemetry(self) -> DataFrame:
        n = F.col("event_id")
        rows = self.table("events").select(
            F.concat(F.lit("AST-"), F.col("user_id").cast("string")).alias("asset_id"),
            F.concat(F.lit("SEN-"), F.col("user_id").cast("string"), F.lit("-"), (n % 2).cast("string")).alias("sensor_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            (15 + F.col("value") / 23).alias("temperature"),
            (30 + (n % 40) / 1.3).alias("humidity"),
            (200 + (n % 100) / 0.7).alias("pressure"),
            ((n % 50) / 7.0).alias("vibration"),
            (F.col("value") / 0.7).alias("power_consumption"),
            _mapped(F.col("event_type"), MODES).alias("operating_mode"),
            F.date_add(F.to_date("ts"), F.when(n % 17 == 0, 2).otherwise(0)).alias("ingest_date"),
        )
        return self._located(rows)

    def make_events(self) -> DataFrame:
        value = F.col("value")
        rows = self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.concat(F.lit("AST-"), F.col("user_id").cast("string")).alias("asset_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            _mapped(F.col("event_type"), TYPES, "Info").alias("event_type"),
            F.when(value < 20, "Low").when(value < 80, "Medium").otherwise("High").alias("severity"),
            F.get_json_object("props", "$.k").alias("message"),
        )
        return self._located(rows)

    def make_raw_telemetry(self) -> DataFrame:
        """Telemetry as landed: text, with defects by event number, and some records twice."""
        n, user = F.col("event_id"), F.col("user_id").cast("string")
        every = lambda k: n % k == 0
        iso, spaced = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        mode = _mapped(F.col("event_type"), MODES)
        located = self.register.select(F.col("asset_no").alias("user_id"), F.col("site_id").alias("_site"), F.col("building_id").alias("_building"))
        base = self.table("events").join(located, "user_id")
        rows = base.select(
            F.when(every(101), "not-a-timestamp").when(every(103), "1970-01-01T00:00:00Z").when(every(107), "").when(every(5), spaced).otherwise(iso).alias("timestamp"),
            F.when(every(73), "SITE-X").otherwise(F.col("_site")).alias("site_id"),
            F.when(every(79), None).otherwise(F.col("_building")).alias("building_id"),
            F.when(every(109), "").when(every(113), F.concat(F.lit("UNREGISTERED-"), n.cast("string"))).when(every(7), F.concat(F.lit(" ast-"), user, F.lit(" "))).otherwise(F.concat(F.lit("AST-"), user)).alias("asset_id"),
            F.concat(F.lit("SEN-"), user, F.lit("-"), (n % 2).cast("string")).alias("sensor_id"),
            F.when(every(53), "9999.99").when(every(59), None).when(every(61), "junk").otherwise(F.concat((15 + n % 25).cast("string"), F.lit(".5"))).alias("temperature"),
            F.when(every(67), "-50").otherwise((30 + n % 40).cast("string")).alias("humidity"),
            (200 + n % 100).cast("string").alias("pressure"),
            (n % 50).cast("string").alias("vibration"),
            (n % 500).cast("string").alias("power_consumption"),
            F.when(every(71), "weird").when(every(3), F.concat(F.lit(" "), F.lower(mode))).otherwise(mode).alias("operating_mode"),
            F.date_add(F.to_date("ts"), F.when(every(17), 2).otherwise(0)).alias("ingest_date"),
            n.alias("landing_no"),
        )
        again = rows.where(F.col("landing_no") % 83 == 0).withColumn("landing_no", F.col("landing_no") + 1_000_000_000)
        return rows.unionByName(again)

    def make_prepared(self) -> DataFrame:
        """Typed telemetry with the helper columns of its rules."""
        from ..operators import conform, quality
        from ..schemas import TELEMETRY_KEY

        rows = conform.with_lateness(conform.with_register(conform.typed_telemetry(self.raw_telemetry), self.register))
        return quality.with_duplicate_rank(rows, TELEMETRY_KEY, [F.col("landing_no")])

    def make_readings(self) -> DataFrame:
        return model.readings(self.telemetry, SAMPLING_SECONDS)

    def make_hourly(self) -> DataFrame:
        return model.fact_energy_hourly(self.readings)

    def make_utilization(self) -> DataFrame:
        return marts.daily_utilization(self.readings)

    def make_environment(self) -> DataFrame:
        return marts.daily_environment(self.readings)

    def make_asset_daily(self) -> DataFrame:
        return marts.asset_daily(self.utilization, self.environment, self.events)

    def make_building_daily(self) -> DataFrame:
        return marts.building_daily(self.asset_daily, self.buildings)

    def make_site_daily(self) -> DataFrame:
        return marts.site_daily(self.building_daily, self.sites)

    def make_faults(self) -> DataFrame:
        return marts.fault_statistics(self.events)

    def make_closure(self) -> DataFrame:
        return hierarchy.closure(self.assets)

    def make_hierarchy(self) -> DataFrame:
        return hierarchy.hierarchy(self.assets, self.closure)

    def make_dates(self) -> DataFrame:
        return model.dim_date(self.telemetry.agg(F.min(F.to_date("timestamp")).alias("first_date"), F.max(F.to_date("timestamp")).alias("last_date")))
