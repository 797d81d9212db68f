"""A seeded estate: sites, buildings, assets, telemetry and events, with defects of known number.

Rows are made from ``spark.range`` and hashes of their number, so any part of
the data comes out alike on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVENT_TYPES, SEVERITIES
from ..schemas import EVENT_RAW, TELEMETRY_RAW

#: Kinds of assets of the made-up estate, with rated power and the number in a building; the tower feeds the fans, and a sensor hangs below each.
KINDS = (("TOWER", 125.0, 1), ("FAN", 7.5, 3), ("LIFT", 33.0, 1), ("OVEN", 60.0, 1), ("COUNTER", 0.4, 1))
#: What stands in place of a time, temperatures beyond any building, and payloads that don't parse.
BAD_TIMES = ("noon or so", "2026-02-31T08:00:00Z", "99:99", "yesterday")
OUTLIERS = ("-274.5", "5120", "73000.5")
BROKEN = ("{", "[1, 2", "sensor rebooted", '{"temperature": }', '"half a line')


@dataclass(frozen=True)
class Plan:
    """What to generate; rates are shares of the records."""

    sites: int = 3
    buildings_per_site: int = 2
    days: int = 7
    start: str = "2026-06-01"
    interval_seconds: int = 300
    seed: int = 42
    rates: dict[str, float] = field(default_factory=lambda: {"missing": 0.01, "duplicate": 0.01, "bad_time": 0.002, "outlier": 0.003, "unknown_asset": 0.002, "late": 0.01, "corrupt": 0.0008})


class Generator:
    def __init__(self, spark: SparkSession, plan: Plan | None = None):
        self.spark, self.plan = spark, plan or Plan()

    def _u(self, name: str, *columns: Column) -> Column:
        """A number in [0, 1) from the seed, a name and columns."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.plan.seed), F.lit(name), *columns), 11) / float(1 << 53)

    def _pick(self, values: tuple[str, ...], u: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))

    def sites(self) -> DataFrame:
        n = (F.col("id") + 1).cast("string")
        return self.spark.range(self.plan.sites).select(F.concat(F.lit("SITE-"), n).alias("site_id"), F.concat(F.lit("Site "), n).alias("site_name"), F.concat(F.lit("City "), n).alias("city"), F.lit("XX").alias("country"), F.lit("UTC").alias("timezone"), F.concat(F.lit("CUST-"), n).alias("customer_id"))

    def buildings(self) -> DataFrame:
        b = F.explode(F.sequence(F.lit(1), F.lit(self.plan.buildings_per_site)))
        rows = self.sites().select("site_id", b.alias("b"))
        name = F.concat("site_id", F.lit("-B"), F.col("b").cast("string"))
        return rows.select(name.alias("building_id"), F.concat(F.lit("Building "), name).alias("building_name"), "site_id", (2_000 + F.floor(self._u("area", name) * 20_000)).cast("double").alias("floor_area_sqm"), F.lit("Office").alias("building_type"))

    def assets(self) -> DataFrame:
        """In each building a tower feeds fans, the rest stands by itself, and each has a sensor below it."""
        entries = [(f"{kind}-{i + 1}", kind, power, "TOWER-1" if kind == "FAN" else None) for kind, power, n in KINDS for i in range(n)]
        entries += [(f"{name}-S", "SENSOR", 0.1, name) for name, *_ in entries]
        kinds = self.spark.createDataFrame(entries, "name string, asset_type string, rated_power_kw double, parent string")
        rows = self.buildings().select("site_id", "building_id").crossJoin(F.broadcast(kinds))  # a dozen kinds
        key = lambda c: F.concat("building_id", F.lit("-"), F.col(c))
        return rows.select(key("name").alias("asset_id"), F.col("name").alias("asset_name"), "asset_type", self._pick(("Acme", "Borealis", "Cirrus"), self._u("maker", key("name"))).alias("manufacturer"), F.lit("M1").alias("model"), F.lit("2020-01-01").cast("date").alias("installation_date"), "rated_power_kw", "site_id", "building_id", key("parent").alias("parent_asset_id"))

    def _ticks(self) -> Column:
        return F.expr(f"explode(sequence(timestamp'{self.plan.start}', timestamp'{self.plan.start}' + interval {self.plan.days} days - interval {self.plan.interval_seconds} seconds, interval {self.plan.interval_seconds} seconds))")

    def telemetry(self) -> DataFrame:
        """Clean readings: power follows occupancy by hour and weekday."""
        hosts = self.assets().where("asset_type <> 'SENSOR'")
        rows = hosts.select("site_id", "building_id", "asset_id", F.concat("asset_id", F.lit("-S")).alias("sensor_id"), "rated_power_kw", self._ticks().alias("at"))
        hour, noise = F.hour("at") + F.minute("at") / 60, lambda n: self._u(n, F.col("asset_id"), F.col("at")) - 0.5
        busy = F.exp(-F.pow((hour - 13) / 4.5, 2)) * F.when(F.dayofweek("at").isin(1, 7), 0.3).otherwise(1.0)
        load = F.greatest(F.lit(0.02), 0.1 + 0.75 * busy + 0.1 * noise("load"))
        mode = F.when(load > 0.7, "BOOST").when(load > 0.25, "RUNNING").when(load > 0.12, "IDLE").otherwise("STANDBY")
        shown = lambda c, d=3: F.round(c, d).cast("string")
        return rows.select(
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "site_id", "building_id", "asset_id", "sensor_id",
            shown(19 + 6 * busy + 2 * noise("t")).alias("temperature"), shown(45 + 15 * noise("h")).alias("humidity"), shown(300 + 40 * noise("p")).alias("pressure"), shown(1.2 + load + noise("v")).alias("vibration"),
            shown(F.col("rated_power_kw") * load).alias("power_consumption"), mode.alias("operating_mode"), F.to_date("at").alias("ingest_date"),
        )

    def events(self) -> DataFrame:
        """About one event an asset and day."""
        at = F.expr(f"explode(sequence(timestamp'{self.plan.start}', timestamp'{self.plan.start}' + interval {self.plan.days - 1} days, interval 1 day))")
        rows = self.assets().select("asset_id", at.alias("day"))
        rows = rows.where(self._u("happens", F.col("asset_id"), F.col("day")) < 0.8)
        when = F.timestamp_seconds(F.unix_seconds("day") + F.floor(self._u("second", F.col("asset_id"), F.col("day")) * 86_400))
        return rows.select(
            F.sha1(F.concat_ws("|", "asset_id", F.col("day").cast("string"))).alias("event_id"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "asset_id",
            self._pick(EVENT_TYPES, self._u("type", F.col("asset_id"), F.col("day"))).alias("event_type"), self._pick(SEVERITIES, self._u("severity", F.col("asset_id"), F.col("day"))).alias("severity"),
            F.lit("generated").alias("message"), F.to_date("day").alias("ingest_date"),
        )

    def defective(self) -> DataFrame:
        """Telemetry with defects, each named in ``defect``; a record has one at most, and duplicates come on top."""
        base, key, at = self.telemetry(), (F.col("asset_id"), F.col("timestamp")), F.lit(None).cast("string")
        edge, below, u = 0.0, {}, self._u("defect", *key)
        for name in ("missing", "bad_time", "outlier", "unknown_asset", "late"):
            below[name] = (edge, edge + self.plan.rates[name])
            edge = below[name][1]
        for name, (a, b) in below.items():
            at = F.when((u >= a) & (u < b), name).otherwise(at)
        rows, pick = base.withColumn("defect", at), self._u("which", *key)
        hit = lambda name: F.coalesce(F.col("defect") == name, F.lit(False))
        rows = rows.withColumns(
            {
                "temperature": F.when(hit("missing"), None).when(hit("outlier"), self._pick(OUTLIERS, pick)).otherwise(F.col("temperature")),
                "timestamp": F.when(hit("bad_time"), self._pick(BAD_TIMES, pick)).otherwise(F.col("timestamp")),
                "asset_id": F.when(hit("unknown_asset"), F.concat(F.lit("GHOST-"), F.hex(F.floor(pick * (1 << 24)).cast("long")))).otherwise(F.col("asset_id")),
                "ingest_date": F.when(hit("late"), F.date_add("ingest_date", 1 + (pick * 2).cast("int"))).otherwise(F.col("ingest_date")),
            }
        )
        again = rows.where(F.col("defect").isNull() & (self._u("again", *key) < self.plan.rates["duplicate"])).withColumn("defect", F.lit("duplicate"))
        return rows.unionByName(again)

    def land(self, path: str) -> dict[str, int]:
        """Write the landing zone (JSON lines by ``ingest_date``, CSV reference tables); returns the manifest of defects."""
        rows = self.defective()
        line = F.to_json(F.struct(*TELEMETRY_RAW.names))
        broken = self._u("corrupt", F.col("asset_id"), F.col("timestamp"), F.col("defect")) < self.plan.rates["corrupt"]
        value = F.when(broken, self._pick(BROKEN, self._u("kind", F.col("asset_id"), F.col("timestamp")))).otherwise(line)
        rows = rows.withColumns({"value": value, "defect": F.when(broken, "corrupt").otherwise(F.col("defect"))})
        rows.select("value", "ingest_date").write.mode("overwrite").partitionBy("ingest_date").text(f"{path}/telemetry")
        self.events().select(F.to_json(F.struct(*EVENT_RAW.names)).alias("value"), "ingest_date").write.mode("overwrite").partitionBy("ingest_date").text(f"{path}/events")
        for name in ("sites", "buildings", "assets"):
            getattr(self, name)().write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        return {r.defect or "clean": r["count"] for r in rows.groupBy("defect").count().collect()}
