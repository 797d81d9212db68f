"""The batch: landing to bronze, silver, gold and hierarchy, each stage written and read again.

Evidence (rule results and quarantine) is written before the quality gate may
stop the run, and every stage may be run again: partitions it writes are replaced.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import conform, hierarchy, marts, model, quality
from ..schemas import ASSET, BUILDING, CORRUPT, EVENT_KEY, EVENT_RAW, SITE, TELEMETRY_KEY, TELEMETRY_RAW
from ..sources import landing, tables
from ..sources.scratch import dropped

LAYERS = ("bronze", "silver", "gold", "hierarchy", "report")
log = logging.getLogger("meterlake")


@dataclass
class Run:
    """A batch's id, its metrics and the seconds of its stages."""

    batch_id: str = field(default_factory=lambda: f"b{uuid.uuid4().hex[:12]}")  # a letter first: folders named by it never read as numbers
    metrics: dict[str, object] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def stage(self, name: str, work: Callable[[], None]) -> None:
        began = time.perf_counter()
        work()
        self.seconds[name] = round(time.perf_counter() - began, 3)
        log.info(json.dumps({"batch_id": self.batch_id, "stage": name, "seconds": self.seconds[name]}))


class Lake:
    """A lake under ``settings.root``, fed from a landing folder."""

    def __init__(self, spark: SparkSession, settings: Settings, landing_path: str, as_of: str | None = None):
        self.spark, self.s, self.landing, self.as_of = spark, settings, landing_path, as_of
        self.fmt = tables.resolved_format(spark, settings.format)

    def read(self, layer: str, name: str) -> DataFrame:
        return tables.read(self.spark, self.s.table(layer, name), self.fmt)

    def write(self, df: DataFrame, layer: str, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
        tables.write(df, self.s.table(layer, name), mode, partition_by, self.fmt)

    def bronze(self, run: Run, dates: Sequence[str] = ()) -> None:
        """Landed records as they are, with audit columns; reference tables as snapshots."""
        for name, schema in (("telemetry", TELEMETRY_RAW), ("events", EVENT_RAW)):
            rows = landing.read_jsonl(self.spark, f"{self.landing}/{name}", schema, dates)
            self.write(conform.audited(rows, run.batch_id, "landing"), "bronze", name, ["ingest_date"])
        for name, schema in (("sites", SITE), ("buildings", BUILDING), ("assets", ASSET)):
            self.write(conform.audited(landing.read_csv(self.spark, f"{self.landing}/{name}", schema), run.batch_id, "reference"), "bronze", name)

    def silver(self, run: Run, dates: Sequence[str] = ()) -> None:
        """Conformed reference tables, then clean records; what fails a blocking rule is quarantined, what doesn't parse is a dead letter.

        With landing ``dates`` only theirs of bronze are read, and their clean records are upserted.  Of
        records with one key the first to land stays, as in a whole run: one whose key silver holds from
        another landing date is a duplicate.  Landing the same dates again updates their records.
        """
        for name in ("sites", "buildings"):
            rows, key = self.read("bronze", name), f"{name[:-1]}_id"
            others = [c for c in rows.columns if c != key]
            self.write(rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, "_r.*"), "silver", name)
        self.write(conform.conformed_assets(self.read("bronze", "assets").select(*ASSET.names)), "silver", "assets")
        register = self.read("silver", "assets")
        plan = (("telemetry", conform.typed_telemetry, TELEMETRY_KEY, quality.telemetry_rules), ("events", conform.typed_events, EVENT_KEY, quality.event_rules))
        landed_on = F.col("ingest_date").isin([dt.date.fromisoformat(str(d)) for d in dates])
        for name, typed, key, rules in plan:
            landed = self.read("bronze", name)
            landed = landed.where(landed_on) if dates else landed
            self.write(landed.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw"), "_source_file", "_batch_id", "ingest_date"), "quarantine", f"{name}_dlq", ["ingest_date"])
            rows = conform.with_lateness(conform.with_register(typed(landed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)), register), self.s.late_seconds)
            rows = quality.with_duplicate_rank(rows, key, [F.col("_ingested_at").asc_nulls_last(), F.col("_source_file"), F.col("_payload_hash")])
            kept = self.s.table("silver", name)
            adds = bool(dates) and tables.exists(self.spark, kept)
            if adds:
                by = [*key, "event_date"] if "timestamp" in key else list(key)  # a key's date prunes silver's partitions
                held = self.read("silver", name).where(~landed_on).select(*by, F.lit(1).alias("_held"))
                rows = rows.withColumn("event_date", F.to_date("timestamp")).join(held, by, "left")
                rows = rows.withColumn("_dup_rank", F.col("_dup_rank") + F.coalesce("_held", F.lit(0))).drop("_held", "event_date")
            rows = rows.persist()
            checks = rules(self.s, self.as_of)
            results = quality.rule_results(rows, checks).withColumns({"layer": F.lit("silver"), "evaluated_at": F.current_timestamp(), "batch_id": F.lit(run.batch_id), "table_name": F.lit(name)})
            self.write(results, "quality", "dq_results", ["batch_id", "table_name"])
            good, bad = quality.split(rows, checks)
            self.write(bad.withColumn("_batch", F.lit(run.batch_id)), "quarantine", name, ["_batch"])
            found = self.read("quality", "dq_results").where((F.col("batch_id") == run.batch_id) & (F.col("table_name") == name))
            run.metrics[f"{name}_breached"] = quality.enforce(found, self.s.fail_on_breach)
            helpers = ["_dup_rank", "_asset_known", "_raw_timestamp"]
            if name == "events":
                good = good.join(register.select("asset_id", "site_id", "building_id"), "asset_id", "left")
            good = conform.finalised(good.drop(*helpers, "_register_site_id"), list(key))
            if adds:
                tables.upsert(self.spark, good, kept, list(key), ["event_date"], self.fmt)
            else:
                self.write(good, "silver", name, ["event_date"])
            rows.unpersist()

    def gold(self, run: Run) -> None:
        """Dimensions, facts, readings, marts and roll-ups, whole."""
        sites, buildings, assets = (self.read("silver", n) for n in ("sites", "buildings", "assets"))
        self.write(model.dim_time(self.spark), "gold", "dim_time")
        self.write(model.dim_site(sites), "gold", "dim_site")
        self.write(model.dim_building(buildings, sites), "gold", "dim_building")
        now = F.lit(self.as_of).cast("timestamp") if self.as_of else F.current_timestamp()
        root = self.s.table("gold", "dim_asset")
        known = tables.versions(self.spark, root)
        tables.write_version(model.merge_versions(tables.read_version(self.spark, root), assets, now) if known else model.asset_versions(assets, now), root)
        self._dated()

    def _dated(self, touched: Sequence[dt.date] = ()) -> None:
        """The gold tables that have dates; with ``touched``, only those partitions that records of these dates reach.

        Readings are held until the next one, so telemetry is read from the first touched date on.  Hourly
        comparisons reach every later date, a site's baseline the days that follow a touched one.
        """
        telemetry, events = self.read("silver", "telemetry"), self.read("silver", "events")
        sites, buildings = self.read("silver", "sites"), self.read("silver", "buildings")
        date, ahead = F.col("event_date"), self.s.baseline_days
        on = lambda df: df.where(date.isin(list(touched))) if touched else df
        between = lambda df, before, after: df.where(date.between(min(touched) - dt.timedelta(before), max(touched) + dt.timedelta(after))) if touched else df
        since = lambda df: df.where(date >= min(touched)) if touched else df
        bounds = telemetry.agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
        self.write(model.dim_date(bounds), "gold", "dim_date")
        self.write(marts.fault_statistics(events), "gold", "curated_fault_statistics")
        gold = lambda name: self.read("gold", name)
        steps: tuple[tuple[str, Callable[[], DataFrame]], ...] = (
            ("fact_telemetry", lambda: model.fact_telemetry(on(telemetry))),
            ("fact_event", lambda: model.fact_event(on(events))),
            ("readings", lambda: on(model.readings(since(telemetry), self.s.sampling_seconds))),
            ("fact_energy_hourly", lambda: model.fact_energy_hourly(on(gold("readings")))),
            ("curated_hourly_energy", lambda: since(marts.hourly_energy(gold("fact_energy_hourly")))),
            ("curated_daily_utilization", lambda: marts.daily_utilization(on(gold("readings")))),
            ("curated_daily_environment", lambda: marts.daily_environment(on(gold("readings")))),
            ("agg_asset_daily", lambda: marts.asset_daily(on(gold("curated_daily_utilization")), on(gold("curated_daily_environment")), on(events))),
            ("agg_building_daily", lambda: marts.building_daily(on(gold("agg_asset_daily")), buildings)),
            ("agg_site_daily", lambda: between(marts.site_daily(between(gold("agg_building_daily"), ahead, ahead), sites, ahead, self.s.anomaly_score), 0, ahead)),
        )
        for name, make in steps:
            self.write(make(), "gold", name, ["event_date"])

    def topology(self, run: Run) -> None:
        assets = self.read("silver", "assets")
        pairs = hierarchy.closure(assets, self.s.max_depth)
        self.write(pairs, "gold", "asset_closure")
        dropped(pairs)
        self.write(hierarchy.hierarchy(assets, self.read("gold", "asset_closure")), "gold", "dim_asset_hierarchy")

    def report(self, run: Run) -> None:
        from .reporting import of_batch, quality_metrics

        telemetry = self.read("silver", "telemetry")
        anchor = F.lit(telemetry.agg(F.max("timestamp")).first()[0])
        run.metrics["quality"] = quality_metrics(of_batch(self.read("quality", "dq_results"), run.batch_id), quality.freshness(telemetry, anchor, self.s.stale_minutes), quality.completeness(telemetry, self.s.sampling_seconds), run.batch_id, self.quarantined(run))

    def quarantined(self, run: Run) -> dict[str, dict[str, int]]:
        """A batch's quarantined records by table and reason."""
        held = {n: self.read("quarantine", n).where(F.col("_batch") == run.batch_id) for n in ("telemetry", "events") if tables.exists(self.spark, self.s.table("quarantine", n))}
        return {n: {r.reason: r.n for r in quality.reason_counts(rows).collect()} for n, rows in held.items()}

    def run(self, layers: Sequence[str] = LAYERS, dates: Sequence[str] = ()) -> Run:
        """Run the layers in order, with ``dates`` only of what landed on them; the report is made even if the gate stops the batch."""
        run, work = Run(), {"bronze": lambda r: self.bronze(r, dates), "silver": lambda r: self.silver(r, dates), "gold": self.gold, "hierarchy": self.topology, "report": self.report}
        try:
            for name in layers:
                if name != "report":
                    run.stage(name, lambda name=name: work[name](run))
        finally:
            if "report" in layers and tables.exists(self.spark, self.s.table("silver", "telemetry")):
                run.stage("report", lambda: self.report(run))
        return run

    def restate(self, run: Run, lookback_days: int | None = None) -> list[str]:
        """Build gold again where late records of the last ``lookback_days`` before the newest date (``None``: ever) reach; returns their dates.

        A late record also ends the hold of its asset's reading before it, so that reading's date is built again too.
        """
        telemetry = self.read("silver", "telemetry")
        late = tables.late_dates(telemetry).union(tables.late_dates(self.read("silver", "events"))).distinct()
        if lookback_days is not None:
            newest = telemetry.agg(F.max("event_date")).first()[0]
            late = late.where(F.col("event_date") >= F.lit(newest - dt.timedelta(lookback_days))) if newest else late
        dates = sorted(r.event_date for r in late.collect())
        if dates:
            came = telemetry.where("_is_late").where(F.col("event_date").isin(dates)).select("asset_id", F.col("event_date").alias("_late_on")).distinct()
            seen = telemetry.where(F.col("event_date") < max(dates)).select("asset_id", "event_date").distinct()
            before = came.join(seen, "asset_id").where("event_date < _late_on").groupBy("asset_id", "_late_on").agg(F.max("event_date").alias("event_date"))
            self._dated(sorted({*dates, *(r.event_date for r in before.select("event_date").distinct().collect())}))
        return [str(d) for d in dates]

    def maintain(self, now: float | None = None) -> Run:
        """Restate late dates, compact the newest, drop what is superseded or too old; metrics say what was done.

        Nothing else may write the lake meanwhile.  ``now`` is in seconds since the epoch; the clock, if it is not given.
        """
        run, now = Run(), time.time() if now is None else now
        lookback = self.s.late_seconds // 86_400 + 3

        def compacted() -> None:
            newest = self.read("silver", "telemetry").agg(F.max("event_date")).first()[0]
            recent = F.col("event_date") >= F.lit(newest - dt.timedelta(lookback)) if newest else F.lit(False)
            for layer, name in (("silver", "telemetry"), ("gold", "fact_telemetry"), ("gold", "readings")):
                if tables.exists(self.spark, self.s.table(layer, name)):
                    tables.compact(self.spark, self.s.table(layer, name), ["asset_id", "timestamp"], self.s.compact_files, ["event_date"], recent)

        run.stage("late", lambda: run.metrics.update(late=self.restate(run, lookback)))
        run.stage("compact", compacted)
        run.stage("vacuum", lambda: run.metrics.update(vacuumed=tables.vacuum_versions(self.spark, self.s.table("gold", "dim_asset"), unread_since=now - 3_600 * self.s.retain_hours)))
        pruned = lambda: [b for n in ("telemetry", "events") for b in tables.prune_written(self.spark, self.s.table("quarantine", n), "_batch", now - 86_400 * self.s.quarantine_days)]
        run.stage("prune", lambda: run.metrics.update(pruned=pruned()))
        return run
