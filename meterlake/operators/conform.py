"""Typing and cleaning of landed records, and the register of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_double, clean, content_hash, parsed_timestamp
from ..schemas import MEASURES


def audited(df: DataFrame, batch_id: str, system: str, ingested_at: str | None = None) -> DataFrame:
    """Landed rows with their audit columns; ``ingested_at`` pins the clock, for restarts and tests."""
    now = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    payload = [c for c in df.columns if not c.startswith("_")]
    return df.withColumns({"_ingested_at": now, "_batch_id": F.lit(batch_id), "_source_system": F.lit(system), "_payload_hash": content_hash(payload)})


def typed_telemetry(raw: DataFrame) -> DataFrame:
    """Text telemetry as typed columns; the raw time stays as ``_raw_timestamp``. Ids and modes are upper-cased, junk becomes null."""
    upper = {n: F.upper(clean(n)) for n in ("site_id", "building_id", "asset_id", "sensor_id", "operating_mode")}
    return raw.withColumns({"_raw_timestamp": F.col("timestamp"), "timestamp": parsed_timestamp(clean("timestamp")), **upper, **{m: as_double(m) for m in MEASURES}})


def typed_events(raw: DataFrame) -> DataFrame:
    """Text events as typed columns; type and severity in title case."""
    return raw.withColumns(
        {
            "_raw_timestamp": F.col("timestamp"),
            "timestamp": parsed_timestamp(clean("timestamp")),
            "event_id": clean("event_id"),
            "asset_id": F.upper(clean("asset_id")),
            "event_type": F.initcap(clean("event_type")),
            "severity": F.initcap(clean("severity")),
            "message": clean("message"),
        }
    )


def with_register(records: DataFrame, assets: DataFrame) -> DataFrame:
    """Records with ``_asset_known`` and the register's site, by asset id. Spark broadcasts the register where it is small enough."""
    register = assets.select(F.upper(F.trim("asset_id")).alias("asset_id"), F.col("site_id").alias("_register_site_id")).where("asset_id is not null").dropDuplicates(["asset_id"])
    register = register.withColumn("_in_register", F.lit(True))
    return records.join(register, "asset_id", "left").withColumn("_asset_known", F.coalesce("_in_register", F.lit(False))).drop("_in_register")


def with_lateness(records: DataFrame, late_seconds: int = 86_400) -> DataFrame:
    """Whole days from event to landing, in seconds, and whether that is late; null times are not late."""
    lateness = F.datediff("ingest_date", F.to_date("timestamp")).cast("long") * 86_400
    return records.withColumn("_lateness_seconds", lateness).withColumn("_is_late", F.coalesce(F.col("_lateness_seconds") >= late_seconds, F.lit(False)))


def finalised(records: DataFrame, grain: list[str]) -> DataFrame:
    """Clean records with their date, hour and grain hash."""
    return records.withColumns({"event_date": F.to_date("timestamp"), "event_hour": F.date_trunc("hour", "timestamp"), "_record_hash": content_hash(grain, mark="~")})


def conformed_assets(assets: DataFrame) -> DataFrame:
    """One row an asset id (the least by name and parent), with ``is_orphan``, ``is_root`` and dangling parents cut.

    An orphan names a parent that isn't registered; a root names none.
    """
    tidy = assets.withColumns({n: F.upper(clean(n)) for n in ("asset_id", "site_id", "building_id", "parent_asset_id")}).where("asset_id is not null")
    others = [c for c in tidy.columns if c != "asset_id"]
    one = tidy.groupBy("asset_id").agg(F.min(F.struct(*others)).alias("r")).select("asset_id", *(F.col(f"r.{c}").alias(c) for c in others))
    ids = one.select(F.col("asset_id").alias("_parent"))
    joined = one.join(ids, one["parent_asset_id"] == ids["_parent"], "left")
    named = F.col("parent_asset_id").isNotNull()
    return joined.select(
        *[c for c in one.columns if c != "parent_asset_id"],
        (named & F.col("_parent").isNull()).alias("is_orphan"),
        (~named).alias("is_root"),
        F.col("_parent").alias("parent_asset_id"),
    )
