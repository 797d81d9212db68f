"""The stream: parse, divert what doesn't parse, validate by the batch's rules, deduplicate, roll up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import conform, quality
from ..schemas import CORRUPT, TELEMETRY_KEY, with_corrupt


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages with their parsed fields in ``p``; text that isn't a JSON object has no ``p``."""
    p = F.from_json("value", with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.withColumn("p", p)
    fine = F.col("p").isNotNull() & F.col(f"p.{CORRUPT}").isNull()
    return rows.withColumn("p", F.when(fine, F.col("p")))


def dead_letters(rows: DataFrame) -> DataFrame:
    return rows.where("p is null").select(F.col("value").alias("raw"), "topic", "partition", "offset", "arrived_at", F.lit("unparseable").alias("reason"))


def validated(rows: DataFrame, register: DataFrame | None, settings: Settings, as_of: str | None = None) -> DataFrame:
    """Typed records with their quarantine reasons and warnings; without a register every asset is known."""
    typed = conform.typed_telemetry(rows.where("p is not null").select("p.*").drop(CORRUPT))
    if register is None:
        typed = typed.withColumns({"_asset_known": F.lit(True), "_register_site_id": F.lit(None).cast("string")})
    else:
        typed = conform.with_register(typed, register)
    return quality.judged(typed, quality.stream_rules(settings, as_of))


def clean(rows: DataFrame, settings: Settings, keys: Sequence[str] = TELEMETRY_KEY) -> DataFrame:
    """Accepted records, once a key (it holds the timestamp); its state is dropped behind the watermark.

    Of records with one key whose other columns differ, any may stay; with these columns among ``keys`` all do.
    """
    good = rows.where(F.size("_quarantine_reasons") == 0).drop("_quarantine_reasons")
    return good.withWatermark("timestamp", settings.watermark).dropDuplicates(list(keys)).withColumn("event_date", F.to_date("timestamp"))


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("_quarantine_reasons") > 0).withColumn("event_date", F.to_date(F.coalesce("timestamp", F.current_timestamp())))


def rollup(rows: DataFrame, settings: Settings, keys: Sequence[str] = TELEMETRY_KEY) -> DataFrame:
    """Windows of an asset over the records of :func:`clean`; a window appears once the watermark has passed it."""
    length = F.window("timestamp", settings.window)
    per_hour = F.expr(f"INTERVAL {settings.window}").cast("interval day to second")
    hours = (F.extract(F.lit("MINUTE"), per_hour) / 60 + F.extract(F.lit("HOUR"), per_hour)).cast("double")
    grouped = clean(rows, settings, keys).groupBy(length.alias("w"), "site_id", "building_id", "asset_id").agg(
        F.count("*").alias("readings"),
        F.avg("power_consumption").alias("avg_power_kw"),
        F.max("power_consumption").alias("max_power_kw"),
        F.avg("temperature").alias("avg_temperature"),
        F.max("vibration").alias("max_vibration"),
    )
    out = grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])
    return out.withColumns({"approx_kwh": F.col("avg_power_kw") * hours, "event_date": F.to_date("window_start")})


SINKS = ("clean", "quarantine", "dlq", "rollup")


@dataclass
class Streams:
    """Started queries by sink, and where each writes."""

    queries: dict[str, StreamingQuery]
    paths: dict[str, str]

    def wait(self, seconds: float | None = None) -> dict[str, dict[str, int | None]]:
        """Wait for all queries, raise what stopped one, and sum up their progress."""
        out = {}
        for name, query in self.queries.items():
            query.awaitTermination(seconds) if seconds is not None else query.awaitTermination()
            done = query.recentProgress
            rows = [p["sink"]["numOutputRows"] for p in done]
            out[name] = {"micro_batches": len(done), "source_rows": sum(p["numInputRows"] for p in done), "sink_rows": None if any(n < 0 for n in rows) else sum(rows)}
            if query.isActive:
                query.stop()
        return out


def start(lines: DataFrame, schema: T.StructType, out: str, register: DataFrame | None = None, settings: Settings | None = None, sinks: tuple[str, ...] = SINKS, available_now: bool = True, as_of: str | None = None, keys: Sequence[str] = TELEMETRY_KEY) -> Streams:
    """Start one query a sink, each with a checkpoint of its own, that appends parquet under ``out``; ``keys`` as in :func:`clean`."""
    settings = settings or Settings()
    rows = parsed(lines, schema)
    typed = validated(rows, register, settings, as_of)
    frames = {"clean": lambda: clean(typed, settings, keys), "quarantine": lambda: quarantined(typed), "dlq": lambda: dead_letters(rows), "rollup": lambda: rollup(typed, settings, keys)}
    made = Streams({}, {})
    for name in sinks:
        writer = frames[name]().writeStream.format("parquet").outputMode("append").queryName(f"{name}_{abs(hash(out)) % 10**9}")
        writer = writer.option("checkpointLocation", f"{out}/_checkpoints/{name}").option("path", f"{out}/{name}")
        if name != "dlq":
            writer = writer.partitionBy("event_date")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        made.paths[name] = f"{out}/{name}"
        made.queries[name] = writer.start()
    return made


def run(spark: SparkSession, lines: DataFrame, schema: T.StructType, out: str, **options: object) -> dict[str, DataFrame]:
    """Drain what is there and read each sink's table."""
    streams = start(lines, schema, out, **options)
    streams.wait()
    return {name: spark.read.schema(q).parquet(p) for name, p in streams.paths.items() for q in [spark.read.parquet(p).schema]}
