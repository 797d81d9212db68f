"""Declarative data quality: rules, one-pass evaluation, quarantine, and signals.

A rule's predicate is true for a failure, and null counts as passing.  One list
of rules drives the counts, the quarantine and the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EVENT_TYPES, OPERATING_MODES, RANGES, SEVERITIES, Settings

BLOCKING, WARN, INFO = "BLOCKING", "WARN", "INFO"


class QualityBreach(RuntimeError):
    """A blocking rule failed on more rows than its threshold allows."""


@dataclass(frozen=True)
class Rule:
    id: str
    dimension: str
    severity: str
    fails: Callable[[], Column]
    threshold: float | None = None
    requires: tuple[str, ...] = ()

    def failed(self) -> Column:
        return F.coalesce(self.fails(), F.lit(False))


def missing(name: str) -> Callable[[], Column]:
    return lambda: F.col(name).isNull()


def blank(name: str) -> Callable[[], Column]:
    return lambda: F.col(name).isNull() | (F.trim(F.col(name)) == "")


def outside(name: str, low: float, high: float) -> Callable[[], Column]:
    return lambda: ~F.col(name).between(low, high)


def not_among(name: str, values: Sequence[str]) -> Callable[[], Column]:
    return lambda: ~F.col(name).isin(*values)


def unparseable() -> Column:
    return F.col("_raw_timestamp").isNotNull() & F.col("timestamp").isNull()


def implausible(as_of: str | None) -> Callable[[], Column]:
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return lambda: (F.col("timestamp") < F.lit("2000-01-01").cast("timestamp")) | (F.col("timestamp") > now + F.expr("INTERVAL 1 DAY"))


def _common(prefix: str, s: Settings, as_of: str | None) -> list[Rule]:
    return [
        Rule(f"{prefix}.validity.timestamp_parseable", "validity", BLOCKING, unparseable, s.threshold("validity"), ("_raw_timestamp",)),
        Rule(f"{prefix}.validity.timestamp_plausible", "validity", BLOCKING, implausible(as_of), s.threshold("validity")),
        Rule(f"{prefix}.consistency.asset_registered", "consistency", BLOCKING, lambda: ~F.col("_asset_known"), s.threshold("consistency"), ("_asset_known",)),
        Rule(f"{prefix}.timeliness.late_arrival", "timeliness", WARN, lambda: F.col("_lateness_seconds") >= s.late_seconds, s.threshold("timeliness"), ("_lateness_seconds",)),
    ]


def telemetry_rules(s: Settings | None = None, as_of: str | None = None) -> list[Rule]:
    """The 22 rules for telemetry."""
    s = s or Settings()
    full, keys = s.threshold("completeness"), ("asset_id", "site_id", "building_id")
    return [
        Rule("tel.completeness.timestamp_not_null", "completeness", BLOCKING, missing("timestamp"), full),
        *(Rule(f"tel.completeness.{k}_not_null", "completeness", BLOCKING, blank(k), full) for k in keys),
        *(Rule(f"tel.completeness.{m}_present", "completeness", WARN, missing(m), full) for m in (*RANGES, "operating_mode")),
        Rule("tel.uniqueness.business_key", "uniqueness", BLOCKING, lambda: F.col("_dup_rank") > 1, s.threshold("uniqueness"), ("_dup_rank",)),
        Rule("tel.validity.operating_mode_enum", "validity", WARN, not_among("operating_mode", OPERATING_MODES), s.threshold("enum")),
        *(Rule(f"tel.accuracy.{m}_in_range", "accuracy", BLOCKING, outside(m, *r), s.threshold("accuracy")) for m, r in RANGES.items()),
        Rule("tel.consistency.site_matches_register", "consistency", WARN, lambda: F.col("site_id") != F.col("_register_site_id"), s.threshold("site"), ("_register_site_id",)),
        *_common("tel", s, as_of),
    ]


def event_rules(s: Settings | None = None, as_of: str | None = None) -> list[Rule]:
    """The 13 rules for events."""
    s = s or Settings()
    full = s.threshold("completeness")
    return [
        Rule("evt.completeness.timestamp_not_null", "completeness", BLOCKING, missing("timestamp"), full),
        *(Rule(f"evt.completeness.{k}_not_null", "completeness", BLOCKING, blank(k), full) for k in ("event_id", "asset_id", "event_type", "severity")),
        Rule("evt.completeness.message_present", "completeness", WARN, blank("message"), full),
        Rule("evt.uniqueness.event_id", "uniqueness", BLOCKING, lambda: F.col("_dup_rank") > 1, s.threshold("uniqueness"), ("_dup_rank",)),
        Rule("evt.validity.event_type_enum", "validity", BLOCKING, not_among("event_type", EVENT_TYPES), s.threshold("enum")),
        Rule("evt.validity.severity_enum", "validity", BLOCKING, not_among("severity", SEVERITIES), s.threshold("enum")),
        *_common("evt", s, as_of),
    ]


def stream_rules(s: Settings | None = None, as_of: str | None = None) -> list[Rule]:
    """Telemetry rules that need no other row and no landing date."""
    return [r for r in telemetry_rules(s, as_of) if not {"_dup_rank", "_lateness_seconds"} & set(r.requires)]


def with_duplicate_rank(records: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``_dup_rank`` 1, 2, ... within a business key; 1 for rows whose key has a null, which duplicate nothing."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    spread = F.when(~whole, F.monotonically_increasing_id())  # null keys don't gather in one task
    w = Window.partitionBy(*keys, "_spread").orderBy(*order)
    return records.withColumn("_spread", spread).withColumn("_dup_rank", F.when(whole, F.row_number().over(w)).otherwise(1)).drop("_spread")


def _check(df: DataFrame, rules: Sequence[Rule]) -> None:
    lacking = sorted({c for r in rules for c in r.requires} - set(df.columns))
    if lacking:
        raise ValueError(f"columns that rules need are missing: {', '.join(lacking)}")


def rule_results(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row a rule: rows evaluated and failed, rate, and whether it passed; one pass over ``df``."""
    _check(df, rules)
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(r.failed()).alias(f"r{i}") for i, r in enumerate(rules)))
    entries = [
        F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.lit(r.threshold).cast("double").alias("threshold"), F.col(f"r{i}").alias("failed"))
        for i, r in enumerate(rules)
    ]
    rows = counts.select("n", F.explode(F.array(*entries)).alias("e"))
    rate = F.coalesce(F.round(F.col("e.failed") / F.nullif(F.col("n"), F.lit(0)), 6), F.lit(0.0))
    return rows.select("e.rule_id", "e.dimension", "e.severity", F.col("n").alias("evaluated"), "e.failed", rate.alias("failure_rate"), "e.threshold", F.coalesce(rate <= F.col("e.threshold"), F.lit(True)).alias("passed"))


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``_quarantine_reasons`` (blocking) and ``_dq_warnings``: ids of the failed rules."""
    _check(df, rules)
    ids = lambda severity: F.array_compact(F.array(*(F.when(r.failed(), F.lit(r.id)) for r in rules if r.severity == severity))) if any(r.severity == severity for r in rules) else F.array().cast("array<string>")
    return df.withColumn("_quarantine_reasons", ids(BLOCKING)).withColumn("_dq_warnings", ids(WARN))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantined rows; together all of ``df``."""
    rows = judged(df, rules)
    return rows.where(F.size("_quarantine_reasons") == 0).drop("_quarantine_reasons"), rows.where(F.size("_quarantine_reasons") > 0)


def enforce(results: DataFrame, fail: bool = True) -> list[str]:
    """The blocking rules that were breached; raises if there is one and ``fail``."""
    breached = [r.rule_id for r in results.where((F.col("severity") == BLOCKING) & ~F.col("passed")).orderBy("rule_id").collect()]
    if breached and fail:
        raise QualityBreach(", ".join(breached))
    return breached


def by_dimension(results: DataFrame) -> DataFrame:
    return results.groupBy("dimension").agg(F.count("*").alias("rules"), F.sum("failed").alias("failed"), F.count_if(~F.col("passed")).alias("breached"))


def reason_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(F.explode("_quarantine_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def robust_outliers(df: DataFrame, value: str, by: Sequence[str] = ("asset_id", "sensor_id"), limit: float = 6.0) -> DataFrame:
    """``robust_z`` = 0.6745 (x - median) / MAD within a group, 0 where the MAD is 0, and ``is_outlier``.

    Medians are exact and aggregated, so a group's rows are never windowed; they are joined back.
    """
    middle = df.groupBy(*by).agg(F.median(value).alias("_median"))
    off = df.join(middle, list(by)).withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    spread = off.groupBy(*by).agg(F.median("_off").alias("_mad"))
    z = F.when(F.col("_mad") > 0, 0.6745 * (F.col(value) - F.col("_median")) / F.col("_mad")).otherwise(0.0)
    return off.join(spread, list(by)).withColumn("robust_z", z).withColumn("is_outlier", F.coalesce(F.abs("robust_z") > limit, F.lit(False))).drop("_off", "_median", "_mad")


def freshness(df: DataFrame, as_of: Column, stale_minutes: float = 60.0) -> DataFrame:
    """Per asset: last reading, count, lag in minutes at ``as_of``, and whether it is stale."""
    rows = df.groupBy("asset_id").agg(F.max("timestamp").alias("last_reading_at"), F.count("*").alias("readings"))
    lag = (F.unix_micros(as_of) - F.unix_micros("last_reading_at")) / 60e6
    return rows.withColumn("lag_minutes", lag).withColumn("is_stale", F.col("lag_minutes") > stale_minutes)


def completeness(df: DataFrame, sampling_seconds: int) -> DataFrame:
    """Per asset, sensor and day: readings received, expected and missing, and the share received (at most 100 %)."""
    expected = max(86_400 // sampling_seconds, 1)
    rows = df.groupBy("asset_id", "sensor_id", F.to_date("timestamp").alias("event_date")).agg(F.count("*").alias("received"))
    return rows.withColumns({"expected": F.lit(expected).cast("long"), "missing": F.greatest(F.lit(expected) - F.col("received"), F.lit(0)), "completeness_pct": F.least(F.col("received") / expected, F.lit(1.0)) * 100})
