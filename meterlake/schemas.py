"""Explicit contracts of the landed tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


TELEMETRY_RAW = _strings("timestamp site_id building_id asset_id sensor_id temperature humidity pressure vibration power_consumption operating_mode")
EVENT_RAW = _strings("event_id timestamp asset_id event_type severity message")
SITE = _strings("site_id site_name city country timezone customer_id")
BUILDING = T.StructType([*_strings("building_id building_name site_id"), T.StructField("floor_area_sqm", T.DoubleType()), T.StructField("building_type", T.StringType())])
ASSET = T.StructType(
    [
        *_strings("asset_id asset_name asset_type manufacturer model"),
        T.StructField("installation_date", T.DateType()),
        T.StructField("rated_power_kw", T.DoubleType()),
        *_strings("site_id building_id parent_asset_id"),
    ]
)
MEASURES = ("temperature", "humidity", "pressure", "vibration", "power_consumption")
TELEMETRY_KEY = ("asset_id", "sensor_id", "timestamp")
EVENT_KEY = ("event_id",)
CORRUPT = "_corrupt_record"


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The contract with a column for text that doesn't parse."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
