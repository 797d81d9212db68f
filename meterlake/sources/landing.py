"""Batch and stream readers of the landing zone, always by explicit contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CORRUPT, with_corrupt


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, dates: Sequence[str] = ()) -> DataFrame:
    """JSON lines under ``ingest_date=`` folders; text that doesn't parse is kept in ``_corrupt_record``.

    ``dates`` prune partitions by a filter on the folder column.
    """
    rows = spark.read.schema(with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumns({"_source_file": F.col("_metadata.file_path"), "_file_modified_at": F.col("_metadata.file_modification_time")})
    return rows.where(F.col("ingest_date").isin(*dates)) if dates else rows


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 2, pattern: str = "*") -> DataFrame:
    """Lines of new text files in a folder, shaped as a broker's messages: value, topic, partition, offset, arrived_at."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).load(path)
    none = F.lit(None)
    return lines.select("value", none.cast("string").alias("topic"), none.cast("int").alias("partition"), none.cast("long").alias("offset"), F.col("_metadata.file_modification_time").alias("arrived_at"))


def stream_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int = 50_000) -> DataFrame:
    """Messages of a Kafka topic in the same shape; needs Spark's Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false"}
    rows = spark.readStream.format("kafka").options(**options).load()
    return rows.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", F.col("timestamp").alias("arrived_at"))


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New rows of a parquet table."""
    return spark.readStream.schema(schema).parquet(path)


def register_views(spark: SparkSession, root: str, names: Sequence[str], prefix: str = "") -> None:
    """Temporary views over tables of a layer, columns merged over files."""
    for name in names:
        spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").createOrReplaceTempView(f"{prefix}{name}")


def visible_to(df: DataFrame, site_ids: Sequence[str] | None) -> DataFrame:
    """Row-level access: only rows of the given sites; ``None`` sees all."""
    return df if site_ids is None else df.where(F.col("site_id").isin(*site_ids))
