"""Lake tables: partitioned writes, upserts, compaction, versions and maintenance.

Paths are Hadoop paths; they are only touched through Spark and its file
system, so any store that Spark reads will do.  A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_path


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there."""
    fs, target = _fs(spark, path)
    return fs.exists(target) and any("=" in n or not n.startswith(("_", ".")) for n in (s.getPath().getName() for s in fs.listStatus(target)))


def drop(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def resolved_format(spark: SparkSession, wanted: str) -> str:
    """``wanted``, or parquet where the session lacks the classes of ``delta``."""
    if wanted != "delta":
        return wanted
    try:
        spark._jvm.java.lang.Class.forName("io.delta.sql.DeltaSparkSessionExtension")
        return "delta"
    except Exception:
        return "parquet"


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write a table; with partitions, overwriting replaces only those that ``df`` has rows for."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.save(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    write(df, path, "append", partition_by, fmt)


def upsert(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Update rows with equal keys (nulls equal), insert the others.

    Keys are looked for in the partitions that the source has rows for, and in all where a key may have
    moved: the table is rewritten there, staged first, as it can't be overwritten while it is read.
    Partitions that their last row leaves are deleted when all is written: a run that breaks off loses nothing,
    and the next one mends it.
    Of several source rows with one key the greatest by all columns wins.
    """
    others = [c for c in df.columns if c not in keys]
    source = df.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)) if others else df.distinct()
    if not exists(spark, path):
        write(source.select(df.columns), path, partition_by=partition_by, fmt=fmt)
        return
    target = read(spark, path, fmt)
    source = source.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    if partition_by:
        # partitions to rewrite: those of the source, and those that hold a key of the source
        holds = target.join(source.select(*keys), same(target, source, keys), "left_semi").select(*partition_by)
        touched = source.select(*partition_by).union(holds).distinct()
        kept = target.join(touched, same(target, touched, partition_by), "left_semi")
    else:
        kept = target
    kept = kept.join(source, same(kept, source, keys), "left_anti")
    staged = scratch_path(spark, "upsert")
    kept.unionByName(source).write.parquet(staged)
    vacated: list[str] = []
    if partition_by:  # partitions whose last row has moved away, by the names that Spark gave their folders
        left = spark.read.schema(target.schema).parquet(staged).select(*partition_by).distinct()
        gone = touched.join(left, same(touched, left, partition_by), "left_anti")
        homes = target.select(*partition_by, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_home"))
        vacated = [r[0] for r in homes.join(gone, same(homes, gone, partition_by), "left_semi").select("_home").distinct().collect()]
    write(spark.read.schema(target.schema).parquet(staged), path, partition_by=partition_by, fmt=fmt)
    for home in vacated:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(home))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    drop(spark, staged)


def compact(spark: SparkSession, path: str, cluster_by: Sequence[str], files: int, partition_by: Sequence[str] = (), where: Column | None = None) -> None:
    """Rewrite a table in fewer files, ranged and sorted, so that their statistics skip data.

    ``where`` picks whole partitions; the others stay as they are.
    """
    if where is not None and not partition_by:
        raise ValueError("only partitions can be compacted apart")
    staged = scratch_path(spark, "compact")
    rows = read(spark, path) if where is None else read(spark, path).where(where)
    rows.repartitionByRange(files, *partition_by, *cluster_by).sortWithinPartitions(*partition_by, *cluster_by).write.parquet(staged)
    write(spark.read.schema(rows.schema).parquet(staged), path, partition_by=partition_by)
    drop(spark, staged)


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, target = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def write_version(df: DataFrame, root: str) -> int:
    """Write the next version of a table of snapshots; returns its number."""
    have = versions(df.sparkSession, root)
    new = have[-1] + 1 if have else 0
    df.write.parquet(f"{root}/v{new}")
    return new


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    have = versions(spark, root)
    if not have or (version is not None and version not in have):
        raise ValueError(f"no version {version} in {root}")
    return spark.read.parquet(f"{root}/v{have[-1] if version is None else version}")


def vacuum_versions(spark: SparkSession, root: str, keep: int = 1, unread_since: float | None = None) -> list[int]:
    """Delete all but the newest versions; with ``unread_since`` (seconds since the epoch), only those superseded before then."""
    have = versions(spark, root)
    old = have[: -keep or None]
    if unread_since is not None:
        fs, target = _fs(spark, root)
        written = {int(s.getPath().getName()[1:]): s.getModificationTime() / 1e3 for s in (fs.listStatus(target) if have else []) if s.getPath().getName()[1:].isdigit()}
        old = [v for v, successor in zip(old, have[1:], strict=False) if written[successor] < unread_since]
    for v in old:
        drop(spark, f"{root}/v{v}")
    return old


def late_dates(records: DataFrame) -> DataFrame:
    """Dates that late records belong to: the partitions to build again."""
    return records.where("_is_late").select("event_date").distinct()


def prune(spark: SparkSession, path: str, partition: str, before: str) -> list[str]:
    """Delete partitions ``<partition>=<value>`` whose value sorts before ``before``."""
    fs, target = _fs(spark, path)
    gone = []
    for s in fs.listStatus(target) if fs.exists(target) else []:
        name = s.getPath().getName()
        if name.startswith(f"{partition}=") and name.split("=", 1)[1] < before:
            fs.delete(s.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)


def prune_written(spark: SparkSession, path: str, partition: str, before: float) -> list[str]:
    """Delete partitions of a column that were last written before a time, in seconds since the epoch."""
    fs, target = _fs(spark, path)
    old = [s.getPath() for s in (fs.listStatus(target) if fs.exists(target) else []) if s.getPath().getName().startswith(f"{partition}=") and s.getModificationTime() < before * 1e3]
    for folder in old:
        fs.delete(folder, True)
    return sorted(f.getName().split("=", 1)[1] for f in old)
