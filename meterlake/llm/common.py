"""What the operators share: the shared folder, written intermediate tables, stable sampling."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark import Broadcast

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that may be broadcast (16 bytes a row at most); beyond it joins shuffle.
BROADCAST_IDS = 500_000
#: Rows and bytes that an Arrow batch may hold before Python sees it.
ARROW_BATCH_ROWS, ARROW_BATCH_BYTES = 1_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or (only where it is unset and all runs in one process, as in tests) a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="meterlake-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meterlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meterlake_path = path  # type: ignore[attr-defined]
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_meterlake_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package's source to the executors, once an application, so that their Python workers can import it."""
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _shipped or not package.is_dir():
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="meterlake-")) / f"{package.name}-{app}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def arrow_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: ship the package, and bound Arrow batches for tables with very long texts."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def uniform(column: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the value and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows."""
    return df.count() <= limit


def copied(rows: DataFrame, count: str, number: str) -> DataFrame:
    """Each row as often as its ``count`` says, numbered from 0; in two steps, so that no row holds a long list."""
    step = 1 << 14
    first = rows.withColumn("copied_from", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(count) - 1).cast("long"), F.lit(step).cast("long"))))
    last = F.least(F.col("copied_from") + (step - 1), F.col(count) - 1)
    return first.withColumn(number, F.explode(F.sequence("copied_from", last))).drop("copied_from", count)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Slots of :func:`likely_in`: the most rows that it broadcasts.
ID_SLOTS = 1 << 20


def likely_in(rows: DataFrame, ids: DataFrame, column: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows whose id hashes to a slot of one of ``ids`` (``left_anti``: the others, which are surely not among them).

    A filter of fixed size before an exact join: at most ``ID_SLOTS`` numbers
    are broadcast, however many ids there are, and few other rows pass while
    the ids are few.  Large rows then needn't be shuffled to be found.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(ID_SLOTS))
    name = fresh(rows, "id_slot")
    taken = ids.select(slot(column).alias(name)).distinct()
    return rows.join(F.broadcast(taken), slot(column) == F.col(name), how)


#: Address bits of :func:`bitmap`, at least and at most: 128 KB to 128 MB.
BITMAP_BITS = (20, 30)


def bitmap(keys: DataFrame, column: str, expected: int) -> Broadcast:
    """A broadcast bitmap with the low bits of the keys set, of about 16 bits for each of the expected keys within ``BITMAP_BITS``.

    However many keys there are, no more than the largest bitmap is gathered and broadcast; the fuller it
    is, the more other keys pass it.
    """
    size = min(max(int(16 * expected).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    place = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
    word = F.shiftright(place, 6)
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    rows = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be among those of the bitmap; none of them is missed."""
    place = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
