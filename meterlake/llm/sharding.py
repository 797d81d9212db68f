"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are sorted by size, and each enters the bin with the tightest remaining
capacity that holds it, found in a balanced tree.  For a given number of shards
the capacity is the smallest (by bisection) at which the packing needs no more bins.

Groups are equal texts, and every group is packed by itself.  Packing depends on
sizes alone, so the driver holds the distinct sizes of groups with their counts, of which
there are at most the square root of twice all bytes.  Of equal items, best fit
puts as many as it holds in the tightest bin and then goes on to the next: such a
run is one step.  A group above a whole shard can't stay whole in
shards of near equal size: it is split by a hash of the document's id into
pieces of about half a shard (at most two for each shard).

Groups of one size are ranked in hash buckets of about ``BUCKET_ROWS`` groups and find the bin
of their rank's run by a join on the size; rows find their group's bin by a join on the
group.  Equal rows are one with a count until then.  Slots number the rows
of a shard in buckets as well, so no task ever holds a shard, a size or a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, copied, dropped, written

BUCKET_ROWS = 20_000


@dataclass
class _Node:
    key: tuple[int, int]
    rank: int
    left: _Node | None = None
    right: _Node | None = None


class BalancedTree:
    """A treap of distinct keys; ranks are hashes of a counter, so runs agree."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self._count = 0

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, key: tuple[int, int]) -> None:
        self._count += 1
        new = _Node(key, self._count * 0x9E3779B97F4A7C15 % (1 << 64))
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, new), b)

    def take_ceiling(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Remove and return the smallest key that isn't below ``key``."""
        node, best = self.root, None
        while node is not None:
            node, best = (node.right, best) if node.key < key else (node.left, node.key)
        if best is not None:
            a, b = self._split(self.root, best)
            _, c = self._split(b, (best[0], best[1] + 1))
            self.root = self._merge(a, c)
        return best


def best_fit_decreasing(sizes: Sequence[int], counts: Sequence[int], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Runs (items, bin) of each distinct size, given in falling order, with its count.

    An item above the capacity has a bin of its own.  None if it takes more than ``most`` bins.
    """
    tree, bins, out = BalancedTree(), 0, []
    for size, count in zip(sizes, counts, strict=True):
        runs: list[tuple[int, int]] = []
        while count:
            got = tree.take_ceiling((size, -1))
            if got is None:
                if bins == most:
                    return None
                got, bins = (max(capacity, size), bins), bins + 1
            fit = min(count, got[0] // size) if size else count
            runs.append((fit, got[1]))
            tree.add((got[0] - fit * size, got[1]))
            count -= fit
        out.append(runs)
    return out


def balanced_bins(sizes: Sequence[int], counts: Sequence[int], bins: int) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing at the smallest capacity found for which ``bins`` bins suffice: steps from the least possible one double until they do, then halve."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    low = max([-(-total // bins), *sizes[:1], 1])
    best = best_fit_decreasing(sizes, counts, low, bins)
    failed, high, step = low, low, 1
    while best is None:
        failed, high, step = high, low + step, 2 * step
        best = best_fit_decreasing(sizes, counts, high, bins)
    while high - failed > 1:
        middle = (failed + high) // 2
        got = best_fit_decreasing(sizes, counts, middle, bins)
        failed, high, best = (middle, high, best) if got is None else (failed, middle, got)
    return best


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document's shard under the law ``bytes``: sizes near equal, equal texts together.

    Inputs ``doc_id, text``, others are ignored.  Output, one row per input
    row: ``doc_id, size`` (UTF-8 bytes + 8), ``text_crc32, law, shard, slot,
    grown_shard``; slots of a shard run from 0 without gaps.  Null texts count no bytes,
    have a null crc32, and are one group.  Null ids and repeated rows are documents like
    others.  An empty table gives no rows.  Reruns agree, however rows are partitioned.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text.isNull(), text).alias("g1"),
        F.xxhash64(F.lit(2), text).alias("g2"),
    )
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "documents")
    n, total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()
    fair = max(-(-total // shards), 1)
    groups = written(rows.groupBy("g1", "g2").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "groups")
    large = groups.where(F.col("bytes") > fair).collect()  # fewer than shards
    pieces = F.broadcast(spark.createDataFrame([(r.g1, r.g2, -(-2 * r.bytes // fair)) for r in large], "g1 long, g2 long, pieces long"))
    single = copied(rows, "copies", "copy").join(pieces, ["g1", "g2"], "left")
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(F.lit(3), "doc_id", "copy"), F.col("pieces"))).otherwise(F.lit(0))
    single = single.withColumn("piece", piece.cast("long"))
    split = single.where("pieces is not null").groupBy("g1", "g2", "piece").agg(F.sum("size").alias("bytes"))
    items = groups.join(pieces, ["g1", "g2"], "left_anti").select("g1", "g2", F.lit(0).cast("long").alias("piece"), "bytes").unionByName(split)
    if large:
        items = written(items, "items")

    per_size = items.groupBy("bytes").count().orderBy(F.desc("bytes")).toArrow()
    sizes, counts = per_size.column("bytes").to_pylist(), per_size.column("count").to_pylist()
    runs = balanced_bins(sizes, counts, shards) if sizes else []
    upto = [list(accumulate(k for k, _ in own)) for own in runs]
    table = pa.table({"bytes": pa.array(sizes, pa.int64()), "upto": pa.array(upto, pa.list_(pa.int64())), "bins": pa.array([[b for _, b in own] for own in runs], pa.list_(pa.int32()))})
    table = spark.createDataFrame(table)
    table = F.broadcast(table) if len(sizes) <= BROADCAST_IDS else table.hint("merge")

    ranked = _numbered(items, ["bytes"], ["g1", "g2", "piece"], max(1, sum(counts) // BUCKET_ROWS), "rank").join(table, "bytes")
    bin_ = F.element_at("bins", (F.size(F.filter("upto", lambda x: x <= F.col("rank"))) + 1).cast("int"))
    found = written(ranked.select("g1", "g2", "piece", bin_.alias("shard")), "found")
    dropped(groups)

    put = single.join(found.hint("merge"), ["g1", "g2", "piece"])
    put = _numbered(put, ["shard"], ["doc_id", "g1", "g2", "copy"], max(1, n // (shards * BUCKET_ROWS)), "slot")
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, keys: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Rows numbered from 0 without gaps within each key, by hash buckets of the (unique) order columns and the order in them."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), *order), F.lit(buckets)))
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order)
    out = rows.withColumn("inside", F.row_number().over(inside) - 1).join(counts, [*keys, "bucket"])
    return out.withColumn(name, (F.col("base") + F.col("inside")).cast("long")).drop("base", "inside", "bucket")
