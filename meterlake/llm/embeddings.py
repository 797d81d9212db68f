"""Embedding near-duplicates by cross-polytope hashing.

Vectors are normalised in double precision and padded with zeros to a power of
two.  A hash is the index and sign of the largest coordinate after three fast
Hadamard transforms with random signs (Andoni et al., 2015); a bucket joins
``HASHES`` of them, and there are ``TABLES`` tables.  Each vector is put in its
own bucket of every table and looks into ``PROBES`` more (or more still beyond
``PROBED_WIDTH`` dimensions): those whose loss of the largest coordinate is least.  Pairs that meet are verified by their cosine.

Plan.  Equal vectors are one node with a count, so a large group of copies costs
nothing.  Nodes within half the angle of a link from a pivot, the least node of
one of their buckets, are a ball: by the triangle inequality all its members are
linked with each other, so a tight cluster is verified by one pair a member.
Balls instead of nodes then meet in buckets, by a join on (table, bucket).  The
angle of two pivots and the radii of their balls prove that all members are
linked or that none are; only where they prove neither are members compared.
Most nodes outside clusters are balls of one, which are compared by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_batches, bounded, dropped, written
from .components import connected_components

TABLES, HASHES, PROBES = 8, 3, 12
#: Beyond this width (a power of two), ``PROBES`` more for each doubling.
PROBED_WIDTH = 128
#: Bytes of vectors that may be broadcast to verify pairs; beyond it they are joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: Radians by which angles must differ from a bound before they prove anything; far above their rounding errors.
MARGIN = 1e-6
SEED = 3
BUCKETS = "node long, dim int, table int, bucket long, own boolean"


#: The same result in DuckDB by comparing all pairs.
ORACLE = """
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS length FROM given
  WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.9
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM given UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT given.vec_id, coalesce(n, 0) AS n_links, component_id, given.vec_id = component_id AS kept
FROM given JOIN named USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, k: int) -> np.ndarray:
    """A pseudorandom rotation of each row."""
    signs = np.random.Generator(np.random.PCG64([SEED, table, k, x.shape[1]])).integers(0, 2, (3, x.shape[1])) * 2.0 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def bucket_probes(x: np.ndarray, table: int) -> np.ndarray:
    """Own bucket and the next ones of each unit row."""
    n, d = x.shape
    best, loss = [], []
    probes = PROBES * max(1, 1 + (d // PROBED_WIDTH).bit_length() - 1)
    take = min(probes + 1, 2 * d)
    for k in range(HASHES):
        y = rotated(x, table, k)
        both = np.concatenate([y, -y], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :take]
        value = np.take_along_axis(both, top, axis=1)
        best.append(top)
        loss.append((value[:, :1] - value) ** 2)
    bucket, total = best[0].astype(np.int64), loss[0]
    for k in range(1, HASHES):
        bucket = (bucket[:, :, None] * (2 * d) + best[k][:, None, :]).reshape(n, -1)
        total = (total[:, :, None] + loss[k][:, None, :]).reshape(n, -1)
        keep = np.argsort(total, axis=1, kind="stable")[:, : probes + 1]
        bucket, total = np.take_along_axis(bucket, keep, axis=1), np.take_along_axis(total, keep, axis=1)
    return bucket[:, : probes + 1]


def _buckets(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            flat = batch.column(1).flatten().to_numpy()
            start = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for part in np.array_split(rows, max(1, len(rows) * int(dim) // 500_000)):
                    x = flat[start[part][:, None] + np.arange(dim)]
                    width = 1 << max(1, int(dim - 1).bit_length())
                    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - int(dim))))
                    for table in range(TABLES):
                        b = bucket_probes(x, table)
                        count = b.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat(node[part], count)),
                                pa.array(np.full(b.size, dim, dtype=np.int32)),
                                pa.array(np.full(b.size, table, dtype=np.int32)),
                                pa.array(b.ravel()),
                                pa.array(np.tile(np.arange(count) == 0, len(part))),
                            ],
                            names=["node", "dim", "table", "bucket", "own"],
                        )

    return nodes.select("node", "v", "dim").mapInArrow(run, BUCKETS)


def _cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, cos, angle`` of pairs of nodes."""
    a = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"))
    b = nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).value_lengths().to_numpy()
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            x, y = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            dot, xx, yy = (np.add.reduceat(p, start) for p in (x * y, x * x, y * y))
            cos = dot / (np.sqrt(xx) * np.sqrt(yy))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos), pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["a", "b", "cos", "angle"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cos double, angle double")


def _balls(own: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """``node, ball, angle``: the least pivot of a node's own buckets within ``reach`` of it, else itself, and the angle to it.

    Where that pivot is in another's ball, the other is tried too, which brings the parts of a cluster together.
    """
    place = ["dim", "table", "bucket"]
    pivots = own.groupBy(*place).agg(F.min("node").alias("a"))
    close = lambda pairs: _cosines(pairs, nodes).where(F.col("angle") <= reach).groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.col("a").alias("ball"), "angle")).alias("near"))
    near = close(own.join(pivots, place).where("node <> a").select("a", F.col("node").alias("b")).distinct())
    itself = F.struct(F.col("node").alias("ball"), F.lit(0.0).alias("angle"))
    balls = written(nodes.select("node").join(near, "node", "left").select("node", F.coalesce("near", itself).alias("near")).select("node", "near.*"), "balls")
    if balls.where("ball <> node").isEmpty():
        return balls
    up = balls.select(F.col("node").alias("ball"), F.col("ball").alias("a"))
    nearer = close(balls.join(up, "ball").where("a <> ball").select("a", F.col("node").alias("b")))
    moved = balls.join(nearer, "node", "left").select("node", F.coalesce("near", F.struct("ball", "angle")).alias("near"))
    out = written(moved.select("node", "near.*"), "balls")
    dropped(balls)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Vectors linked by a cosine of at least ``least``, and their groups.

    Inputs ``vec_id`` and ``embedding`` (numbers), others are ignored.
    Output, one row per input row: ``vec_id, n_links, component_id, kept``.
    Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing, as do rows with a null id (whose component is null, and which
    are kept).  Only vectors of one length are compared.  Equal vectors are
    always linked; of other pairs all found ones are, and none below ``least``.
    An empty table gives none.
    Rows that share a ``vec_id`` are separate vectors under one name.
    """
    arrow_batches(vectors.sparkSession)
    value = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    peak = F.array_max(F.transform(value, lambda x: F.abs(x)))
    # divided by the power of two next to the largest number, so that squares neither overflow nor vanish; + 0.0 makes -0.0 equal to 0.0
    unit = F.transform(value, lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(peak))) + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(fine, F.lit(False)), unit).alias("v"))
    # two hashes name a vector when rows meet their node again, so that vectors are shuffled once
    key = ["k1", "k2"]
    rows = written(rows.select("*", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(SEED), "v").alias("k2")), "vectors")
    good = rows.where("v is not null")
    nodes = good.groupBy("v", *key).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    # the first id names the node, unless different vectors share it: then all but one are named by their hash
    first = F.row_number().over(Window.partitionBy("first_id").orderBy("k1", "k2")) == 1
    nodes = nodes.withColumn("node", F.when(first, F.col("first_id")).otherwise(F.col("k1")))
    nodes = written(nodes, "nodes")
    whole = math.acos(least)

    buckets = written(_buckets(nodes), "buckets")
    size = nodes.agg(F.coalesce(F.sum(8 * F.col("dim").cast("long") + 32), F.lit(0))).first()[0]
    vectors = F.broadcast(nodes.select("node", "v")) if size <= BROADCAST_BYTES else nodes.select("node", "v")
    placed = _balls(buckets.where("own").drop("own"), vectors, whole / 2 - MARGIN)
    members = written(nodes.drop("v", "dim").join(placed, "node"), "members")
    balls = written(members.groupBy("ball").agg(F.sum("copies").alias("size"), F.max("angle").alias("radius"), F.min("first_id").alias("first_id")), "balls")

    at = members.select("node", "ball")
    at = F.broadcast(at) if bounded(at, BROADCAST_IDS) else at
    held = buckets.join(at, "node").groupBy("dim", "table", "bucket", "ball").agg(F.max("own").alias("own"))
    own, look = held.where("own").alias("own"), held.alias("look")
    same = (F.col("own.table") == F.col("look.table")) & (F.col("own.bucket") == F.col("look.bucket")) & (F.col("own.dim") == F.col("look.dim"))
    # two balls that both have their own members in a bucket meet twice; keep one order
    once = (F.col("own.ball") != F.col("look.ball")) & (~F.col("look.own") | (F.col("own.ball") < F.col("look.ball")))
    pairs = own.join(look, same & once).select(F.least("own.ball", "look.ball").alias("a"), F.greatest("own.ball", "look.ball").alias("b")).distinct()
    radius = balls.select("ball", "radius")
    met = _cosines(pairs, vectors).join(radius.toDF("a", "ra"), "a").join(radius.toDF("b", "rb"), "b").withColumn("spread", F.col("ra") + F.col("rb"))
    single = F.col("spread") == 0
    met = met.withColumn("sure", F.when(single, F.col("cos") >= least).otherwise(F.col("angle") + F.col("spread") <= whole - MARGIN))
    met = written(met.where(F.col("sure") | (~single & (F.col("angle") - F.col("spread") <= whole + MARGIN))).select("a", "b", "sure"), "met")
    sure, doubt = met.where("sure").select("a", "b"), met.where("not sure").select("a", "b")

    # members of balls that may be linked in part
    left, right = members.select(F.col("ball").alias("a"), F.col("node").alias("na")), members.select(F.col("ball").alias("b"), F.col("node").alias("nb"))
    compared = doubt.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    links = written(_cosines(compared, vectors).where(F.col("cos") >= least).select("a", "b"), "links")

    def linked(both: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
        both = both.union(both.select("b", "a")).toDF("at", "other")
        return both.join(sizes.toDF("other", "n"), "other").groupBy(F.col("at").alias(name)).agg(F.sum("n").alias(f"linked_{name}"))

    ball_of = members.select("node", "ball")
    between = links.join(ball_of.toDF("a", "ball_a"), "a").join(ball_of.toDF("b", "ball_b"), "b").select("ball_a", "ball_b").distinct()
    labels = connected_components(sure.union(between)).withColumnRenamed("node", "ball")
    named = balls.join(labels, "ball", "left").withColumn("label", F.coalesce("component", "ball"))
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(names, "label").join(linked(sure, balls.select("ball", "size"), "ball"), "ball", "left").select("ball", "size", "linked_ball", "component_id")
    counted = members.select(*key, "node", "ball").join(linked(links, members.select("node", "copies"), "node"), "node", "left").join(named, "ball")
    found = counted.select(*key, (F.col("size") - 1 + F.coalesce("linked_ball", F.lit(0)) + F.coalesce("linked_node", F.lit(0))).alias("n_links"), "component_id")
    out = good.select("vec_id", *key).join(found, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
