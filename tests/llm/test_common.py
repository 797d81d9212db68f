import random

import numpy as np
from pyspark.sql import functions as F

from meterlake.llm import common
from meterlake.llm.components import connected_components


def test_components_agree_with_a_walk(spark):
    rng = random.Random(6)
    links = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 5001 + i) for i in range(60)]  # a chain and a star
    links += [(7, 7), (None, 8), (9, None), links[0]]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            group[high] = low
    frame = spark.createDataFrame(links, "a long, b long")
    assert {(r.node, r.component) for r in connected_components(frame).collect()} == {(x, find(x)) for x in group}
    assert connected_components(frame.where("false")).count() == 0


def test_filters_miss_no_id(spark):
    ids = spark.range(0, 4_000, 7).withColumnRenamed("id", "doc_id")
    rows = spark.range(5_000).selectExpr("id as doc_id", "1 as id_slot").unionByName(spark.createDataFrame([(None, 1)], "doc_id long, id_slot int"))
    kept = {r.doc_id for r in common.likely_in(rows, ids).collect()}
    left = {r.doc_id for r in common.likely_in(rows, ids, how="left_anti").collect()}
    assert kept >= {r.doc_id for r in ids.collect()} and not kept & left and len(kept | left) == 5_001 and None in left
    assert len(kept) < 600


def test_bitmap_misses_no_key(spark):
    keys = spark.range(3_000).select(F.xxhash64("id").alias("key"))
    bits = common.bitmap(keys, "key", 3_000).value
    held = np.array([r.key for r in keys.collect()], dtype=np.int64)
    assert common.in_bitmap(bits, held).all()
    other = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 10_000)
    assert common.in_bitmap(bits, other).mean() < 0.01


def test_written_tables_keep_their_schema_and_can_be_dropped(spark):
    made = common.written(spark.createDataFrame([(1, [1, 2], b"x")], "a long, b array<long>, c binary"), "t")
    assert made.first().c == b"x" and made.dtypes == [("a", "bigint"), ("b", "array<bigint>"), ("c", "binary")]
    common.dropped(made, spark.range(1))
    empty = common.written(spark.range(0), "t")
    assert empty.count() == 0


def test_names_and_numbers(spark):
    frame = spark.createDataFrame([(1, 2)], "Name long, name_ long")
    assert common.fresh(frame, "name") == "name__" and common.fresh(frame, "other") == "other"
    numbers = [r.u for r in spark.range(2_000).select(common.uniform(F.col("id"), 3).alias("u")).collect()]
    assert 0 < min(numbers) < 0.01 and 0.99 < max(numbers) < 1 and abs(np.mean(numbers) - 0.5) < 0.03
