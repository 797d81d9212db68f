import math
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import mixing
from tests.conftest import SMALL, TINY
from tests.llm.cases import no_documents, odd_documents
from tests.llm.test_text import plain_words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=9))
def test_targets_fill_up_below_their_limits(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.water_filled(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(0 <= t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if s and t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(max(free), 1)
    full = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if s and t >= 3 * s - 1e-6]
    assert not free or not full or max(full) <= min(free) + 1e-6


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 97, 1000, 4099):
        for key in (0, 5, 10**12):
            i, m, k = np.arange(n), np.full(n, n), np.full(n, key)
            to = mixing.Permutation.of(i, m, k)
            assert sorted(to) == list(range(n))
            assert (mixing.Permutation.of(to, m, k, inverse=True) == i).all()


def feistel(i, n, key):
    """The permutation for one number, in plain integers."""
    low = max(math.isqrt(n - 1) + 1 if n > 1 else 1, 1)
    high, mask = max(-(-n // low), 1), (1 << 64) - 1

    def noise(value, step):
        x = (value * 0x9E3779B97F4A7C15 + key * 0xC2B2AE3D27D4EB4F + step * 0xD6E8FEB86659FD93) & mask
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        return (x ^ x >> 32) >> 1

    while True:
        a, b = i % low, i // low
        for step in range(mixing.ROUNDS):
            if step % 2:
                b = (b + noise(a, step) % high) % high
            else:
                a = (a + noise(b, step) % low) % low
        i = b * low + a
        if i < n:
            return i


def brute(rows, block, shards, drawn, seed=mixing.SEED):
    """The output shards' words and what is taken of each row, from the draws alone: all words of a source laid out, slots walked one by one.

    ``rows`` are (doc_id, words, source, place), ``drawn`` slots by shard and source.
    """
    sources = sorted({s for _, _, s, _ in rows if s is not None}) + [None] * any(s is None for _, _, s, _ in rows)
    size = [sum(len(w) for _, w, s, _ in rows if s == source) for source in sources]
    target = mixing.water_filled(size, [1 + i % 3 for i in range(len(sources))])
    taken, output = {}, {k: Counter() for k in range(shards)}
    for number, source in enumerate(sources):
        own = sorted((r for r in rows if r[2] == source), key=lambda r: r[3])
        laid = [(i, w) for i, (_, ws, _, _) in enumerate(own) for w in ws]
        blocks, left = -(-size[number] // block), min(round(target[number]), 3 * size[number])
        homes = [k for k in range(shards) for _ in range(int(drawn[k][number]))]
        for slot, home in enumerate(homes):
            at = feistel(slot % blocks, blocks, (number * 8 + slot // blocks) * 1_000_003 + seed)
            words = laid[at * block : (at + 1) * block][: max(left, 0)]
            left -= len(words)
            for i, w in words:
                output[home][w] += 1
                got = taken.setdefault((own[i][0], source), [0, set()])
                got[0] += 1
                got[1].add(home)
        assert left == 0
    return taken, output


def told(docs, block, shards):
    """Rows for :func:`brute`, and the draws of the operator's plan."""
    from pyspark.sql import functions as F

    rows = [(r.doc_id, regex.findall(r"[^\x20\x09-\x0D]+", r.text or ""), r.source, r.p) for r in docs.select("doc_id", "text", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("p")).collect()]
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    size = [sum(len(r[1]) for r in rows if r[2] == s) for s in names]
    plan = mixing.Plan.make(size, mixing.water_filled(size, [1 + i % 3 for i in range(len(size))]), block, shards, mixing.SEED)
    return rows, plan.drawn


@pytest.mark.parametrize("block", [16, 100_000])
def test_documents_agree_with_a_walk_over_the_draws(spark, block):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows, drawn = told(docs, block, 4)
    taken, output = brute(rows, block, 4, drawn)
    got = mixing.mixture(docs, block=block, shards=4)[0].collect()
    assert {(r.doc_id, r.source): (r.taken, r.output_shards) for r in got if r.taken} == {k: (n, sorted(s)) for k, (n, s) in taken.items()}
    mixed, order = {k: Counter() for k in range(4)}, {}
    for r in mixing.packed(docs, block=block, shards=4).collect():
        words = r.text.split(" ")
        assert len(words) == r.n_words
        mixed[r.output_shard].update(words)
        order.setdefault((r.output_shard, r.place_in_shard), []).append((r.first_word_in_slot, r.n_words))
    assert mixed == output
    for k, row in enumerate(drawn):
        assert sorted(p for s, p in order if s == k) == list(range(int(row.sum())))
    for pieces in order.values():  # a slot is filled without gaps
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))


def test_other_draws_give_another_mix(spark, monkeypatch):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    before = {r.doc_id: tuple(r.output_shards) for r in mixing.mixture(docs, block=16, shards=4)[0].collect()}
    make = mixing.Plan.make.__func__

    def turned(cls, *args):
        plan = make(cls, *args)
        plan.drawn[2] = plan.drawn.sum(axis=0)
        plan.drawn[[0, 1, 3]] = 0
        return plan

    monkeypatch.setattr(mixing.Plan, "make", classmethod(turned))
    after = {r.doc_id: tuple(r.output_shards) for r in mixing.mixture(docs, block=16, shards=4)[0].collect()}
    assert after == {k: (2,) * bool(v) for k, v in before.items()} != before


def test_repeated_rows_stand_side_by_side(spark):
    rows = [(None, "a b c", "x")] * 50 + [(1, "d e f g", "x")] * 7 + [(i, f"w{i} " * 9, "y") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, block=8)[0].collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    again = mixing.mixture(docs.repartition(5), block=8)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_are_met_and_runs_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    taken, slots = mixing.mixture(docs)
    got = taken.toPandas()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {r.doc_id: len(plain_words(r.text)) for r in docs.collect()}
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (by["size"] == by.source_size).all()
    assert (got.taken <= 3 * got["size"]).all()
    again, _ = mixing.mixture(docs.repartition(7))
    assert sorted(map(tuple, again.select("doc_id", "taken").collect())) == sorted(zip(got.doc_id, got.taken, strict=True))
    shards = slots.groupBy("output_shard").count().collect()
    assert len(shards) == mixing.OUTPUT_SHARDS and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
    per_block = slots.groupBy("source_no", "block", "epoch").count()
    assert per_block.where("count > 1").count() == 0


def test_a_small_source_stops_at_three_times_its_size(spark):
    rows = [(1, "a b c d", "x")] + [(i, "w " * 50, "y") for i in range(2, 30)]
    taken, _ = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1), block=8)
    got = {r.doc_id: r for r in taken.collect()}
    assert got[1].taken == 12 and got[1].target == 12
    assert sum(r.taken for r in got.values()) == sum(r.size for r in got.values())


def test_odd_and_no_documents(spark):
    docs = odd_documents(spark)
    taken, _ = mixing.mixture(docs, block=16)
    got = taken.collect()
    assert len(got) == docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in by.values()) and None in by
    kept = mixing.mixed(docs, block=16)
    assert kept.columns == docs.columns and kept.where("text is null or doc_id is null").count() == 0
    assert mixing.mixture(no_documents(spark))[0].count() == 0 and mixing.mixed(no_documents(spark)).count() == 0


def test_whole_documents_meet_the_targets(spark):
    """A hot source of documents of 20,000 words, of which the mix takes 0.15, among sources taken 0.7 to 2.1 times."""
    from pyspark.sql import functions as F

    numbers = [(i, 1 if i < 60 else 2 + i % 19) for i in range(60 + 19 * 40)]
    docs = spark.createDataFrame(numbers, "doc_id long, n int").select("doc_id", F.when(F.col("n") == 1, F.lit("s01")).otherwise(F.format_string("s%02d", F.when(F.col("n") == 2, 0).otherwise(F.col("n")))).alias("source"), F.expr("repeat('word ', if(n = 1, 20000, 3158))").alias("text"))
    taken, _ = mixing.mixture(docs)
    targets = {r.source: r for r in taken.groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("largest"), F.sum("size").alias("size")).collect()}
    got = {r.source: r.words for r in mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("words")).collect()}
    assert len(targets) == 20 and 0.14 < targets["s01"].target / targets["s01"]["size"] < 0.16
    assert all(abs(got.get(k, 0) - t.target) < 2 * t.largest for k, t in targets.items())
    again = mixing.mixed(docs.repartition(7)).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.mixed(docs).groupBy("doc_id").count().collect()))
