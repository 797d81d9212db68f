import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import sharding
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents, odd_rows


def plain_packing(sizes, capacity):
    """The bin of each item, in falling order of sizes, by scanning all bins."""
    room, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(left, b) for b, left in enumerate(room) if left >= size]
        if fits:
            out.append(min(fits)[1])
        else:
            out.append(len(room))
            room.append(max(capacity, size))
        room[out[-1]] -= size
    return out


def packed(sizes, capacity):
    distinct = sorted(set(sizes), reverse=True)
    runs = sharding.best_fit_decreasing(distinct, [sizes.count(s) for s in distinct], capacity)
    return [b for own in runs for k, b in own for _ in range(k)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(40, 80))
def test_packing_agrees_with_a_scan_over_the_bins(sizes, capacity):
    assert packed(sizes, capacity) == plain_packing(sizes, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([8, 9, 20, 33, 90]), min_size=1, max_size=40), st.integers(2, 6))
def test_bins_suffice_at_the_capacity_found(sizes, bins):
    distinct = sorted(set(sizes), reverse=True)
    runs = sharding.balanced_bins(distinct, [sizes.count(s) for s in distinct], bins)
    where = [b for own in runs for k, b in own for _ in range(k)]
    assert len(where) == len(sizes) and max(where) < bins
    loads = [sum(s for s, b in zip(sorted(sizes, reverse=True), where, strict=True) if b == k) for k in range(bins)]
    assert where == plain_packing(sizes, max(loads)) or max(loads) <= 2 * max(sum(sizes) / bins, max(sizes))


def test_tree_finds_the_least_key_above():
    rng, tree, plain = random.Random(0), sharding.BalancedTree(), set()
    for _ in range(3_000):
        if plain and rng.random() < 0.4:
            key = (rng.randrange(500), -1)
            above = [k for k in plain if k >= key]
            got = tree.take_ceiling(key)
            assert got == (min(above) if above else None)
            plain.discard(got)
        else:
            key = (rng.randrange(500), rng.randrange(1_000))
            if key not in plain:
                plain.add(key)
                tree.add(key)


def test_bins_are_level():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 1000) for _ in range(2_000)), reverse=True)
    distinct = sorted(set(sizes), reverse=True)
    runs = sharding.balanced_bins(distinct, [sizes.count(s) for s in distinct], 24)
    where = [b for own in runs for k, b in own for _ in range(k)]
    loads = [sum(s for s, b in zip(sizes, where, strict=True) if b == k) for k in range(24)]
    assert max(loads) - min(loads) < 0.01 * max(loads) and sum(loads) == sum(sizes)


def check(rows, docs, shards=24):
    got = rows.collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return got


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = check(sharding.sharded(docs), docs)
    loads, homes = {}, {}
    for r in got:
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(loads) == 24 and max(loads.values()) < 1.01 * min(loads.values())
    assert all(len(s) == 1 for s in homes.values())
    # brute force: every group packed by itself, by scanning the bins at the capacity that the fullest shard shows
    size = {t: sum(r.size for r in got if texts[r.doc_id] == t) for t in homes}
    items = sorted(size.values(), reverse=True)
    expect = [0] * 24
    for s, b in zip(items, plain_packing(items, max(loads.values())), strict=True):
        expect[b] += s
    assert sorted(expect) == sorted(loads.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_a_group_above_a_shard_is_split(spark):
    rows = [(i, "the same text again and again") for i in range(900)] + [(1000 + i, f"text {i} " * 3) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads = {}
    for r in check(sharding.sharded(docs), docs):
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_repeated_rows_and_null_ids_spread(spark):
    rows = [(None, "the same text again and again")] * 900 + [(7, "text of one id")] * 900 + [(1000 + i, f"text {i} " * 3) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads = {}
    for r in check(sharding.sharded(docs, 6), docs, 6):
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(loads) == 6 and max(loads.values()) < 1.1 * min(loads.values())


def test_odd_and_no_documents(spark):
    docs = odd_documents(spark)
    got = check(sharding.sharded(docs), docs)
    sizes = sorted(8 + len((t or "").encode()) for _, t, *_ in odd_rows())
    assert sorted(r.size for r in got) == sizes and {r.doc_id for r in got if r.text_crc32 is None} == {5, None}
    assert sharding.sharded(no_documents(spark)).count() == 0
