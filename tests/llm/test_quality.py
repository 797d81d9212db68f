import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import quality
from tests.conftest import SMALL
from tests.llm.cases import no_documents, odd_documents


def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def test_sample_follows_the_labels_and_stage_agrees(spark):
    docs, labels = tables(spark)
    rows, model = quality.sampled(docs, labels)
    got = rows.toPandas()
    known = got.merge(labels.toPandas(), on="doc_id")
    assert known[known.quality == 0].selected.mean() < 0.05
    assert known[known.quality == 1].selected.mean() > 0.97
    assert got.selected.sum() == (got.weight >= model.threshold).sum()
    kept = quality.resampled(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(got[got.selected].doc_id)


def test_weights_agree_with_a_plain_count(spark):
    docs, labels = tables(spark)
    docs = docs.where("doc_id < 60")
    rows, _ = quality.sampled(docs, labels)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}

    def grams(data):
        code = [int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)]
        return [(c * 2654435761 % 2**32) >> (32 - quality.BUCKET_BITS) for c in code]

    def pairs(data):
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in data.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if x]
        return [quality.REPEATED if a == b else quality.NEW for a, b in zip(w, w[1:], strict=False)]

    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, data in texts.items():
        for b in grams(data) + pairs(data):
            raw[b] += 1
            target[b] += i in good
    ratio = np.zeros(quality.BUCKETS)
    for kind in (slice(0, quality.NEW), slice(quality.NEW, None)):
        p, q = (raw[kind] + 1) / (raw[kind] + 1).sum(), target[kind] / target[kind].sum()
        ratio[kind] = np.log((1 - quality.SMOOTHING) * q + quality.SMOOTHING * p) - np.log(p)
    for r in rows.collect():
        expect = sum(ratio[b] for b in grams(texts[r.doc_id]) + pairs(texts[r.doc_id]))
        assert r.log_weight == pytest.approx(expect, rel=1e-9, abs=1e-6)


def test_top_k_is_exact(spark):
    keys = spark.range(5_000).select((F.xxhash64("id") % 1_000_003 * 977).alias("k"))
    sorted_keys = sorted((r.k for r in keys.collect()), reverse=True)
    for k in (1, 2, 77, 4_999, 5_000):
        assert quality._kth_largest(keys, "k", k) == sorted_keys[k - 1]
    docs, labels = tables(spark)
    rows, _ = quality.sampled(docs, labels, k=100)
    assert rows.where("selected").count() == 100


def test_odd_and_no_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (14, 1), (15, 1), (13, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    docs = odd_documents(spark)
    rows, _ = quality.sampled(docs, labels)
    got = rows.collect()
    assert len(got) == docs.count()
    assert all(not r.selected for r in got if r.n_grams == 0) and {r.doc_id for r in got if r.n_grams == 0} == {4, 5, None}
    assert quality.resampled(docs, labels).columns == docs.columns
    assert quality.sampled(no_documents(spark), labels)[0].count() == 0
    everything, _ = quality.sampled(docs, labels.where("false"))
    assert everything.where("selected").count() == everything.where("n_grams > 0").count()
