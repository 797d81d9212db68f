"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (Xie et al., 2023): byte trigrams,
since junk shows in its characters, and word pairs reduced to whether a word
repeats the one before.  One is of target text, the documents labelled as good,
and one of raw text, all documents.  A document's
importance weight is the likelihood ratio of the two; it is taken per trigram,
so that long and short documents compare.  Documents are drawn without
replacement by Gumbel top-k: the k largest of log weight / temperature + Gumbel
noise, where the noise is a function of the document's id.  k defaults to the
number of documents that the weight accepts at the threshold which separates
the labelled rows best.

The models are counted over all documents in one pass; target trigrams and the
threshold come from at most ``MAX_LABELS`` labelled rows, those with the
smallest hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, fresh, uniform, written
from .text import Words, slices

#: Labelled rows that the target model and the threshold are fitted on, at most.
MAX_LABELS = 20_000
BUCKET_BITS = 14
#: Share of the raw model that is mixed into the target model.
SMOOTHING = 0.01
#: Trigrams with a log ratio of 0 that are added to each document.
SHRINK = 20
TEMPERATURE = 0.002
#: Sampling keys are whole numbers of this many parts of 1.
KEY_SCALE = 1_000_000
SEED = 4
SCORED = "doc_id long, n_grams long, log_weight double, weight double, sample_key long"


#: Buckets of word pairs: a new word, a repeated word.
NEW, REPEATED = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + 1
BUCKETS = (1 << BUCKET_BITS) + 2


def word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word pairs with a new and with a repeated second word in each text."""
    w = Words(data, offsets)
    same = np.concatenate([[0, 0], np.cumsum(w.hashes[1:] == w.hashes[:-1])])[: len(w.hashes) + 1]
    pairs = np.maximum(np.diff(w.bounds) - 1, 0)
    repeated = np.where(pairs > 0, same[w.bounds[1:]] - same[np.minimum(w.bounds[:-1] + 1, len(w.hashes))], 0)
    return pairs - repeated, repeated


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and first and end position of each text's trigrams."""
    code = data.astype(np.uint32)
    both = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:] if len(code) > 2 else np.zeros(0, np.uint32)
    bucket = (both * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    first = np.minimum(offsets[:-1], len(bucket))
    return bucket, first, np.maximum(np.minimum(offsets[1:] - 2, len(bucket)), first)


@dataclass
class QualityModel:
    log_ratio: np.ndarray
    threshold: float = 0.0
    least_key: int | None = None

    def weights(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of trigrams and log weight of each text."""
        n, total = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        for row, end, data, offsets in slices(column):
            bucket, first, last = trigrams(data, offsets)
            run = np.concatenate([[0.0], np.cumsum(self.log_ratio[bucket])])
            new, repeated = word_pairs(data, offsets)
            n[row:end] = last - first
            total[row:end] = run[last] - run[first] + new * self.log_ratio[NEW] + repeated * self.log_ratio[REPEATED]
        return n, total

    def keys(self, weight: np.ndarray, gumbel: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.rint(np.clip((weight - self.threshold) / TEMPERATURE + gumbel, -1e6, 1e6) * KEY_SCALE).astype(np.int64)


def _per_gram(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log weight per trigram; texts without a trigram get -inf."""
    return np.where(n > 0, total / (n + SHRINK), -np.inf)


def _gumbel(seed: int) -> F.Column:
    return -F.log(-F.log(uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), seed)))


def _sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids with their labels: those with the smallest hashes."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELS) -> QualityModel:
    """Count both models over all of ``docs`` and set the threshold on the labelled rows.

    Without good labelled rows, or without bad ones, every text with a trigram is accepted.
    """
    arrow_batches(docs.sparkSession)
    got = _sample(labels, label, limit).toPandas()
    good = np.sort(got.doc_id[got.label > 0].to_numpy(dtype=np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            chosen = np.isin(ids, good) & np.asarray(batch.column(0).is_valid())
            for row, end, data, offsets in slices(batch.column(1)):
                bucket, first, last = trigrams(data, offsets)
                edge = np.zeros(len(bucket) + 1, dtype=np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
                inside = np.cumsum(edge)[:-1] > 0
                raw += np.bincount(bucket[inside], minlength=len(raw))
                edge[:] = 0
                np.add.at(edge, first[chosen[row:end]], 1)
                np.add.at(edge, last[chosen[row:end]], -1)
                target += np.bincount(bucket[np.cumsum(edge)[:-1] > 0], minlength=len(raw))
                for at, pairs in zip((NEW, REPEATED), word_pairs(data, offsets), strict=True):
                    raw[at] += pairs.sum()
                    target[at] += pairs[chosen[row:end]].sum()
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = texts.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    ratio = np.zeros(BUCKETS)
    for kind in (slice(0, NEW), slice(NEW, BUCKETS)):
        p = (raw[kind] + 1) / (raw[kind] + 1).sum()
        q = target[kind] / target[kind].sum() if target[kind].sum() else p
        ratio[kind] = np.log((1 - SMOOTHING) * q + SMOOTHING * p) - np.log(p)
    model = QualityModel(ratio)
    if len(got):
        known = docs.sparkSession.createDataFrame(got)
        rows = scores(texts.join(F.broadcast(known.select("doc_id")), "doc_id"), model).select("doc_id", "weight").toPandas().merge(got, on="doc_id")
        model.threshold = _best_cut(rows.weight.to_numpy(), rows.label.to_numpy() > 0)
    else:
        model.threshold = -1e3
    return model


def _best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut of greatest balanced accuracy, in the middle of the gap there."""
    good, weight = good[np.isfinite(weight)], weight[np.isfinite(weight)]
    if good.all() or not good.any():
        return -1e3
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost, caught = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    gain = np.where(np.append(w[1:] > w[:-1], True), caught - lost, -1)
    at = int(np.argmax(gain))
    return float((w[at] + w[min(at + 1, len(w) - 1)]) / 2)


def scores(docs: DataFrame, model: QualityModel, seed: int = SEED) -> DataFrame:
    """Weights and sampling keys of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = model.weights(batch.column(1))
            weight = _per_gram(n, total)
            key = model.keys(weight, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(weight), pa.array(key)], names=["doc_id", "n_grams", "log_weight", "weight", "sample_key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _gumbel(seed).alias("g")).mapInArrow(run, SCORED)


def _kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest whole number of a column, by counting on its leading and then its trailing bits."""
    shift = 24
    tops = sorted(rows.groupBy(F.shiftright(column, shift).alias("top")).count().collect(), reverse=True)
    for top, n in tops:
        if k <= n:
            break
        k -= n
    rest = rows.where(F.shiftright(column, shift) == top)
    middles = sorted(rest.groupBy(F.shiftright(column, shift // 2).alias("top")).count().collect(), reverse=True)
    for top, n in middles:
        if k <= n:
            break
        k -= n
    for value, n in sorted(rest.where(F.shiftright(column, shift // 2) == top).groupBy(column).count().collect(), reverse=True):
        if k <= n:
            return value
        k -= n
    raise ValueError("fewer rows than k")


def sampled(docs: DataFrame, labels: DataFrame, label: str = "quality", k: int | None = None) -> tuple[DataFrame, QualityModel]:
    """Weights of all documents and whether each is in the sample.

    Inputs ``doc_id, text`` and ``doc_id`` with a 0/1 ``label`` column; other
    columns are ignored.  Output, one row per input row: ``doc_id, n_grams,
    log_weight, weight, sample_key, selected``; ``weight`` is the log weight
    per trigram.  Null, empty and one- or two-byte texts have no trigram, a
    weight of -inf and are never selected.  Rows that tie with the k-th key
    are all selected; rows with a null id share their noise.  Conflicting
    labels of one id count as bad.  An empty table gives none.
    """
    model = fit(docs, labels, label)
    rows = written(scores(docs, model), "quality")
    usable = rows.where("n_grams > 0")
    k = usable.where(F.col("weight") >= F.lit(model.threshold)).count() if k is None else min(k, usable.count())
    model.least_key = _kth_largest(usable, "sample_key", k) if k > 0 else 1 << 62
    return rows.withColumn("selected", (F.col("n_grams") > 0) & (F.col("sample_key") >= F.lit(model.least_key))), model


def resampled(docs: DataFrame, labels: DataFrame, label: str = "quality", k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, decided in one pass by each row's own text and id."""
    _, model = sampled(docs, labels, label, k)
    at, noise = docs.columns.index("text"), fresh(docs, "gumbel_noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = model.weights(batch.column(at))
            keep = (n > 0) & (model.keys(_per_gram(n, total), batch.column(batch.num_columns - 1).to_numpy()) >= model.least_key)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return docs.withColumn(noise, _gumbel(SEED)).mapInArrow(run, T.StructType(docs.schema.fields))
