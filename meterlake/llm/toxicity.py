"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are runs of ASCII letters and digits and of bytes from 128, lower-cased
in ``A-Z``.  Tokens and their stems (leading bytes, for inflected forms) have
log-odds between toxic and other labelled texts under an informative Dirichlet
prior (Monroe, Colaresi and Quinn, 2008).  A token scores the largest of those
that are significant, else a small penalty.  All maximal-scoring segments of a
text are found in linear time (Ruzzo and Tompa, 1999).  A segment of score S in
a text of n tokens has E = n exp(-lambda S) equals by chance, with lambda the
positive root of sum p exp(lambda s) = 1 over the background's tokens (Karlin
and Altschul, 1990); segments with E below ``MAX_E`` are significant.  A text's
evidence, the sum of -ln E over them, becomes a probability by a logistic fit.

The fit uses at most ``MAX_LABELS`` labelled rows, those with the smallest
hashes of their ids.  When a labelled text is scored for the fit, its own tokens
are taken out of the counts first (leave one out), so the calibration sees
evidence as unseen texts have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .text import NOT_TOKEN, HashArray, Words, words_of

MAX_LABELS = 20_000
#: Pseudo-counts of the Dirichlet prior, as a share of the pooled token counts.
PRIOR = 0.1
#: Least log-odds and standard score of a token with a score of its own, and least number of toxic texts it occurs in.
LEAST_ODDS, LEAST_Z, LEAST_TEXTS = 2.0, 2.5, 3
#: Score of every other token.
PENALTY = -0.05
MAX_E = 1.0
#: Bytes of the stems of longer tokens.
STEMS = (4, 5, 6, 7)
SCORED = "doc_id long, n_tokens long, n_segments long, evidence double, score double"
SEGMENTS = "doc_id long, start_byte long, end_byte long, n_tokens long, segment_score double, e_value double, passage string"


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and standard score of tokens by their counts in both classes."""
    alpha, total = PRIOR * (toxic + other), PRIOR * (n_toxic + n_other)
    a, b = toxic + alpha + 1e-9, other + alpha + 1e-9
    delta = np.log(a / (n_toxic + total - a + 1)) - np.log(b / (n_other + total - b + 1))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def token_scores(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    delta, z = log_odds(toxic, other, n_toxic, n_other)
    return np.where((z >= LEAST_Z) & (delta >= LEAST_ODDS) & (toxic >= LEAST_TEXTS), delta, PENALTY)


def segments(position: np.ndarray, score: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence in which the given positions have the given
    positive scores and all others the penalty: first and last position, score.

    Ruzzo and Tompa's algorithm with runs of penalties taken in one step.  Each candidate knows the last one
    before it with a smaller total, and a search goes from one to the next: what it passes is never seen again.
    """
    found: list[list[float]] = []  # first, last, total before, total after, the last one with a smaller total before
    total, at = 0.0, -1
    for p, s in zip(position.tolist(), score.tolist(), strict=True):
        total += penalty * (p - at - 1)
        at = p
        new = [p, p, total, total + s, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in found]


@dataclass
class ToxicityModel:
    tokens: HashArray
    scores: np.ndarray
    decay: float  # lambda
    intercept: float = -3.0
    slope: float = 1.0

    def evidence(self, position: np.ndarray, score: np.ndarray, n: int) -> tuple[int, float]:
        """Number of significant segments and the sum of their -ln E."""
        each = [self.decay * s - np.log(n) for _, _, s in segments(position, score)]
        each = [e for e in each if e > -np.log(MAX_E)]
        return len(each), float(sum(each))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, with all mass not in ``share`` on the penalty."""
    rest = max(1 - share.sum(), 1e-9)

    def excess(x: float) -> float:
        return float((share * np.exp(np.minimum(x * scores, 700))).sum() + rest * np.exp(x * PENALTY) - 1)

    low, high = 1e-6, 1.0
    if not len(scores) or excess(low) >= 0:
        return 1.0  # no drift downwards: fall back to scores as they are
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if excess((low + high) / 2) < 0 else (low, (low + high) / 2)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a weak pull of the slope to 1; the slope isn't negative."""
    w, X = np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 1.0]), np.stack([np.ones_like(x), x], 1)
    pull, to = np.diag([1e-3, 1.0]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + pull, X.T @ (y - p) - pull @ (w - to))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    return words_of(column, separators=NOT_TOKEN)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, usable: Column | None = None) -> DataFrame:
    """``doc_id, text, label`` of at most ``limit`` labelled documents."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id").limit(limit)
    known = docs.sparkSession.createDataFrame(rows.toPandas(), "doc_id long, label int")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_LABELS, usable: Column | None = None) -> ToxicityModel:
    """Learn token scores and the calibration from labelled documents (``usable``: of which label rows).

    Without toxic rows, or without others, every text scores alike.
    """
    arrow_batches(docs.sparkSession)
    texts = labelled(docs, labels, label, limit, usable)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, keys, flags = batch.column(2).to_numpy() > 0, [], []
            for row, _, w in _tokens(batch.column(1)):
                stems = [w.prefixes(length) for length in STEMS]
                cuts = [np.searchsorted(at, w.bounds) for at, _ in stems]
                for i in range(len(w)):
                    own = [w.hashes[w.bounds[i] : w.bounds[i + 1]], *(h[c[i] : c[i + 1]] for (_, h), c in zip(stems, cuts, strict=True))]
                    own = np.unique(np.concatenate(own))
                    keys.append(own)
                    flags.append(np.full(len(own), toxic[row + i]))
            key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            flag = np.concatenate(flags) if flags else np.zeros(0, dtype=bool)
            unique, at = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique.view(np.int64)), pa.array(np.bincount(at[flag], minlength=len(unique))), pa.array(np.bincount(at[~flag], minlength=len(unique)))],
                names=["token", "toxic", "other"],
            )

    counts = texts.mapInArrow(count, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    total = counts.agg(F.sum("toxic"), F.sum("other")).first()
    n_toxic, n_other = total[0] or 0, total[1] or 0
    # only tokens that can have a score of their own reach the driver: bounded by the labelled sample
    rows = counts.where(f"toxic >= {LEAST_TEXTS} and toxic * {max(n_other, 1)}D > other * {max(n_toxic, 1)}D").toPandas()
    keys = rows.token.to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, toxic, other = keys[order], rows.toxic.to_numpy(dtype=float)[order], rows.other.to_numpy(dtype=float)[order]
    whole = token_scores(toxic, other, n_toxic, n_other)
    without = {True: token_scores(toxic - 1, other, n_toxic, n_other), False: token_scores(toxic, np.maximum(other - 1, 0), n_toxic, n_other)}
    held = (whole > 0) | (without[False] > 0)
    keys, whole, other, without = keys[held], whole[held], other[held], {k: v[held] for k, v in without.items()}
    scored = whole > 0
    model = ToxicityModel(HashArray(keys[scored]), whole[scored], 1.0)
    model.decay = _decay(model.scores, (other[scored] + 0.5) / max(n_other, 1))
    array = HashArray(keys)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(2).to_numpy()
            out = [model.evidence(p, s, n)[1] for p, s, n in _scored(batch.column(1), array, without, label > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(out, pa.float64())], names=["label", "evidence"])

    fits = texts.mapInArrow(left_out, "label int, evidence double").groupBy("label", F.round("evidence", 2).alias("evidence")).count().toPandas()
    if fits.label.nunique() == 2:
        y, x = np.repeat(fits.label.to_numpy(float), fits["count"]), np.repeat(np.log1p(fits.evidence.to_numpy()), fits["count"])
        model.intercept, model.slope = _logistic(x, y)
    return model


def _scored(column: pa.Array, array: HashArray, scores: np.ndarray | dict, toxic: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Positions and scores of each text's positive tokens, and its number of tokens."""
    for row, _, w in _tokens(column):
        if toxic is None:
            value = _values(w, array, scores)
        else:
            flag = np.repeat(toxic[row : row + len(w)], np.diff(w.bounds))
            value = np.where(flag, _values(w, array, scores[True]), _values(w, array, scores[False]))
        hits = np.flatnonzero(value > 0)
        cut = np.searchsorted(hits, w.bounds)
        for i in range(len(w)):
            own = hits[cut[i] : cut[i + 1]]
            yield own - w.bounds[i], value[own], int(w.bounds[i + 1] - w.bounds[i])


def _values(w: Words, array: HashArray, scores: np.ndarray) -> np.ndarray:
    """The largest score of each token and its stems; the penalty where none is known."""
    padded = np.append(scores, PENALTY)  # position -1: unknown
    value = padded[array.find(w.hashes)]
    for length in STEMS:
        at, hashes = w.prefixes(length)
        value[at] = np.maximum(value[at], padded[array.find(hashes)])
    again = np.append(False, w.hashes[1:] == w.hashes[:-1])[: len(value)]
    again[w.bounds[:-1][w.bounds[:-1] < len(value)]] = False  # the text before may end with a text's first token
    value[again] = PENALTY  # a token said again is no further evidence
    return value


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Toxicity of every whole text: ``doc_id, n_tokens, n_segments, evidence, score``, one row per input row.

    Null and empty texts have no tokens and no evidence, and score as texts without toxic passages do.
    Rows with null ids are scored like others, equal texts alike; an empty table gives none.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, count, evidence = (np.zeros(batch.num_rows, dtype=t) for t in (np.int64, np.int64, float))
            for i, (position, value, size) in enumerate(_scored(batch.column(1), model.tokens, model.scores)):
                n[i] = size
                if len(position):
                    count[i], evidence[i] = model.evidence(position, value, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(count), pa.array(evidence), pa.array(model.probability(evidence))], names=["doc_id", "n_tokens", "n_segments", "evidence", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant toxic passage with its bytes, score and E; texts without one give no row."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for row, _, w in _tokens(batch.column(1)):
                value = _values(w, model.tokens, model.scores)
                for i in range(len(w)):
                    lo, hi = w.bounds[i], w.bounds[i + 1]
                    own = np.flatnonzero(value[lo:hi] > 0)
                    for a, b, s in segments(own, value[lo:hi][own]):
                        e = float((hi - lo) * np.exp(-model.decay * s))
                        if e < MAX_E:
                            x, y = int(w.start[lo + a]), int(w.end[lo + b])
                            base = int(w.offsets[i])
                            out.append((ids[row + i], x - base, y - base, b - a + 1, s, e, w.data[x:y].tobytes().decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SEGMENTS)
