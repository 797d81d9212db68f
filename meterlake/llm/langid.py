"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased (simple, code point by code point); every run of
characters other than letters becomes one space.  Each language has a model of
order ``ORDER`` over these characters: absolute discounting of the counts at the
highest order and of continuation counts below (Kneser and Ney, 1995; Chen and
Goodman, 1999), interpolated down to a uniform distribution.  Models are kept
as sorted arrays of 64-bit n-gram hashes, one for each order, with the log
probabilities of all languages side by side.  The language of least cross-entropy per
character wins; ``score`` is its posterior at that length, and ``rejected``
marks texts whose cross-entropy is above the ``REJECT`` quantile of labelled
texts of that language that the models have not seen.

The models are fitted on a bounded sample of the labelled rows: of each
language about ``SAMPLE_CHARS`` characters, as whole rows drawn by a hash of
the id.  All texts are scored whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, uniform
from .text import HashArray, mix, slices

ORDER = 4
#: Characters of text from which the model of a language is fitted, about.
SAMPLE_CHARS = 2_000_000
#: Share of the sampled rows that calibrates the rejection instead of feeding the models.
CALIBRATION = 0.2
REJECT = 0.999
#: Characters that count for the posterior at most, as neighbouring ones aren't independent.
POSTERIOR_CHARS = 60
SPACE = 32
UNKNOWN = "und"
SCORED = "doc_id long, lang_pred string, score double, cross_entropy double, n_chars_scored long, rejected boolean"
_U64 = np.uint64


def _classes() -> np.ndarray:
    """For each code point its lower-case letter, or a space; points beyond 65,535 are folded into the private-use area."""
    out = np.full(sys.maxunicode + 1, SPACE, dtype=np.uint16)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha() or unicodedata.category(char) in ("Mn", "Mc"):
            low = char.lower()
            at = ord(low) if len(low) == 1 else point
            out[point] = at if at < 65536 else 0xE000 + at % 6400
    return out


def _letters(classes: np.ndarray) -> np.ndarray:
    """Which normalised characters are letters; combining marks are not, and a text of marks alone has no letter."""
    out = np.zeros(1 << 16, dtype=bool)
    out[classes[[point for point in range(sys.maxunicode + 1) if chr(point).isalpha()]]] = True
    return out


_class: list[np.ndarray] = []
_letter: list[np.ndarray] = []


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters of a run of texts, each with a space before and after; and the texts' bounds."""
    if not _class:
        _class.append(_classes())
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) == len(data):
        at = offsets
    else:  # byte offsets to code points: count the bytes that begin one
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[offsets]
        if at[-1] != len(points):  # invalid UTF-8: decode each text by itself
            parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    chars = _class[0][points]
    padded = np.insert(chars, at[1:], SPACE)  # an end mark for each text
    bounds = at + np.arange(len(at))
    first = np.zeros(len(padded), dtype=bool)
    first[bounds[:-1]] = True
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != SPACE) | (padded[:-1] != SPACE) | first[1:]
    keep &= ~(first & (padded == SPACE)) | np.isin(np.arange(len(padded)), bounds[1:] - 1)
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return padded[keep], kept


def ngrams(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """At each character the packed ``ORDER`` characters that end there; a text begins after spaces."""
    out = chars.astype(_U64)
    start = np.zeros(len(chars), dtype=np.int64)
    lengths = np.diff(bounds)
    start = np.repeat(bounds[:-1], lengths)
    place = np.arange(len(chars))
    for back in range(1, ORDER):
        before = np.full(len(chars), SPACE, dtype=_U64)
        before[back:] = chars[:-back]
        before[place - back < start] = SPACE
        out |= before << _U64(16 * back)
    return out


def _suffix(grams: np.ndarray, order: int) -> np.ndarray:
    return grams if order == 4 else grams & _U64((1 << (16 * order)) - 1)


def _hashed(grams: np.ndarray, order: int) -> np.ndarray:
    return mix(grams + _U64(order * 0x9E3779B97F4A7C15 % (1 << 64)))


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(min(max(once / max(once + 2 * twice, 1), 0.1), 0.95))


class KneserNey:
    """Log probabilities of one language's n-grams and backoff weights of its contexts, by order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.grams: dict[int, np.ndarray] = {}
        self.p: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.gamma: dict[int, np.ndarray] = {}
        self.uniform = 1.0 / alphabet
        by_order = {ORDER: (grams, counts.astype(float))}
        for order in range(ORDER - 1, 0, -1):
            longer = by_order[order + 1][0]
            by_order[order] = tuple(np.unique(_suffix(longer, order), return_counts=True))
        for order in range(1, ORDER + 1):
            own, c = by_order[order]
            d = _discount(c)
            context = own >> _U64(16)  # all but the last character
            names, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, weights=c), np.bincount(at)
            gamma = d * kinds / total
            lower = np.full(len(own), self.uniform) if order == 1 else self.p[order - 1][np.searchsorted(self.grams[order - 1], _suffix(own, order - 1))]
            self.grams[order], self.p[order] = own, (c - d) / total[at] + gamma[at] * lower
            self.contexts[order], self.gamma[order] = names, gamma


@dataclass
class LanguageModel:
    languages: list[str]
    tables: dict[int, HashArray] = field(default_factory=dict)
    log_p: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, HashArray] = field(default_factory=dict)
    log_gamma: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = -10.0
    limits: np.ndarray | None = None

    @classmethod
    def build(cls, models: dict[str, KneserNey], alphabet: int) -> LanguageModel:
        """Put the languages' tables side by side: of each n-gram seen in any language, every language's interpolated log probability."""
        out = cls(sorted(models), floor=float(-np.log(alphabet)))
        for order in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([m.grams[order] for m in models.values()]))
            names = np.unique(np.concatenate([m.contexts[order] for m in models.values()]))
            p, gamma = np.zeros((len(grams), len(models))), np.ones((len(names), len(models)))
            for k, language in enumerate(out.languages):
                m = models[language]
                at = np.searchsorted(names, m.contexts[order])
                gamma[at, k] = m.gamma[order]
                lower = np.full(len(grams), m.uniform) if order == 1 else below[np.searchsorted(shorter, _suffix(grams, order - 1)), k]
                p[:, k] = gamma[np.searchsorted(names, grams >> _U64(16)), k] * lower
                p[np.searchsorted(grams, m.grams[order]), k] = m.p[order]
            shorter, below = grams, p
            for kind, keys, values in (("tables", grams, p), ("contexts", names, gamma)):
                hashed = _hashed(keys, order)
                order_ = np.argsort(hashed)
                getattr(out, kind)[order] = HashArray(hashed[order_])
                (out.log_p if kind == "tables" else out.log_gamma)[order] = np.log(values[order_]).astype(np.float32)
        return out

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram, under each language."""
        out = np.zeros((len(grams), len(self.languages)), dtype=np.float32)
        left, rest = np.arange(len(grams)), grams
        for order in range(ORDER, 0, -1):
            own = _suffix(rest, order)
            at = self.tables[order].find(_hashed(own, order))
            seen = at >= 0
            out[left[seen]] += self.log_p[order][at[seen]]
            left, rest = left[~seen], rest[~seen]
            if not len(left):
                return out
            at = self.contexts[order].find(_hashed(own[~seen] >> _U64(16), order))
            known = at >= 0
            out[left[known]] += self.log_gamma[order][at[known]]
        out[left] += self.floor
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the number of characters (0: no letter)."""
        n, out = np.zeros(len(column), dtype=np.int64), np.zeros((len(column), len(self.languages)))
        for row, end, data, offsets in slices(column):
            chars, bounds = characters(data, offsets)
            if not _letter:
                _letter.append(_letters(_class[0]))
            letters = np.concatenate([[0], np.cumsum(_letter[0][chars])])
            n[row:end] = np.where(letters[bounds[1:]] > letters[bounds[:-1]], np.diff(bounds), 0)
            total = np.zeros((len(chars) + 1, len(self.languages)))
            np.cumsum(self.log_probabilities(ngrams(chars, bounds)), axis=0, dtype=np.float64, out=total[1:])
            out[row:end] = -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
        return n, out


def _sampled(docs: DataFrame, usable: Column) -> tuple[DataFrame, list[str]]:
    """Labelled rows, about ``SAMPLE_CHARS`` characters of each language, and the languages.

    ``first`` marks the row with letters that a language has in any case: the first by the hash of its id.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    drawn = uniform(F.col("doc_id"), 1)
    first = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.struct(drawn.alias("u"), F.col("doc_id").alias("id"))))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), first["id"].alias("first")).collect()
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, SAMPLE_CHARS / max(r.n, 1)), r["first"]) for r in sizes], "lang string, share double, first_id long")
    rows = rows.join(F.broadcast(share), "lang").withColumn("first", F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)))
    return rows.where(F.col("first") | (drawn < F.col("share"))).select("doc_id", "text", "lang", "first"), sorted(r.lang for r in sizes)


def fit(docs: DataFrame, usable: Column) -> LanguageModel:
    """Fit on the labelled rows of ``docs`` that are ``usable``; without any, the model knows no language and every text is ``und``."""
    arrow_batches(docs.sparkSession)
    sample, _ = _sampled(docs, usable)
    calibrates = (uniform(F.col("doc_id"), 2) < CALIBRATION) & ~F.col("first")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                texts, parts = batch.column(0).filter(pa.array(langs == lang)), []
                for _, _, data, offsets in slices(texts):
                    parts.append(ngrams(*characters(data, offsets)))
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.where(~calibrates).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return LanguageModel([])
    alphabet = len(np.unique(counts.gram.to_numpy(np.int64).view(_U64) & _U64(0xFFFF))) + 1
    models = {}
    for lang, own in counts.groupby("lang"):
        grams = own.gram.to_numpy(np.int64).view(_U64)
        order = np.argsort(grams)
        models[lang] = KneserNey(grams[order], own.n.to_numpy()[order], alphabet)
    model = LanguageModel.build(models, alphabet)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {k: i for i, k in enumerate(model.languages)}
        for batch in batches:
            n, h = model.entropies(batch.column(0))
            langs = batch.column(1).to_pylist()
            keep = [i for i in range(len(n)) if n[i] and langs[i] in at]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in keep], pa.string()), pa.array([float(h[i, at[langs[i]]]) for i in keep], pa.float64())], names=["lang", "h"])

    seen = sample.where(calibrates).select("text", "lang").mapInArrow(measured, "lang string, h double").groupBy("lang").agg(F.percentile("h", F.lit(REJECT)).alias("h")).collect()
    limits = {r.lang: r.h for r in seen}
    model.limits = np.array([limits.get(k, np.inf) for k in model.languages])
    return model


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The language of every whole text of ``docs``, one row per input row.

    Columns ``doc_id`` and ``text`` are read, others ignored.  Null texts and
    texts without a letter get ``und``, score 0 and no cross-entropy, and are
    rejected.  Of equal cross-entropies the first language by name wins.
    Repeated rows and rows with null ids are predicted like others; an empty table gives none.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            n, h = model.entropies(batch.column(1)) if model.languages else (np.zeros(batch.num_rows, dtype=np.int64), np.zeros((batch.num_rows, 1)))
            best = h.argmin(axis=1)
            least = h[np.arange(len(n)), best]
            weight = np.exp(-(h - least[:, None]) * np.minimum(n, POSTERIOR_CHARS)[:, None])
            known = n > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
                    pa.array(np.where(known, 1 / weight.sum(axis=1), 0.0)),
                    pa.array(least, mask=~known),
                    pa.array(n),
                    pa.array(~known | (least > model.limits[best]) if model.languages else ~known),
                ],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "n_chars_scored", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)
