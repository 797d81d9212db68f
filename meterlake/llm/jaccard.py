"""N-gram Jaccard join by PartEnum signatures.

Every text becomes the set of its distinct word shingles.  Sets whose Jaccard
similarity reaches ``percent`` are linked, and the links' connected components
are the groups.

Signatures (Arasu, Ganti and Kaushik, 2006).  Sizes are cut into bands of factor
``BAND``.  A set signs for its own band and, if a linked larger set may lie in the
next one, for that too.  In a band whose largest size is r, linked sets differ in
at most k = floor(2 r (1 - s) / (1 + s)) elements.  The hash domain is cut into
n1 + e first-level parts with n1 (k2 + 1) > k, so in 1 + e of them at least the
sets differ in no more than k2 elements; each is cut into n2 second-level parts,
and every subset of n2 - k2 of these signs: one of them at least is equal.
Subsets without elements, or with those of a frequent passage alone, would be shared by
strangers.  A part is poor if one of its subsets has no elements or a signature that more than
``HEAVY`` rows have.  A set with at most e poor parts leaves such signatures out and still
shares another one with every linked set; a set with more keeps the heavy ones.  If it has more than e
parts with empty subsets, it leaves the empty ones out all the same and signs at the next of
``LEVELS`` cuts too, which have more spare parts; a linked set that needs no next one shares a signature at
this one, as it has a part without empty subsets where the two differ in no more than k2 elements.
Only sets that have too many at the last cut sign with empty subsets there.  So no linked pair is lost.

Plan.  All signatures are shuffled once, alone, to find those that more than one row
has; a bitmap of bounded size then keeps the others from being shuffled again (if
it fills up, more pass, and the result is the same).  Equal sets are one node
(their 64-bit fingerprint), so copies cost nothing.  In a bucket of nodes with one
signature, all are compared with the one that has met most others; groups of near copies become
components for about one comparison a member.  What then lies in different
components of a bucket of at most ``HEAVY`` nodes is compared pairwise.  The nodes of larger ones
(those that consist of frequent passages for the most part) sign again, with other parts of the domain: linked
nodes share a signature of every family, strangers seldom do twice.  Only what meets in
all ``FAMILIES`` is compared pairwise in buckets of any size.  Pairs first pass a
lossless filter: the parities of a set's hashes in 1,024 cells, and then in as many cells as
elements, differ in no more cells than the sets differ in elements.  The rest is
verified on whole sets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, bitmap, dropped, fresh, in_bitmap, likely_in, written
from .components import connected_components
from .text import mix, whole_hash, words_of

#: Second-level parts, and how many of them may differ; the others form the subsets that sign.
PARTS, DIFFERING = 3, 1
#: Poor parts that a set may have: three deviations more than small sets should, and at most this share of the parts.
SPARE = 0.15
#: Second-level parts, how many of them may differ, and spare parts for each needed one, of the cuts after the first.
LEVELS = ((PARTS, DIFFERING, 0.5), (1, 0, 3.0))
#: Smallest over largest size of a band: wider bands need more parts, narrower ones more sets that sign twice.
BAND = 0.7
#: Nodes of a bucket that are compared pairwise at once (and rows of a signature that isn't heavy), and families of signatures.
HEAVY, FAMILIES = 32, 2
#: Bits of the bitmap of heavy signatures for each of them, over 16: others that it holds make parts poor.
SPARSE = 32
#: Signatures a text that other texts may have, as far as the bitmap's size is concerned.
RECURRING = 24
_U64 = np.uint64
SKETCH = 16  # words of 64 parity cells
SIGNED = "doc_id long, n_shingles long, node long, sketch array<long>, wide binary, signatures array<long>"
LIKELY = "a long, b long, doc_a long, doc_b long"
SETS = "node long, shingles array<long>"


#: :func:`jaccard_groups` of ``documents`` with three words and 90 percent in DuckDB, by comparing all pairs.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded
), sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM reached LEFT JOIN sized ON doc_id = a GROUP BY a
"""


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle, no words none."""
    for _, _, w in words_of(column):
        hashes, bounds = w.shingles(width)
        for i in range(len(w)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi > lo:
                yield np.unique(hashes[lo:hi])
            elif w.bounds[i + 1] > w.bounds[i]:
                yield whole_hash(w.hashes[w.bounds[i] : w.bounds[i + 1]])[None]
            else:
                yield np.zeros(0, dtype=_U64)


def fingerprint(own: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(own), keepdims=True) + _U64(len(own)))[0].astype(np.int64))


class Bands:
    """Size bands 1, 2, ...: ``low[i]..high[i]``; the next band's smallest links reach into this one only.

    Families cut the domain in unrelated ways.
    """

    def __init__(self, percent: int, family: int = 0):
        self.percent, self.family = percent, family
        self.low, self.high = [1], [1]
        self._parts: dict[tuple[int, int], tuple[int, int, np.ndarray, np.ndarray, np.uint64]] = {}

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.low.append(low)
            self.high.append(max(int(low / BAND), low * 100 // self.percent))
        return bisect_left(self.high, size)

    def differing(self, band: int) -> int:
        """Most elements in which linked sets of at most the band's largest size differ."""
        return 2 * self.high[band] * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int, level: int = 0) -> tuple[int, int, np.ndarray, np.ndarray, np.uint64]:
        """First-level parts, how many of them may be poor, the cuts of the domain, the subsets (part x subset), and a label."""
        got = self._parts.get((band, level))
        if got is None:
            k = self.differing(band)
            inner, k2, share = LEVELS[level - 1] if level else (PARTS, DIFFERING, SPARE)
            if not k:
                inner, k2 = 1, 0
            n1 = -(-(k + 1) // (k2 + 1))
            spare = int(np.ceil(share * n1))
            if not level:
                empty = np.exp(-self.low[band] * (100 + self.percent) / (200 * n1 * inner))  # of the second-level parts of a small set
                poor = n1 * sum(comb(inner, j) * empty**j * (1 - empty) ** (inner - j) for j in range(inner - k2, inner + 1))
                spare = min(int(np.ceil(poor + 3 * np.sqrt(poor))), spare) if n1 > 3 else 0
            cells = (n1 + spare) * inner
            cuts = np.array([(i << 64) // cells for i in range(1, cells)], dtype=object).astype(_U64)
            chosen = list(combinations(range(inner), inner - k2))
            subsets = np.array([[i in c for c in chosen] for i in range(inner)], dtype=np.int64)
            label = _U64((band * 0xC2B2AE3D27D4EB4F + self.family * 0xD6E8FEB86659FD93 + level * 0xA0761D6478BD642F) % (1 << 64))
            got = self._parts[band, level] = n1 + spare, spare, cuts, subsets, label
        return got

    def signatures(self, own: np.ndarray, heavy: np.ndarray | None = None) -> np.ndarray:
        """Signatures of a sorted set for its own band and, if a larger set there may be linked, the next; heavy ones are in a bitmap.

        Which levels a set signs at doesn't depend on the bitmap, so those without it are all that it may have with one.
        """
        band = self.of(len(own))
        both = self.of(len(own) * 100 // self.percent) > band
        if self.family:
            own = np.sort(mix(own + _U64(self.family)))
        total = np.zeros(len(own) + 1, dtype=_U64)
        np.cumsum(mix(own + _U64(0x51ED270B)), out=total[1:])
        out = []
        for b in (band, band + 1)[: 1 + both]:
            for level in range(1 + len(LEVELS)):
                n1, spare, cuts, subsets, label = self.parts(b, level)
                at = np.zeros(len(cuts) + 2, dtype=np.int64)
                at[1:-1] = np.searchsorted(own, cuts)
                at[-1] = len(own)
                filled = ((at[1:] - at[:-1]).reshape(n1, -1) @ subsets > 0).ravel()
                part = ((total[at[1:]] - total[at[:-1]]).reshape(n1, -1) @ subsets.astype(_U64)).ravel()
                signature = mix(mix(part) ^ ((np.arange(len(part), dtype=_U64) + _U64(1)) * _U64(0x9E3779B97F4A7C15) + label))
                enough = _poor(filled, n1) <= spare
                if not enough and level == len(LEVELS):
                    filled[:] = True
                elif enough and heavy is not None:
                    light = filled & ~in_bitmap(heavy, signature)
                    filled = light if _poor(light, n1) <= spare else filled
                out.append(signature[filled])
                if enough:
                    break
        return np.concatenate(out).view(np.int64)


def _poor(filled: np.ndarray, parts: int) -> int:
    """How many parts have a subset that isn't ``filled``."""
    return int((~filled).reshape(parts, -1).any(axis=1).sum())


def parities(own: np.ndarray) -> np.ndarray:
    """Parity of the set's elements in each of 1,024 or more cells, about as many as elements; packed bits."""
    cells = 1 << max(6 + SKETCH.bit_length() - 1, int(len(own)).bit_length())
    counts = np.bincount((mix(own) & _U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(counts.astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same parities in fewer cells: ``size`` bytes of packed bits in the last dimension."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the start and length of each value."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8), at[:-1], np.diff(at)


def differing_cells(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many cells the packed parities of ``x`` and ``y`` differ, row by row, in the cells of the smaller one; 0 where one is null."""
    (a, at_a, len_a), (b, at_b, len_b) = _bytes(x), _bytes(y)
    out = np.zeros(len(x), dtype=np.int64)
    for m, n in np.unique(np.stack([len_a, len_b], axis=1), axis=0):
        if not m or not n:
            continue
        rows = np.flatnonzero((len_a == m) & (len_b == n))
        for some in np.array_split(rows, -(-len(rows) * int(m + n) // (8 << 20))):
            u, v = a[at_a[some][:, None] + np.arange(m)], b[at_b[some][:, None] + np.arange(n)]
            out[some] = np.bitwise_count(folded(u, min(m, n)) ^ folded(v, min(m, n))).sum(axis=1)
    return out


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([p.view(np.int64) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _is_wanted(own: np.ndarray, wanted: Broadcast | None) -> bool:
    """Whether a set signs: it has elements and, if there is a bitmap of wanted nodes, may be one of them."""
    return len(own) > 0 and (wanted is None or bool(in_bitmap(wanted.value, np.array([fingerprint(own)]))[0]))


def _often(docs: DataFrame, width: int, percent: int, family: int = 0, wanted: Broadcast | None = None) -> tuple[Broadcast, Broadcast]:
    """Bitmaps of the signatures that more than one row has, and of those that more than ``HEAVY`` have; equal rows count too.

    Nearly all signatures are unique, so they are shuffled bare and counted once; a batch
    passes on at most ``HEAVY`` + 1 of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, family)
        for batch in batches:
            named = np.asarray(batch.column(0).is_valid())
            signs = [bands.signatures(own) for own, known in zip(text_sets(batch.column(1), width), named, strict=True) if known and _is_wanted(own, wanted)]
            if signs:
                sign, count = np.unique(np.concatenate(signs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sign, np.minimum(count, HEAVY + 1)))], names=["signature"])

    signatures = _documents(docs).mapInArrow(run, "signature long")
    counts = signatures.repartition("signature").groupBy("signature").count().where("count > 1")
    often = written(counts.select("signature", (F.col("count") > HEAVY).alias("heavy")), "often")
    heavy = often.where("heavy")
    out = bitmap(often, "signature", RECURRING * docs.count() if family == 0 else often.count()), bitmap(heavy, "signature", SPARSE * heavy.count())
    dropped(often)
    return out


def signed(docs: DataFrame, width: int, percent: int, often: Broadcast, heavy: Broadcast) -> DataFrame:
    """One row per text: set size, node, parity sketch and those of its signatures that other rows may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            n, node, sketch, wide, signs = [], [], [], [], []
            for own in text_sets(batch.column(1), width):
                n.append(len(own))
                node.append(fingerprint(own) if len(own) else None)
                bits = parities(own)
                sketch.append(folded(bits, 8 * SKETCH).view(np.int64))
                wide.append(bits.tobytes() if len(bits) > 8 * SKETCH else None)
                found = bands.signatures(own, heavy.value) if len(own) else np.zeros(0, dtype=np.int64)
                signs.append(found[in_bitmap(often.value, found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), _long_lists(sketch), pa.array(wide, pa.binary()), _long_lists(signs)],
                names=["doc_id", "n_shingles", "node", "sketch", "wide", "signatures"],
            )

    return _documents(docs).mapInArrow(run, SIGNED)


def _signed_again(docs: DataFrame, nodes: DataFrame, width: int, percent: int, family: int) -> DataFrame:
    """``signature, node`` of the given nodes, and of few others, in another family; no text is shuffled."""
    wanted = bitmap(nodes, "node", SPARSE * nodes.count())
    often, heavy = _often(docs, width, percent, family, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, family)
        for batch in batches:
            named = np.asarray(batch.column(0).is_valid())
            node, signs = [], []
            for own, known in zip(text_sets(batch.column(1), width), named, strict=True):
                if known and _is_wanted(own, wanted):
                    found = bands.signatures(own, heavy.value)
                    signs.append(found[in_bitmap(often.value, found)])
                    node.append(fingerprint(own))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs)), pa.array(np.repeat(node, [len(x) for x in signs]))], names=["signature", "node"])

    return _documents(docs).mapInArrow(run, "signature long, node long")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """The whole sets of ``text, node`` rows whose text is that node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(node, s) for node, s in zip(batch.column(1).to_pylist(), text_sets(batch.column(0), width), strict=True) if len(s) and fingerprint(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in own], pa.int64()), _long_lists([s for _, s in own])], names=["node", "shingles"])

    return docs.select("text", "node").mapInArrow(run, SETS)


def _may_link(percent: int) -> Column:
    """Lossless: sizes and parity sketches of ``a`` and ``b`` allow the similarity."""
    fit = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.element_at("a.sketch", i + 1).bitwiseXOR(F.element_at("b.sketch", i + 1))) for i in range(SKETCH)))
    return fit & (differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes that reach the similarity on whole sets."""
    a, b = nodes.alias("a"), nodes.alias("b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose wide parities allow the similarity."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = differing_cells(batch.column(4), batch.column(5)) * (100 + percent) <= batch.column(6).to_numpy() * (100 - percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "doc_a", "doc_b"]).filter(pa.array(keep))

    met = pairs.alias("p").join(a, F.col("p.a") == F.col("a.node")).join(b, F.col("p.b") == F.col("b.node")).where(_may_link(percent))
    met = met.select("p.a", "p.b", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.col("a.wide").alias("wa"), F.col("b.wide").alias("wb"), F.col("a.n") + F.col("b.n"))
    likely = written(met.mapInArrow(alike, LIKELY), "likely")
    wanted = likely.select(F.explode(F.array(F.struct(F.col("doc_a").alias("doc_id"), F.col("a").alias("node")), F.struct(F.col("doc_b").alias("doc_id"), F.col("b").alias("node")))).alias("w")).select("w.*").distinct()
    texts = likely_in(_documents(docs), wanted).join(wanted, "doc_id")
    sets = written(shingle_sets(texts, width), "sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    out = written(
        likely.select("a", "b").join(x, "a").join(y, "b").where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct(),
        "links",
    )
    dropped(likely, sets)
    return out


def _shared(signed: DataFrame) -> DataFrame:
    """The ``signature, node`` rows whose signature more than one node has."""
    rows = written(signed.distinct(), "rows")
    shared = rows.groupBy("signature").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("signature")
    out = written(rows.join(shared, "signature"), "buckets")
    dropped(rows)
    return out


def _apart(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, light: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``a, b`` of nodes with different labels that meet in buckets of at most ``light`` nodes (None: of any size) and may
    link, and the nodes of larger buckets with different labels."""
    placed = buckets.join(labels, "node")
    mixed = placed.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("met")).where("x <> y").select("signature", "met")
    placed = written(placed.join(mixed, "signature"), "placed")
    heavy = None
    if light is not None:
        heavy = written(placed.where(F.col("met") > light).select("node").distinct(), "heavy")
        placed = placed.where(F.col("met") <= light)
    placed = placed.drop("met").join(nodes.select("node", "n", "sketch"), "node")
    a, b = placed.alias("a"), placed.alias("b")
    apart = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    return a.join(b, apart & _may_link(percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), heavy


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Groups of texts by the Jaccard similarity of their shingle sets.

    Input columns ``doc_id`` and ``text``, others are ignored.  Output, one row
    per input row: ``doc_id, n_shingles, component_id``.  Null or empty texts
    have no shingles and link with nothing.  Rows with a null ``doc_id`` link
    with nothing and have a null component.  Rows that share a ``doc_id`` and
    differ in text are separate sets under one name: each gets the component of
    its own text.  Equal texts are always linked.  An empty table gives none.
    """
    return _grouped(docs, width, percent).drop("node")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """:func:`jaccard_groups` with the ``node`` of each row, null without words or id."""
    spark = docs.sparkSession
    arrow_batches(spark)
    base = written(signed(docs, width, percent, *_often(docs, width, percent)), "signed")
    linkable = base.where("n_shingles > 0 and doc_id is not null")
    nodes = linkable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max(F.struct(*[F.element_at("sketch", i + 1).alias(f"s{i}") for i in range(SKETCH)], "wide")).alias("s"))
    nodes = written(nodes.select("node", "doc_id", "n", F.array(*[f"s.s{i}" for i in range(SKETCH)]).alias("sketch"), "s.wide"), "nodes")
    buckets = _shared(linkable.select(F.explode("signatures").alias("signature"), "node"))
    met = buckets.join(buckets.groupBy("signature").count(), "signature").groupBy("node").agg(F.sum("count").alias("met"))
    hubs = buckets.join(met, "node").groupBy("signature").agg(F.max(F.struct("met", "node")).alias("m")).select("signature", F.col("m.node").alias("hub"))

    stars = buckets.join(hubs, "signature").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(docs, stars, nodes, width, percent)
    labels = connected_components(links)
    labels = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    rest, left = None, buckets
    for family in range(1, FAMILIES + 1):
        light, heavy = _apart(left, labels, nodes, percent, HEAVY if family < FAMILIES else None)
        rest = light if rest is None else rest.union(light)
        if heavy is None or heavy.isEmpty():
            break
        left = _shared(_signed_again(docs, heavy, width, percent, family))
    more = _verified(docs, rest.distinct(), nodes, width, percent)
    if not more.isEmpty():
        labels = connected_components(links.union(more)).withColumnRenamed("component", "label")
    labels = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(names, "label").select("node", "component_id")
    dropped(buckets)
    own = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return own.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def _nodes(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_hash, node`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [fingerprint(own) if len(own) else None for own in text_sets(batch.column(2), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64())], names=["doc_id", "text_hash", "node"])

    arrow_batches(rows.sparkSession)
    return rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_hash long, node long")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: those with its smallest ``doc_id``.

    Rows with a null id or without words stay.  Of rows that share a ``doc_id``
    each stays or goes with the group of its own text, and equal texts among them are
    one: the row whose columns have the smallest hash.  An empty table gives none.
    """
    groups = written(_grouped(docs, width, percent), "groups")
    stays = F.col("component_id") == F.col("doc_id")
    known = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(stays).alias("all_stay"), F.max(stays).alias("stays"))
    odd = written(known.where("n > 1 or not stays"), "odd")
    sure, maybe = likely_in(docs, odd, how="left_anti"), likely_in(docs, odd)
    name, text = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    gone = odd.where("not stays").select(F.col("doc_id").alias(name))
    maybe = maybe.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    split = odd.where("stays and not all_stay")
    if not split.isEmpty():
        known_as = split.select(F.col("doc_id").alias(name))
        rows = _nodes(likely_in(docs, split).join(known_as, F.col("doc_id").cast("long") == F.col(name), "left_semi"), width)
        others = groups.where(~stays).join(split, "doc_id", "left_semi").select("doc_id", "node").distinct()
        gone = rows.join(others, ["doc_id", "node"]).select(F.col("doc_id").alias(name), F.col("text_hash").alias(text)).distinct()
        gone = written(gone, "gone")
        maybe = maybe.join(gone, (F.col("doc_id").cast("long") == F.col(name)) & (F.xxhash64("text") == F.col(text)), "left_anti")
    if not odd.where("n > 1 and stays").isEmpty():  # of rows that differ in other columns alone, the one with the smallest hash
        row = F.struct(*[F.col(c) for c in docs.columns])
        maybe = maybe.groupBy("doc_id", "text").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return sure.unionByName(maybe)
