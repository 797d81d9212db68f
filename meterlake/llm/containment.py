"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are short and documents may be very long, so the Jaccard
similarity of the two is near zero and MinHash signatures of whole documents
say nothing.  Containment MinHash (Koslicki and Zabeti, 2019) samples only the
small side: the smallest hashes of an item's shingle set are looked up among
all shingles of each document.  Items are partitioned by size into classes
(powers of two), and in each class the sample is just large enough that an item
contained to ``threshold`` in a document must have a sampled shingle there:
with at most (1 - threshold) of u shingles missing, floor((1 - threshold) u) + 1
of them suffice.  So no item is missed; candidates are verified by exact
containment of their whole shingle sets.

Plan.  The index of the items is broadcast in blocks of at most
``BLOCK_BYTES`` of item text; documents are streamed once for each block, with
no shuffle.  However large the benchmark is, nothing larger is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches
from .text import HashArray, whole_hash, words_of

#: Most bytes of item text whose index is broadcast at once.
BLOCK_BYTES = 16 << 20
_U64 = np.uint64
FOUND = "doc_id long, item_id long, n_shingles long, n_common long, containment double"


class Index:
    """Sketches and whole shingle sets of a block of items, by shingle width.

    Items of fewer words than ``width`` are one shingle of their own length.
    """

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: Fraction):
        self.threshold, self.ids, self.sets = threshold, [i for i, _ in items], []
        sketches: dict[int, list[tuple[np.ndarray, int]]] = {}
        texts = pa.array([t for _, t in items], pa.large_string())
        for _, _, w in words_of(texts):
            hashes, bounds = w.shingles(width)
            for i in range(len(w)):
                n = int(w.bounds[i + 1] - w.bounds[i])
                if n == 0:
                    self.sets.append(np.zeros(0, dtype=_U64))
                    continue
                own = np.unique(hashes[bounds[i] : bounds[i + 1]]) if n >= width else whole_hash(w.hashes[w.bounds[i] : w.bounds[i + 1]])[None]
                largest = (1 << int(len(own)).bit_length()) - 1  # of the item's size class
                sample = min(len(own), int((1 - threshold) * largest) + 1)
                sketches.setdefault(min(n, width), []).append((own[:sample], len(self.sets)))
                self.sets.append(own)
        self.lookup: dict[int, tuple[HashArray, np.ndarray, np.ndarray]] = {}
        for size, parts in sketches.items():
            keys = np.concatenate([s for s, _ in parts])
            owner = np.concatenate([np.full(len(s), i) for s, i in parts])
            order = np.lexsort((owner, keys))
            unique, first = np.unique(keys[order], return_index=True)
            self.lookup[size] = (HashArray(unique), owner[order], np.append(first, len(order)))

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """Row of the text, position of the item, size of the item's set, shingles in common."""
        for row, _, w in words_of(column):
            for size, (array, owner, first) in self.lookup.items():
                hashes, bounds = w.shingles(size)
                at = array.find(hashes)
                hits = np.flatnonzero(at >= 0)
                if not len(hits):
                    continue
                doc = np.searchsorted(bounds, hits, side="right") - 1
                pairs = np.unique(np.stack([doc, at[hits]]), axis=1)
                for d in np.unique(pairs[0]):
                    own = np.unique(hashes[bounds[d] : bounds[d + 1]])
                    keys = pairs[1][pairs[0] == d]
                    for item in np.unique(np.concatenate([owner[first[k] : first[k + 1]] for k in keys])):
                        wanted = self.sets[item]
                        found = np.searchsorted(own, wanted)
                        common = int((own[np.minimum(found, len(own) - 1)] == wanted).sum())
                        if common >= self.threshold * len(wanted):
                            yield row + int(d), int(item), len(wanted), common


def _blocks(benchmark: DataFrame, width: int, threshold: Fraction) -> Iterator[Broadcast]:
    """Indexes of the benchmark's items, one block of bounded size at a time."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        n = len(row.text.encode())
        if block and size + n > BLOCK_BYTES:
            yield sc.broadcast(Index(block, width, threshold))
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    if block:
        yield sc.broadcast(Index(block, width, threshold))


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Every (document, item) with at least ``threshold`` of the item's distinct shingles in the document.

    Inputs ``doc_id, text`` and ``item_id, text``; other columns are ignored.
    Output ``doc_id, item_id, n_shingles, n_common, containment``, one row for
    each pair of rows (repeated rows repeat).  Null or empty texts, of either
    side, contain and match nothing.  Null ids are carried as null.  Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    parts, exact = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), Fraction(str(threshold))
    out = None
    for index in _blocks(benchmark, width, exact):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in batches:
                found = list(held.search(batch.column(1)))
                if not found:
                    continue
                row, item, n, common = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([held.ids[i] for i in item], pa.int64()), pa.array(n), pa.array(common), pa.array(common / n)],
                    names=["doc_id", "item_id", "n_shingles", "n_common", "containment"],
                )

        found = parts.mapInArrow(run, FOUND)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no benchmark item; rows with a null text stay.

    Decides each row by its own text in one pass a block, without a join.
    """
    arrow_batches(docs.sparkSession)
    exact = Fraction(str(threshold))
    schema = T.StructType(docs.schema.fields)
    at = docs.columns.index("text")
    for index in _blocks(benchmark, width, exact):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in index.value.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


ORACLE = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, list_slice(w, i, i + 4) AS s FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), sizes AS (
  SELECT id, count(*) AS n_shingles FROM shingles WHERE kind = 'i' GROUP BY id
), met AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s GROUP BY d.id, i.id
)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment FROM met JOIN sizes ON id = item_id WHERE n_common * 10 >= n_shingles * 8
"""
