"""Mixing sources to target weights over packed blocks.

The words of a source, its documents one after another in the order of a hash,
are packed into blocks of ``BLOCK_WORDS`` words.  Targets share the words of
all sources by weight, no source above ``MAX_REPEATS`` times its size (what is
above is shared again by weight).  A source's target is dealt as slots of one
block each.  The slots go to output shards by multinomial draws of the sources'
counts, shard after shard, with the sources' remaining slots as probabilities, so
that the shards together hold every slot.  Slot j of an epoch takes block
pi(j), where pi is a pseudorandom permutation of the source's block indexes
(Feistel rounds with cycle walking), so every block is taken once an epoch.  The
last slot of a source ends where its target is met.

Within an output shard the slots of all sources stand in the order of another
permutation.

Documents are joined with slots by block index: the pieces of documents that fill
a slot are what the mix consists of, and the words it takes of a document are
theirs.  Equal rows are one with a count until they are laid out.  Prefix sums of words run in
hash buckets of about ``BUCKET_ROWS`` rows, and over the buckets' totals, so no
task ever holds a source.  On the driver there is one number a source and a
count for each source and output shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, copied, dropped, fresh, uniform, written

BLOCK_WORDS = 1024
MAX_REPEATS = 3
OUTPUT_SHARDS = 32
BUCKET_ROWS = 20_000
SEED = 2
ROUNDS = 6
WORD = r"[^\x20\x09-\x0D]+"
SLOTS = "source_no long, block long, epoch long, output_shard long, place_in_shard long, n_words long"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9..13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sizes: Sequence[int], weights: Sequence[float], limit: float = MAX_REPEATS) -> list[float]:
    """Shares of the total size by weight, none above ``limit`` times its size; the excess is shared again by weight."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > limit * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


class Permutation:
    """Keyed pseudorandom permutations of ``range(n)``, for arrays of (n, key)."""

    @staticmethod
    def _halves(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.ceil(np.sqrt(n.astype(float))).astype(np.int64)
        low = np.maximum(low, 1)
        return low, np.maximum(-(-n // low), 1)  # low * high >= n, by less than low

    @staticmethod
    def _noise(value: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
        x = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(step * 0xD6E8FEB86659FD93 % (1 << 64))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x >> np.uint64(1)).astype(np.int64)

    @classmethod
    def _once(cls, i: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool) -> np.ndarray:
        low, high = cls._halves(n)
        a, b = i % low, i // low
        for step in range(ROUNDS)[:: -1 if inverse else 1]:
            sign = -1 if inverse else 1
            if step % 2:
                b = (b + sign * (cls._noise(a, key, step) % high)) % high
            else:
                a = (a + sign * (cls._noise(b, key, step) % low)) % low
        return b * low + a

    @classmethod
    def of(cls, i: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
        out = cls._once(i, n, key, inverse)
        while True:
            outside = np.flatnonzero(out >= n)  # walk the cycle until it is inside again
            if not len(outside):
                return out
            out[outside] = cls._once(out[outside], n[outside], key[outside], inverse)


@dataclass
class Plan:
    """Per source: size, target, blocks, slots; and slots drawn for each output shard."""

    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    words: np.ndarray
    slots: np.ndarray
    drawn: np.ndarray  # output shard x source

    @classmethod
    def make(cls, sizes: Sequence[int], targets: Sequence[float], block: int, shards: int, seed: int) -> Plan:
        size, target = np.array(sizes, dtype=np.int64), np.array(targets, dtype=float)
        blocks = -(-size // block)
        words = np.minimum(np.rint(target).astype(np.int64), MAX_REPEATS * size)
        epoch, rest = words // np.maximum(size, 1), words % np.maximum(size, 1)
        short = block * blocks - size  # words that the last block lacks
        at = np.array([Permutation.of(np.array([b - 1]), np.array([b]), np.array([cls.key(s, e, seed)]), inverse=True)[0] if b else 0 for s, (b, e) in enumerate(zip(blocks, epoch, strict=True))])
        before = at * block  # words ahead of the short block in the last epoch
        slots = np.where(rest <= before, -(-rest // block), np.maximum(at + 1, -(-(rest + short) // block)))
        slots = np.where(rest > 0, slots, 0) + epoch * blocks
        rng, left, drawn = np.random.Generator(np.random.PCG64(seed)), slots.copy(), []
        for k in range(shards):
            want = int(round(left.sum() / (shards - k)))
            row = np.zeros_like(left)
            while want - row.sum() > 0:
                free = left - row
                more = rng.multinomial(want - row.sum(), free / free.sum())
                row += np.minimum(more, free)
            drawn.append(row)
            left = left - row
        return cls(size, target, blocks, words, slots, np.array(drawn).reshape(shards, len(size)))

    @staticmethod
    def key(source: int, epoch: int, seed: int) -> int:
        return (int(source) * 8 + int(epoch)) * 1_000_003 + seed

    def slot_table(self, spark, block: int, seed: int) -> DataFrame:
        """Every slot: its block, epoch, output shard and number of words."""
        arrow_batches(spark)
        first = np.concatenate([[0], np.cumsum(self.slots)])
        share = np.cumsum(self.drawn, axis=0)  # of each source's slots, those in shards up to this one
        beside = np.cumsum(self.drawn, axis=1) - self.drawn  # slots of the sources before, in the same shard
        held = self.drawn.sum(axis=1)
        plan = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i = batch.column(0).to_numpy()
                source = np.searchsorted(first, i, side="right") - 1
                slot = i - first[source]
                n, size = plan.blocks[source], plan.size[source]
                epoch, j = slot // n, slot % n
                key = (source * 8 + epoch) * 1_000_003 + seed
                taken = Permutation.of(j, n, key)
                length = np.minimum(block, size - taken * block)
                at = Permutation.of(n - 1, n, key, inverse=True)
                before = j * block - np.where(j > at, n * block - size, 0)
                words = np.clip(plan.words[source] - epoch * size - before, 0, length)
                shard = np.zeros(len(i), dtype=np.int64)
                for k in range(len(share)):
                    shard += slot >= share[k][source]
                within = slot - share[shard, source] + plan.drawn[shard, source] + beside[shard, source]
                place = Permutation.of(within, held[shard], shard * 1_000_003 + seed + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (source, taken, epoch, shard, place, words)], names=[f.split()[0] for f in SLOTS.split(", ")])

        return spark.range(int(first[-1])).mapInArrow(run, SLOTS)


def mixture(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), block: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """How many words the mix takes of every document, and the slots of the mix.

    Inputs ``doc_id, text, source``, others are ignored.  Sources in the order
    of code points, null last, have the weights in turn.  The first table has one row
    per input row: ``doc_id, source, size, source_size, target, taken, output_shards`` (words taken,
    repeats counted, and the sorted output shards that hold some of them).  Texts without words, null ones too, have size 0 and are
    never taken.  The slots are ``source_no, block, epoch, output_shard,
    place_in_shard, n_words``.  Repeated rows are separate documents.  The same rows
    give the same mix, however they are partitioned.  An empty table gives none of either.
    """
    placed, slots = _laid(docs, weights, block, shards, seed)
    return _taken(placed, slots, block).drop("place"), slots


def packed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), block: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: ``output_shard, place_in_shard, first_word_in_slot, source, doc_id, first_word, n_words, text``, one row for each piece of a document in a slot.

    A slot's pieces in the order of ``first_word_in_slot`` are its packed block; ``text`` is the
    piece's words with single spaces between them.  Inputs and edge cases as in :func:`mixture`;
    what isn't taken has no row.
    """
    placed, slots = _laid(docs, weights, block, shards, seed)
    wanted = _pieces(placed, slots, block).groupBy("place", "source", "output_shard", "place_in_shard", "first_word", "n_words", "first_word_in_slot").count()
    texts = docs.groupBy(_place(seed).alias("place")).agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.min(F.col("text").cast("string")).alias("text"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    rows = wanted.hint("merge").join(texts, "place").withColumn("piece", F.array_join(words, " "))
    columns = ["output_shard", "place_in_shard", "first_word_in_slot", "source", "doc_id", "first_word", "n_words", F.col("piece").alias("text")]
    return copied(rows, "count", "copy").select(columns)


def _place(seed: int) -> Column:
    """Where a row stands in its source, and the mix's name for it; defined for null ids too."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _laid(docs: DataFrame, weights: Sequence[float], block: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One row per input row with its ``start`` among its source's words and its ``place``; and the slots."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), key.alias("source_key"), n_words(F.col("text").cast("string")).alias("size"), _place(seed).alias("place"))
    base = written(base.groupBy(*base.columns).agg(F.count("*").alias("copies")), "sizes")
    per_source = base.groupBy("source_key").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n")).collect()
    per_source.sort(key=lambda r: (r.source_key == "", r.source_key))
    sizes = [r["size"] for r in per_source]
    targets = water_filled(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    plan = Plan.make(sizes, targets, block, shards, seed)
    slots = plan.slot_table(spark, block, seed)

    buckets = max(1, sum(r.n for r in per_source) // BUCKET_ROWS)
    sources = spark.createDataFrame([(r.source_key, i, r["size"], targets[i]) for i, r in enumerate(per_source)], "source_key string, source_no long, source_size long, target double")
    placed = base.withColumns({"bucket": F.pmod("place", F.lit(buckets)), "words": F.col("size") * F.col("copies")})
    totals = placed.groupBy("source_key", "bucket").agg(F.sum("words").alias("total"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_key", "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(totals, ["source_key", "bucket"])
    placed = copied(placed.join(sources, "source_key"), "copies", "copy").withColumn("start", F.col("base") + F.col("ahead") + F.col("size") * F.col("copy"))
    placed = written(placed.select("doc_id", "source", "source_no", "size", "source_size", "target", "start", "place"), "placed")
    dropped(base)
    return placed, slots


def _pieces(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """``place, source_no, start, source, output_shard, place_in_shard, first_word, n_words, first_word_in_slot``: what fills the slots."""
    parts = placed.where("size > 0").select("place", "source_no", "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.col("n_words"))
    met = parts.join(slots, ["source_no", "block"]).where(high > low)
    first = F.col("block") * block + low - F.col("start")
    return met.select("place", "source_no", "start", "source", "output_shard", "place_in_shard", first.alias("first_word"), (high - low).alias("n_words"), low.alias("first_word_in_slot"))


def _taken(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """One row per row of ``placed`` with the words and the output shards of its pieces."""
    words = _pieces(placed, slots, block).groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_set("output_shard")).alias("output_shards"))
    none = F.array().cast("array<long>")
    nothing = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "output_shards": none})
    some = placed.where("size > 0").join(words, ["source_no", "start"], "left").withColumns({"taken": F.coalesce("taken", F.lit(0)), "output_shards": F.coalesce("output_shards", none)})
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "output_shards", "place"]
    return some.select(columns).unionByName(nothing.select(columns))


def _whole_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``times``, their ``share`` (words taken over ``size``) rounded to whole copies so that sources meet their targets.

    The fractions are rounded by systematic sampling, in the order of sizes
    within buckets of a source: the chance of one copy more is the fraction, and in a
    bucket the words differ from those taken by less than two of its largest documents.
    """
    buckets = max(1, rows.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(buckets))
    rows = rows.withColumns({"bucket": bucket, "rest": F.col("share") - F.floor("share")})
    inside = Window.partitionBy("of", "bucket").orderBy("size", F.xxhash64(F.lit(SEED + 1), "key"), "key")
    first = uniform(F.struct("of", "bucket"), SEED)
    to = first + F.sum("rest").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    since = first + F.coalesce(F.sum("rest").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("times", (F.floor("share") + F.floor(to) - F.floor(since)).cast("int"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), null_ids: bool = False, block: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """``docs``, all columns, as the mix takes them: a row stands as often as its words are taken, its fraction of a copy rounded by :func:`_whole_copies`.

    Rows that share ``doc_id`` and text stand as often as they are taken
    together, shared out evenly.  Rows without words are not taken, and those with
    a null id only with ``null_ids``; the targets count their words in any case.
    Pipelines whose stages pass documents on use this; the mix's blocks are :func:`packed`.
    An empty table gives none.
    """
    taken = _taken(*_laid(docs, weights, block, shards, seed), block)
    key, times, copy = (fresh(docs, n) for n in ("mixed_id", "mixed_times", "mixed_copy"))
    rows = taken.where("size > 0" if null_ids else "size > 0 and doc_id is not null").groupBy(F.col("place").alias("key"))
    rows = rows.agg(F.min("source").alias("of"), F.sum("size").alias("size"), (F.sum("taken") / F.sum("size")).alias("share")).where("share > 0")
    wanted = _whole_copies(written(rows, "shares")).where("times > 0").select(F.col("key").alias(key), F.col("times").alias(times))
    # what is wanted grows with the corpus: never broadcast it, at any size
    joined = docs.join(wanted.hint("merge"), _place(seed) == F.col(key))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, copy)
