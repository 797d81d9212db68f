"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import containment, jaccard, mixing, quality, sharding
from meterlake.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier doesn't sample: those without a trigram (null and empty texts), and those whose key is below the limit.

    Each row is decided by its own text and id, so repeated rows stay or go together.  An empty table gives none.
    """
    return quality.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words, a Jaccard similarity of 0.8.

    The one with the smallest id stays.  Rows with a null id or without words all stay.  An empty table gives none.
    """
    return jaccard.representatives(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item: five words, a containment of 0.8.

    Null and empty texts hold nothing and stay, as do rows with a null id whose text is clean.  Without items, or for an empty table, ``docs`` comes back.
    """
    return containment.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, threshold=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of weights 1, 2, 3 takes them, null ids too.

    Texts without words are in no mix.  Null sources are one source, the last.  An empty table gives none.
    """
    return mixing.mixed(docs, weights=(1, 2, 3), null_ids=True)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix; repeated rows, null ids and null texts have theirs.  An empty table gives none."""
    return sharding.sharded(docs, shards=24)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", source_mix),
    ("sharding", shards),
]

#: The stages hash, sample and connect, which SQL can't express: tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
