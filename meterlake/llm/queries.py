"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, embeddings, html, jaccard, langid, mixing, quality, sharding, toxicity, urls
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    rows = langid.identified(docs, langid.fit(docs, ~held_out()))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes, and for which output shards."""
    rows, _ = mixing.mixture(_table(spark, sf_dir, "documents"), weights=(1, 2, 3))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "output_shards")


def op3_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links of a cosine of 0.9 or more, and their groups."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op4_quality_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and the Gumbel top-k sample of them."""
    rows, _ = quality.sampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of ``pages`` with the lists its URL is on at its fetch time.

    The table has no fetch times: capture n is taken as fetched n mod 366 days
    into 2024.  The list joins fixed entries with hosts reported from the captures.
    """
    pages = _table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    entries = urls.fixed_entries(spark).unionByName(urls.reported_hosts(pages))
    return urls.evaluated(pages.select("page_id", "url", fetched.alias("fetched_on")), entries)


def op7_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages, laid out."""
    return html.rendered(_table(spark, sf_dir, "pages"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from label rows outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), usable=~held_out())
    rows = toxicity.scores(docs, model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_segments", "evidence")


def op9_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    return sharding.sharded(_table(spark, sf_dir, "documents"), shards=24)


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds at least 0.8 of a benchmark item's 5-word shingles, with the item."""
    return containment.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_kneser_ney": op1_language_kneser_ney,
    "op2_source_mixing": op2_source_mixing,
    "op3_cross_polytope_neighbours": op3_cross_polytope_neighbours,
    "op4_quality_importance_resampling": op4_quality_importance_resampling,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_temporal_lists": op6_url_temporal_lists,
    "op7_layout_rendering": op7_layout_rendering,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_best_fit_sharding": op9_best_fit_sharding,
    "op10_benchmark_containment": op10_benchmark_containment,
}

ORACLES: dict[str, str] = {
    "op3_cross_polytope_neighbours": embeddings.ORACLE,
    "op5_ngram_jaccard_join": jaccard.ORACLE,
    "op6_url_temporal_lists": urls.ORACLE,
    "op10_benchmark_containment": containment.ORACLE,
}
