"""The subpackage's queries, each over its whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windrose.llm.oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much Python: over all cores, where its files have fewer splits than these."""
    from windrose.operators.candidates import spread

    return spread(_table(spark, sf_dir, name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without the later repeats of runs of 24 words or more."""
    from windrose.llm.line_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "text", "stretches_removed", "chars_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles of all labelled documents."""
    from windrose.llm.language_id import identify, profiles

    docs = _spread(spark, sf_dir, "documents")
    return identify(docs, profiles(docs))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, each with its group of near copies."""
    from windrose.llm.simhash import kept_with_copies

    return kept_with_copies(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 8,192 tokens."""
    from windrose.llm.packing import best_fit

    return best_fit(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of personal data in every document."""
    from windrose.llm.pii import find

    return find(_table(spark, sf_dir, "documents"))


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs to block: those under which any page was seen that is full of symbol junk."""
    from pyspark.sql import functions as F

    pages = _table(spark, sf_dir, "pages")
    return pages.where(F.col("html").contains("%%%") | F.col("html").contains("***")).select("url")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with whether its normalised URL is listed."""
    from windrose.llm.url_cascade import judge

    return judge(_table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, with their score."""
    from windrose.llm.pu_quality import accepted, train, trusted_ids

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, trusted_ids(_table(spark, sf_dir, "labels")))
    return accepted(docs, model, columns=["doc_id"])


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thumbnail of every embedding, stored as a progressive JPEG and decoded to its RGB tensor."""
    from windrose.llm.progressive_jpeg import decoded, thumbnails

    return decoded(thumbnails(_spread(spark, sf_dir, "embeddings"))).drop("file")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per copy of a document emitted, sources weighted by the square root of their size."""
    from windrose.llm.mixing import emitted_ids

    return emitted_ids(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, each with the ids of all that have its text."""
    from windrose.llm.exact_dedup import kept_with_copies

    return kept_with_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_language_id, op3_simhash_near_dedup, op4_best_fit_packing, op5_pii, op6_url_filters,
        op7_quality_classifier, op8_progressive_jpeg, op9_mixing, op10_exact_dedup,
    )
}
