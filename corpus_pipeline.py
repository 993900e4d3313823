"""Corpus pipeline: quality, line dedup, near-dedup, mixing, packing; every stage is written and read again.

``run`` applies STAGES to the table ``documents``. The written stages lie in the shared folder named by
``spark.checkpoint.dir``, so a lost executor costs at most the tasks of the stage at hand. SQL can't express the
classifier, the near-dedup or the packing, so ORACLE_SQL is None and the tests hold the stages against
brute-force versions.

What holds for every stage: rows keep their columns, those with clashing names too; a table without rows gives one without rows; texts are read whole;
ids that aren't whole numbers are refused with a ``TypeError``. Rows with null ids or null texts are said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import line_dedup, mixing, packing, pu_quality, simhash
from windrose.llm._common import col, discard, others, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go.

    A null, empty or wordless text is scored by its empty feature set; a null id is never trusted; rows that repeat are scored alike;
    without a trusted label all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pu_quality.train(docs, pu_quality.trusted_ids(labels))
    return pu_quality.accepted(docs, model).drop("quality_score")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; a document of which nothing is left goes with them.

    Null and empty texts stay; null ids come first in the order; rows equal in id and text are one document and treated alike; ``n_chars``
    is counted anew where text was cut.
    """
    kept = line_dedup.remove_repeats(docs)
    kept = kept.where((F.col("chars_removed") == 0) | F.col("text").rlike(r"\S") | F.col("text").isNull())
    n_chars = [F.when(F.col("chars_removed") > 0, F.length("text").cast("bigint")).otherwise(col(c)).alias(c) if c == "n_chars" else col(c) for c in others(docs)]
    return kept.select(*n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays.

    Null and wordless texts, and rows with a null id, stay; rows that share an id stay or go together.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to the square root of their size; the number of rows stays, rounded by source.

    A null source is a source of its own; null ids and texts are emitted as others are; of rows that are equal each may be emitted.
    """
    return mixing.mix(docs).drop("copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its bin and its place there.

    Null and empty texts have no piece; null ids are packed; rows that share an id are told apart by ``copy``.
    """
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", remove_repeated_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = written(stage(spark, before, sf_dir), name.replace(" ", "-"))
        if before is not docs:
            discard(before)
        before = after
    return before
