"""Text lines with exact numbers, however many splits a file has."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of every line of one file or folder, numbered from 1 within its file.

    Lines are numbered within their split, and the splits' totals, few, are summed before them; so no file is read by one task.
    """
    read = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid")
    )
    sizes = read.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("path", "block").orderBy("mid"))
    return read.withColumn("nth", inside).join(bases, ["path", "block"]).select("path", (F.col("base") + F.col("nth")).alias("line_no"), "value")


def require_file(path: str) -> str:
    """``path``, which must be there where it is on a local disk; other file systems complain themselves."""
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(path)
    return path


def fail_on_first(bad: DataFrame) -> None:
    """ValueError ``path:line: reason`` of the first of the rows (path, line_no, reason), if there is any."""
    first = bad.orderBy("path", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['path'].removeprefix('file://')}:{first[0]['line_no']}: {first[0]['reason']}")
