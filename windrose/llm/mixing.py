"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of the total number of rows to emit; a document's expected copies are that
target over its source's number of documents, in whole millionths. Within a source the expected copies are summed up
in the order of a hash of doc_id; one random offset per source, drawn from the seed, is added; and a document is
emitted once for every whole number its stretch of the running sum crosses. Each source so gets its target, rounded, and each document
its expectation rounded up or down.

The running sum has two levels, so that no source is ordered by one task: rows are summed within (source, bucket)
where buckets are ranges of the hash, and the buckets' totals, few, are summed before them.

Defined cases: a null source is a source of its own; a source without a weight, or of weight 0, emits nothing; rows
that repeat a doc_id, null ones too, are documents of their own, told apart by a hash of all their columns (of maps by their JSON); ids may be of any kind;
texts of any length are only passed on; an empty table gives an empty result; an input column named ``copy`` is replaced, others pass by any name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.llm._common import col, cut, fresh, others

ONE = 1_000_000
SEED = 13
#: Documents in a bucket of a source, about.
BUCKET_ROWS = 200_000


def offset(seed: int, source: Column) -> Column:
    """The source's random offset, in millionths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit("\u0000")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % ONE


def _ties(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row; columns of kinds that have no hash, maps above all, count by their JSON."""
    unhashed = ("map<", "variant")
    columns = [F.to_json(F.struct(col(f.name))) if any(k in f.dataType.simpleString() for k in unhashed) else col(f.name) for f in docs.schema]
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def copies_per_document(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, power: float = 0.5, total: int | None = None,
    seed: int = SEED, doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """(doc_id, source, tie, tie2, copies) for every document; the ties are hashes of the whole row.

    ``weights``: of each source; by default its number of documents to the ``power``. ``total``: rows to emit; by
    default as many as there are documents.
    """
    if weights is not None and (not any(weights.values()) or min(weights.values()) < 0):
        raise ValueError("weights must not be negative, nor all 0")
    ties = [t.alias(n) for t, n in zip(_ties(docs), ("tie", "tie2"))]
    rows = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), *ties, F.md5(F.coalesce(col(doc_id).cast("string"), F.lit(""))).alias("h"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        known = [(F.col("source") == F.lit(s)) if s is not None else F.col("source").isNull() for s in weights]
        weight = F.lit(0.0)
        for test, w in zip(known, weights.values()):
            weight = F.when(test, F.lit(float(w))).otherwise(weight)
    # Sources may be as many as the corpus has hosts: their rates stay a table, and only three totals come to the driver.
    sizes = cut(rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("w", weight))
    exact = F.sum(F.col("w").cast("decimal(38,12)")).cast("double")  # the same in any order
    n, every, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(exact, F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    amount = total if total is not None else n
    digits = next(d for d in range(1, 9) if 16**d * BUCKET_ROWS >= most or d == 8)
    rate = F.floor(F.lit(amount) * F.col("w") / F.lit(every) / F.col("n") * ONE + 0.5).cast("bigint") if every else F.lit(0).cast("bigint")
    rates = sizes.select(F.col("source").alias("at"), rate.alias("e"))
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col("at"))).drop("at")
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    totals = rows.groupBy("source", "bucket").agg(F.sum("e").alias("sum"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "tie", "tie2").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("sum", F.sum("e").over(inside))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    upto = F.col("base") + F.col("sum") + offset(seed, F.col("source"))
    emitted = F.floor(upto / ONE) - F.floor((upto - F.col("e")) / ONE)
    return rows.select("doc_id", "source", "tie", "tie2", emitted.cast("int").alias("copies"))


def emitted_ids(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """(doc_id, source, copy): a row per emitted copy; copies are numbered from 1."""
    rows = copies_per_document(docs, weights, **options).where("copies > 0")
    return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """``docs``, all its columns, each row as often as it is emitted, and ``copy``, numbered from 1."""
    names = others(docs, "copy")
    one, two, left, right, times, alike, nth = fresh(docs, "one", "two", "left", "right", "times", "alike", "nth")
    counts = copies_per_document(docs, weights, **options)
    counts = counts.groupBy("tie", "tie2").agg(F.sum("copies").alias(times), F.count("*").alias(alike)).where(F.col(times) > 0)
    counts = counts.select(F.col("tie").alias(left), F.col("tie2").alias(right), times, alike)
    tied = docs.withColumns(dict(zip((one, two), _ties(docs))))
    joined = tied.join(counts.hint("merge"), (F.col(one) == F.col(left)) & (F.col(two) == F.col(right)))
    # Equal rows share their group's copies: the nth of k takes numbers n, n + k, n + 2k ...
    joined = joined.withColumn(nth, F.row_number().over(W.partitionBy(one, two).orderBy(one, two)))
    joined = joined.where(F.col(nth) <= F.col(times))
    numbers = F.sequence(*(F.col(c).cast("int") for c in (nth, times, alike)))
    return joined.select(*map(col, names), F.explode(numbers).alias("copy"))
