"""NDCG@k, MRR@k, Recall@k and MAP of rankings against graded judgments.

``rankings``: the ``keys`` of a query, ``by`` columns (such as method), doc_id and rank (1-based). ``qrels``: keys, doc_id,
rel. The gain is linear; the ideal takes positive judgments only, while actual gains take any. Recall and MAP divide by all
relevant documents, ranked or not; MAP has no cut-off. A missing judgment is 0. Queries without judgments score 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = ["ndcg_at_k", "mrr_at_k", "recall_at_k", "map"]


def _ideal(rels: Column, k: int) -> Column:
    gains = F.transform(F.slice(F.sort_array(rels, asc=False), 1, k), lambda x, i: x / F.log2(i + F.lit(2)))
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def judge(rankings: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``rankings`` with the judgment ``gain`` (truncated to a whole number) and ``hit`` (any positive judgment)."""
    judged = qrels.select(*keys, "doc_id", F.col("rel").cast("double").alias("__rel"))
    rel = F.coalesce(F.col("__rel"), F.lit(0.0))
    joined = rankings.join(judged, [*keys, "doc_id"], "left")
    return joined.withColumn("gain", rel.cast("int")).withColumn("hit", (rel > 0).cast("int")).drop("__rel")


def ideals(qrels: DataFrame, k: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """A row per query: ``relevant`` documents and the ideal gain ``idcg``."""
    rel = F.col("rel").cast("double")
    grades = F.collect_list(F.when(rel.cast("int") > 0, rel.cast("int")))
    return qrels.groupBy(*keys).agg(F.count_if(rel > 0).alias("relevant"), _ideal(grades, k).alias("idcg"))


def evaluate(rankings: DataFrame, qrels: DataFrame, k: int = 10, *, keys: Sequence[str] = ("query_id",), by: Sequence[str] = ()) -> DataFrame:
    """keys, by, and the four metrics: one exchange by (keys, by) for hits so far and sums together."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    order = W.partitionBy(*keys, *by).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = judge(rankings.select(*keys, *by, "doc_id", "rank"), qrels, keys).withColumn("seen", F.sum("hit").over(order))
    inside, rank = F.col("rank") <= k, F.col("rank")
    sums = rows.groupBy(*keys, *by).agg(
        F.sum(F.when(inside, F.col("gain") / F.log2(rank + F.lit(1))).otherwise(0.0)).alias("dcg"),
        F.min(F.when(inside & (F.col("hit") == 1), rank)).alias("first"),
        F.count_distinct(F.when(inside & (F.col("hit") == 1), F.col("doc_id"))).alias("found"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / rank).otherwise(0.0)).alias("precisions"),
    )
    joined = sums.join(ideals(qrels, k, keys), list(keys), "left")
    zero = F.lit(0.0)
    return joined.select(
        *keys, *by,
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(zero).alias("ndcg_at_k"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr_at_k"),
        F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(zero).alias("recall_at_k"),
        F.when(F.col("relevant") > 0, F.col("precisions") / F.col("relevant")).otherwise(zero).alias("map"),
    )


def zero_if_invalid(scores: DataFrame, valid: Column, names: Sequence[str] = NAMES) -> DataFrame:
    """Scores of invalid outputs, or of missing ones, count as 0 and stay in the denominator."""
    return scores.withColumns({n: F.when(valid, F.coalesce(F.col(n), F.lit(0.0))).otherwise(0.0) for n in names})


def aggregate_evaluations(scores: DataFrame, by: Sequence[str] = ("algorithm",), names: Sequence[str] = NAMES) -> DataFrame:
    """Number of cases and the macro mean of every metric, in the order of ``by``."""
    means = [F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names]
    return scores.groupBy(*by).agg(F.count("*").alias("case_count"), *means).orderBy(*by)
