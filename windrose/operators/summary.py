"""Roll-ups of query results: quality, validity, latency, calls, tokens and cost, per method and per task and method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["ndcg_at_10", "mrr_at_10", "map", "recall_at_10"]


def mean(x: Column | str) -> Column:
    """The mean, 0 over nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def nearest_rank(name: str, p: float) -> Column:
    """The nearest-rank percentile, 0 over nothing; exact, so it holds the group's distinct values."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by `{name}`)").cast("double"), F.lit(0.0))


def aggregates(metrics: Sequence[str] = METRICS) -> list[Column]:
    """The columns of a summary row over rows of the query-result schema."""
    valid = F.col("valid")
    return [
        F.count("*").alias("query_count"),
        F.count_if(valid).alias("valid_count"),
        mean(F.when(valid, 0.0).otherwise(1.0)).alias("invalid_rate"),
        *(mean(m).alias(m) for m in metrics),
        *(mean(F.when(valid, F.col(m))).alias(f"{m}_valid_only") for m in metrics),
        nearest_rank("latency_ms", 0.5).alias("latency_p50_ms"),
        nearest_rank("latency_ms", 0.95).alias("latency_p95_ms"),
        mean("prompt_tokens").alias("prompt_tokens_mean"),
        mean("completion_tokens").alias("completion_tokens_mean"),
        mean("llm_calls").alias("llm_calls_mean"),
        F.coalesce(F.sum("llm_calls"), F.lit(0)).cast("bigint").alias("llm_calls_total"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_total"),
        mean("cost").alias("cost_mean_costed"),
        mean(F.coalesce("cost", F.lit(0.0))).alias("cost_mean_all"),
    ]


def summarise(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """A row per method (task null, all rows pooled) and per (task, method), from one pass; ``level`` says which."""
    rows = results.withColumnRenamed("task", "task_name")
    grouped = rows.groupingSets([[F.col("method")], [F.col("method"), F.col("task_name")]], F.col("method"), F.col("task_name"))
    out = grouped.agg(F.when(F.grouping("task_name") == 1, "overall").otherwise("task").alias("level"), *aggregates(metrics))
    return out.withColumnRenamed("task_name", "task")


def with_failures(summary: DataFrame, results: DataFrame) -> DataFrame:
    """``summary`` with ``failure_type_counts``, a map from failure_type to its number of rows."""
    rows = results.where("failure_type is not null").withColumnRenamed("task", "task_name")
    grouped = rows.groupingSets([[F.col("method"), F.col("failure_type")], [F.col("method"), F.col("task_name"), F.col("failure_type")]], F.col("method"), F.col("task_name"), F.col("failure_type"))
    counts = grouped.agg(F.when(F.grouping("task_name") == 1, "overall").otherwise("task").alias("level"), F.count("*").alias("n"))
    maps = counts.groupBy("level", "method", F.col("task_name").alias("task")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_type", "n")))).alias("failure_type_counts"))
    maps = maps.toDF("__level", "__method", "__task", "failure_type_counts")
    same = (F.col("level") == F.col("__level")) & F.col("method").eqNullSafe(F.col("__method")) & F.col("task").eqNullSafe(F.col("__task"))
    empty = F.create_map().cast("map<string,bigint>")
    joined = summary.join(maps, same, "left").drop("__level", "__method", "__task")
    return joined.withColumn("failure_type_counts", F.coalesce("failure_type_counts", empty))


def task_macro(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per method the mean of its tasks' means: the other reading of an overall score."""
    return summary.where("level = 'task'").groupBy("method").agg(*(mean(m).alias(f"{m}_task_macro") for m in metrics))


def failure_histogram(results: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return results.where("failure_type is not null").groupBy(*by, "failure_type").agg(F.count("*").alias("failures"))
