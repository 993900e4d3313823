"""Runs: samples x methods, resumable, with every failure recorded; and the fail-fast comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.config import LISTWISE, ORIGINAL, Listwise, Method, Pairwise, PriceConfig, Strategy, parse_method
from windrose.errors import RerankInputError
from windrose.functions.scalar import estimate_calls, estimate_cost
from windrose.operators.candidates import pending, scope
from windrose.operators.metrics import aggregate_evaluations, evaluate, zero_if_invalid
from windrose.operators.rerank import Reranker, ask_provider, rerank_by_score
from windrose.operators.summary import summarise, with_failures
from windrose.schemas import RESULT_KEY
from windrose.sources import sinks
from windrose.storage import materialised

KEYS = ["task", "split", "query_id"]
_SCORES = {"ndcg_at_k": "ndcg_at_10", "mrr_at_k": "mrr_at_10", "map": "map", "recall_at_k": "recall_at_10"}


def strategy_of(method: Method, listwise: Listwise, pairwise: Pairwise) -> Strategy:
    return listwise if method.family == LISTWISE else pairwise


def run_method(
    samples: DataFrame, name: str, provider: Callable[[], Any] | None, *, listwise: Listwise = Listwise(), pairwise: Pairwise = Pairwise(),
    price: PriceConfig | None = None, max_concurrency: int = 1, partitions: int | None = None, on_usage: Callable[..., Any] | None = None,
) -> DataFrame:
    """Rows of the query-result schema for one method over long samples; an invalid answer scores 0 and stays."""
    method = parse_method(name)
    if method.family == ORIGINAL:
        rows = samples.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list("original_index")), lambda x: x).alias("order"))
        nothing = {"failure_type": "string", "error": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint"}
        outcomes = rows.withColumns({"valid": F.lit(True), "latency_ms": F.lit(0.0), "llm_calls": F.lit(0)} | {k: F.lit(None).cast(v) for k, v in nothing.items()})
    else:
        if provider is None:
            raise RerankInputError(f"{name} needs a provider")
        strategy = strategy_of(method, listwise, pairwise)
        outcomes = ask_provider(scope(samples, method.depth), provider, strategy, keys=KEYS, max_concurrency=max_concurrency, partitions=partitions, on_usage=on_usage)
    places = outcomes.where("valid").select(*KEYS, F.posexplode("order").alias("pos", "original_index"))
    ranked = places.join(samples.select(*KEYS, "original_index", "doc_id"), [*KEYS, "original_index"])
    ranked = ranked.select(*KEYS, F.coalesce("doc_id", F.lit("")).alias("doc_id"), (F.col("pos") + 1).alias("rank"))
    qrels = samples.select(*KEYS, "doc_id", F.col("label").alias("rel")).where("doc_id is not null").distinct()
    scores = evaluate(ranked, qrels, 10, keys=KEYS)
    ids = ranked.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranked_doc_ids"))
    joined = zero_if_invalid(outcomes.join(scores, KEYS, "left"), F.col("valid")).join(ids, KEYS, "left")
    return joined.select(
        *KEYS, F.lit(name).alias("method"), *(F.col(a).alias(b) for a, b in _SCORES.items()), "valid", "failure_type", "error", "latency_ms",
        "prompt_tokens", "completion_tokens", "llm_calls", estimate_cost(F.col("prompt_tokens"), F.col("completion_tokens"), price).alias("cost"), "ranked_doc_ids",
    )


def run(
    spark: SparkSession, samples: DataFrame, methods: Sequence[str], log: str, *, provider: Callable[[], Any] | None = None, resume: bool = True,
    batch_queries: int = 1000, evaluate_one: Callable[..., DataFrame] = run_method, on_batch: Callable[[DataFrame], None] | None = None, **options: Any,
) -> DataFrame:
    """Every pair of sample and method that ``log`` does not hold yet is evaluated and appended; the whole log is returned.

    Pairs are evaluated about ``batch_queries`` at a time and each batch is appended when it is finished, so what a crash costs is the batch under way. ``evaluate_one`` makes the rows
    of a batch for one method; ``on_batch`` is told each batch once it is in the log.
    """
    if batch_queries < 1:
        raise ValueError("batch_queries must be 1 or more")
    parsed = [parse_method(m).name for m in methods]
    done = sinks.finished_results(spark, log)
    if not resume and not done.isEmpty():
        raise ValueError(f"{log} holds results; resume, or choose another folder")
    for name in parsed:
        left = pending(samples, sinks.finished_results(spark, log).where(F.col("method") == name), KEYS)
        n = left.select(*KEYS).distinct().count()
        parts = -(-n // batch_queries)
        share = F.pmod(F.xxhash64(*KEYS), F.lit(max(1, parts)))
        for i in range(parts):
            rows = materialised(evaluate_one(left.where(share == i), name, provider, **options), "batch")
            sinks.append_results(rows, log)
            if on_batch is not None:
                on_batch(rows)
    return sinks.finished_results(spark, log)


def completed_keys(results: DataFrame) -> DataFrame:
    return results.select(*RESULT_KEY).distinct()


def call_totals(candidates: DataFrame, strategies: Mapping[str, Strategy], keys: Sequence[str] = ("query_id",)) -> dict[str, int]:
    """Estimated calls of each algorithm over all cases."""
    sizes = candidates.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    row = sizes.agg(*(F.coalesce(F.sum(estimate_calls(F.col("n"), s)), F.lit(0)).alias(a) for a, s in strategies.items())).first()
    return row.asDict()


def compare(candidates: DataFrame, qrels: DataFrame, strategies: Mapping[str, Strategy], *, provider: Callable[[], Any] | None = None, score: str | None = None, top_k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(aggregate, per query) of several algorithms over the same cases; the first failure ends it. ``top_k`` cuts the metrics."""
    scored = None
    for name, strategy in sorted(strategies.items()):
        if provider is not None:
            ranked = Reranker(strategy, provider=provider).transform(candidates)
        else:
            ranked = rerank_by_score(candidates, score, strategy)
        own = evaluate(ranked, qrels, top_k).withColumn("algorithm", F.lit(name))
        scored = own if scored is None else scored.unionByName(own)
    return aggregate_evaluations(scored), scored.orderBy("algorithm", "query_id")


def summaries(results: DataFrame, folder: str, arguments: Mapping[str, Any]) -> DataFrame:
    summary = with_failures(summarise(results), results)
    sinks.write_summaries(folder, summary, sinks.run_metadata(results.sparkSession, arguments))
    return summary
