"""Registered queries of the reranking engine and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windrose.plans import more_oracles, more_queries, oracles
from windrose.plans import queries as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "first_stage": Q.first_stage,
    "rerank_listwise_window": Q.rerank_listwise_window,
    "rerank_listwise_single": Q.rerank_listwise_single,
    "rerank_original": Q.rerank_original,
    "rerank_prp_k1": Q.rerank_prp_k1,
    "rerank_prp_k10": Q.rerank_prp_k10,
    "rerank_top_k": Q.rerank_top_k,
    "candidate_scope_at_n": Q.candidate_scope_at_n,
    "provider_listwise": Q.provider_listwise,
    "provider_pairwise": Q.provider_pairwise,
    "metric_ndcg10": Q._metric("ndcg_at_k"),
    "metric_mrr10": Q._metric("mrr_at_k"),
    "metric_recall10": Q._metric("recall_at_k"),
    "metric_map": Q._metric("map"),
    "metric_zero_on_invalid": Q.metric_zero_on_invalid,
    "summary_by_method": Q.summary_by_method,
    "summary_by_task_method": Q.summary_by_task_method,
    "failure_histogram": Q.failure_counts,
    "latency_percentiles": Q.latency_percentiles,
    "call_estimates": Q.call_estimates,
    "window_plan": Q.window_plan,
    "cost_estimate": Q.cost_estimate,
    "stable_seed": Q.stable_seed,
    "prompt_listwise": Q.prompt_listwise,
    "prompt_pairwise": Q.prompt_pairwise,
    "parse_ranking_failures": Q.parse_ranking_failures,
    "parse_winner": Q.parse_winner_answers,
    "qrels_join_default0": Q.qrels_join_default0,
    "method_cross_join": Q.method_cross_join,
    "pending_anti_join": Q.pending_anti_join,
    "dup_candidates": Q.dup_candidates,
    "length_guard": Q.length_guard,
    "oracle_plus_hash_candidates": Q.oracle_plus_hash_candidates,
    "hash_shuffle": Q.hash_shuffle,
    "seeded_shuffle": Q.seeded_shuffle,
    **more_queries.QUERIES,
}
ORACLES: dict[str, str] = oracles.ORACLES | more_oracles.ORACLES
