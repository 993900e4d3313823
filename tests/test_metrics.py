from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from windrose.config import PriceConfig
from windrose.functions.scalar import compose_optional_title, compose_title, estimate_cost, stable_seed
from windrose.operators.metrics import aggregate_evaluations, evaluate, zero_if_invalid
from windrose.operators.summary import failure_histogram, mean, nearest_rank, summarise, task_macro
from windrose.schemas import QUERY_RESULTS


def scores(spark, ranking, qrels, k=10):
    ranked = spark.createDataFrame([("q", d, i) for i, d in enumerate(ranking, 1)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", d, r) for d, r in qrels.items()], "query_id string, doc_id string, rel double")
    return evaluate(ranked, judged, k).first().asDict()


def test_goldens(spark):
    got = scores(spark, "abc", {"a": 3.0, "b": 2.0}, 3)
    assert got["ndcg_at_k"] == got["mrr_at_k"] == got["recall_at_k"] == 1.0
    got = scores(spark, "cba", {"a": 3.0, "b": 2.0}, 3)
    assert got["ndcg_at_k"] == pytest.approx(0.6480409554829326, abs=1e-12) and got["mrr_at_k"] == 0.5
    assert scores(spark, "cba", {"a": 3.0, "b": 2.0}, 2)["recall_at_k"] == 0.5
    assert scores(spark, ["d1", "d2", "d3", "d4"], {"d2": 2.0, "d4": 1.0, "d1": 0.0})["map"] == 0.5
    assert set(scores(spark, "ab", {"z": 0.0}).values()) == {"q", 0.0}
    half = scores(spark, "ab", {"b": 0.5})
    assert half["ndcg_at_k"] == 0.0 and half["mrr_at_k"] == 0.5 and half["recall_at_k"] == 1.0
    with pytest.raises(ValueError):
        scores(spark, "a", {"a": 1.0}, 0)


def test_against_brute_force(spark):
    rng, ranked, judged, want = random.Random(3), [], [], {}
    for q in range(40):
        n, k = rng.randrange(1, 15), 5
        docs = [f"d{i}" for i in range(n + 3)]
        rels = {d: rng.choice([-1, 0, 0, 1, 2, 3]) for d in rng.sample(docs, rng.randrange(0, n + 3))}
        order = rng.sample(docs, n)
        ranked += [(q, d, i) for i, d in enumerate(order, 1)]
        judged += [(q, d, r) for d, r in rels.items()]
        dcg = sum(rels.get(d, 0) / math.log2(i + 1) for i, d in enumerate(order[:k], 1))
        ideal = sum(r / math.log2(i + 1) for i, r in enumerate(sorted((r for r in rels.values() if r > 0), reverse=True)[:k], 1))
        good = {d for d, r in rels.items() if r > 0}
        hits, total = 0, 0.0
        for i, d in enumerate(order, 1):
            if d in good:
                hits += 1
                total += hits / i
        first = next((1 / i for i, d in enumerate(order[:k], 1) if d in good), 0.0)
        want[q] = (dcg / ideal if ideal else 0.0, first, len(good & {*order[:k]}) / len(good) if good else 0.0, total / len(good) if good else 0.0)
    got = evaluate(spark.createDataFrame(ranked, "query_id int, doc_id string, rank int"), spark.createDataFrame(judged, "query_id int, doc_id string, rel int"), 5)
    for r in got.collect():
        assert tuple(r)[1:] == pytest.approx(want[r["query_id"]])
    assert got.count() == 40


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(stable_seed(F.lit(13), F.lit("Task"), F.lit("q1"))).first()[0] == 2477442981
    price = PriceConfig(2.0, 8.0)
    assert one.select(estimate_cost(F.lit(1_000_000), F.lit(500_000), price)).first()[0] == 6.0
    assert one.select(estimate_cost(F.lit(None).cast("bigint"), F.lit(1), price)).first()[0] is None
    assert one.select(estimate_cost(F.lit(1), F.lit(1), None)).first()[0] is None
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert tuple(values.agg(nearest_rank("x", 0.5), nearest_rank("x", 0.95)).first()) == (2.0, 4.0)
    assert tuple(values.where("x > 9").agg(nearest_rank("x", 0.5), mean("x")).first()) == (0.0, 0.0)
    t = spark.createDataFrame([(None, " a\n"), ("", "b"), ("T", "c ")], "title string, text string")
    assert [tuple(r) for r in t.select(compose_title(F.col("title"), F.col("text")), compose_optional_title(F.col("title"), F.col("text"))).collect()] == [("\n\n a\n", "a"), ("\n\nb", "b"), ("T\n\nc ", "T\n\nc")]


def test_summaries(spark):
    def row(task, q, method, value, valid=True, why=None, calls=0, tokens=None, cost=None):
        return (task, "test", q, method, value, value, value, value, valid, why, None, float(calls), tokens, tokens, calls, cost, None)

    rows = [row("t1", "1", "m", 1.0, calls=9, tokens=10, cost=2.0), row("t2", "2", "m", 0.0, False, "provider_error", calls=3), row("t1", "1", "original", 0.5)]
    results = spark.createDataFrame(rows, QUERY_RESULTS)
    out = {(r["level"], r["method"], r["task"]): r for r in summarise(results).collect()}
    assert len(out) == 5
    m = out["overall", "m", None]
    assert (m["query_count"], m["valid_count"], m["invalid_rate"], m["ndcg_at_10"], m["ndcg_at_10_valid_only"]) == (2, 1, 0.5, 0.5, 1.0)
    assert (m["llm_calls_mean"], m["llm_calls_total"], m["prompt_tokens_mean"], m["cost_total"], m["cost_mean_costed"], m["cost_mean_all"]) == (6.0, 12, 10.0, 2.0, 2.0, 1.0)
    assert (m["latency_p50_ms"], m["latency_p95_ms"]) == (3.0, 9.0)
    assert [tuple(r) for r in failure_histogram(results).collect()] == [("m", "provider_error", 1)]
    macro = {r["method"]: r["map_task_macro"] for r in task_macro(summarise(results)).collect()}
    assert macro == {"m": 0.5, "original": 0.5}
    zeroed = zero_if_invalid(spark.createDataFrame([("a", 0.7, True), ("a", 0.7, False), ("a", None, True)], "algorithm string, map double, valid boolean"), F.col("valid"), ["map"])
    assert tuple(aggregate_evaluations(zeroed, names=["map"]).first()) == ("a", 3, pytest.approx(0.7 / 3))
