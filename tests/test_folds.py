from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from windrose import DocumentTooLongError, Listwise, Pairwise, Reranker, RerankInputError
from windrose.config import parse_method
from windrose.operators.rerank import original_order, rerank_by_score
from windrose.streaming.rerank_stream import rerank_packed


def literal_listwise(scores: list, w: int, s: int) -> list[int]:
    order = list(range(len(scores)))
    start = len(order) - w
    while order:
        at = max(start, 0)
        order[at : at + w] = sorted(order[at : at + w], key=lambda i: -scores[i])
        if at == 0:
            break
        start -= s
    return order


def literal_pairwise(scores: list, passes: int) -> list[int]:
    order = list(range(len(scores)))
    for _ in range(passes):
        for j in range(len(order) - 1, 0, -1):
            if scores[order[j]] > scores[order[j - 1]]:
                order[j - 1], order[j] = order[j], order[j - 1]
    return order


def _cases() -> list[list[int]]:
    rng = random.Random(5)
    return [[rng.randrange(5) for _ in range(n)] for n in (1, 2, 3, 4, 5, 8, 13, 21, 30) for _ in range(6)]


@pytest.mark.parametrize("strategy", [Listwise(4, 2), Listwise(3, 3), Listwise(1, 1), Listwise(7, 1), Listwise(20, 10), Pairwise(1), Pairwise(3), Pairwise(10)])
def test_folds_equal_literal_loops(spark, strategy):
    cases = _cases()
    rows = [(q, i, f"d{i}", s) for q, scores in enumerate(cases) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "query_id int, original_index int, doc_id string, score int")
    got: dict[int, list[int]] = {}
    for r in rerank_by_score(df, "score", strategy).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["original_index"])
    for q, scores in enumerate(cases):
        want = literal_listwise(scores, strategy.window_size, strategy.stride) if isinstance(strategy, Listwise) else literal_pairwise(scores, strategy.passes)
        assert got[q] == want


def test_empty_null_and_top_k(spark):
    schema = "query_id int, original_index int, doc_id string, score double"
    assert rerank_by_score(spark.createDataFrame([], schema), "score", Listwise()).count() == 0
    df = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", 1.0), (1, 2, "b", 2.0)], schema)
    assert [r["original_index"] for r in rerank_by_score(df, "score", Pairwise(3)).orderBy("rank").collect()] == [2, 1, 0]
    assert rerank_by_score(df, "score", Listwise(), top_k=0).count() == 0
    assert rerank_by_score(df, "score", Listwise(), top_k=2).count() == 2
    with pytest.raises(RerankInputError):
        rerank_by_score(df, "score", Listwise(), top_k=-1)
    assert [r["rank"] for r in original_order(df).orderBy("original_index").collect()] == [1, 2, 3]


def test_configuration_is_checked():
    with pytest.raises(RerankInputError):
        Listwise(3, 4)
    for bad in (lambda: Listwise(0, 1), lambda: Pairwise(0), lambda: Pairwise(pair_order_parallelism=3), lambda: Listwise(algorithm="x"), lambda: parse_method("prp_sliding_k@0"), lambda: parse_method("direct@3")):
        with pytest.raises(ValueError):
            bad()
    assert parse_method("rankgpt_sliding_window@100").depth == 100 and parse_method("original").name == "original"


def test_packed_rows_and_facade(spark):
    rows = spark.createDataFrame([(1, [("a", 1.0), ("b", 3.0), ("c", 2.0)]), (2, [])], "query_id int, candidates array<struct<doc_id:string,score:double>>")
    assert [r["doc_id"] for r in rerank_packed(rows, Listwise()).orderBy("rank").collect()] == ["b", "c", "a"]
    long = spark.createDataFrame([("q", "x", 0, "d", "t" * 11, 1)], "query_id string, query string, original_index int, doc_id string, text string, score int")
    with pytest.raises(Exception, match="11 characters"):
        Reranker(Listwise(max_document_chars=10), score="score").transform(long).collect()
    out = Reranker(Listwise(), score="score").transform(long).first()
    assert out["rank"] == 1 and out["result_metadata"] == {"strategy": "listwise", "algorithm": "rankgpt_sliding_window"}
    assert issubclass(DocumentTooLongError, RerankInputError)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("a", 1.0), ("b", 3.0)])], "query_id int, candidates array<struct<doc_id:string,score:double>>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = rerank_packed(stream, Pairwise(1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    assert {(r["doc_id"], r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("b", 1), ("a", 2)}


def test_window_plan_and_calls(spark):
    from windrose.functions.scalar import estimate_calls, window_ranges, window_starts

    assert window_ranges(8, 4, 2) == [(4, 8), (2, 6), (0, 4)]
    assert window_ranges(5, 4, 2) == [(1, 5), (0, 3)]
    n = spark.range(0, 60).select(F.col("id").cast("int").alias("n"))
    for w, s in ((3, 2), (20, 10), (5, 5), (1, 1)):
        for r in n.select("n", window_starts(F.col("n"), Listwise(w, s)).alias("at"), estimate_calls(F.col("n"), Listwise(w, s)).alias("c")).collect():
            want = [*range(r["n"] - w, 0, -s), 0]
            assert r["at"] == want and r["c"] == (len(want) if r["n"] else 0)
    assert n.where("n = 5").select(estimate_calls(F.col("n"), Pairwise(10))).first()[0] == 80
    assert n.where("n = 100").count() == 0
