from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_providers import broken_for_q2, by_length
from windrose import Listwise, Pairwise, PriceConfig
from windrose.operators import candidates as C
from windrose.plans import runner
from windrose.schemas import SAMPLE


@pytest.fixture
def samples(spark):
    rows = [("t", "test", q, text, i, d, d * n, label) for q, text in (("1", "one"), ("2", "two")) for i, (d, n, label) in enumerate((("a", 1, 0.0), ("b", 3, 1.0), ("c", 2, 0.0)))]
    return spark.createDataFrame(rows, SAMPLE)


def test_run_resumes(spark, samples, tmp_path):
    log, methods = str(tmp_path / "log"), ["original", "rankgpt_sliding_window@3"]
    first = runner.run(spark, samples.where("query_id = '1'"), methods, log, provider=by_length, price=PriceConfig(1, 1))
    assert {(r["method"], r["mrr_at_10"]) for r in first.collect()} == {("original", 0.5), ("rankgpt_sliding_window@3", 1.0)}
    both = runner.run(spark, samples, methods, log, provider=broken_for_q2)
    rows = {(r["query_id"], r["method"]): r for r in both.collect()}
    assert len(rows) == both.count() == 4 == runner.completed_keys(both).count()
    bad = rows["2", "rankgpt_sliding_window@3"]
    assert (bad["valid"], bad["mrr_at_10"], bad["failure_type"], bad["ranked_doc_ids"]) == (False, 0.0, "llm_output_invalid", None)
    assert rows["1", "rankgpt_sliding_window@3"]["ranked_doc_ids"] == ["b", "c", "a"]
    with pytest.raises(ValueError):
        runner.run(spark, samples, methods, log, provider=by_length, resume=False)
    runner.summaries(both, str(tmp_path / "out"), {})
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"overall_summary.json", "task_summary.json", "metadata.json", "result_tables.md"}


class Died(Exception):
    pass


def test_a_crash_costs_one_batch(spark, tmp_path):
    """Rows of finished batches are never asked again."""
    calls = tmp_path / "calls"
    rows = [("t", "test", f"{q:02}", f"q{q:02}", i, d, d, float(d == "b")) for q in range(12) for i, d in enumerate("ab")]
    many = spark.createDataFrame(rows, SAMPLE)

    def factory():
        from tests.test_providers import length
        from windrose.operators.providers import FunctionProvider

        class P(FunctionProvider):
            def rank(self, query, documents):
                with open(calls, "a") as f:
                    f.write(query + "\n")
                return super().rank(query, documents)

        return P(length)

    batches = []

    def die(batch):
        batches.append(batch.count())
        if len(batches) == 2:
            raise Died

    with pytest.raises(Died):
        runner.run(spark, many, ["rankgpt_sliding_window@2"], str(tmp_path / "log"), provider=factory, batch_queries=3, on_batch=die)
    before = calls.read_text().split()
    assert len(before) == sum(batches) < 12
    seen = []
    out = runner.run(spark, many, ["rankgpt_sliding_window@2"], str(tmp_path / "log"), provider=factory, batch_queries=5, on_batch=seen.append)
    assert sorted(calls.read_text().split()) == [f"q{q:02}" for q in range(12)] and out.count() == 12 and seen


def test_failures_are_counted_in_summaries(spark, samples, tmp_path):
    from windrose.operators.summary import summarise, with_failures

    results = runner.run(spark, samples, ["original", "rankgpt_sliding_window@3"], str(tmp_path / "log"), provider=broken_for_q2)
    got = {(r["level"], r["method"]): r["failure_type_counts"] for r in with_failures(summarise(results), results).collect()}
    assert got == {("overall", "original"): {}, ("task", "original"): {}, ("overall", "rankgpt_sliding_window@3"): {"llm_output_invalid": 1}, ("task", "rankgpt_sliding_window@3"): {"llm_output_invalid": 1}}


def test_streams(spark, tmp_path):
    from windrose import Reranker
    from windrose.streaming import rerank_stream as S

    rows = [(str(q), f"q{q}", i, d, d * (i + 1)) for q in range(3) for i, d in enumerate("ab")]
    schema = "query_id string, query string, original_index int, doc_id string, text string"
    for n, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = S.rerank_stream(stream, Reranker(Listwise(), provider=by_length), f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in out.collect()} == {(str(q), r, d) for q in range(3) for r, d in ((1, "b"), (2, "a"))}
    packed = spark.createDataFrame([("1", [("a", 1.0), ("b", 2.0), ("c", None)])], "query_id string, candidates array<struct<doc_id:string,score:double>>")
    assert [r["doc_id"] for r in S.rerank_packed(packed, Listwise(), top_k=2).orderBy("rank").collect()] == ["b", "a"]
    keys = spark.createDataFrame([("t", "s", "1", "m"), ("t", "s", "2", "m")], "task string, split string, query_id string, method string")
    assert [r["query_id"] for r in S.unfinished(keys, keys.where("query_id = '1'")).collect()] == ["2"]


def test_depth_drops_the_rest(spark, samples):
    row = runner.run_method(samples, "prp_sliding_k@1", by_length).orderBy("query_id").first()
    assert row["ranked_doc_ids"] == ["a"] and row["recall_at_10"] == 0.0 and row["llm_calls"] == 0


def test_compare(spark, samples):
    candidates = samples.select("query_id", "query", "original_index", "doc_id", "text")
    qrels = samples.select("query_id", "doc_id", F.col("label").alias("rel"))
    strategies = {"listwise": Listwise(3, 2), "pairwise": Pairwise(2)}
    aggregate, per_query = runner.compare(candidates, qrels, strategies, provider=by_length)
    assert [(r["algorithm"], r["case_count"], r["ndcg_at_k"]) for r in aggregate.collect()] == [("listwise", 2, 1.0), ("pairwise", 2, 1.0)]
    assert per_query.count() == 4
    assert runner.call_totals(candidates, strategies) == {"listwise": 2, "pairwise": 16}


def test_candidate_operators(spark, samples):
    shuffled = C.seeded_shuffle(samples, 13)
    assert sorted(r["original_index"] for r in shuffled.where("query_id = '1'").collect()) == [0, 1, 2]
    import hashlib
    import random

    numbers = [0, 1, 2]
    random.Random(int.from_bytes(hashlib.sha256(b"13:t:1").digest()[:4], "big")).shuffle(numbers)
    assert [r["doc_id"] for r in shuffled.where("query_id = '1'").orderBy("original_index").collect()] == ["abc"[i] for i in numbers]
    assert C.duplicates(samples, ["doc_id"]).count() == 3 and C.duplicates(samples, ["query_id", "doc_id"]).count() == 0
    pairs = C.across(samples.select("task", "split", "query_id").distinct(), spark.createDataFrame([("m",), ("n",)], "method string"))
    done = pairs.where("method = 'm'")
    assert pairs.count() == 4 and C.pending(pairs, done, ["task", "split", "query_id", "method"]).count() == 2
    assert C.scope(samples, 2).count() == 4


def test_the_joined_first_stage_has_the_same_rows(spark, monkeypatch):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, None if i == 7 else " ".join(rng.choices(words, k=rng.randrange(0, 12))) + " É!") for i in range(400)]
    asked = [(i, " ".join(rng.sample(words, rng.randrange(1, 4)))) for i in range(25)] + [(99, "..."), (98, None)]
    corpus, queries = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(asked, "query_id int, query string")

    def both():
        found = C.matches(queries, corpus, 4)
        return {tuple(r) for r in C.best_matches(found, 4).collect()}, {tuple(r) for r in found.where("full").collect()}

    monkeypatch.setattr(C, "_GATHERED", 100)
    by_index = both()
    monkeypatch.setattr(C, "INDEX_PAIRS", 0)
    assert by_index == both() and by_index[0] and by_index[1]
    sets = {i: {*t.lower().split()} & {*words} for i, t in docs if t}
    for q, text in asked[:25]:
        want = sorted(((-len({*text.split()} & s), d) for d, s in sets.items() if {*text.split()} & s))[:4]
        assert [(-r[2], r[1]) for r in sorted((r for r in by_index[0] if r[0] == q), key=lambda r: r[5])] == want
    names = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x")], "doc_id string, text string")
    monkeypatch.setattr(C, "INDEX_PAIRS", 100)
    assert [r["doc_id"] for r in C.first_stage(spark.createDataFrame([("q", "x y")], "query_id string, query string"), names, 2).orderBy("original_index").collect()] == ["a", "b"]


def test_the_first_stage_holds_no_more_when_more_texts_come(monkeypatch):
    """Long texts that share much with every query: what a task holds beside them is bounded, and the best are right."""
    import random
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    asked = [rng.sample(words, 30) for _ in range(100)]
    index = SimpleNamespace(value=C.QueryIndex(pa.array(range(100)), asked))
    texts = [rng.sample(words, 30) for _ in range(500)]
    batch = pa.array([" ".join([*t, *(f"n{i}" for i in range(1000))]) for t in texts])

    def peak(n: int) -> tuple[int, list]:
        tracemalloc.start()
        try:
            batches = (pa.RecordBatch.from_arrays([pa.array(range(b * 500, b * 500 + 500)), batch], ["doc_id", "text"]) for b in range(n))
            out = list(C._matcher(index, 5)(batches))
            return tracemalloc.get_traced_memory()[1], [tuple(r.values()) for x in out for r in x.to_pylist()]
        finally:
            tracemalloc.stop()

    few, many = peak(1), peak(8)
    assert few[0] < 24e6 and many[0] < 24e6
    sets = [{*t} for t in texts]
    want = {(q, *x) for q, a in enumerate(asked) for x in sorted(((d, len({*a} & sets[d % 500])) for d in range(4000)), key=lambda x: (-x[1], x[0]))[:5]}
    assert {r[:3] for r in many[1] if not r[5]} == want and {r[3:5] for r in many[1]} == {(1030, 30)}
    for name, small in (("_GATHERED", 70), ("_HELD", 90), ("_TEXTS", 3), ("_TRIPLES", 50), ("_LONG", 10)):  # handed on in parts: more rows, the same best
        monkeypatch.setattr(C, name, small)
    parts = peak(1)[1]
    assert {r for r in parts if r[5]} == {r for r in few[1] if r[5]} and len({*parts}) == len(parts) > len(few[1]) and {*few[1]} <= {*parts}
