from __future__ import annotations

import json

import pytest

from windrose.sources import benchmarks as B
from windrose.sources.lines import numbered_lines
from windrose.sources.settings import parse_env, setting
from windrose.sources.sinks import markdown_table, report, run_metadata, write_jsonl


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


CASE = {
    "schema_version": 1, "fixture_id": "f", "dataset": "d", "source": "s", "license": "l", "query_id": "q1", "query": "what",
    "documents": [{"id": "a", "title": "A", "text": "x"}, {"id": "b", "title": "B", "text": "y"}], "qrels": {"a": 2},
}


@pytest.fixture
def cache(tmp_path):
    write(tmp_path / "corpus.jsonl", [{"_id": "d1", "title": "T", "text": "x"}, "", {"_id": "d2", "text": "y"}, {"_id": "d3", "text": "z"}])
    write(tmp_path / "queries.jsonl", [{"_id": "q1", "text": "one"}, {"_id": "q2", "text": "two"}])
    write(tmp_path / "qrels/test.tsv", ["query-id\tcorpus-id\tscore", "q1 d1 1", "q1\td1\t2", "q1 d2 1", "q1 d1 0", "q1 d3 0"])
    return tmp_path


def test_line_numbers_over_splits(spark, tmp_path):
    path = write(tmp_path / "x.txt", [f"line {i}" for i in range(1, 2001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = numbered_lines(spark, path)
        assert all(r["value"] == f"line {r['line_no']}" for r in rows.collect()) and rows.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cases(spark, tmp_path):
    cases = B.load_cases(spark, write(tmp_path / "c.jsonl", [CASE, "", dict(CASE, query_id="q2")]))
    candidates, qrels = B.case_tables(cases)
    assert candidates.count() == 4 and candidates.where("doc_id = 'b'").first()["text"] == "B\n\ny" and qrels.count() == 2
    for bad, message in (("{", ":2: not JSON"), ("[1]", ":2: not a JSON object"), (dict(CASE, schema_version=2), "schema_version"), (dict(CASE, query=""), "query must"), (dict(CASE, documents=[{"id": "a"}]), "a document needs")):
        with pytest.raises(ValueError, match=message):
            B.load_cases(spark, write(tmp_path / "bad.jsonl", [CASE, bad]))
    with pytest.raises(ValueError, match="no cases"):
        B.load_cases(spark, write(tmp_path / "none.jsonl", [""]))
    with pytest.raises(FileNotFoundError):
        B.load_cases(spark, str(tmp_path / "missing.jsonl"))


def test_beir(spark, cache):
    assert {tuple(r) for r in B.load_qrels(spark, str(cache / "qrels/test.tsv")).collect()} == {("q1", "d1", 2), ("q1", "d2", 1)}
    path = write(cache / "candidates.tsv", ["q1 d2 9", "q1 d1 1", "q1 d3 4"])
    candidates, _ = B.load_beir(spark, str(cache), candidates_path=path)
    assert [(r["doc_id"], r["text"]) for r in candidates.orderBy("original_index").collect()] == [("d2", "\n\ny"), ("d1", "T\n\nx"), ("d3", "\n\nz")]
    with pytest.raises(Exception, match="no document"):
        B.load_beir(spark, str(cache), candidates_path=write(cache / "u.tsv", ["q1 nope 1"]))[0].collect()
    with pytest.raises(Exception, match="no judgments"):
        B.load_beir(spark, str(cache), candidates_path=write(cache / "u.tsv", ["q2 d1 1"]))[0].collect()
    with pytest.raises(ValueError, match=":2: the candidate"):
        B.load_candidates(spark, write(cache / "t.tsv", ["q1 d1 1", "q1 d1 2"]))
    with pytest.raises(ValueError, match=":1: three columns"):
        B.load_qrels(spark, write(cache / "t.tsv", ["q1 d1"]))
    with pytest.raises(ValueError, match=":1: the score"):
        B.load_qrels(spark, write(cache / "t.tsv", ["q1 d1 x"]))
    picked, _ = B.load_beir(spark, str(cache), candidate_strategy="oracle_plus_random", candidate_count=3, seed=7)
    assert {r["doc_id"] for r in picked.collect()} == {"d1", "d2", "d3"}
    with pytest.raises(ValueError, match="more than the 1"):
        B.load_beir(spark, str(cache), candidate_strategy="oracle_plus_random", candidate_count=1)
    with pytest.raises(ValueError, match="comes 2 times"):
        B.load_corpus(spark, write(cache / "twice.jsonl", [{"_id": "a", "text": "x"}] * 2))


def test_task_samples(spark):
    corpus = spark.createDataFrame([("a", "T", " x "), ("b", None, "y")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q", "one")], "query_id string, query string")
    relevant = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0)], "query_id string, doc_id string, label double")
    top = spark.createDataFrame([("q", "b", 0), ("q", "z", 1)], "query_id string, doc_id string, original_index int")
    rows = B.task_samples(corpus, queries, relevant, top, task="t").orderBy("original_index").collect()
    assert [(r["doc_id"], r["text"], r["label"]) for r in rows] == [("b", "y", 0.0), ("z", "", 0.0)]
    assert B.task_samples(corpus, queries, relevant, None, task="t").count() == 2
    with pytest.raises(ValueError, match="not relevant"):
        B.task_samples(corpus, queries, relevant.where("label > 0"), None, task="t")


def test_settings_and_reports(spark, tmp_path, monkeypatch):
    text = "# c\nexport A='x # y'\nB=1 # note\n\n"
    assert parse_env(text) == {"A": "x # y", "B": "1"} and parse_env(text + "oops\n", strict=False)["B"] == "1 # note"
    with pytest.raises(ValueError):
        parse_env("oops")
    monkeypatch.setenv("A", "env")
    assert setting("A", {"A": "file"}) == "env" and setting("NOPE", required=False) is None
    with pytest.raises(ValueError):
        setting("NOPE")
    write_jsonl(str(tmp_path / "n/x.jsonl"), [{"b": 1, "a": "ü"}])
    assert (tmp_path / "n/x.jsonl").read_text() == '{"a": "ü", "b": 1}\n'
    row = dict.fromkeys(["ndcg_at_10", "mrr_at_10", "map", "recall_at_10", "latency_p50_ms", "latency_p95_ms", "invalid_rate", "llm_calls_mean", "cost_mean_all"], 0.5)
    assert markdown_table([dict(row, method="b"), dict(row, method="a")]).splitlines()[2].startswith("| a | 0.5000 |")
    one = spark.range(1)
    assert report(dataset="beir", candidate_strategy="oracle_plus_random", aggregate=one, per_query=one, call_estimates={})["benchmark_type"] == "diagnostic_not_retrieval"
    assert run_metadata(spark, {"x": 1})["zero_score_on_invalid"]
