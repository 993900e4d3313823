from __future__ import annotations

import json

import pytest

from tests.test_sources import CASE, write
from windrose.errors import DocumentTooLongError
from windrose.plans.cli import main
from windrose.schemas import SAMPLE

PROVIDER = ["--provider", "tests.test_providers:by_length", "--allow-live"]


def test_compare(spark, tmp_path):
    fixture = write(tmp_path / "c.jsonl", [CASE])
    main(["compare", "--fixture", fixture, "--output", str(tmp_path / "r.json"), *PROVIDER], spark)
    made = json.loads((tmp_path / "r.json").read_text())
    assert made["benchmark_type"] == "smoke_fixture" and made["call_estimates"] == {"rankgpt_sliding_window": 1, "prp_sliding_k": 20}
    assert {r["algorithm"]: r["ndcg_at_k"] for r in made["aggregate"]} == {"rankgpt_sliding_window": 1.0, "prp_sliding_k": 1.0}


def test_evaluate(spark, tmp_path):
    rows = [("t", "test", q, "x", i, d, d * (i + 1), float(d == "b")) for q in ("1", "2") for i, d in enumerate("ab")]
    spark.createDataFrame(rows, SAMPLE).write.parquet(str(tmp_path / "s"))
    args = ["evaluate", "--samples", str(tmp_path / "s"), "--output-dir", str(tmp_path / "o"), "--max-queries", "1", *PROVIDER]
    main(args, spark)
    overall = {r["method"]: r for r in json.loads((tmp_path / "o/overall_summary.json").read_text())}
    assert overall["original"]["mrr_at_10"] == 0.5 and overall["rankgpt_sliding_window@100"]["mrr_at_10"] == 1.0
    with pytest.raises(ValueError):
        main(args, spark)
    main([*args[:5], "--resume", *PROVIDER], spark)
    assert spark.read.parquet(str(tmp_path / "o/query_results")).count() == 4


def store(spark, root, name, ranked=True):
    folder = f"{root}/{name}/test"
    spark.createDataFrame([("a", "T", "x"), ("b", None, "yyy")], "doc_id string, title string, text string").write.parquet(f"{folder}/corpus.parquet")
    write(root / name / "test/queries.jsonl", [{"query_id": q, "query": f"ask {q}"} for q in "12"])
    spark.createDataFrame([(q, d, float(d == "b")) for q in "12" for d in "ab"], "query_id string, doc_id string, label double").write.parquet(f"{folder}/relevant_docs.parquet")
    if ranked:
        spark.createDataFrame([(q, d, i) for q in "12" for i, d in enumerate("ab")], "query_id string, doc_id string, original_index int").write.parquet(f"{folder}/top_ranked.parquet")


def test_stored_tasks(spark, tmp_path, capsys, monkeypatch):
    root = tmp_path / "tasks"
    root.mkdir()
    store(spark, root, "one")
    store(spark, root, "two", ranked=False)
    main(["evaluate", "--tasks-dir", str(root), "--list-tasks"], spark)
    assert [t["name"] for t in json.loads(capsys.readouterr().out)] == ["one", "two"]
    main(["evaluate", "--tasks-dir", str(root), "--inspect-task-schema", "two"], spark)
    assert json.loads(capsys.readouterr().out)["test"] == {"corpus": {"doc_id": "string", "title": "string", "text": "string"}, "queries": {"query_id": "string", "query": "string"}, "relevant_docs": {"query_id": "string", "doc_id": "string", "label": "double"}, "top_ranked": None}
    monkeypatch.delenv("WINDROSE_TEST", raising=False)
    env = tmp_path / "env"
    env.write_text("WINDROSE_TEST='from file'\n")
    main(["evaluate", "--tasks-dir", str(root), "--methods", "original", "--output-dir", str(tmp_path / "o"), "--env-file", str(env), "--max-queries", "1"], spark)
    import os

    assert os.environ.pop("WINDROSE_TEST") == "from file"
    tasks = json.loads((tmp_path / "o/task_summary.json").read_text())
    assert {(r["task"], r["query_count"], r["mrr_at_10"]) for r in tasks} == {("one", 1, 0.5), ("two", 1, 0.5)} and tasks[0]["failure_type_counts"] == {}
    with pytest.raises(ValueError, match="no task 'three'"):
        main(["evaluate", "--tasks-dir", str(root), "--tasks", "three", "--methods", "original", "--output-dir", str(tmp_path / "p")], spark)
    with pytest.raises(DocumentTooLongError, match="document a has 4"):
        main(["evaluate", "--tasks-dir", str(root), "--max-document-chars", "3", "--methods", "original", "--output-dir", str(tmp_path / "p")], spark)


@pytest.mark.parametrize("args", [["compare", *PROVIDER], ["compare", "--provider", "x:y"], ["evaluate", "--samples", "s", "--resume", "--overwrite", *PROVIDER], ["evaluate", "--samples", "s", "--input-price", "1", *PROVIDER], ["evaluate", "--samples", "s", "--input-price", "-1", "--output-price", "1", *PROVIDER], ["evaluate", "--samples", "s"], ["evaluate", "--methods", "original"], ["evaluate", "--samples", "s", "--tasks-dir", "t", *PROVIDER], ["evaluate", "--samples", "s", "--tasks", "t", *PROVIDER]])
def test_arguments(args):
    with pytest.raises(SystemExit):
        main(args)
