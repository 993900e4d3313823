"""Result logs, summaries and reports. Rows are written by executors; only summaries come to the driver."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from windrose.schemas import QUERY_RESULTS


def append_results(results: DataFrame, path: str) -> None:
    """One commit of finished rows, in folders by method."""
    results.write.mode("append").partitionBy("method").parquet(path)


def finished_results(spark: SparkSession, path: str) -> DataFrame:
    """The log so far; empty where nothing was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], QUERY_RESULTS)
    return spark.read.schema(QUERY_RESULTS).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_jsonl(path: str, rows: Sequence[Mapping[str, Any]]) -> None:
    """A small list of rows, keys in order, one JSON object a line."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(dict(r), ensure_ascii=False, sort_keys=True) + "\n" for r in rows)


_COLUMNS = [
    ("NDCG@10", "ndcg_at_10", ".4f"), ("MRR@10", "mrr_at_10", ".4f"), ("MAP", "map", ".4f"), ("Recall@10", "recall_at_10", ".4f"),
    ("p50 ms", "latency_p50_ms", ".1f"), ("p95 ms", "latency_p95_ms", ".1f"), ("invalid", "invalid_rate", ".3f"),
    ("calls", "llm_calls_mean", ".1f"), ("cost", "cost_mean_all", ".6f"),
]


def markdown_table(rows: Sequence[Mapping[str, Any]]) -> str:
    """Summary rows, by method."""
    lines = ["| method | " + " | ".join(n for n, _, _ in _COLUMNS) + " |", "|" + "---|" * (len(_COLUMNS) + 1)]
    lines += [f"| {r['method']} | " + " | ".join(format(r[c], f) for _, c, f in _COLUMNS) + " |" for r in sorted(rows, key=lambda r: r["method"])]
    return "\n".join(lines) + "\n"


def run_metadata(spark: SparkSession, arguments: Mapping[str, Any]) -> dict[str, Any]:
    """What the run was: arguments, versions, commit, start."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        commit = None
    return {
        "arguments": dict(arguments), "strict_validation": True, "zero_score_on_invalid": True, "spark": spark.version,
        "python": platform.python_version(), "commit": commit, "started": datetime.now(timezone.utc).isoformat(),
    }


def write_summaries(folder: str, summary: DataFrame, metadata: Mapping[str, Any]) -> None:
    """overall_summary.json, task_summary.json, metadata.json and result_tables.md."""
    rows = [r.asDict(True) for r in summary.orderBy("level", "task", "method").collect()]
    os.makedirs(folder, exist_ok=True)
    overall, tasks = ([r for r in rows if r["level"] == level] for level in ("overall", "task"))
    for name, value in (("overall_summary", overall), ("task_summary", tasks), ("metadata", metadata)):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2, sort_keys=True)
    parts = ["# Overall\n\n" + markdown_table(overall)]
    for task in sorted({r["task"] for r in tasks}):
        parts.append(f"# {task}\n\n" + markdown_table([r for r in tasks if r["task"] == task]))
    with open(os.path.join(folder, "result_tables.md"), "w", encoding="utf-8") as out:
        out.write("\n".join(parts))


def report(*, dataset: str, candidate_strategy: str, aggregate: DataFrame, per_query: DataFrame, call_estimates: Mapping[str, int], **settings: Any) -> dict[str, Any]:
    """The comparison's JSON object; ``benchmark_type`` says what its figures are worth."""
    kinds = {"fixture": "smoke_fixture", "oracle_plus_random": "diagnostic_not_retrieval"}
    kind = kinds.get("fixture" if dataset == "fixture" else candidate_strategy, "reranking_with_first_stage_candidates")
    return {
        "schema_version": 1, "benchmark_type": kind, "dataset": dataset, "candidate_strategy": candidate_strategy, **settings,
        "call_estimates": dict(call_estimates), "aggregate": [r.asDict(True) for r in aggregate.collect()],
        "per_query": [r.asDict(True) for r in per_query.collect()],
    }
