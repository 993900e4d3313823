"""Command line: ``compare`` algorithms over a benchmark, or ``evaluate`` methods over stored samples, resumably.

``--provider module:factory`` names a picklable factory; because its calls may be paid, it needs ``--allow-live``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import shutil
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.config import LISTWISE, ORIGINAL, PAIRWISE, Listwise, Pairwise, PriceConfig, parse_method
from windrose.operators.candidates import seeded_shuffle
from windrose.plans import runner
from windrose.sources import benchmarks, sinks
from windrose.sources.settings import parse_env


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="windrose")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--provider", help="module:factory")
    common.add_argument("--env-file", help="KEY=value lines, set where the environment has no such key")
    common.add_argument("--allow-live", action="store_true")
    common.add_argument("--split", default="test")
    common.add_argument("--max-document-chars", type=int, default=4000)

    c = commands.add_parser("compare", parents=[common])
    c.add_argument("--dataset", choices=["fixture", "beir"], default="fixture")
    for name in ("--fixture", "--cache-dir", "--candidates", "--output"):
        c.add_argument(name)
    c.add_argument("--candidate-strategy", choices=["candidate_file", "oracle_plus_random"], default="candidate_file")
    c.add_argument("--algorithm", choices=["all", LISTWISE, PAIRWISE], default="all")
    for name, value in (("--candidate-count", 20), ("--seed", 13), ("--window-size", 3), ("--stride", 2), ("--passes", 10), ("--top-k", 3), ("--max-cases", None)):
        c.add_argument(name, type=int, default=value)

    e = commands.add_parser("evaluate", parents=[common])
    e.add_argument("--samples", help="Parquet of the sample schema")
    e.add_argument("--tasks-dir", help="stored tasks: <task>/<split>/{corpus,queries,relevant_docs,top_ranked}.parquet or .jsonl")
    e.add_argument("--tasks", nargs="+", help="of --tasks-dir; by default all")
    e.add_argument("--list-tasks", action="store_true")
    e.add_argument("--inspect-task-schema", metavar="TASK")
    e.add_argument("--methods", nargs="+", default=["original", f"{LISTWISE}@100"])
    e.add_argument("--output-dir")
    for name in ("--overwrite", "--resume", "--shuffle-candidates"):
        e.add_argument(name, action="store_true")
    for name, value in (("--max-queries", None), ("--shuffle-seed", 13), ("--rankgpt-window-size", 20), ("--rankgpt-step", 10), ("--prp-passes", 10), ("--concurrency", 1), ("--partitions", None), ("--batch-queries", 1000)):
        e.add_argument(name, type=int, default=value)
    for name in ("--input-price", "--output-price"):
        e.add_argument(name, type=float)
    return parser


def _checked(args: argparse.Namespace, parser: argparse.ArgumentParser) -> None:
    live = args.command == "compare" or not (args.list_tasks or args.inspect_task_schema) and any(m != ORIGINAL for m in args.methods)
    if live and not args.provider:
        parser.error("all methods but original need --provider")
    if live and not args.allow_live:
        parser.error("a provider's calls may be paid for: --allow-live says that this is meant")
    if args.command == "compare":
        if args.dataset == "fixture" and not args.fixture or args.dataset == "beir" and not args.cache_dir:
            parser.error("fixture needs --fixture, beir needs --cache-dir")
        if args.dataset == "beir" and args.candidate_strategy == "candidate_file" and not args.candidates:
            parser.error("candidate_file needs --candidates")
    else:
        for name in args.methods:
            parse_method(name)
        if args.resume and args.overwrite:
            parser.error("--resume and --overwrite exclude each other")
        if (args.list_tasks or args.inspect_task_schema or args.tasks) and not args.tasks_dir:
            parser.error("tasks lie in --tasks-dir")
        if not (args.list_tasks or args.inspect_task_schema) and bool(args.samples) == bool(args.tasks_dir):
            parser.error("give either --samples or --tasks-dir")
        if min(args.input_price or 0, args.output_price or 0) < 0:
            parser.error("prices must not be negative")
        if (args.input_price is None) != (args.output_price is None):
            parser.error("prices come in pairs")
    for name in ("candidate_count", "max_cases", "max_queries", "top_k", "concurrency", "partitions", "batch_queries", "max_document_chars", "prp_passes", "passes", "rankgpt_window_size", "rankgpt_step", "window_size", "stride"):
        if (value := getattr(args, name, None)) is not None and value < 1:
            parser.error(f"--{name.replace('_', '-')} must be 1 or more")


def _factory(name: str) -> Callable[[], Any]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _compare(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    if args.dataset == "fixture":
        candidates, qrels = benchmarks.case_tables(benchmarks.load_cases(spark, args.fixture))
    else:
        candidates, qrels = benchmarks.load_beir(
            spark, args.cache_dir, split=args.split, candidates_path=args.candidates, candidate_strategy=args.candidate_strategy,
            candidate_count=args.candidate_count, max_cases=args.max_cases, seed=args.seed,
        )
    every = {LISTWISE: Listwise(args.window_size, args.stride, args.max_document_chars), PAIRWISE: Pairwise(args.passes, args.max_document_chars)}
    strategies = {n: s for n, s in every.items() if args.algorithm in ("all", n)}
    calls = runner.call_totals(candidates, strategies)
    aggregate, per_query = runner.compare(candidates, qrels, strategies, provider=_factory(args.provider), top_k=args.top_k)
    settings = {k: getattr(args, k) for k in ("split", "seed", "top_k", "window_size", "stride", "passes", "candidate_count")}
    made = sinks.report(dataset=args.dataset, candidate_strategy=args.candidate_strategy, aggregate=aggregate, per_query=per_query, call_estimates=calls, **settings)
    text = json.dumps(made, ensure_ascii=False, indent=2, sort_keys=True)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            out.write(text + "\n")
    else:
        print(text)
    return made


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.list_tasks:
        print(json.dumps(benchmarks.list_tasks(spark, args.tasks_dir), indent=2))
        return
    if args.inspect_task_schema:
        print(json.dumps(benchmarks.inspect_task(spark, args.tasks_dir, args.inspect_task_schema), indent=2))
        return
    if args.output_dir is None:
        return  # arguments are checked, nothing is run
    log = os.path.join(args.output_dir, "query_results")
    if os.path.exists(log) and args.overwrite:
        shutil.rmtree(log)
    if args.tasks_dir:
        samples = benchmarks.load_tasks(
            spark, args.tasks_dir, args.tasks, split=args.split, max_queries=args.max_queries, max_document_chars=args.max_document_chars,
            shuffle_seed=args.shuffle_seed if args.shuffle_candidates else None,
        )
    else:
        samples = _stored_samples(spark, args)
    price = None if args.input_price is None else PriceConfig(args.input_price, args.output_price)
    results = runner.run(
        spark, samples, args.methods, log, provider=_factory(args.provider) if args.provider else None, resume=args.resume, batch_queries=args.batch_queries, price=price,
        max_concurrency=args.concurrency, partitions=args.partitions,
        listwise=Listwise(args.rankgpt_window_size, args.rankgpt_step, args.max_document_chars), pairwise=Pairwise(args.prp_passes, args.max_document_chars),
    )
    runner.summaries(results, args.output_dir, {k: v for k, v in vars(args).items() if k != "provider"})


def _stored_samples(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    samples = spark.read.parquet(args.samples)
    if args.max_queries is not None:
        keys = ["task", "split", "query_id"]
        place = F.row_number().over(W.partitionBy("task", "split").orderBy("query_id"))
        first = samples.select(*keys).distinct().withColumn("nth", place).where(F.col("nth") <= args.max_queries).select(*keys)
        samples = samples.join(first, keys, "left_semi")
    return seeded_shuffle(samples, args.shuffle_seed) if args.shuffle_candidates else samples


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = _parser()
    args = parser.parse_args(argv)
    _checked(args, parser)
    if args.env_file:
        with open(args.env_file, encoding="utf-8") as file:
            for key, value in parse_env(file.read()).items():
                os.environ.setdefault(key, value)
    spark = spark or SparkSession.builder.appName("windrose").getOrCreate()
    (_compare if args.command == "compare" else _evaluate)(spark, args)


if __name__ == "__main__":
    main()
