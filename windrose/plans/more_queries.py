"""Queries that take the driver's tables through loaders, runs and streams: written to the shared folder in each format first."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.config import LISTWISE, PAIRWISE, Listwise, Pairwise
from windrose.functions import parsing, scalar
from windrose.operators import candidates as C
from windrose.operators.metrics import aggregate_evaluations, evaluate
from windrose.operators.providers import FunctionProvider
from windrose.operators.rerank import Reranker, ask_provider, ranked_rows, rerank_by_score
from windrose.plans import queries as Q
from windrose.plans import runner
from windrose.sources import benchmarks as B
from windrose.storage import materialised, shared_folder
from windrose.streaming.rerank_stream import rerank_packed


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _text(value: str) -> Column:
    return F.col(value).cast("string")


def _stored_lines(rows: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """The column ``value`` as a text file; where the order of its lines counts, one file in that order."""
    (rows.coalesce(1).sortWithinPartitions(*order) if order else rows).select("value").write.text(path)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("value")


def _stored_corpus(spark: SparkSession, sf_dir: str, path: str) -> None:
    docs = Q.table(spark, sf_dir, "documents").where("text <> ''")
    _stored_lines(docs.select(_json(_id=_text("doc_id"), title=_text("source"), text=F.col("text"))), path)


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as JSONL and loaded."""
    path = f"{_folder(spark)}/corpus.jsonl"
    _stored_corpus(spark, sf_dir, path)
    return B.load_corpus(spark, path).select("doc_id", "title", F.md5("text").alias("digest"))


def _stored_cache(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A cache of corpus, queries and judgments, and its candidates, of the queries that have judgments."""
    folder = _folder(spark)
    _stored_corpus(spark, sf_dir, f"{folder}/corpus.jsonl")
    _stored_lines(Q.base_queries(spark, sf_dir).where("query <> ''").select(_json(_id=_text("query_id"), text=F.col("query"))), f"{folder}/queries.jsonl")
    found = Q.matched(spark, sf_dir)
    judged = materialised(Q.qrels(spark, sf_dir, found), "judged")
    header = spark.createDataFrame([("query-id\tcorpus-id\tscore", -1)], "value string, query_id bigint")
    lines = judged.select(F.concat_ws("\t", "query_id", "doc_id", "rel").alias("value"), "query_id")
    _stored_lines(header.unionByName(lines), f"{folder}/qrels/test.tsv", ["query_id"])
    pairs = Q.light(spark, sf_dir, found).join(judged.select("query_id").distinct(), "query_id", "left_semi")
    _stored_lines(pairs.select(F.concat_ws(" ", "query_id", "doc_id", "score").alias("value"), "query_id", "original_index"), f"{folder}/candidates.tsv", ["query_id", "original_index"])
    return folder, f"{folder}/candidates.tsv"


def load_beir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a cache of the whole corpus, all joins that must match, the first 25 cases in string order."""
    folder, candidates = _stored_cache(spark, sf_dir)
    rows, _ = B.load_beir(spark, folder, candidates_path=candidates, max_cases=25)
    return rows.select("case_id", "query_id", "doc_id", "original_index", F.md5("text").alias("digest"), F.md5("query").alias("asked"))


def load_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgments: positive ones stay, written with a header and loaded."""
    path = f"{_folder(spark)}/test.tsv"
    labels = Q.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    _stored_lines(labels.select(F.concat_ws("  ", F.lit("q"), "doc_id", "quality").alias("value")), path)
    return B.load_qrels(spark, path).select("query_id", "doc_id", "rel")


def load_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cases of every judged query with its candidates, written as JSONL, checked, loaded and made long."""
    found = Q.matched(spark, sf_dir)
    judged = Q.qrels(spark, sf_dir, found).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(_text("doc_id"), "rel")))).alias("qrels"))
    texts = Q.corpus(spark, sf_dir).where("text <> ''")
    entry = F.struct("original_index", F.struct(_text("doc_id").alias("id"), F.lit("t").alias("title"), F.col("text").alias("text")).alias("d"))
    rows = Q.light(spark, sf_dir, found).join(texts, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["d"]).alias("documents"))
    cases = rows.join(judged, "query_id").join(Q.base_queries(spark, sf_dir), "query_id")
    value = _json(
        schema_version=F.lit(1), fixture_id=F.concat(F.lit("f"), _text("query_id")), dataset=F.lit("d"), source=F.lit("s"), license=F.lit("l"),
        query_id=_text("query_id"), query=F.col("query"), documents=F.col("documents"), qrels=F.col("qrels"),
    )
    path = f"{_folder(spark)}/cases.jsonl"
    _stored_lines(cases.select(value), path)
    candidates, qrels = B.case_tables(B.load_cases(spark, path))
    joined = candidates.join(qrels, ["query_id", "doc_id"], "left")
    return joined.select("query_id", "doc_id", "original_index", F.md5("text").alias("digest"), F.coalesce("rel", F.lit(0)).alias("rel"))


def load_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored tasks, one by source of candidates, loaded with the first ten queries of each in string order."""
    root, found = _folder(spark), materialised(Q.light(spark, sf_dir), "light")
    docs = Q.table(spark, sf_dir, "documents").select(_text("doc_id").alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), "text")
    for name, rest in (("even", 0), ("odd", 1)):
        own = found.where(F.col("query_id") % 2 == rest).select(_text("query_id").alias("query_id"), _text("doc_id").alias("doc_id"), "original_index")
        labels = Q.good_labels(spark, sf_dir).select(_text("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("label"))
        folder = f"{root}/{name}/test"
        docs.write.parquet(f"{folder}/corpus.parquet")
        Q.base_queries(spark, sf_dir).select(_text("query_id").alias("query_id"), "query").write.parquet(f"{folder}/queries.parquet")
        own.join(labels, "doc_id").select("query_id", "doc_id", "label").write.parquet(f"{folder}/relevant_docs.parquet")
        own.write.parquet(f"{folder}/top_ranked.parquet")
    rows = B.load_tasks(spark, root, max_queries=10, max_document_chars=Q.NO_LIMIT)
    return rows.select("task", "split", "query_id", "doc_id", "original_index", F.md5("text").alias("digest"), F.col("label").cast("int").alias("label"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.candidates(spark, sf_dir).join(Q.good_labels(spark, sf_dir), "doc_id", "left")
    task = F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")
    return materialised(
        rows.select(
            task.alias("task"), F.lit("test").alias("split"), _text("query_id").alias("query_id"), "query", "original_index", _text("doc_id").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("label"),
        ), "samples",
    )


class _Stop(Exception):
    pass


def resume_after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run that died after its first batch and was resumed: every pair of sample and method once."""
    samples, log = _samples(spark, sf_dir), f"{_folder(spark)}/log"
    methods = ["original", f"{LISTWISE}@50", f"{LISTWISE}@20"]
    strategy = Q.LISTWISE_20
    batch = max(1, Q.base_queries(spark, sf_dir).count() // 2)

    def die(_: DataFrame) -> None:
        raise _Stop

    try:
        runner.run(spark, samples, methods, log, provider=Q._Overlap, batch_queries=batch, on_batch=die, listwise=strategy)
    except _Stop:
        pass
    done = runner.run(spark, samples, methods, log, provider=Q._Overlap, batch_queries=batch, listwise=strategy)
    return done.select("task", "query_id", "method", "valid", "llm_calls", F.round("mrr_at_10", 9).alias("mrr_at_10"), F.round("map", 9).alias("map"), F.round("recall_at_10", 9).alias("recall_at_10"))


def compare_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both algorithms over all queries: cases, means and the calls they would make."""
    found = Q.matched(spark, sf_dir)
    light_ = materialised(Q.light(spark, sf_dir, found), "light")
    strategies = {LISTWISE: Q.LISTWISE_20, PAIRWISE: Pairwise(passes=10)}
    aggregate, _ = runner.compare(light_, Q.qrels(spark, sf_dir, found), strategies, score="score", top_k=10)
    calls = runner.call_totals(light_, strategies)
    total = F.when(F.col("algorithm") == LISTWISE, F.lit(calls[LISTWISE])).otherwise(F.lit(calls[PAIRWISE])).cast("bigint")
    return aggregate.select("algorithm", "case_count", *(F.round(c, 9).alias(c) for c in ("ndcg_at_k", "mrr_at_k", "recall_at_k", "map")), total.alias("calls"))


def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reranking all orders' line items would cost in calls, by algorithm."""
    lines = Q.table(spark, sf_dir, "lineitem").select("l_orderkey")
    totals = runner.call_totals(lines, {"listwise": Listwise(3, 2), "pairwise": Pairwise(10)}, ["l_orderkey"])
    return spark.createDataFrame(list(totals.items()), "algorithm string, calls bigint")


def window_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows moved by their end over every order's line items, the last may be short."""
    sizes = Q.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    plan = sizes.select("l_orderkey", F.posexplode(scalar.range_plan(F.col("n"), 3, 2)).alias("call", "x"))
    return plan.select("l_orderkey", "call", "x.start", "x.upto")


def compose_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of both ways to put a title before every document's text; one title in three is empty and one missing."""
    title = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    docs = Q.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(scalar.compose_title(title, F.col("text"))).alias("always"), F.md5(scalar.compose_optional_title(title, F.col("text"))).alias("optional"))


def apply_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every order in the order of a ranking: from the last line back."""
    rows = Q.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    ranking = F.transform("x", lambda _, i: F.size("x") - i)
    return rows.select("l_orderkey", F.posexplode(parsing.apply_permutation(F.col("x"), ranking)).alias("pos", "y")).select("l_orderkey", "pos", F.col("y.l_partkey").alias("l_partkey"))


def strict_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in JSON about every order's lines, sound or broken, read by the strict parser."""
    @F.pandas_udf("failure_type string, best int")
    def read(raw: pd.Series, n: pd.Series) -> pd.DataFrame:
        found = [parsing.classify_ranking(r, int(k)) for r, k in zip(raw, n)]
        return pd.DataFrame({"failure_type": [f.failure_type for f in found], "best": pd.array([f.ranking[0] if f.valid else None for f in found], "Int32")})

    key = F.col("l_orderkey") % 8
    rows = Q.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sequence(F.lit(1), F.count("*").cast("int")).alias("r"))
    listed = F.array_join(F.reverse("r"), ", ")
    raw = (
        F.when(key == 0, F.concat(F.lit('{"ranking": ['), listed, F.lit("]")))
        .when(key == 1, F.concat(F.lit('{"ranking": ['), listed, F.lit(']} and that is all')))
        .when(key == 2, F.concat(F.lit('{"order": ['), listed, F.lit("]}")))
        .when(key == 3, F.concat(F.lit('{"ranking": ['), listed, F.lit(", true]}")))
        .when(key == 4, F.concat(F.lit('{"ranking": ['), listed, F.lit(", 1]}")))
        .when(key == 5, F.concat(F.lit('{"ranking": ['), F.array_join(F.transform("r", lambda x: x + 1), ","), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"why": "[1, 2]", "ranking": ['), listed, F.lit("]}")))
    )
    return rows.select("l_orderkey", read(raw, F.size("r")).alias("x")).select("l_orderkey", "x.failure_type", "x.best")


class _AsyncOverlap(Q._Overlap):
    """The same answers, awaited, with the number of texts as the tokens of a call."""

    async def rank(self, query, documents):
        return FunctionProvider.rank(self, query, documents), (len(documents), 1)

    async def compare(self, query, a, b):
        return FunctionProvider.compare(self, query, a, b), (2, 1)


def _asked(strategy):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = materialised(Q.candidates(spark, sf_dir), "candidates")
        outcomes = ask_provider(rows, _AsyncOverlap, strategy, max_concurrency=8, partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
        return ranked_rows(rows, outcomes).select("query_id", "rank", "original_index", "doc_id", "score")

    return query


provider_listwise_async = _asked(Q.LISTWISE_20)
provider_pairwise_async = _asked(Pairwise(passes=2, max_document_chars=Q.NO_LIMIT))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By query the calls, reports and tokens of a listwise walk."""
    outcomes = ask_provider(Q.candidates(spark, sf_dir), _AsyncOverlap, Q.LISTWISE_20, max_concurrency=8)
    return outcomes.select("query_id", "valid", "llm_calls", "usage_reports", "prompt_tokens", "completion_tokens")


class _Whole:
    """A strategy of one's own: the whole list in one call, then the best half turned over twice, which changes nothing."""

    algorithm, max_document_chars, needs = "whole_list", Q.NO_LIMIT, ("rank",)

    async def walk(self, ask, query, texts):
        order = [r - 1 for r in parsing.parse_ranking(await ask("rank", query, texts), len(texts))] if texts else []
        half = len(order) // 2
        return order[:half][::-1][::-1] + order[half:]


def custom_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = Reranker(_Whole(), provider=Q._Overlap).transform(Q.candidates(spark, sf_dir))
    return ranked.select("query_id", "rank", "original_index", "doc_id", "score", F.col("result_metadata")["strategy"].alias("strategy"))


def stream_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's candidates as a stream of packed rows, ranked and appended by micro-batches."""
    folder = _folder(spark)
    entry = F.struct("original_index", F.struct("doc_id", F.col("score").cast("double").alias("score")).alias("x"))
    packed = Q.light(spark, sf_dir).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["x"]).alias("candidates"))
    packed.write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    ranked = rerank_packed(stream, Q.LISTWISE_20)
    ranked.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(ranked.schema).parquet(f"{folder}/out").select("query_id", "rank", "original_index", "doc_id")


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with several orders of one priority."""
    return C.duplicates(Q.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


def aggregate_by_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of cases and macro means of two orders of the same candidates."""
    found = Q.matched(spark, sf_dir)
    light_ = materialised(Q.light(spark, sf_dir, found), "light")
    judged = Q.qrels(spark, sf_dir, found)
    ranked = {"first_stage": light_.withColumn("rank", F.col("original_index") + 1), "single": rerank_by_score(light_, "score", Listwise(window_size=Q.DEPTH, stride=Q.DEPTH))}
    scored = [evaluate(r, judged, 10).withColumn("algorithm", F.lit(n)) for n, r in ranked.items()]
    out = aggregate_evaluations(scored[0].unionByName(scored[1]))
    return out.select("algorithm", "case_count", *(F.round(c, 9).alias(c) for c in ("ndcg_at_k", "mrr_at_k", "recall_at_k", "map")))


QUERIES = {
    f.__name__: f
    for f in (
        load_corpus, load_beir, load_qrels, load_fixture, load_tasks, resume_after_crash, compare_algorithms, call_totals, window_ranges, compose_titles,
        apply_permutation, strict_rankings, usage_totals, custom_strategy, stream_rerank, duplicate_pairs, aggregate_by_algorithm,
    )
} | {"provider_listwise_async": provider_listwise_async, "provider_pairwise_async": provider_pairwise_async}
