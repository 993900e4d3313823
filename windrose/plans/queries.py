"""The engine's queries over the driver's tables, whole tables and whole texts.

``benchmark`` holds the queries and ``documents`` the corpus. The first stage takes the ``DEPTH`` documents that share most
distinct tokens with a query; the reranking score is the share of common tokens among all tokens of both. A document that
contains the query's text has grade 2 and a candidate labelled good has grade 1.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.config import LISTWISE, ORIGINAL, PAIRWISE, Listwise, Pairwise, PriceConfig, Strategy
from windrose.functions import parsing, scalar
from windrose.operators import candidates as C
from windrose.operators.metrics import aggregate_evaluations, evaluate, zero_if_invalid
from windrose.operators.providers import FunctionProvider
from windrose.operators.rerank import ask_provider, guard_length, length_failure, original_order, ranked_rows, rerank_by_score
from windrose.operators.summary import METRICS, failure_histogram, nearest_rank, summarise
from windrose.storage import materialised

DEPTH = 50
NO_LIMIT = 2**31 - 1
LISTWISE_20 = Listwise(window_size=20, stride=10, max_document_chars=NO_LIMIT)
PRICE = PriceConfig(2.5, 10.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of query and document that share tokens, written once for all that a query derives from them."""
    return materialised(C.matches(base_queries(spark, sf_dir), corpus(spark, sf_dir), DEPTH), "matches")


def light(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, original_index, score): the first stage and the reranking score in millionths; no text is read again."""
    found = C.matches(base_queries(spark, sf_dir), corpus(spark, sf_dir), DEPTH) if found is None else found
    score = F.floor(F.lit(1_000_000) * F.col("shared") / (F.col("doc_tokens") + F.col("query_tokens") - F.col("shared"))).cast("bigint")
    return C.best_matches(found, DEPTH).select("query_id", "doc_id", "original_index", score.alias("score"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``light`` with the texts of queries and documents."""
    rows = light(spark, sf_dir).join(corpus(spark, sf_dir), "doc_id").join(base_queries(spark, sf_dir), "query_id")
    return rows.select("query_id", "query", "doc_id", "text", "original_index", "score")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def qrels(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rel) with positive grades: containment over the whole corpus, labels over the pool of candidates.

    A document that contains the query has all its tokens, so the text test meets only pairs that share them all.
    """
    found = matched(spark, sf_dir) if found is None else found
    full = found.where("full").select("query_id", "doc_id").join(base_queries(spark, sf_dir), "query_id")
    contained = full.join(corpus(spark, sf_dir), "doc_id").where(F.contains("text", "query")).select("query_id", "doc_id", F.lit(2).alias("rel"))
    pool = C.best_matches(found, DEPTH).join(good_labels(spark, sf_dir).where("quality = 1"), "doc_id")
    graded = contained.unionByName(pool.select("query_id", "doc_id", F.lit(1).alias("rel")))
    return graded.groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))


def _ranked(strategy: Strategy, top_k: int | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = rerank_by_score(light(spark, sf_dir), "score", strategy, top_k=top_k)
        return ranked.select("query_id", "rank", "original_index", "doc_id", "score")

    return query


rerank_listwise_window = _ranked(LISTWISE_20)
rerank_listwise_single = _ranked(Listwise(window_size=DEPTH, stride=DEPTH))
rerank_prp_k1 = _ranked(Pairwise(passes=1))
rerank_prp_k10 = _ranked(Pairwise(passes=10))
rerank_top_k = _ranked(LISTWISE_20, top_k=5)


def rerank_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return original_order(light(spark, sf_dir)).select("query_id", "rank", "original_index", "doc_id", "score")


def candidate_scope_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking over the first 20 candidates; the others are dropped."""
    ranked = rerank_by_score(C.scope(light(spark, sf_dir), 20), "score", LISTWISE_20)
    return ranked.select("query_id", "rank", "original_index", "doc_id", "score")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched(spark, sf_dir)
    return evaluate(rerank_by_score(light(spark, sf_dir, found), "score", LISTWISE_20), qrels(spark, sf_dir, found), 10)


def _metric(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scores(spark, sf_dir).select("query_id", F.round(name, 6).alias(name))

    return query


def method_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per (task, query, method) of the four scores with accounting columns that follow from the query's id.

    The task is the parity of the query's id, and one query in seven counts as invalid.
    """
    found = matched(spark, sf_dir)
    light_ = materialised(light(spark, sf_dir, found), "candidates")  # read by every method
    ranked = original_order(light_).withColumn("method", F.lit(ORIGINAL))
    for strategy, name in ((LISTWISE_20, f"{LISTWISE}@{DEPTH}"), (Pairwise(passes=10), f"{PAIRWISE}@{DEPTH}")):
        ranked = ranked.unionByName(rerank_by_score(light_, "score", strategy).withColumn("method", F.lit(name)))
    scores = evaluate(ranked, qrels(spark, sf_dir, found), 10, by=["method"])
    q = F.col("query_id")
    called = F.col("method") != ORIGINAL
    valid = ~called | (q % 7 != 0)
    rows = zero_if_invalid(scores, valid).select(
        F.when(q % 2 == 0, "even").otherwise("odd").alias("task"), "query_id", "method",
        F.col("ndcg_at_k").alias("ndcg_at_10"), F.col("mrr_at_k").alias("mrr_at_10"), "map", F.col("recall_at_k").alias("recall_at_10"),
        valid.alias("valid"), F.when(~valid & (q % 2 == 0), "llm_output_invalid").when(~valid, "provider_error").alias("failure_type"),
        F.when(called, (q * 37 % 101).cast("double")).otherwise(0.0).alias("latency_ms"),
        F.when(called & valid, q * 10).alias("prompt_tokens"), F.when(called & valid, q).alias("completion_tokens"),
        F.when(called, (q % 9 + 1).cast("int")).otherwise(0).alias("llm_calls"),
    )
    return rows.withColumn("cost", scalar.estimate_cost(F.col("prompt_tokens"), F.col("completion_tokens"), PRICE))


def _rounded(df: DataFrame) -> DataFrame:
    """Nine digits: mean costs have seven or eight, so six would round halves."""
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def metric_zero_on_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = method_results(spark, sf_dir)
    return _rounded(rows.select("query_id", "method", "valid", *METRICS))


def summary_by_task_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summarise(method_results(spark, sf_dir)))


def summary_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregate_evaluations(method_results(spark, sf_dir), ["method"], METRICS))


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_histogram(method_results(spark, sf_dir))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(nearest_rank("value", 0.5).alias("p50"), nearest_rank("value", 0.95).alias("p95"))


def call_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls for reranking every order's line items, by each algorithm."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    n = F.col("n")
    return sizes.select("l_orderkey", "n", scalar.estimate_calls(n, Listwise(3, 2)).alias("listwise"), scalar.estimate_calls(n, Pairwise(10)).alias("pairwise"))


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per window of every order's line items, in the order of the calls."""
    strategy = Listwise(3, 2)
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    plan = sizes.select("l_orderkey", "n", F.posexplode(scalar.window_starts(F.col("n"), strategy)).alias("call", "start"))
    return plan.select("l_orderkey", "call", "start", F.least(F.col("start") + strategy.window_size, F.col("n")).cast("int").alias("upto"))


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of sending every document and receiving a tenth of it; unlabelled documents have no usage."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(good_labels(spark, sf_dir), "doc_id", "left")
    sent = F.when(F.col("quality").isNotNull(), F.col("n_chars"))
    return rows.select("doc_id", F.round(scalar.estimate_cost(sent, F.floor(sent / 10), PRICE), 9).alias("cost"))


def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_queries(spark, sf_dir).select("query_id", scalar.stable_seed(F.lit(13), F.lit("Task"), F.col("query_id")).alias("seed"))


def prompt_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of the prompt with all candidates of every query, whole texts."""
    entry = F.array_sort(F.collect_list(F.struct("original_index", "text")))
    packed = candidates(spark, sf_dir).groupBy("query_id", "query").agg(F.transform(entry, lambda x: x["text"]).alias("texts"))
    prompt = packed.select("query_id", scalar.listwise_prompt(F.col("query"), F.col("texts")).alias("p"))
    return prompt.select("query_id", F.md5("p").alias("digest"), F.length("p").cast("bigint").alias("chars"))


def prompt_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of the prompt for every pair of neighbours among the candidates."""
    rows = candidates(spark, sf_dir).select("query_id", "query", "original_index", "text")
    below = rows.select("query_id", (F.col("original_index") - 1).alias("original_index"), F.col("text").alias("below"))
    p = scalar.pairwise_prompt(F.col("query"), F.col("text"), F.col("below"))
    return rows.join(below, ["query_id", "original_index"]).select("query_id", "original_index", F.md5(p).alias("digest"), F.length(p).cast("bigint").alias("chars"))


def parse_ranking_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """failure_type of a ranking made from every order's line numbers, broken in some orders by their key."""
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("r"))
    n = F.size("r")
    broken = (
        F.when(key % 6 == 0, F.lit(None).cast("array<int>"))
        .when(key % 6 == 1, F.concat("r", F.array(F.lit(None).cast("int"))))
        .when(key % 6 == 2, F.concat("r", F.array(F.lit(1))))
        .when(key % 6 == 3, F.transform("r", lambda x: x + 1))
        .when(key % 6 == 4, F.transform("r", lambda x: F.lit(1)))
        .otherwise(F.reverse("r"))
    )
    made = rows.select("l_orderkey", n.alias("n"), broken.alias("r"))
    return made.select("l_orderkey", parsing.ranking_failure(F.col("r"), F.col("n")).alias("failure_type"), parsing.is_permutation(F.col("r"), F.col("n")).alias("valid"))


def qrels_join_default0(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched(spark, sf_dir)
    joined = light(spark, sf_dir, found).join(qrels(spark, sf_dir, found), ["query_id", "doc_id"], "left")
    return joined.select("query_id", "doc_id", F.coalesce("rel", F.lit(0)).alias("rel"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = spark.createDataFrame([(ORIGINAL,), (f"{LISTWISE}@{DEPTH}",), (f"{PAIRWISE}@{DEPTH}",)], "method string")
    return C.across(base_queries(spark, sf_dir).select("query_id"), methods)


def method_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run has left when all of one method and, of another, the queries with a relevant document are done."""
    judged = qrels(spark, sf_dir).select("query_id").distinct().withColumn("method", F.lit(f"{LISTWISE}@{DEPTH}"))
    done = base_queries(spark, sf_dir).select("query_id", F.lit(ORIGINAL).alias("method")).unionByName(judged)
    return C.pending(_pairs(spark, sf_dir), done, ["query_id", "method"])


def dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come more than once in the corpus, by hash."""
    docs = corpus(spark, sf_dir).where("text is not null").select(F.md5("text").alias("digest"))
    return C.duplicates(docs, ["digest"])


def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its length and whether the default limit refuses it."""
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", F.length(guard_length(F.col("text"), NO_LIMIT)).alias("chars"), length_failure(F.col("text"), Listwise().max_document_chars).alias("failure_type"))


def oracle_plus_hash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.oracle_plus_hash(corpus(spark, sf_dir), qrels(spark, sf_dir), 1000, 13)


def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hash_shuffle(light(spark, sf_dir), 13).select("query_id", "doc_id", "original_index")


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates in the order of Python's seeded shuffle; no SQL has that generator."""
    rows = light(spark, sf_dir).withColumn("task", F.lit("Task"))
    return C.seeded_shuffle(rows, 13).select("query_id", "doc_id", "original_index")


def first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_stage(base_queries(spark, sf_dir), corpus(spark, sf_dir), DEPTH).select("query_id", "doc_id", "shared", "original_index")


def _overlap(query: str, text: str) -> int:
    a, b = ({*re.findall("[a-z0-9]+", x.lower())} for x in (query, text))
    return 1_000_000 * len(a & b) // max(1, len(a | b))


class _Overlap(FunctionProvider):
    """The reranking score as a provider that answers in JSON; each text is read once a partition."""

    def __init__(self) -> None:
        super().__init__(lru_cache(maxsize=20_000)(_overlap))


def _provided(strategy: Strategy):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = materialised(candidates(spark, sf_dir), "candidates")  # asked and joined to the answers
        outcomes = ask_provider(rows, _Overlap, strategy, partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
        return ranked_rows(rows, outcomes).select("query_id", "rank", "original_index", "doc_id", "score")

    return query


provider_listwise = _provided(LISTWISE_20)
provider_pairwise = _provided(Pairwise(passes=10, max_document_chars=NO_LIMIT))


def parse_winner_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each conversation turn, taken as an answer or as the reason within one, names a winner: by the strict parser."""
    @F.pandas_udf("string")
    def winner(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: _winner(x))

    turns = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("why")))
    raw = F.coalesce("text", F.lit(""))
    for k, name in ((0, "A"), (1, "B"), (2, "a")):
        raw = F.when(kind == k, F.concat(F.lit(f'{{"winner": "{name}", '), F.substr(said, F.lit(2)))).otherwise(raw)
    return turns.select("conv_id", "turn", winner(raw).alias("winner"))


def _winner(raw: str) -> str | None:
    try:
        return parsing.parse_winner(raw)
    except parsing.RerankParseError:
        return None
