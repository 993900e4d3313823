"""Reranking long candidate rows: by a score that is already a column, or by a provider.

Input: a row per candidate with the ``keys`` of its query, ``original_index`` (0-based) and, for providers, ``query`` and ``text``. Output: the same
rows, all columns, with ``rank`` (1-based), the first ``top_k`` of each query if that is given. ``top_k`` never narrows the work.
Only scores and positions pass through the fold; the other columns wait in the same row, or are joined to a provider's answer.
"""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.config import Listwise, Strategy, check_capability, check_top_k, kind_of
from windrose.errors import BY_FAILURE, RerankError, RerankInputError
from windrose.functions.scalar import estimate_calls
from windrose.operators.folds import fold
from windrose.operators.providers import NOT_ASKED, Outcome, Pool
from windrose.schemas import OUTCOME
from windrose.storage import materialised


@dataclass(frozen=True)
class Document:
    text: str
    id: str | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Ranked:
    """A document with its place, 1 for the best, and where it was in the list that was given, from 0."""

    document: Document
    rank: int
    original_index: int
    metadata: Mapping[str, Any]


def normalised(documents: Sequence[str | Document]) -> list[Document]:
    """Texts become documents without an id; anything else is a ``TypeError``."""
    for d in documents:
        if not isinstance(d, (str, Document)):
            raise TypeError(f"a document is a text or a Document, not {type(d).__name__}")
    return [d if isinstance(d, Document) else Document(d) for d in documents]


def length_failure(text: Column, limit: int) -> Column:
    """The failure_type of a text that is longer than the limit; null for others."""
    return F.when(F.length(text) > limit, "document_too_long")


def guard_length(text: Column, limit: int) -> Column:
    """``text``, or an error that names its length, where it is longer than the limit; it is never cut."""
    message = F.format_string(f"document of %d characters; the limit is {limit}", F.length(text))
    return F.when(length_failure(text, limit).isNotNull(), F.raise_error(message)).otherwise(text)


def _scored(ranked: DataFrame, top_k: int | None) -> DataFrame:
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def rerank_by_score(candidates: DataFrame, score: Column | str, strategy: Strategy, *, keys: Sequence[str] = ("query_id",), top_k: int | None = None) -> DataFrame:
    """Candidates in the strategy's order by ``score``, larger first; ties keep their order, a null score comes last.

    All that a query's row needs to carry along rides in its array, so the fold costs one exchange by ``keys``.
    """
    check_top_k(top_k)
    score = F.col(score) if isinstance(score, str) else score
    rest = [c for c in candidates.columns if c not in (*keys, "original_index")]
    k = F.coalesce(-score.cast("double"), F.lit(float("inf")))
    item = F.struct(k.alias("k"), F.col("original_index").alias("i"), F.struct(*rest).alias("rest")) if rest else F.struct(k.alias("k"), F.col("original_index").alias("i"))
    packed = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("original_index").alias("at"), item.alias("item")))).alias("items"))
    # Positions only go through the fold: the payload is fetched by the final order.
    packed = packed.select(*keys, F.transform("items", lambda x: x["item"]).alias("payload"))
    packed = packed.withColumn("light", F.transform("payload", lambda x, p: F.struct(x["k"].alias("k"), x["i"].alias("i"), p.alias("at"))))
    folded = packed.select(*keys, "payload", fold(F.col("light"), strategy).alias("order"))
    if top_k is not None:
        folded = folded.withColumn("order", F.slice("order", 1, top_k))
    placed = folded.select(*keys, "payload", F.posexplode("order").alias("pos", "x"))
    got = F.element_at("payload", F.col("x.at") + 1)
    placed = placed.select(*keys, (F.col("pos") + 1).cast("int").alias("rank"), got.alias("item"))
    return placed.select(*keys, "rank", F.col("item.i").alias("original_index"), *(F.col("item.rest").getField(c).alias(c) for c in rest))


def original_order(candidates: DataFrame, *, top_k: int | None = None) -> DataFrame:
    """The method that calls nothing: rank is place."""
    check_top_k(top_k)
    return _scored(candidates.withColumn("rank", (F.col("original_index") + 1).cast("int")), top_k)


#: Queries whose answers a task hands on together: what an executor's loss can cost, and what it holds in memory.
_TOGETHER = 64


def _partition(factory: Callable[[], Any], strategy: Strategy, keys: Sequence[str], max_concurrency: int, fail_fast: bool, on_usage: Callable | None):
    names = [x.split()[0] for x in OUTCOME.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, failed = None, False
        for batch in batches:
            for at in range(0, len(batch), max(_TOGETHER, 4 * max_concurrency)):
                part = batch.iloc[at : at + max(_TOGETHER, 4 * max_concurrency)]
                pool = Pool(factory, max_concurrency) if pool is None else pool
                asked = [(q, list(t)) for q, t in zip(part["query"], part["texts"])]
                if failed and fail_fast:
                    found = [Outcome(valid=False, failure_type=NOT_ASKED) for _ in asked]
                else:
                    found = asyncio.run(pool.answers(asked, strategy, fail_fast=fail_fast, on_usage=on_usage))
                failed = failed or not all(o.valid for o in found)
                outcomes = pd.DataFrame([asdict(o) for o in found], columns=names)
                outcomes["prompt_tokens"] = outcomes["prompt_tokens"].astype("Int64")
                outcomes["completion_tokens"] = outcomes["completion_tokens"].astype("Int64")
                yield pd.concat([part[[*keys, "ids"]].reset_index(drop=True), outcomes], axis=1)

    return run


def ask_provider(
    candidates: DataFrame, factory: Callable[[], Any], strategy: Strategy, *, keys: Sequence[str] = ("query_id",),
    max_concurrency: int = 1, partitions: int | None = None, fail_fast: bool = False, on_usage: Callable | None = None,
) -> DataFrame:
    """A row per query: its keys, ``order`` (original indices, best first), and what the call cost or why it failed.

    The rows are written to the shared folder before they are returned, so no later action asks again. A lost
    task repeats the calls of its own queries only. Queries are spread over ``partitions``. ``fail_fast``: once a query of a
    task has failed the task begins no other, and those left have the failure_type "not_asked". ``on_usage`` is called in the executor with the ``Usage`` of every call that told it.
    """
    check_capability(factory(), strategy)
    entry = F.struct("original_index", F.coalesce("text", F.lit("")).alias("text"))
    packed = candidates.groupBy(*keys).agg(F.first("query").alias("query"), F.array_sort(F.collect_list(entry)).alias("e"))
    packed = packed.select(*keys, "query", F.transform("e", lambda x: x["original_index"]).alias("ids"), F.transform("e", lambda x: x["text"]).alias("texts"))
    if partitions:
        packed = packed.repartition(partitions, *keys)
    kinds = ", ".join(f"`{k}` {candidates.schema[k].dataType.simpleString()}" for k in keys)
    asked = packed.mapInPandas(_partition(factory, strategy, keys, max_concurrency, fail_fast, on_usage), f"{kinds}, ids array<int>, {OUTCOME}")
    positions = F.transform("order", lambda p: F.element_at("ids", p + 1))
    return materialised(asked.withColumn("order", positions).drop("ids"), "answers")


def raise_first(outcomes: DataFrame, keys: Sequence[str]) -> None:
    """The typed error of the first failed query, if any failed."""
    bad = outcomes.where(F.expr("not valid") & (F.col("failure_type") != NOT_ASKED)).orderBy(*keys).limit(1).collect()
    if bad:
        row = bad[0]
        kind, message = BY_FAILURE.get(row["failure_type"], RerankError), row["error"] or row["failure_type"]
        raise kind(message, row["raw_response"] or "") if row["failure_type"] == "llm_output_invalid" else kind(message)


def ranked_rows(candidates: DataFrame, outcomes: DataFrame, *, keys: Sequence[str] = ("query_id",), top_k: int | None = None) -> DataFrame:
    """The candidates of all valid outcomes with their ``rank``."""
    places = outcomes.where("valid").select(*keys, F.posexplode("order").alias("pos", "original_index"))
    places = _scored(places.select(*keys, (F.col("pos") + 1).cast("int").alias("rank"), "original_index"), top_k)
    return candidates.join(places, [*keys, "original_index"])


class Reranker:
    """The facade: candidates in, ranked candidates with ``result_metadata`` out, by a score or by a provider.

    ``provider`` is a factory; without one, ``score`` names the column to rank by. ``mode="fail_fast"`` raises the
    first failure; ``mode="record"`` leaves failed queries out of the ranking and in ``outcomes``.
    """

    def __init__(
        self, strategy: Strategy = Listwise(), *, provider: Callable[[], Any] | None = None, score: str | None = None,
        mode: str = "fail_fast", max_concurrency: int = 1, partitions: int | None = None, on_usage: Callable | None = None,
    ) -> None:
        if (provider is None) == (score is None):
            raise ValueError("give either a provider or a score")
        if mode not in ("fail_fast", "record"):
            raise ValueError("mode must be fail_fast or record")
        if provider is not None:
            check_capability(provider(), strategy)
        self.strategy, self.provider, self.score, self.mode = strategy, provider, score, mode
        if score is not None and kind_of(strategy) == "custom":
            raise RerankInputError("a strategy of one's own walks a provider's answers, not a score")
        self.max_concurrency, self.partitions, self.on_usage = max_concurrency, partitions, on_usage
        self.outcomes: DataFrame | None = None

    def transform(self, candidates: DataFrame, *, keys: Sequence[str] = ("query_id",), top_k: int | None = None) -> DataFrame:
        check_top_k(top_k)
        metadata = F.create_map(F.lit("strategy"), F.lit(kind_of(self.strategy)), F.lit("algorithm"), F.lit(self.strategy.algorithm))
        if self.provider is None:
            guarded = candidates.withColumn("text", guard_length(F.col("text"), self.strategy.max_document_chars)) if "text" in candidates.columns else candidates
            ranked = rerank_by_score(guarded, self.score, self.strategy, keys=keys, top_k=top_k)
        else:
            self.outcomes = ask_provider(candidates, self.provider, self.strategy, keys=keys, max_concurrency=self.max_concurrency, partitions=self.partitions, fail_fast=self.mode == "fail_fast", on_usage=self.on_usage)
            if self.mode == "fail_fast":
                raise_first(self.outcomes, keys)
            ranked = ranked_rows(candidates, self.outcomes, keys=keys, top_k=top_k)
        return ranked.withColumn("result_metadata", metadata)

    def rerank(self, spark: SparkSession, query: str, documents: Sequence[str | Document], *, top_k: int | None = None) -> list[Ranked]:
        """One query's documents, given and returned as plain objects; nothing is asked where there are none."""
        check_top_k(top_k)
        given = normalised(documents)
        if not given:
            return []
        rows = [("", query, i, d.text) for i, d in enumerate(given)]
        frame = spark.createDataFrame(rows, "query_id string, query string, original_index int, text string")
        ranked = self.transform(frame, top_k=top_k).orderBy("rank").collect()
        return [Ranked(given[r["original_index"]], r["rank"], r["original_index"], dict(r["result_metadata"])) for r in ranked]

    def estimated_calls(self, candidates: DataFrame, *, keys: Sequence[str] = ("query_id",)) -> DataFrame:
        """Calls per query, before any is made."""
        return candidates.groupBy(*keys).agg(F.count("*").cast("int").alias("n")).withColumn("calls", estimate_calls(F.col("n"), self.strategy))
