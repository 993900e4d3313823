"""A stream of packed queries, ranked batch by batch; a query's row is complete in itself, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windrose.config import Strategy, check_top_k
from windrose.operators.candidates import pending
from windrose.operators.folds import fold
from windrose.operators.rerank import Reranker
from windrose.schemas import RESULT_KEY


def rerank_packed(queries: DataFrame, strategy: Strategy, *, top_k: int | None = None) -> DataFrame:
    """Rows (query_id, rank, original_index, doc_id) from rows (query_id, candidates array<struct<doc_id, score>>); streams as well as tables."""
    check_top_k(top_k)
    k = F.transform("candidates", lambda x, i: F.struct(F.coalesce(-x["score"].cast("double"), F.lit(float("inf"))).alias("k"), i.alias("i"), x["doc_id"].alias("doc_id")))
    order = fold(k, strategy)
    order = order if top_k is None else F.slice(order, 1, top_k)
    placed = queries.select("query_id", F.posexplode(order).alias("pos", "x"))
    return placed.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("original_index"), F.col("x.doc_id").alias("doc_id"))


def rerank_stream(candidates: DataFrame, reranker: Reranker, path: str, checkpoint: str) -> StreamingQuery:
    """Long candidate rows whose queries come whole within a batch, ranked and appended to ``path``.

    A batch that is repeated after a failure overwrites what it wrote before: its folder bears its number.
    """

    def one(batch: DataFrame, number: int) -> None:
        reranker.transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def unfinished(batch: DataFrame, results: DataFrame) -> DataFrame:
    """What of a batch has no result yet."""
    return pending(batch, results, RESULT_KEY)
