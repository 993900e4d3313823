"""Vector best-fit packing of documents into training sequences.

A bin holds at most ``tokens`` tokens, ``docs`` pieces and ``cost`` attention cost, where a piece of n tokens costs n * n
(attention is kept within documents). A document longer than a bin's limits is cut into pieces that fit: whole texts are
packed. Items are taken in decreasing size; among the open bins that satisfy every constraint the one is chosen that
has the largest weighted dot product of the item's demand and the bin's residual (``rule="dot"``) or the smallest
weighted norm of the residual left (``rule="norm"``); ties go to the oldest bin. Demands and residuals are shares of the
capacities. A bin closes only when no item, however small, can fit.

Documents are spread over shards of about ``shard_rows`` by a hash of their id; every shard is packed on its own, so
the work is linear in the input, and the waste is at most a few open bins a shard. Only ids and lengths move.

Token counts: a column or expression; by default a quarter of the UTF-8 bytes, rounded up.

Defined cases: a null or empty text has 0 tokens and takes no bin; a null doc_id is packed like any other; rows that
repeat a doc_id are separate items, numbered by ``copy`` (the longest first, unless there are more than an eighth of a shard: these are dealt out over several shards and
numbered there by turns); the longest texts are cut into pieces; ids that aren't whole numbers are refused; an empty table gives no rows; extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.llm._common import col, whole_ids, written

SCHEMA = "bin_id bigint, position int, doc_id bigint, copy int, piece int, first_token bigint, tokens int"


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin, the weights of the three dimensions, and the rule."""

    tokens: int = 8192
    docs: int = 64
    cost: int = 8192 * 4096
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    rule: str = "dot"
    shard_rows: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.docs, self.cost, self.shard_rows) < 1 or self.rule not in ("dot", "norm") or min(self.weights) < 0:
            raise ValueError("capacities must be positive, weights not negative, and the rule dot or norm")

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that fits an empty bin."""
        return max(1, min(self.tokens, int(self.cost**0.5)))


def default_tokens(text: str = "text") -> Column:
    return F.ceil(F.octet_length(col(text)) / 4)


def pack_items(sizes: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(bin, position in it) of every item; ``sizes`` is in decreasing order and no size exceeds ``limits.piece``."""
    n = len(sizes)
    capacity = np.array([limits.tokens, limits.docs, limits.cost], np.int64)
    scale = np.array(limits.weights) / capacity
    residual = np.empty((256, 3), np.int64)
    number = np.empty(256, np.int64)
    open_bins = made = 0
    filled: list[int] = []
    bins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        need = np.array([size, 1, size * size], np.int64)
        free = residual[:open_bins]
        fits = np.flatnonzero((free[:, 0] >= size) & (free[:, 1] >= 1) & (free[:, 2] >= size * size))
        if len(fits):
            if limits.rule == "dot":
                best = np.argmax(free[fits] @ (need * scale / capacity))
            else:
                best = np.argmin((((free[fits] - need) / capacity) ** 2) @ np.array(limits.weights))
            at = int(fits[best])
        else:
            if open_bins == len(residual):
                residual = np.concatenate((residual, np.empty_like(residual)))
                number = np.concatenate((number, np.empty_like(number)))
            at, open_bins = open_bins, open_bins + 1
            residual[at], number[at] = capacity, made
            made += 1
            filled.append(0)
        own = int(number[at])
        bins[i], places[i] = own, filled[own]
        filled[own] += 1
        residual[at] -= need
        if residual[at].min() < 1:
            residual[at : open_bins - 1] = residual[at + 1 : open_bins]
            number[at : open_bins - 1] = number[at + 1 : open_bins]
            open_bins -= 1
    return bins, places


def _packer(limits: Limits):
    def pack(part: pa.Table) -> pa.RecordBatch:
        shard, length, ids, copy = (part.column(c) for c in ("shard", "length", "doc_id", "copy"))
        length = length.to_numpy()
        pieces = -(-length // limits.piece)
        of = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = nth * limits.piece
        size = np.minimum(length[of] - first, limits.piece)
        order = np.argsort(-size, kind="stable")
        of, nth, first, size = of[order], nth[order], first[order], size[order]
        bins, places = pack_items(size, limits)
        bins += shard[0].as_py() << 32
        take = pa.array(of)
        kinds = (np.int64, np.int32, None, None, np.int32, np.int64, np.int32)
        values = (bins, places, ids.take(take).combine_chunks(), copy.take(take).combine_chunks(), nth, first, size)
        arrays = [pa.array(v.astype(k)) if k else v for v, k in zip(values, kinds)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(shards) else [0]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if held and held[-1].column("shard")[0].as_py() != shards[a]:
                    yield pack(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pack(pa.Table.from_batches(held))

    return run


def best_fit(docs: DataFrame, limits: Limits = Limits(), tokens: Column | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: bin_id, position in the bin, doc_id, copy, piece, first_token and tokens."""
    tokens = default_tokens(text) if tokens is None else tokens
    whole_ids(docs, doc_id)
    items = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("length")).where("length > 0")
    # Written once: counted, asked for ids that many rows share, and packed; its row numbers so never change.
    items = written(items.withColumn("nth", F.monotonically_increasing_id()), "items")
    shards = max(1, -(-items.count() // limits.shard_rows))
    most = max(1, limits.shard_rows // 8)
    hot = items.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("doc_id").alias("hot"), F.ceil(F.col("n") / most).alias("ways"))
    items = items.join(hot, F.col("doc_id").eqNullSafe(F.col("hot")), "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    items = items.withColumn("way", F.pmod("nth", "ways"))
    shard = F.when(F.col("ways") == 1, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "way"))
    items = items.select(F.pmod(shard, F.lit(shards)).alias("shard"), "length", "doc_id", "ways", "way").repartition("shard")
    nth = F.row_number().over(W.partitionBy("shard", "doc_id", "way").orderBy(F.desc("length")))
    items = items.withColumn("copy", ((nth - 1) * F.col("ways") + F.col("way") + 1).cast("int")).drop("ways", "way")
    items = items.sortWithinPartitions("shard", F.desc("length"), "doc_id", "copy")
    return items.mapInArrow(_packer(limits), SCHEMA)
