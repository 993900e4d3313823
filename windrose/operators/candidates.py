"""First-stage candidates and the joins, guards and samplings around them."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.functions.scalar import stable_seed, tokens

_TOKEN = re.compile("[a-z0-9]+")


#: (query, token) pairs up to which the queries' index goes to every task; a larger set of queries is joined instead.
INDEX_PAIRS = 2_000_000
#: Pairs of query and document that a task gathers, at the least, before it drops those behind the ``depth`` best.
_GATHERED = 1 << 18
#: Best pairs that a task holds; with more queries than that allows it hands them on and holds the next ones.
_HELD = 1 << 20
#: Texts, and (text, token, query) triples, that are matched at once; only a single text can bring more triples.
_TEXTS, _TRIPLES = 512, 1 << 17
#: Characters from which on a text's tokens aren't listed before their repetitions are dropped.
_LONG = 1 << 18
MATCHES = "shared int, doc_tokens int, query_tokens int, full boolean"


class QueryIndex:
    """Queries by token: the positions of the queries that hold it, in one array."""

    def __init__(self, ids: pa.Array, found: list[list[str]]) -> None:
        self.ids, self.size = ids, np.array([len(t) for t in found], np.int32)
        by_token: dict[str, list[int]] = {}
        for q, held in enumerate(found):
            for token in held:
                by_token.setdefault(token, []).append(q)
        self.row = {t: i for i, t in enumerate(by_token)}
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in by_token.values()]))).astype(np.int64)
        self.held = np.array([q for x in by_token.values() for q in x], np.int32)

    def tokens(self, text: str | None) -> tuple[np.ndarray, int]:
        """The rows of the queries' tokens in a text, and the number of all its distinct tokens."""
        low = (text or "").lower()
        found = {*_TOKEN.findall(low)} if len(low) < _LONG else {m.group() for m in _TOKEN.finditer(low)}
        return np.array([self.row[t] for t in found if t in self.row], np.int64), len(found)

    def match(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, query, shared tokens) of those that share any, by the rows of each text."""
        row = np.concatenate(rows)
        size = self.start[row + 1] - self.start[row]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[row], size)
        key = np.repeat(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), size) * max(1, len(self.size)) + self.held[at]
        if len(rows) * len(self.size) <= 4 * len(key):
            count = np.bincount(key)
            found = np.flatnonzero(count)
            count = count[found]
        else:
            found, count = np.unique(key, return_counts=True)
        return *np.divmod(found, max(1, len(self.size))), count.astype(np.int32)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the text, query, shared tokens, tokens of the text) of those that share any, a bounded block at a time."""
        rows: list[np.ndarray] = []
        sizes: list[int] = []
        first = triples = 0
        for i, text in enumerate(texts, 1):
            row, size = self.tokens(text.as_py())
            rows.append(row)
            sizes.append(size)
            triples += int((self.start[row + 1] - self.start[row]).sum())
            if triples >= _TRIPLES or len(rows) == _TEXTS or i == len(texts):
                place, q, shared = self.match(rows)
                yield place + first, q, shared, np.array(sizes, np.int32)[place]
                rows, sizes, first, triples = [], [], i, 0


def _best(q: np.ndarray, shared: np.ndarray, docs: pa.Array, depth: int) -> np.ndarray:
    """The places of each query's ``depth`` best."""
    rank = pc.rank(docs, tiebreaker="dense").to_numpy()
    order = np.lexsort((rank, -shared, q))
    own = q[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[nth < depth]


def _matcher(index: Broadcast, depth: int):
    """What a task does: memory is bounded by the constants above and a batch of texts, however many batches come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: QueryIndex = index.value
        least = np.zeros(len(at.size), np.int32)  # what the worst of a query's best shares, once there are ``depth``
        held: list[tuple] = []
        kept = gathered = 0

        def made(q, shared, size, docs, full: bool) -> pa.RecordBatch:
            arrays = [at.ids.take(pa.array(q)), docs, pa.array(shared), pa.array(size), pa.array(at.size[q]), pa.repeat(pa.scalar(full), len(q))]
            return pa.RecordBatch.from_arrays(arrays, ["query_id", "doc_id", *(c.split()[0] for c in MATCHES.split(", "))])

        def best() -> tuple:
            q, shared, size = (np.concatenate([p[i] for p in held]) for i in range(3))
            docs = pa.concat_arrays([p[3] for p in held])
            keep = _best(q, shared, docs, depth)
            q, shared, size, docs = q[keep], shared[keep], size[keep], docs.take(pa.array(keep))
            n = np.bincount(q, minlength=len(least))
            whole = n == depth
            least[whole] = shared[(np.cumsum(n) - 1)[whole]]
            return q, shared, size, docs

        def handed_on(q, shared, size, docs) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(q), 50_000):
                k = slice(i, i + 50_000)
                yield made(q[k], shared[k], size[k], docs[k], False)

        for batch in batches:
            ids = batch.column(0)
            for place, q, shared, size in at.blocks(batch.column(1)):
                if len(full := np.flatnonzero(shared == at.size[q])):
                    yield made(q[full], shared[full], size[full], ids.take(pa.array(place[full])), True)
                near = np.flatnonzero(shared >= least[q])
                if not len(near):
                    continue
                held.append((q[near], shared[near], size[near], ids.take(pa.array(place[near]))))
                gathered += len(near)
                if gathered >= max(_GATHERED, kept):
                    held, gathered = [best()], 0
                    kept = len(held[0][0])
                    if kept > _HELD:
                        yield from handed_on(*held.pop())
                        kept = 0
            del batch, ids  # before the next one is read
            pa.default_memory_pool().release_unused()
        if held:
            yield from handed_on(*best())

    return run


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is read, dealt out over all cores where its files have fewer splits than these."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def matches(queries: DataFrame, corpus: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc_id, shared, doc_tokens, query_tokens, full): pairs by the distinct tokens they share, where they share any.

    Of the rows that aren't ``full`` every query's ``depth`` best documents (ties by doc_id) are there, with others that
    were among the best of a task; rows that are ``full`` are all pairs in which the document has every token of the query.

    The corpus is read once and no pair is shuffled but these: each task holds the queries' index and keeps its best. Where
    the queries have more than ``INDEX_PAIRS`` tokens in all, tokens are joined and pairs counted instead, for the same rows.
    """
    words = queries.select("query_id", tokens(F.col("query")).alias("t")).where(F.size("t") > 0)
    if (words.agg(F.sum(F.size("t"))).first()[0] or 0) > INDEX_PAIRS:
        return _joined_matches(words, corpus)
    got = words.toArrow()
    index = QueryIndex(got["query_id"].combine_chunks(), got["t"].to_pylist())
    kinds = [f"{n} {d.schema[n].dataType.simpleString()}" for d, n in ((queries, "query_id"), (corpus, "doc_id"))]
    return spread(corpus.select("doc_id", "text")).mapInArrow(_matcher(corpus.sparkSession.sparkContext.broadcast(index), depth), ", ".join([*kinds, MATCHES]))


def _joined_matches(words: DataFrame, corpus: DataFrame) -> DataFrame:
    asked = words.select("query_id", F.size("t").alias("query_tokens"), F.explode("t").alias("token"))
    own = corpus.select("doc_id", tokens(F.col("text")).alias("t"))
    wanted = own.select("doc_id", F.size("t").alias("doc_tokens"), F.explode("t").alias("token"))
    pairs = wanted.join(asked, "token").groupBy("query_id", "doc_id", "doc_tokens", "query_tokens").agg(F.count("*").cast("int").alias("shared"))
    both = F.when(F.col("shared") == F.col("query_tokens"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return pairs.select("query_id", "doc_id", "shared", "doc_tokens", "query_tokens", F.explode(both).alias("full"))


def best_matches(found: DataFrame, depth: int) -> DataFrame:
    """The ``depth`` best documents of every query by shared tokens, ties by doc_id, with ``original_index`` from 0."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("shared"), "doc_id"))
    ranked = found.where("not full").drop("full").withColumn("rn", place).where(F.col("rn") <= depth)
    return ranked.withColumn("original_index", (F.col("rn") - 1).cast("int")).drop("rn")


def first_stage(queries: DataFrame, corpus: DataFrame, depth: int) -> DataFrame:
    """``best_matches`` of all queries over the whole corpus."""
    return best_matches(matches(queries, corpus, depth), depth)


def scope(candidates: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` candidates; the others are dropped."""
    return candidates.where(F.col("original_index") < depth)


def must_match(left: DataFrame, right: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """An inner join that fails on the first left row without a partner, in the job that consumes it."""
    marked = right.withColumn("__there", F.lit(True))
    joined = left.join(marked, list(on), "left")
    message = F.concat(F.lit(f"no {what} for "), F.concat_ws(", ", *(F.col(c).cast("string") for c in on)))
    first = on[0]
    checked = F.when(F.col("__there").isNull(), F.raise_error(message).cast(left.schema[first].dataType)).otherwise(F.col(first))
    return joined.withColumn(first, checked).drop("__there")


def with_defaults(top_ranked: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidates joined to texts, queries and labels; what is missing becomes an empty text or a label of 0."""
    out = top_ranked.join(corpus, "doc_id", "left").join(queries, "query_id", "left").join(qrels, ["query_id", "doc_id"], "left")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "query": F.coalesce("query", F.lit("")), "label": F.coalesce(F.col("label").cast("double"), F.lit(0.0))})


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that come more than once, with their ``count``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def across(samples: DataFrame, methods: DataFrame) -> DataFrame:
    """Every sample with every method; methods are a list of the command line, a handful of rows."""
    return samples.crossJoin(methods)


def pending(pairs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs without a finished result."""
    return pairs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def hash_order(seed: int, *parts: Column) -> Column:
    """A keyed order that is the same on every cluster: the hex SHA-256 of seed and parts joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def hash_shuffle(candidates: DataFrame, seed: int, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Candidates in a keyed random order, ``original_index`` numbered anew."""
    parts = [*(F.col(k) for k in keys), F.col("doc_id")]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(hash_order(seed, *parts), "doc_id"))
    return candidates.withColumn("original_index", (place - 1).cast("int"))


def seeded_shuffle(candidates: DataFrame, seed: int, keys: Sequence[str] = ("task", "query_id")) -> DataFrame:
    """Candidates in the order of Python's ``random.Random(s).shuffle`` with s = stable seed of (seed, task, query)."""
    @F.pandas_udf("array<int>")
    def order(n: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for size, own in zip(n, s):
            numbers = list(range(size))
            random.Random(int(own)).shuffle(numbers)
            out.append(numbers)
        return pd.Series(out)

    sizes = candidates.groupBy(*keys).agg(F.count("*").cast("int").alias("__n"))
    seeds = stable_seed(F.lit(seed), *(F.col(k) for k in keys))
    orders = sizes.select(*keys, F.posexplode(order("__n", seeds)).alias("__new", "original_index"))
    return candidates.join(orders, [*keys, "original_index"]).withColumn("original_index", F.col("__new")).drop("__new")


def oracle_plus_hash(corpus: DataFrame, qrels: DataFrame, count: int, seed: int) -> DataFrame:
    """(query_id, doc_id, original_index, relevant): all relevant documents of a query and others in keyed random order up to ``count``.

    A query with more relevant documents than ``count`` is an error. The corpus is put in the order of a hash of (seed, doc_id)
    once, and each query takes the first documents that it doesn't hold relevant; so ``count`` and the size of the largest
    judged set together are as many as can be needed.
    """
    relevant = qrels.where("rel > 0").select("query_id", "doc_id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most > count:
        raise ValueError(f"a query has {most} relevant documents, more than the {count} candidates")
    ids = corpus.select("doc_id").distinct()
    pool = ids.select("doc_id", hash_order(seed, F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(count + most)
    others = sizes.crossJoin(pool).join(relevant, ["query_id", "doc_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("h", "doc_id"))
    others = others.withColumn("rn", place).where(F.col("rn") <= count - F.col("n"))
    first = relevant.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")).alias("rn"))
    first = first.select("query_id", "doc_id", (F.col("rn") - 1).cast("int").alias("original_index"), F.lit(True).alias("relevant"))
    rest = others.select("query_id", "doc_id", (F.col("rn") + F.col("n") - 1).cast("int").alias("original_index"), F.lit(False).alias("relevant"))
    return first.unionByName(rest)
