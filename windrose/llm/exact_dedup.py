"""Exact dedup by a log-structured merge index over digests.

The digests' space is split over the shuffle's partitions; each holds one index. Arriving (digest, doc_id) pairs fill
a memtable; a full memtable is flushed as an immutable run, sorted by digest, with a Bloom filter. Runs of a level are
compacted, once there are four, into one of the next level that keeps the smallest identifier of a digest and how
often it came. A key is looked up only in runs whose filter passes it, so a repeat bumps the older run's
count and only new digests enter the memtable. The last compaction leaves one row per digest.

Digests with more than one document are hits. Their texts, and no others, are compared byte for byte (grouped
by the text itself), so texts that merely share a digest stay apart.

Defined cases: a null text is no copy of anything and is kept; empty texts are copies of each other; a null doc_id
has no row in the result and is kept by ``keep_one``; equal rows are one document; the longest texts are compared whole; ids that aren't whole numbers
are refused; an empty table gives an empty one; extra columns, whatever their names, are never read, and passed on by ``keep_one``.

A partition's index is held by one task, about 30 bytes a distinct digest: set ``spark.sql.shuffle.partitions`` to the number of distinct texts over ten million at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.llm._common import PART_ROWS, col, cut, fresh, whole_ids

MEMTABLE_ROWS = 1 << 17
FANOUT = 4
_KEY = np.dtype([("hi", np.uint64), ("lo", np.uint64)])


class Run:
    """Sorted digests with the smallest id and the count of each, behind a Bloom filter of about 10 bits a key."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.ids, self.counts = keys, ids, counts
        self.mask = np.uint64((1 << max(6, (10 * len(keys)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        for probe in self._probes(keys):
            self.bits[probe] = True

    def _probes(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(4):
            yield (keys["lo"] + np.uint64(i) * (keys["hi"] | np.uint64(1))) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``keys``, positions in the run) of the keys that the run holds."""
        maybe = np.ones(len(keys), bool)
        for probe in self._probes(keys):
            maybe &= self.bits[probe]
        at = np.flatnonzero(maybe)
        first, last = np.searchsorted(self.keys["hi"], keys["hi"][at]), np.searchsorted(self.keys["hi"], keys["hi"][at], "right")
        for i in np.flatnonzero(last - first > 1):
            first[i] += np.searchsorted(self.keys["lo"][first[i] : last[i]], keys["lo"][at[i]])
        inside = np.minimum(first, len(self.keys) - 1)
        hit = (first < len(self.keys)) & (self.keys[inside] == keys[at])
        return at[hit], inside[hit]


def merged(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Run:
    """One run of all pairs: each digest once, with its smallest id and summed count."""
    order = np.lexsort((ids, keys["lo"], keys["hi"]))
    keys, ids, counts = keys[order], ids[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return Run(keys[first], ids[first], np.add.reduceat(counts, first) if len(first) else counts)


class Index:
    """Memtable and levels of runs."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT) -> None:
        self.memtable_rows, self.fanout = memtable_rows, fanout
        self.memtable: list[tuple[np.ndarray, np.ndarray]] = []
        self.levels: list[list[Run]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        for level in self.levels:
            for run in level:
                at, there = run.find(keys)
                if len(at):
                    np.add.at(run.counts, there, 1)
                    np.minimum.at(run.ids, there, ids[at])
                    new = np.ones(len(keys), bool)
                    new[at] = False
                    keys, ids = keys[new], ids[new]
        self.memtable.append((keys, ids))
        if sum(len(k) for k, _ in self.memtable) >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        if self.memtable:
            keys, ids = (np.concatenate(x) for x in zip(*self.memtable))
            self.memtable = []
            self._place(merged(keys, ids, np.ones(len(keys), np.int64)), 0)

    def _place(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._place(self._compacted(runs), level + 1)

    @staticmethod
    def _compacted(runs: list[Run]) -> Run:
        return merged(*(np.concatenate([getattr(r, what) for r in runs]) for what in ("keys", "ids", "counts")))

    def compact(self) -> Run:
        self.flush()
        runs = [r for level in self.levels for r in level]
        return self._compacted(runs) if runs else merged(np.zeros(0, _KEY), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index()
    for batch in batches:
        keys = np.empty(len(batch), _KEY)
        keys["hi"], keys["lo"] = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        index.add(keys, batch.column(2).to_numpy())
    run = index.compact()
    for at in range(0, len(run.keys), 50_000):
        part = slice(at, at + 50_000)
        halves = [pa.array(np.ascontiguousarray(run.keys[h][part]).view(np.int64)) for h in ("hi", "lo")]
        yield pa.RecordBatch.from_arrays([*halves, pa.array(run.ids[part]), pa.array(run.counts[part])], ["hi", "lo", "least", "n"])


def _digested(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole_ids(docs, doc_id)
    digest = F.md5(col(text).cast("binary"))
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]
    source = docs.where(col(doc_id).isNotNull()).select(col(doc_id).cast("bigint").alias("node"), col(text).alias("text"))
    return source.select("node", "text", half[0].alias("hi"), half[1].alias("lo"))


def copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, part, n_copies, copies) of every group of at least two equal texts; (doc_id) of all other documents)."""
    digested = _digested(docs, doc_id, text)
    pairs = digested.where("text is not null").select("hi", "lo", "node").distinct()
    index = cut(pairs.repartition("hi", "lo").mapInArrow(_index, "hi bigint, lo bigint, least bigint, n bigint"))
    hits = index.where("n > 1")
    parts = F.ceil(F.col("n") / PART_ROWS)
    members = digested.join(hits.select("hi", "lo", parts.alias("parts")).hint("shuffle_hash"), ["hi", "lo"])
    members = members.select("hi", "lo", "text", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    equal = members.groupBy("hi", "lo", "text", "part").agg(F.array_sort(F.collect_set("node")).alias("copies"))
    equal = equal.select("hi", "lo", F.sha2("text", 256).alias("proof"), "part", "copies")
    group = W.partitionBy("hi", "lo", "proof")
    equal = equal.select(F.min(F.col("copies")[0]).over(group).alias("doc_id"), "part", F.sum(F.size("copies")).over(group).cast("bigint").alias("n_copies"), "copies")
    rest = index.where("n = 1").select(F.col("least").alias("doc_id")).unionByName(digested.where("text is null").select(F.col("node").alias("doc_id")).distinct())
    return equal, rest


def kept_with_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document that stays: doc_id, how many documents have its text, and their ids in order.

    A group of more than 100,000 takes several rows, told apart by ``part``.
    """
    equal, rest = copies(docs, doc_id=doc_id, text=text)
    return equal.unionByName(rest.select("doc_id", F.lit(0).alias("part"), F.lit(1).cast("bigint").alias("n_copies"), F.array("doc_id").alias("copies")))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all its columns, without the documents whose text a smaller doc_id has."""
    (gone,) = fresh(docs, "gone")
    equal, _ = copies(docs, doc_id=doc_id, text=text)
    removed = equal.select("doc_id", F.explode("copies").alias(gone)).where(F.col(gone) != F.col("doc_id")).select(gone)
    return docs.join(removed, col(doc_id).cast("bigint") == F.col(gone), "left_anti")
