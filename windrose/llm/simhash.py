"""SimHash near-dedup over Golay-code keys.

Every document gets a 184-bit SimHash of its distinct words (in small letters, without punctuation): eight
segments of 23 bits. A segment is decoded to the indices of its nearby codewords (``golay``), one or six keys
that any segment within 2 bits shares. If two fingerprints differ in at most ``3 * (8 - 1) - 1 = 20`` bits, at
most six of the eight segments can have 3 or more errors, so at least two share keys: the pigeonhole bound. Pairs
that share keys of two segments are verified on all 184 bits and kept up to ``max_distance``; beyond the
bound recall falls slowly, as segments a little further apart still share keys often (measured in the README).

Equal fingerprints are joined to one representative before the search, each bucket hands on a spanning
forest of its verified pairs, and groups are connected components; so neither the exact copies of a text nor the
pairs of a large group multiply. A bucket (segment, codeword) is streamed in key order and searched with a second
segment's codewords as inner key: nothing is capped or sampled. Large groups of equal inner keys are compared a block of
rows at a time, without pairs whose first row's component is known to hold both.

Defined cases: texts that are null or have no word are never near copies; a null doc_id is never grouped; rows that
share a doc_id are one document, which takes its first fingerprint, and stay or go together; equal texts are at distance 0; the longest texts are read
whole; ids that aren't whole numbers are refused; an empty table gives an empty one; other columns, whatever their names, are passed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm import _text, golay
from windrose.llm._common import PART_ROWS, col, connected_components, cut, fresh, whole_ids

SEGMENTS = 8
MAX_DISTANCE = 32
LARGE, BLOCK, TILE = 64, 64, 1024
_WIDTH = SEGMENTS * golay.BITS
_LONGS = SEGMENTS // 2
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8)).copy().view(np.uint64).ravel()
_HALF = np.uint64((1 << golay.BITS) - 1)
_SALTS = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB)]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4) uint64, each with two 23-bit segments, and how many distinct words each document has."""
    hashes, of = _text.distinct_words(data, offsets)
    count = np.diff(of)
    packed = np.zeros((len(count), _LONGS), np.uint64)
    busy = np.flatnonzero(count)
    if not len(busy):
        return packed, count
    runs = -(-count[busy] // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(of[busy], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    bits = np.empty((len(busy), _WIDTH), bool)
    for k, salt in enumerate(_SALTS):
        octets = _text.mix(hashes * salt + salt).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            if (b := 8 * k + j) * 8 < _WIDTH:
                sums = np.add.reduceat(_SPREAD[octets[:, j]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
                bits[:, 8 * b : 8 * b + 8] = 2 * np.add.reduceat(sums, first, axis=0) > count[busy, None]
    weights = np.uint64(1) << np.arange(2 * golay.BITS, dtype=np.uint64)
    for k in range(_LONGS):
        part = bits[:, 2 * golay.BITS * k : 2 * golay.BITS * (k + 1)].astype(np.uint64)
        packed[busy, k] = (part * weights).sum(axis=1)
    return packed, count


def segment(packed: np.ndarray, s: int) -> np.ndarray:
    return (packed[:, s // 2] >> np.uint64(golay.BITS * (s % 2))) & _HALF


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.buffers(batch.column(1))
        for a, b in _text.chunks(offsets):
            packed, count = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keep = np.flatnonzero(count)
            longs = [pa.array(packed[keep, k].view(np.int64)) for k in range(_LONGS)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(keep)), *longs], ["doc_id", *(f"f{k}" for k in range(_LONGS))])


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(_LONGS)], axis=1)
        for s in range(SEGMENTS - 1):
            at, index = golay.keys(segment(packed, s))
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array((s << 12 | index).astype(np.int32)), *rows.columns], ["bucket", *batch.schema.names])


def _grouped_pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions with equal keys, in pieces of about a million; ``key`` is sorted."""
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(key)) - 1
    total = np.cumsum(left)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000, "right")))
        n = left[at:to]
        a = np.repeat(np.arange(at, to), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = to


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        root = self.up[x]
        while True:
            above = self.up[root]
            if np.array_equal(above, root):
                break
            root = above
        self.up[x] = root
        return root

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] and b[i] for all i; where a root is hung under several, the rounds after join the others."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = np.flatnonzero(a != b)
            a, b = a[apart], b[apart]
            self.up[np.maximum(a, b)] = np.minimum(a, b)

    def root(self, x: int) -> int:
        return int(self.roots(np.array([x]))[0])

    def join(self, a: int, b: int) -> None:
        self.merge(np.array([a]), np.array([b]))


def _join_small(key: np.ndarray, node: np.ndarray, packed: np.ndarray, forest: Forest, max_distance: int) -> None:
    """Joins all pairs with equal keys within ``max_distance``; ``key`` is sorted."""
    longs = [packed[:, k].copy() for k in range(_LONGS)]
    for a, b in _grouped_pairs(key):
        distance = np.zeros(len(a), np.uint8)
        for k in range(_LONGS):
            distance += np.bitwise_count(longs[k][a] ^ longs[k][b])
            if k == 1:  # half of the bits tell most pairs apart
                near = np.flatnonzero(distance <= max_distance)
                a, b, distance = a[near], b[near], distance[near]
        near = np.flatnonzero(distance <= max_distance)
        forest.merge(node[a[near]], node[b[near]])


def _join_large(node: np.ndarray, packed: np.ndarray, forest: Forest, max_distance: int) -> None:
    """Joins all pairs within ``max_distance`` of one large group: a block of rows against the rest, tile by tile.

    Rows are in order of their roots and a block isn't compared with the rest of its first row's component, so that a group of
    near copies takes one block, whatever its size.
    """
    longs = np.ascontiguousarray(packed.T)
    while len(node) > 1:
        root = forest.roots(node)
        order = np.argsort(root, kind="stable")
        root, node, longs = root[order], node[order], longs[:, order]
        start = int(np.searchsorted(root, root[0], "right"))
        if start == len(node):
            return
        rows = longs[:, :BLOCK, None]
        left, right = [], []
        for at in range(start, len(node), TILE):
            tile = longs[:, None, at : at + TILE]
            distance = np.bitwise_count(rows[0] ^ tile[0])
            for k in range(1, _LONGS):
                distance += np.bitwise_count(rows[k] ^ tile[k])
            near = np.flatnonzero(distance <= max_distance)
            if len(near):
                left.append(near // distance.shape[1])
                right.append(near % distance.shape[1] + at)
        if left:
            forest.merge(node[np.concatenate(left)], node[np.concatenate(right)])
        node, longs = node[BLOCK:], longs[:, BLOCK:]


def _search(bucket: np.ndarray, ids: np.ndarray, packed: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root) ids, of the pairs within ``max_distance`` that share a bucket and a key of a later segment."""
    order = np.argsort(ids, kind="stable")
    bucket, ids, packed = bucket[order], ids[order], packed[order]
    unique, node = np.unique(ids, return_inverse=True)
    forest = Forest(len(unique))
    own = bucket >> 12
    for s in range(1, SEGMENTS):
        rows = np.flatnonzero(own < s)
        if not len(rows):
            continue
        at, index = golay.keys(segment(packed[rows], s))
        key = bucket[rows][at].astype(np.int64) << 12 | index
        order = np.argsort(key, kind="stable")
        at, key = rows[at[order]], key[order]
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(bounds)
        for g in np.flatnonzero(size >= LARGE).tolist():
            group = at[bounds[g] : bounds[g + 1]]
            _join_large(node[group], packed[group], forest, max_distance)
        small = np.repeat((size > 1) & (size < LARGE), size)
        at, key = at[small], key[small]
        _join_small(key, node[at], packed[at], forest, max_distance)
    roots = forest.roots(np.arange(len(unique)))
    joined = np.flatnonzero(roots != np.arange(len(unique)))
    return unique[joined], unique[roots[joined]]


def _verified(max_distance: int, rows: int = 60_000):
    """Streams rows in bucket order; whole buckets are searched together, about ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search(part: pa.Table) -> pa.RecordBatch:
            packed = np.stack([part.column(f"f{k}").to_numpy().view(np.uint64) for k in range(_LONGS)], axis=1)
            member, root = _search(part.column("bucket").to_numpy(), part.column("doc_id").to_numpy(), packed, max_distance)
            return pa.RecordBatch.from_arrays([pa.array(member), pa.array(root)], ["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= rows:
                part = pa.Table.from_batches(held)
                bucket = part.column("bucket").to_numpy()
                end = int(np.searchsorted(bucket, bucket[-1]))
                if end:
                    yield search(part.slice(0, end))
                    held = part.slice(end).combine_chunks().to_batches()
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def near_copies(docs: DataFrame, max_distance: int = MAX_DISTANCE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root): the documents of every group of near copies, each with the group's smallest doc_id."""
    whole_ids(docs, doc_id)
    longs = [f"f{k}" for k in range(_LONGS)]
    source = docs.where(col(doc_id).isNotNull() & col(text).isNotNull()).select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    prints = source.mapInArrow(_fingerprint, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in longs))
    prints = cut(prints.groupBy("doc_id").agg(F.min(F.struct(*longs)).alias("f")).select("doc_id", "f.*"))
    same = cut(prints.groupBy(*longs).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    exact = prints.join(same.where("n > 1").hint("shuffle_hash"), longs).select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    keys = same.select(F.col("least").alias("doc_id"), *longs).mapInArrow(_bucket_keys, "bucket int, doc_id bigint, " + ", ".join(f"{c} bigint" for c in longs))
    near = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verified(max_distance), "u bigint, v bigint")
    return connected_components(exact.unionByName(near))


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all its columns, without the near copies: of each group the smallest doc_id stays."""
    (gone,) = fresh(docs, "gone")
    removed = near_copies(docs, max_distance, doc_id=doc_id, text=text).where("node <> root").select(F.col("node").alias(gone))
    return docs.join(removed, col(doc_id).cast("bigint") == F.col(gone), "left_anti")


def kept_with_copies(docs: DataFrame, max_distance: int = MAX_DISTANCE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document that stays: doc_id, how many documents its group has, and their ids in order.

    A group of more than 100,000 takes several rows, told apart by ``part``; a null doc_id has no row.
    """
    groups = near_copies(docs, max_distance, doc_id=doc_id, text=text)
    ids = docs.where(col(doc_id).isNotNull()).select(col(doc_id).cast("bigint").alias("node")).distinct()
    rows = ids.join(groups, "node", "left").select(F.coalesce("root", "node").alias("doc_id"), "node")
    return listed(rows)


def listed(rows: DataFrame) -> DataFrame:
    """(doc_id, part, n_copies, copies) from (doc_id, node)."""
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n_copies"))
    alone = sizes.where("n_copies = 1").select("doc_id", F.lit(0).alias("part"), "n_copies", F.array("doc_id").alias("copies"))
    many = rows.join(sizes.where("n_copies > 1"), "doc_id")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n_copies") / PART_ROWS)).cast("int")
    many = many.groupBy("doc_id", part.alias("part"), "n_copies").agg(F.array_sort(F.collect_list("node")).alias("copies"))
    return alone.unionByName(many)
