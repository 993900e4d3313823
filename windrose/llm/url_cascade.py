"""URL filter as a Bloom filter cascade: exact membership of the corpus's own URLs, without a join.

The universe is complete: every distinct key of the corpus, and every listed key. Level 1 is a Bloom filter of the listed
keys; level 2 one of the unlisted keys of the universe that level 1 passes by mistake; level 3 of the listed keys
that level 2 passes by mistake; and so on until a level makes no mistake. A key is listed if and only if the first level
that misses it is an even one. For keys of the universe the answer is exact.

Keys are 128-bit hashes of normalised URLs. The universe is split by a hash range into shards, each with a cascade of
its own, built by a task that holds one shard's keys only. The finished filters take about 12 bits a listed key. If all
of them are within ``broadcast_bytes`` the driver broadcasts them and pages are judged where they are read, without a
shuffle. Beyond that the filters stay a table in the shared folder, and the keys alone are brought to their
shard's filter in a cogroup; the answers are the same.

Defined cases: a null or empty URL has no key and is never listed; URLs that differ only in what ``normalised`` removes share a
key; rows that repeat are judged each; an empty list blocks nothing, an empty corpus gives no rows; only the url and
id columns are read, whatever the names of others; URLs are read whole; ids that aren't whole numbers are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm._common import col, cut, whole_ids

BROADCAST_BYTES = 128 << 20
SHARD_KEYS = 2_000_000
#: False positives a level: few at level 1, as the universe is mostly unlisted; half at the others.
RATES = (2.0**-8, 0.5)


def normalised(url: Column) -> Column:
    """The URL without scheme, ``www.`` or ``m.``, query, fragment, ``.html`` and trailing slashes, host in small letters."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    rest = F.regexp_replace(rest, r"(\.html?)?/*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/]*", 0)), r"^(www|m)\.", "")
    return F.nullif(F.concat(host, F.regexp_extract(rest, r"/.*$", 0)), F.lit(""))


def _keyed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("hi"), F.xxhash64(F.lit("2"), key).alias("lo")]


class Bloom:
    """Bits in bytes; ``k`` probes by double hashing, salted with the level."""

    def __init__(self, size: int, probes: int, level: int, bits: np.ndarray | None = None) -> None:
        self.size, self.probes, self.level = size, probes, level
        self.bits = np.zeros(-(-size // 8), np.uint8) if bits is None else bits

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray, rate: float, level: int) -> Bloom:
        probes = max(1, round(-np.log2(rate)))
        made = cls(max(64, int(len(hi) * probes / np.log(2)) + 1), probes, level)
        for at in made._probes(hi, lo):
            np.bitwise_or.at(made.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return made

    def _probes(self, hi: np.ndarray, lo: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(0x9E3779B97F4A7C15 * self.level & (1 << 64) - 1)
        start = (hi ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        start ^= start >> np.uint64(31)
        step = (lo + salt) | np.uint64(1)
        for i in range(self.probes):
            mixed = start + np.uint64(i) * step
            yield ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.size)).astype(np.int64)

    def passes(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.ones(len(hi), bool)
        for at in self._probes(hi, lo):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Levels of Bloom filters, exact over the universe they were built from."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, listed: np.ndarray) -> Cascade:
        inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
        levels: list[Bloom] = []
        while len(inside):
            level = Bloom.of(hi[inside], lo[inside], RATES[bool(levels)], len(levels) + 1)
            levels.append(level)
            inside, outside = outside[level.passes(hi[outside], lo[outside])], inside
        return cls(levels)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, rest = np.zeros(len(hi), bool), np.arange(len(hi))
        for n, level in enumerate(self.levels, 1):
            passed = level.passes(hi[rest], lo[rest])
            out[rest[~passed]] = n % 2 == 0
            rest = rest[passed]
        out[rest] = len(self.levels) % 2 == 1
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<q", len(self.levels))]
        for x in self.levels:
            parts += [struct.pack("<qqqq", x.size, x.probes, x.level, len(x.bits)), x.bits.tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, blob: bytes) -> Cascade:
        (n,), at, levels = struct.unpack_from("<q", blob), 8, []
        for _ in range(n):
            size, probes, level, length = struct.unpack_from("<qqqq", blob, at)
            at += 32
            levels.append(Bloom(size, probes, level, np.frombuffer(blob, np.uint8, length, at)))
            at += length
        return cls(levels)


def _built(part: pd.DataFrame) -> pd.DataFrame:
    cascade = Cascade.build(part["hi"].to_numpy().view(np.uint64), part["lo"].to_numpy().view(np.uint64), part["listed"].to_numpy().astype(bool))
    return pd.DataFrame({"shard": part["shard"].iloc[:1], "filter": [cascade.dump()], "levels": [len(cascade.levels)]})


def build(corpus_urls: DataFrame, listed_urls: DataFrame, *, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """((shard, filter, levels), number of shards) over the one-column tables of the corpus's and the listed URLs."""
    corpus, listed = (df.select(normalised(col(df.columns[0])).alias("key")).where("key is not null") for df in (corpus_urls, listed_urls))
    keys = corpus.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    universe = cut(keys.select(*_keyed(F.col("key")), "listed").groupBy("hi", "lo").agg(F.max("listed").alias("listed")))
    shards = max(1, -(-universe.count() // shard_keys))
    parts = universe.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return parts.groupBy("shard").applyInPandas(_built, "shard int, filter binary, levels int"), shards


def _judge(blobs, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades = {s: Cascade.load(b) for s, b in blobs.value.items()}
        for batch in batches:
            hi, lo = (batch.column(k).fill_null(0).to_numpy() for k in ("hi", "lo"))
            known = batch.column("hi").is_valid().to_numpy(zero_copy_only=False)
            shard, out = np.mod(hi, shards), np.zeros(len(hi), bool)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero((shard == s) & known)
                if s in cascades:
                    out[at] = cascades[s].has(hi[at].view(np.uint64), lo[at].view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out)], ["page_id", "url", "blocked"])

    return run


def _judge_shard(pages: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(len(pages), bool)
    known = pages["known"].to_numpy().astype(bool)
    if len(filters):
        hi, lo = (pages.loc[known, k].to_numpy().view(np.uint64) for k in ("hi", "lo"))
        out[known] = Cascade.load(filters["filter"].iloc[0]).has(hi, lo)
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "blocked": out})


def judge(
    pages: DataFrame, listed_urls: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, url, blocked) of every row of ``pages``: whether its URL's key is one of ``listed_urls``."""
    whole_ids(pages, page_id)
    spark = pages.sparkSession
    filters, shards = build(pages.select(col(url).alias("url")), listed_urls, shard_keys=shard_keys)
    filters = cut(filters)
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    key = normalised(col(url))
    source = pages.select(col(page_id).cast("bigint").alias("page_id"), col(url).alias("url"), *(F.when(key.isNotNull(), h).alias(n) for h, n in zip(_keyed(key), ("hi", "lo"))))
    schema = "page_id bigint, url string, blocked boolean"
    if size <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.select("shard", "filter").toLocalIterator()})
        return source.mapInArrow(_judge(blobs, shards), schema)
    # The filters are too large for every executor: rows meet the filter of their shard, a slice of each at a time.
    slices = 64
    # Keys and ids must hold no nulls here, or pandas would make doubles of them.
    source = source.withColumns({"known": F.col("hi").isNotNull(), "hi": F.coalesce("hi", F.lit(0)), "lo": F.coalesce("lo", F.lit(0)), "page_id": F.col("page_id").cast("string")})
    unknown = source.where("not known").select("page_id", "url", F.lit(False).alias("blocked"))
    source = source.where("known").withColumns({"shard": F.pmod("hi", F.lit(shards)).cast("int"), "slice": F.pmod(F.xxhash64("page_id"), F.lit(slices)).cast("int")})
    spread = filters.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    judged = source.groupBy("shard", "slice").cogroup(spread.groupBy("shard", "slice")).applyInPandas(_judge_shard, "page_id string, url string, blocked boolean")
    return judged.unionByName(unknown).withColumn("page_id", F.col("page_id").cast("bigint"))


def allowed(pages: DataFrame, listed_urls: DataFrame, **options) -> DataFrame:
    """(page_id, url) of the pages whose URL isn't listed."""
    return judge(pages, listed_urls, **options).where("not blocked").drop("blocked")
