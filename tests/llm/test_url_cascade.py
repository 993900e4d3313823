from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.llm import url_cascade as U

PAGES = "page_id bigint, url string, html string"


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 1 << 63, 30_000).astype(np.uint64) for _ in range(2))
    for share in (0.0, 0.001, 0.3, 0.9, 1.0):
        listed = rng.random(30_000) < share
        cascade = U.Cascade.build(hi, lo, listed)
        assert (U.Cascade.load(cascade.dump()).has(hi, lo) == listed).all()
        assert share in (0.0, 1.0) or len(cascade.levels) > 1


def test_normalised(spark):
    urls = ["HTTPS://www.Ex.org/A/?q#f", "ex.org/A/", "http://m.ex.org/A.html", "ex.org", "http://ex.org/", "", None, "://", "ex.org/a"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalised(F.col("u"))).collect()]
    assert got[:5] == ["ex.org/A"] * 3 + ["ex.org"] * 2 and got[5:7] == [None, None] and got[8] == "ex.org/a"


@pytest.mark.parametrize("options", [{}, {"shard_keys": 50}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 50}])
def test_judge_equals_a_set(spark, options):
    rng = random.Random(2)
    urls = [f"http://h{rng.randrange(40)}.org/{rng.randrange(20)}" for _ in range(600)] + [None, "", "http://h1.org/1", "http://h1.org/1"]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x") for i, u in enumerate(urls)], PAGES).repartition(3)
    listed_rows = [(u.replace("http://", "https://www."),) for u in urls[:80]] + [("http://elsewhere.org/",), (None,), ("",), (urls[0],)]
    listed = spark.createDataFrame(listed_rows, "url string")
    keys = {u.replace("http://", "") for u in urls[:80]}
    got = U.judge(pages.withColumn("hi", F.lit("x")).withColumn("shard", F.lit(1)), listed, **options)
    rows = sorted(repr((r["page_id"], r["url"], r["blocked"])) for r in got.collect())
    assert rows == sorted(repr((i if i % 50 else None, u, bool(u) and u.replace("http://", "") in keys)) for i, u in enumerate(urls))
    assert U.allowed(pages, listed, **options).count() == sum("False" in r for r in rows)


def test_empty(spark):
    none, some = spark.createDataFrame([], PAGES), spark.createDataFrame([(1, "http://a.org", "x")], PAGES)
    assert U.judge(none, some.select("url")).count() == 0
    assert [r["blocked"] for r in U.judge(some, none.select("url")).collect()] == [False]
