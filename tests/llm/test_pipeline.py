from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm._data import awkward, frame

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    """Every stage works on all its predecessor kept, and the result is that of ``run``."""
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    from tests.llm.test_line_dedup import brute
    from tests.llm.test_mixing import literal

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, SF), "test")
        seen[name] = (docs, out)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    rows = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, (a, b) in seen.items()}
    before, after = rows["quality classifier"]
    assert {*after} < {*before}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    kept = {r[0] for r in after}
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    before, after = rows["line dedup"]
    want = brute(before)
    assert {(r[0], r[1]) for r in after} == {(d, t) for (d, o), t in want.items() if t == o or t.strip()}
    assert all(r[4] == len(r[1]) for r in after)
    before, after = rows["SimHash near-dedup"]
    assert {*after} < {*before}
    before, after = rows["mixing"]
    assert {r[0]: sum(x[0] == r[0] for x in after) for r in after} == literal(before)
    before, after = rows["best-fit packing"]
    assert sum(r[6] for r in after) == sum(-(-len(r[1].encode()) // 4) for r in before)
    full = P.run(spark, SF)
    assert sorted(map(tuple, full.collect())) == sorted(after)


def test_awkward_rows(spark, tmp_path):
    import random

    sf = str(tmp_path)
    spark.createDataFrame([(900, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame(spark, awkward(random.Random(1)), extra=False).write.parquet(f"{sf}/documents.parquet")
    assert P.run(spark, sf).where(F.col("tokens") <= 0).count() == 0


def test_empty(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame(spark, []).write.parquet(f"{sf}/documents.parquet")
    assert P.run(spark, sf).count() == 0
